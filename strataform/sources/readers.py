"""Sources: JSON lines, text files, tables, manifests, vectors and binary files."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataform.config import CHUNK_CHARS


def numbered_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(source_ref, block, line_no, line): the physical lines of text files (gzip too) from 1, line ends \\n or \\r\\n.

    Files are read in splits; lines are numbered within their split, and splits (one row each) by the lines before them, so
    that neither a file nor its numbering is one task.
    """
    meta = "_metadata.file_path AS source_ref", "_metadata.file_block_start AS block"
    rows = spark.read.option("lineSep", "\n").text(paths).selectExpr(*meta, "regexp_replace(value, '\\r$', '') AS line").withColumn("_id", F.monotonically_increasing_id())
    return placed(rows, ["source_ref"], "line_no").withColumn("line_no", F.col("line_no") + 1).drop("_id")


def placed(rows: DataFrame, within: list[str], name: str) -> DataFrame:
    """``rows`` (source_ref, block, _id) numbered from 0 in the order of file, split and place, restarting with ``within``."""
    inside = F.row_number().over(Window.partitionBy("source_ref", "block").orderBy("_id")).cast("long") - 1
    before = F.sum("_n").over(Window.partitionBy(*within).orderBy("source_ref", "block").rowsBetween(Window.unboundedPreceding, -1))
    splits = rows.groupBy("source_ref", "block").agg(F.count("*").alias("_n")).select("source_ref", "block", F.coalesce(before, F.lit(0)).alias("_before"))
    return rows.withColumn(name, inside).join(splits, ["source_ref", "block"]).withColumn(name, F.col(name) + F.col("_before")).drop("_before")


def json_lines(spark: SparkSession, glob: str) -> DataFrame:
    """(source_ref, line_no, source_index, row): objects of JSON-lines files (gzip too); blank, malformed and other
    lines are skipped. ``line_no`` is the physical line from 1, ``source_index`` counts kept rows of all files in order.
    """
    rows = parsed(numbered_lines(spark, glob), "line").withColumn("_id", F.col("line_no"))
    return placed(rows, [], "source_index").select("source_ref", "line_no", "source_index", "row")


def json_document(spark: SparkSession, path: str) -> DataFrame:
    """One JSON document a file, over any number of lines; a malformed one is an error."""
    return spark.read.option("mode", "FAILFAST").json(path, multiLine=True)


def object_of(line: str) -> Column:
    """The one JSON object that a line holds, as a variant; null if it holds anything else or more."""
    alone = F.try_parse_json(F.concat(F.lit("["), F.col(line), F.lit("]")))  # so that what follows an object is an error
    row = F.try_variant_get(alone, "$[0]", "variant")
    one = row.isNotNull() & F.try_variant_get(alone, "$[1]", "variant").isNull() & F.startswith(F.schema_of_variant(row), F.lit("OBJECT"))
    return F.when(one, row)


def parsed(lines: DataFrame, column: str) -> DataFrame:
    """Lines that hold one JSON object and nothing else, as a variant ``row``."""
    return lines.withColumn("row", object_of(column)).filter(F.col("row").isNotNull())


def text_files(spark: SparkSession, glob: str) -> DataFrame:
    """One document a file."""
    return spark.read.text(glob, wholetext=True).select(F.col("_metadata.file_path").alias("source_ref"), F.col("value").alias("text"))


def table(spark: SparkSession, path: str, field: str = "text", shuffle_seed: int | None = None) -> DataFrame:
    """A landed copy of a dataset; a seed gives its rows in a reproducible random order, in place of a shuffle buffer."""
    rows = spark.read.parquet(path)
    return rows if shuffle_seed is None else rows.withColumn("shuffle_key", F.md5(F.concat_ws("|", F.lit(str(shuffle_seed)), field).cast("binary"))).orderBy("shuffle_key", field)


def component_of(url: Column | str) -> Column:
    """A shard's component: the part of its name before the first dash, without folders."""
    name = F.element_at(F.split(url, "/"), -1)
    return F.split_part(name, F.lit("-"), F.lit(1))


def csv_set(text: str | None) -> set[str]:
    return {x.strip() for x in (text or "").split(",") if x.strip()}


def shards(spark: SparkSession, urls: DataFrame, include: str | None = None, exclude: str | None = None, per_shard: int | None = None, seed: int | None = None) -> DataFrame:
    """Rows of a manifest's shards (url): by component, in seeded order, the first lines of each shard.

    Malformed lines are skipped but count toward the cap. Urls are any that Spark's file systems read.
    """
    from strataform.operators.extract import components

    picked = components(urls.withColumn("component", component_of("url")), csv_set(include), csv_set(exclude)).select("url").distinct()
    key = F.col("url") if seed is None else F.md5(F.concat_ws("|", F.lit(str(seed)), "url").cast("binary"))
    paths = [r.url for r in picked.orderBy(key, "url").collect()]  # a manifest's urls: what a reader must be told anyway
    if not paths:
        return spark.createDataFrame([], "source_ref string, source_shard_index int, source_shard_row_index long, row variant")
    order = spark.createDataFrame([(p.split("://")[-1].lstrip("/").removeprefix("localhost/"), i) for i, p in enumerate(paths)], "_tail string, source_shard_index int")
    lines = numbered_lines(spark, paths).withColumn("source_shard_row_index", F.col("line_no") - 1)
    capped = lines if per_shard is None else lines.filter(F.col("source_shard_row_index") < per_shard)
    tail = F.regexp_replace("source_ref", "^[A-Za-z0-9]+:/+", "")
    return parsed(capped.withColumn("_tail", tail), "line").join(F.broadcast(order), "_tail", "left").select("source_ref", "source_shard_index", "source_shard_row_index", "row")


def cached_paths(spark: SparkSession, folder: str, labels: list[str]) -> dict[str, tuple[str, str]]:
    """Each corpus's chunks and vectors in a cache folder, in a folder of its own or under its name; raises with all that are missing."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    there = lambda p: (q := jvm.org.apache.hadoop.fs.Path(p)).getFileSystem(conf).exists(q)
    out, missing = {}, []
    for label in labels:
        files = [nested if there(nested := f"{folder}/{label}/{kind}") else f"{folder}/{label}.{kind}" for kind in ("chunks.json", "embeddings.npy")]
        missing += [p for p in files if not there(p)]
        out[label] = tuple(files)
    if missing:
        raise FileNotFoundError("missing: " + ", ".join(missing))
    return out


def cached_chunks(spark: SparkSession, paths: dict[str, tuple[str, str]]) -> DataFrame:
    """(label, chunk_index, text) of the chunk lists that ``cached_paths`` found."""
    out = None
    for label, (chunks, _) in paths.items():
        rows = spark.read.text(chunks, wholetext=True).select(F.lit(label).alias("label"), F.posexplode(F.from_json("value", "array<string>")).alias("chunk_index", "text"))
        out = rows if out is None else out.unionByName(rows)
    return out.withColumn("chunk_index", F.col("chunk_index").cast("long"))


def source(spark: SparkSession, spec: dict, base: str = ".") -> DataFrame:
    """Rows of one corpus by its ``source_type``."""
    kind, path = spec.get("source_type", "table"), spec.get("path") or spec.get("dataset")
    where = path if path is None or "://" in path or path.startswith("/") else f"{base}/{path}"
    if kind in ("jsonl", "local_jsonl"):
        return json_lines(spark, where)
    if kind in ("text", "text_glob", "local_text"):
        return text_files(spark, where)
    if kind in ("table", "hf", "parquet"):
        return table(spark, where, spec.get("field") or "text", spec.get("shuffle_seed"))
    if kind == "dataset":
        from strataform.sources.dataset import BUFFER, dataset

        return dataset(spark, where, spec.get("columns"), spec.get("config"), spec.get("split"), spec.get("shuffle_seed"), spec.get("shuffle_buffer") or BUFFER)
    if kind == "capped_shards":
        from strataform.sources.remote import capped_shards

        return capped_shards(spark, spark.read.text(where).select(F.col("value").alias("url")), spec["rows_per_shard"], spec.get("include"), spec.get("exclude"), spec.get("seed")).filter("row IS NOT NULL")
    if kind in ("url_manifest", "shards"):
        return shards(spark, spark.read.text(where).select(F.col("value").alias("url")), spec.get("include"), spec.get("exclude"), spec.get("rows_per_shard"), spec.get("seed"))
    raise ValueError(f"unknown source_type {kind!r}")


def recipe(spark: SparkSession, path: str) -> DataFrame:
    """A panel's corpora with defaults filled in: a corpus's value, else the panel's, else the constant."""
    doc = json_document(spark, path)
    defaults = {f.name for f in doc.schema["defaults"].dataType.fields} if "defaults" in doc.columns else set()
    rows = doc.select(F.col("defaults") if defaults else F.lit(None).alias("defaults"), F.posexplode("corpora").alias("ord", "c"))
    own = {f.name for f in rows.schema["c"].dataType.fields}
    constants = {"chunk_chars": CHUNK_CHARS, "role": "broad", "mode": "plain_text", "field": "text"}
    pick = lambda k: F.coalesce(*([F.col(f"c.{k}")] if k in own else []), *([F.col(f"defaults.{k}")] if k in defaults else []), *([F.lit(constants[k])] if k in constants else []), F.lit(None)).alias(k)
    return rows.select("ord", *map(pick, sorted(own | defaults | set(constants))))


def manifest(spark: SparkSession, path: str, base: str, required: tuple[str, ...] = ("chunks", "embeddings")) -> DataFrame:
    """A manifest's corpora in order, paths resolved; raises with every path that is named but missing."""
    rows = json_document(spark, path).select(F.posexplode("corpora").alias("ord", "c")).select("ord", "c.*")
    for c in (c for c in required if c in rows.columns):
        rows = rows.withColumn(c, F.when(F.col(c).contains("://") | F.col(c).startswith("/"), F.col(c)).otherwise(F.concat(F.lit(base + "/"), c)))
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    named = [r[c] for r in rows.collect() for c in required if c in rows.columns and r[c]]
    missing = [p for p in named if not (q := jvm.org.apache.hadoop.fs.Path(p)).getFileSystem(conf).exists(q)]
    if missing:
        raise FileNotFoundError("missing: " + ", ".join(missing))
    return rows


def vectors(spark: SparkSession, glob: str, label: str) -> DataFrame:
    """(label, vec_id, embedding) of two-dimensional .npy files; read through Spark, parsed in tasks. Vectors are numbered from 0, or
    from the number in the name of a part (``vector_parts``)."""
    import io
    import re
    from collections.abc import Iterator

    import numpy as np
    import pandas as pd

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for path, content in zip(f["path"], f["content"]):
                x = np.load(io.BytesIO(content))
                part = re.search(r"/part-(\d{15})\.npy$", path)
                first = int(part[1]) if part else 0
                if x.ndim != 2:
                    raise ValueError(f"vectors must have two dimensions, not {x.ndim}")
                yield pd.DataFrame({"label": label, "vec_id": np.arange(first, first + len(x)), "embedding": list(x.astype(np.float32))})

    return spark.read.format("binaryFile").load(glob).select("path", "content").mapInPandas(run, "label string, vec_id long, embedding array<float>")


def checkpoint(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines that were appended; no folder gives no rows, a malformed line is an error."""
    q = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not q.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(q):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


#: Bytes of a file that are digested at once.
DIGESTED = 8 << 20


def digests(spark: SparkSession, folder: str) -> DataFrame:
    """(path, bytes, sha256) of every file below a folder.

    Local files are read block by block in tasks of a few files each, so that no file is held whole and one may be larger than 2 GB; a digest is
    one chain over its file, which therefore stays one task. Files elsewhere are read by Spark's scan of binary files (up to 2 GB each), which passes
    over files without bytes, so those are taken from its listing of names.
    """
    import hashlib
    from urllib.parse import unquote

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    listed = [(unquote(n).replace("file:///", "file:/", 1),) for n in files.inputFiles()]
    if listed and all(path.startswith("file:") for (path,) in listed):

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                out = []
                for path in f["path"]:
                    known, size = hashlib.sha256(), 0
                    with open(path[len("file:") :], "rb") as raw:
                        while block := raw.read(DIGESTED):
                            known.update(block)
                            size += len(block)
                    out.append((path, size, known.hexdigest()))
                yield pd.DataFrame(out, columns=["path", "bytes", "sha256"])

        tasks = min(len(listed), 8 * spark.sparkContext.defaultParallelism)
        return spark.createDataFrame(listed, "path string").repartition(tasks, "path").mapInPandas(run, "path string, bytes long, sha256 string")
    rows = files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    blank = spark.createDataFrame(listed, "path string").join(rows.select("path"), "path", "left_anti")
    return rows.unionByName(blank.select("path", F.lit(0).cast("long").alias("bytes"), F.sha2(F.lit("").cast("binary"), 256).alias("sha256")))
