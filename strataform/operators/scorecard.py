"""Score entries: validation, verification of expected values, integrity of files, packages."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataform.config import TOLERANCE

# What a canonical entry states.
ENTRY_SCHEMA, SUITE = "strataform.entry.v1", "v1"
STATUSES = ("submitted", "artifact_validated", "agent_reviewed", "reproduced")
INTERPRETATION = "diagnostic_position_not_quality_ranking"
SETTINGS = {"chunks_per_corpus": "2048", "max_chunk_chars": "768", "embedding_model": "Alibaba-NLP/gte-base-en-v1.5", "embedding_dimension": "768"}


def problems(entry: Column, public: bool) -> Column:
    """All that is wrong with an entry (JSON text), as an array of messages."""
    at = lambda path: F.get_json_object(entry, f"$.{path}")
    blank = lambda path: F.coalesce(at(path), F.lit("")) == ""
    differs = lambda path, value: ~at(path).eqNullSafe(F.lit(value))
    is_object = lambda path: F.coalesce(at(path).startswith("{"), F.lit(False))
    inside = lambda path, bad: is_object(path) & bad
    sha = F.coalesce(at("artifact.sha256"), F.lit(""))
    # What is said of an entry, field by field; users of other validators of such entries look for these words.
    rules = [
        (differs("schema", ENTRY_SCHEMA), "schema"),
        (differs("metric_suite_version", SUITE), "metric_suite_version"),
        (blank("label"), "label is required"),
        (blank("display"), "display is required"),
        (~F.coalesce(at("status").isin(*STATUSES), F.lit(False)), "status"),
        (differs("interpretation", INTERPRETATION), "interpretation"),
        (~is_object("source"), "source object is required"),
        (inside("source", blank("source.source")), "source.source is required"),
        (~is_object("canonical_settings"), "canonical_settings object is required"),
        *((inside("canonical_settings", differs(f"canonical_settings.{k}", v)), f"canonical_settings.{k}") for k, v in SETTINGS.items()),
        (~is_object("standalone_summary"), "standalone_summary object is required"),
        (inside("standalone_summary", differs("standalone_summary.n_chunks", "2048")), "standalone_summary.n_chunks"),
        (inside("standalone_summary", at("standalone_summary.compression_ratio_lzma").isNull()), "compression_ratio_lzma is required"),
        (inside("standalone_summary", ~is_object("standalone_summary.semantic_spectrum")), "semantic_spectrum object is required"),
        *((inside("standalone_summary.semantic_spectrum", at(f"standalone_summary.semantic_spectrum.{k}").isNull()), f"{k} is required") for k in ("top1_share", "top5_share")),
        (~is_object("artifact"), "artifact object is required"),
        (inside("artifact", F.lit(public) & blank("artifact.url")), "artifact.url is required"),
        (inside("artifact", F.lit(public) & (sha == "")), "artifact.sha256 is required"),
        (inside("artifact", (sha != "") & ~sha.rlike("^[0-9a-f]{64}$")), "artifact.sha256 digest"),
    ]
    return F.array_compact(F.array(*(F.when(bad, F.lit(text)) for bad, text in rules)))


def validate_entries(entries: DataFrame, public: bool = True) -> DataFrame:
    """(path, problem) of every problem of every entry (path, entry)."""
    return entries.select("path", F.explode(problems(F.col("entry"), public)).alias("problem"))


def validate_registry(registry: DataFrame, entries: DataFrame) -> DataFrame:
    """(label, problem) of a registry's lines (label, status, path) against the entries that exist (path, entry)."""
    met = registry.join(entries.select(F.col("path").alias("p"), F.get_json_object("entry", "$.label").alias("named")), F.col("path") == F.col("p"), "left")
    bad = F.array_compact(
        F.array(
            F.when(F.coalesce(F.col("label"), F.lit("")) == "", F.lit("label is required")),
            F.when(~F.coalesce(F.col("status").isin(*STATUSES), F.lit(False)), F.lit("status")),
            F.when(F.col("path").isNull(), F.lit("path is required")),
            F.when(F.col("path").isNotNull() & F.col("p").isNull(), F.lit("entry file is missing")),
            F.when(F.col("p").isNotNull() & ~F.col("named").eqNullSafe(F.col("label")), F.lit("entry label differs")),
        )
    )
    twice = registry.groupBy("label").agg(F.count("*").alias("k")).filter("k > 1 AND label IS NOT NULL").select("label", F.lit("duplicate label").alias("problem"))
    return met.select("label", F.explode(bad).alias("problem")).unionByName(twice)


def verify_values(documents: DataFrame, expected: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """(doc, path, expected, actual, ok): numbers at dotted paths of JSON documents (doc, body) against expectations
    (doc, path, expected, whole); whole numbers must be equal, others near."""
    actual = F.expr("try_variant_get(try_parse_json(body), concat('$.', path), 'double')")
    met = expected.join(documents, "doc", "left").withColumn("actual", actual)
    near = F.when(F.col("whole"), F.col("actual") == F.col("expected")).otherwise(F.abs(F.col("actual") - F.col("expected")) <= tolerance)
    return met.select("doc", "path", "expected", "actual", F.coalesce(near, F.lit(False)).alias("ok"))


def missing_labels(wanted: DataFrame, known: DataFrame) -> DataFrame:
    return wanted.select("label").join(known.select("label"), "label", "left_anti")


def _named_digests(spark: SparkSession, folder: str) -> DataFrame:
    """(bytes, name, sha256) of every file by its path below ``folder``."""
    from strataform.sources.readers import digests

    name = F.element_at(F.split("path", "\\Q" + folder.rstrip("/").split("://")[-1] + "\\E/+", 2), -1)
    return digests(spark, folder).select("bytes", name.alias("name"), "sha256")


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """(files, bytes, sha256): totals and the digest of the lines "path digest" of all files below ``folder``, in the order of paths.

    Files are digested by all tasks. The lines, a hundred bytes a file, are one chain and so pass through one task, in order and one after another;
    ``integrity`` has a digest that needs no such chain.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, files, size = hashlib.sha256(), 0, 0
        for f in frames:
            for name, sha, n in zip(f["name"], f["sha256"], f["bytes"], strict=True):
                known.update(f"{chr(10) if files else ''}{name} {sha}".encode())
                files, size = files + 1, size + int(n)
        yield pd.DataFrame([(files, size, known.hexdigest())], columns=["files", "bytes", "sha256"])

    return _named_digests(spark, folder).repartition(1).sortWithinPartitions("name").mapInPandas(run, "files long, bytes long, sha256 string")


def integrity(spark: SparkSession, folder: str) -> DataFrame:
    """(files, bytes, sha256): totals and one digest over all files below ``folder``.

    Lines of a path below the folder and its digest are dealt to 4,096 buckets by the path's digest; the result is the digest of the
    buckets' digests in order, each that of its sorted lines. No row holds the lines of all files.
    """
    rows = _named_digests(spark, folder).withColumn("bucket", F.substring(F.sha2("name", 256), 1, 3))
    joined = F.array_join(F.array_sort(F.collect_list(F.concat_ws(" ", "name", "sha256"))), "\n")
    buckets = rows.groupBy("bucket").agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"), F.sha2(joined, 256).alias("digest"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("bucket", "digest"))), lambda x: F.concat_ws(" ", x["bucket"], x["digest"]))
    return buckets.agg(F.sum("files").alias("files"), F.sum("bytes").alias("bytes"), F.sha2(F.array_join(lines, "\n"), 256).alias("sha256"))


def package_entry(label: str, display: str, source: dict, standalone: dict, pairs: list[dict], status: str = "submitted", artifact: dict | None = None) -> dict:
    """An entry as ``validate_entries`` expects it; the status is what a new entry has, whatever tier is asked for."""
    return {
        "schema": ENTRY_SCHEMA, "metric_suite_version": SUITE, "label": label, "display": display, "status": "submitted", "requested_tier": status, "interpretation": INTERPRETATION,
        "source": source, "canonical_settings": {k: int(v) if v.isdigit() else v for k, v in SETTINGS.items()}, "standalone_summary": standalone, "pairs": pairs, "artifact": artifact or {},
    }
