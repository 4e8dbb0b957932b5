"""Compression ratios of corpora."""

from __future__ import annotations

import gzip
import lzma
import zlib
from collections.abc import Callable

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataform.config import MAX_CHUNKS

CODECS: dict[str, Callable[[bytes], bytes]] = {
    "lzma": lambda raw: lzma.compress(raw, preset=6),
    "gzip": lambda raw: gzip.compress(raw, 9, mtime=0),
    "zlib": lambda raw: zlib.compress(raw, 9),
}


def ratio(text: str, codec: str) -> float:
    raw = text.encode("utf-8", errors="ignore")
    return len(CODECS[codec](raw)) / len(raw) if raw else 0.0


def _ratio_of(codec: str):
    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: ratio(t or "", codec))

    return run


def ratios(chunks: DataFrame, codecs: tuple[str, ...] = ("lzma",), by: tuple[str, ...] = (), times: str | None = None) -> DataFrame:
    """(<by>, label, <codec>_ratio): of each corpus's chunks joined by blank lines, in the order of ``chunk_index``.
    ``times`` names a column that says how often a chunk stands there, one after another.

    A codec sees a corpus as one stream, so chunks must be budgeted (``budget``): a corpus then is a few MB.
    """
    body = F.array_join(F.array_repeat("text", F.col(times).cast("int")), "\n\n") if times else F.col("text")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", body.alias("text")))), lambda c: c["text"]), "\n\n")
    out = chunks.groupBy(*by, "label").agg(text.alias("joined"))
    for codec in codecs:
        out = out.withColumn(f"{codec}_ratio", _ratio_of(codec)("joined"))
    return out.drop("joined")


def stream_sizes(rows: DataFrame, by: list[str], order: list[str], codecs: tuple[str, ...], times: str | None = None) -> DataFrame:
    """(<by>, raw, <codecs>): bytes of each stream, a group of ``rows`` (<by>, <order>, text, opening) joined by blank lines, and packed by each codec.
    One that isn't ``opening`` its corpus begins with the blank line before it. Null texts count as empty. A task holds one stream at a time."""

    def run(group: pa.Table) -> pa.Table:
        rows = group.sort_by([(c, "ascending") for c in order])
        texts = [t or "" for t in rows["text"].to_pylist()]
        if times:
            texts = [t for t, k in zip(texts, rows[times].to_pylist(), strict=True) for _ in range(k)]
        raw = "\n\n".join(texts if rows["opening"][0].as_py() else ["", *texts]).encode("utf-8", errors="ignore")
        sizes = [len(CODECS[c](raw)) if raw else 0 for c in codecs]
        return pa.table([*(rows[c].slice(0, 1) for c in by), pa.array([len(raw)]), *(pa.array([n]) for n in sizes)], names=[*by, "raw", *codecs])

    kinds, parts = dict(rows.dtypes), 8 * rows.sparkSession.sparkContext.defaultParallelism
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in by), "raw long", *(f"{c} long" for c in codecs)])
    return rows.repartition(parts, *by).groupBy(*by).applyInArrow(run, schema)


def shares(sizes: DataFrame, by: list[str], codecs: tuple[str, ...] = ("lzma",)) -> DataFrame:
    """(<by>, <codec>_ratio) of the sums of ``stream_sizes``; without bytes it is 0."""
    return sizes.groupBy(*by).agg(*(F.when(F.sum("raw") > 0, F.sum(c) / F.sum("raw")).otherwise(0.0).alias(f"{c}_ratio") for c in codecs))


def whole_ratios(chunks: DataFrame, codecs: tuple[str, ...] = ("lzma",), block: int = MAX_CHUNKS) -> DataFrame:
    """(label, <codec>_ratio) of all chunks of each corpus, whatever its length: runs of ``block`` chunks are a stream each, as block-wise
    archivers cut their input, and the ratio is that of the sums of bytes.

    A corpus of at most ``block`` chunks is one stream, for which ``ratios`` gives the same. A task holds one run, and the runs of a hot corpus are as many
    tasks as they need. Chunks are numbered from 0 within their corpus; null texts count as empty, a corpus without bytes has ratio 0.
    """
    number = F.floor(F.col("chunk_index") / block)
    placed = chunks.select(F.col("label").cast("string").alias("label"), "chunk_index", "text", number.alias("block"), (number == 0).alias("opening"))
    return shares(stream_sizes(placed, ["label", "block"], ["chunk_index"], codecs), ["label"], codecs)


def composed_ratios(chunks: DataFrame, members: DataFrame, block: int = MAX_CHUNKS) -> DataFrame:
    """(label, lzma_ratio) of composed corpora as of ``whole_ratios``: ``members`` (label, of, chunk_index, times) say of which corpus which
    chunk is in ``label`` and how often, one after another. Places are sums by ranges of numbers, then sums within a range."""
    rows = members.filter("times > 0").withColumn("_range", F.floor(F.col("chunk_index") / block))
    before = lambda w: F.coalesce(F.sum("times").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    key = ["label", "of", "_range"]
    below = rows.groupBy(*key).agg(F.sum("times").alias("times")).select(*key, before(Window.partitionBy("label").orderBy("of", "_range")).alias("_below"))
    at = rows.withColumn("_inside", before(Window.partitionBy(*key).orderBy("chunk_index"))).join(below, key).withColumn("_at", F.col("_below") + F.col("_inside"))
    cut = at.withColumn("block", F.explode(F.sequence(F.floor(F.col("_at") / block), F.floor((F.col("_at") + F.col("times") - 1) / block))))
    inside = F.least(F.col("_at") + F.col("times"), (F.col("block") + 1) * block) - F.greatest("_at", F.col("block") * block)
    cut = cut.select("label", "of", "chunk_index", "block", (F.col("block") == 0).alias("opening"), inside.alias("times"))
    met = cut.join(chunks.select(F.col("label").alias("of"), "chunk_index", "text"), ["of", "chunk_index"])
    return shares(stream_sizes(met, ["label", "block"], ["of", "chunk_index"], ("lzma",), "times"), ["label"])


def mixture_ratios(chunks: DataFrame, mixtures: DataFrame, by: list[str], block: int = MAX_CHUNKS) -> DataFrame:
    """(<by>, lzma_ratio) of mixtures (<by>, first, n_first, second, n_second), the first chunks of one corpus and then those of another, as of
    ``whole_ratios``. A stream that many mixtures share, such as a run of one corpus's chunks, is packed once, and its texts travel once."""
    at, n, m = F.col("_block") * block, F.col("n_first"), F.col("n_second")
    inside = lambda x, most: F.greatest(F.lit(0), F.least(x, most))
    slices = [("first", inside(at, n), inside(at + block, n)), ("second", inside(at - n, m), inside(at + block - n, m))]
    parts = [F.when(e > s, F.struct(F.col(of).alias("of"), s.alias("begin"), e.alias("end"))) for of, s, e in slices]
    numbered = mixtures.filter(n + m > 0).withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((n + m - 1) / block))))
    streams = numbered.select(*by, (F.col("_block") == 0).alias("opening"), F.array_compact(F.array(*parts)).alias("parts"))
    streams = streams.withColumn("stream", F.to_json(F.struct("opening", "parts")))
    asked = streams.select("stream", "opening", "parts").dropDuplicates(["stream"]).select("stream", "opening", F.posexplode("parts").alias("part", "p")).select("stream", "opening", "part", "p.*")
    asked = asked.withColumn("_range", F.explode(F.sequence(F.floor(F.col("begin") / block), F.floor((F.col("end") - 1) / block))))
    own = chunks.select(F.col("label").alias("of"), "chunk_index", "text", F.floor(F.col("chunk_index") / block).alias("_range"))
    met = own.join(asked, ["of", "_range"]).filter("begin <= chunk_index AND chunk_index < end").select("stream", "opening", "part", "chunk_index", "text")
    return shares(streams.select(*by, "stream").join(stream_sizes(met, ["stream"], ["part", "chunk_index"], ("lzma",)), "stream"), by)


def gaps(values: DataFrame, pairs: DataFrame, columns: list[str], signed: bool = False) -> DataFrame:
    """Pairs with the (absolute) difference of each corpus-level column."""
    side = lambda s: values.select(F.col("label").alias(s), *(F.col(c).alias(f"_{s}_{c}") for c in columns))
    met = pairs.join(side("a"), "a").join(side("b"), "b")
    diff = lambda c: F.col(f"_a_{c}") - F.col(f"_b_{c}")
    return met.select(*pairs.columns, *((diff(c) if signed else F.abs(diff(c))).alias(f"{c}_{'gap' if signed else 'abs_diff'}") for c in columns))
