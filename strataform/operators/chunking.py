"""Chunks of documents: fixed windows, budgets, provenance and statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataform.config import Chunking
from strataform.functions.text import strip
from strataform.operators import ordinals


def windows(text: Column, rule: Chunking = Chunking()) -> Column:
    """The kept windows of a text as an array of (char_start, char_end, text).

    Windows start at 0, w, 2w ... of the stripped text and are stripped themselves; short ones are dropped before
    a document's budget counts. Offsets are those in the stripped text before a window is stripped.
    """
    w = rule.chars
    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{w}}}"), F.lit(0))  # one pass, however long the text
    cut = F.transform(pieces, lambda p, i: F.struct((i * w).alias("char_start"), (i * w + F.length(p)).alias("char_end"), strip(p).alias("text")))
    kept = F.filter(cut, lambda c: F.length(c["text"]) >= rule.least)
    return F.slice(kept, 1, rule.per_document) if rule.per_document else kept


def chunk(docs: DataFrame, rule: Chunking = Chunking(), order: str = "doc_id") -> DataFrame:
    """(label, <order>, chunk_in_document, char_start, char_end, text) of every kept window; a narrow plan."""
    body = docs.filter(F.col("text").isNotNull()).withColumn("text", strip("text")).filter("text <> ''")
    out = body.select("label", order, F.posexplode(windows(F.col("text"), rule)).alias("chunk_in_document", "c"))
    return out.select("label", order, "chunk_in_document", "c.char_start", "c.char_end", "c.text")


def budget(chunks: DataFrame, most: int, order: str = "doc_id") -> DataFrame:
    """Each corpus's first ``most`` chunks in order, numbered from 0; every task cuts its ranks before the shuffle."""
    rank = F.row_number().over(Window.partitionBy("label").orderBy(order, "chunk_in_document"))
    return chunks.withColumn("_rank", rank).filter(F.col("_rank") <= most).withColumn("chunk_index", F.col("_rank").cast("long") - 1).drop("_rank")


def numbered(chunks: DataFrame, bounds: list, order: str = "doc_id") -> DataFrame:
    """All chunks, numbered from 0 within their corpus in order. Ranges of ``order`` between the bounds are numbered side
    by side, so that a large corpus isn't sorted in one task; any bounds give the same numbers."""
    span = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= F.col(order))) if bounds else F.lit(0)
    rows = chunks.withColumn("_span", span)
    ahead = Window.partitionBy("label").orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    first = rows.groupBy("label", "_span").agg(F.count("*").alias("_n")).select(F.col("label").alias("_label"), F.col("_span").alias("_at"), F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_first"))
    rank = F.row_number().over(Window.partitionBy("label", "_span").orderBy(order, "chunk_in_document"))
    met = rows.withColumn("_rank", rank).join(first, F.col("label").eqNullSafe(F.col("_label")) & (F.col("_span") == F.col("_at")))
    return met.withColumn("chunk_index", F.col("_first") + F.col("_rank") - 1).drop("_span", "_label", "_at", "_first", "_rank")


def indexed(docs: DataFrame, rule: Chunking, row: tuple[str, ...], order: str = "doc_id") -> DataFrame:
    """All chunks, numbered from 0 within their corpus in order. ``row`` names columns that tell rows of ``docs`` apart.

    Documents' numbers of chunks are added up over their keys alone; texts are neither sorted nor put through a window. Rows that share
    an id follow one another in the order of ``row``.
    """
    body = docs.filter(F.col("text").isNotNull()).withColumn("text", strip("text")).filter("text <> ''").select("label", order, *row, windows(F.col("text"), rule).alias("w")).filter(F.size("w") > 0)
    first = ordinals.ahead(body.select("label", order, *row, F.size("w").cast("long").alias("n")), ["label"], [order, *row], "n").select(*row, "ahead")
    out = body.join(first, list(row)).select("label", order, "ahead", F.posexplode("w").alias("chunk_in_document", "c"))
    return out.select("label", order, "chunk_in_document", "c.char_start", "c.char_end", "c.text", (F.col("ahead") + F.col("chunk_in_document")).alias("chunk_index"))


def short_corpora(chunks: DataFrame, most: int) -> DataFrame:
    """(label, chunk_count) of corpora with fewer than ``most`` chunks."""
    return chunks.groupBy("label").agg(F.count("*").alias("chunk_count")).filter(F.col("chunk_count") < most)


def provenance(docs: DataFrame, rule: Chunking = Chunking(), row: tuple[str, ...] = ()) -> DataFrame:
    """Chunks with their document's ordinal, digests and places.

    ``row`` names columns that tell rows of ``docs`` apart, such as file and place: ordinals are then found from keys alone, and no
    text is sorted. Without them ordinals are given beside the texts. Either way each row has one, repeated ids or not
    (these follow one another in the order of ``row``, else of their texts' digests).
    """
    body = docs.filter(F.col("text").isNotNull()).withColumn("text", strip("text")).filter("text <> ''")
    if row:
        light = ordinals.ahead(body.select("label", "doc_id", *row), ["label"], ["doc_id", *row]).withColumnRenamed("ahead", "source_document_index")
        body = body.join(light.drop("label", "doc_id"), list(row))
    else:
        ties = Window.partitionBy("label").orderBy("doc_id", F.md5(F.col("text").cast("binary")))
        body = body.withColumn("source_document_index", (F.row_number().over(ties) - 1).cast("long"))
    facts = body.select("label", "doc_id", "source_document_index", F.sha2("text", 256).alias("source_text_sha256"), F.length("text").cast("long").alias("source_text_chars"), F.posexplode(windows(F.col("text"), rule)).alias("chunk_in_document", "c"))
    return facts.select("*", "c.char_start", "c.char_end", F.sha2("c.text", 256).alias("chunk_sha256")).drop("c")


def build_statistics(docs: DataFrame, rule: Chunking = Chunking()) -> DataFrame:
    """Per corpus: rows, documents with text, documents with a chunk, chunks."""
    text = strip("text")
    n = F.size(windows(F.col("stripped"), rule))
    rows = docs.withColumn("stripped", F.coalesce(text, F.lit(""))).withColumn("n", n)
    return rows.groupBy("label").agg(F.count("*").alias("source_rows_seen"), F.count_if(F.col("stripped") != "").alias("source_documents_extracted"), F.count_if(F.col("n") > 0).alias("source_documents_with_chunks"), F.sum("n").cast("long").alias("chunk_count"))


def length_summary(chunks: DataFrame, roles: DataFrame) -> DataFrame:
    """Smallest, mean, median and largest length per corpus and pooled by role (label null), in one grouping-sets pass."""
    rows = chunks.select("label", F.length("text").alias("chars")).join(roles.select("label", "role"), "label")
    out = rows.groupingSets([["role", "label"], ["role"]], "role", "label")
    return out.agg(F.count("*").alias("chunks"), F.min("chars").alias("min_chars"), F.avg("chars").alias("mean_chars"), F.percentile("chars", 0.5).alias("median_chars"), F.max("chars").alias("max_chars"))
