"""Mixing sources to target weights by capped water-filling (operator 7, DataFrame functions only).

Sources share a total by weight; one that would pass its maximum (so many epochs of its size) is clamped
there, and what it leaves goes to the others by weight, round by round until none is above. Each document is
then taken a whole number of times, and the rest of a source's target comes from its documents in a seeded
order, the last one in part, so that a source's words meet its target to the word.

The seeded order is cut into slices of the hash's range, so that a source of any share of all rows is summed
in many tasks: sums by slice first (few rows), then within slices.

Defined results: a null text has size 0; a null source is a source, after all others. Sources of size 0 have
target 0. Rows equal in id and text may swap places. Equal ids with other texts are ordered by text. An empty
table gives an empty table; columns of the result's names are replaced. Very long texts count whole, and the last one taken of a
source may be taken in part.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataform.llm.store import materialize, tasks

WORDS = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Mix:
    """``weights`` repeat over the sources in order; ``total``: words of the mix over words there are;
    ``epochs``: the most a source is repeated; ``seed``: of the order in which parts of epochs are taken."""

    weights: tuple[int, ...] = (3, 1, 2)
    total: float = 1.5
    epochs: int = 2
    seed: int = 7


COLUMNS = ["size", "source_size", "target", "taken"]


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def _digest() -> Column:
    return F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))


def targets(sizes: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """(source, source_size, target) from (source, source_size), by rounds of clamping.

    Each round sums clamped sizes and open weights (two numbers) and clamps what lies above; a round that
    clamps nothing ends it. The table of sources stays distributed.
    """
    spark = sizes.sparkSession
    # Places in the order of sources: by range, so that no task holds them all.
    ranged = materialize(sizes.repartitionByRange(tasks(spark), F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()), "sources")
    before, at = {}, 0
    for r in sorted(ranged.groupBy("part").count().collect()):
        before[r.part], at = at, at + r["count"]
    if not at:
        return sizes.withColumn("target", F.lit(0.0))
    offset = F.element_at(F.create_map(*(F.lit(x) for kv in before.items() for x in kv)), F.col("part"))
    place = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())) - 1 + offset
    weight = F.element_at(F.array(*(F.lit(w) for w in mix.weights)), (place % len(mix.weights) + 1).cast("int"))
    # A source's level: the share of a weight of 1 at which it is full.
    open_ = ranged.select("source", "source_size", weight.alias("weight")).withColumn("full", (F.col("source_size") * mix.epochs).cast("double")).withColumn("level", F.col("full") / F.col("weight"))
    everything = open_.agg(F.sum("source_size")).first()[0]
    level = 0.0
    while True:
        clamped = F.col("level") <= level
        r = open_.agg(F.sum(F.when(clamped, F.col("full")).otherwise(0.0)).alias("full"), F.sum(F.when(clamped, 0).otherwise(F.col("weight"))).alias("weight"), F.max("level").alias("top")).first()
        if not r.weight:
            level = r.top
            break
        now = (mix.total * everything - r.full) / r.weight
        if now <= level:
            break
        above = open_.filter((F.col("level") > level) & (F.col("level") <= now)).limit(1).count()
        level = now
        if not above:
            break
    return open_.select("source", "source_size", F.least(F.col("full"), F.col("weight") * F.lit(float(level))).alias("target"))


def mix_documents(docs: DataFrame, mix: Mix = Mix(), rows_per_slice: int = 20_000, wide: bool = True) -> DataFrame:
    """``docs`` with size, source_size, target and taken; without ``wide``, of the columns of ``docs`` only doc_id and source."""
    src = docs.select([c for c in docs.columns if c not in {*COLUMNS, "_text", "_twin"}])
    sized = src.withColumn("size", word_count(F.col("text")))
    light = materialize(docs.select("doc_id", "source", _digest().alias("_text"), word_count(F.col("text")).alias("size")), "sizes")
    by_source = light.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    found = materialize(by_source, "by-source")
    shared = targets(found.select("source", "source_size"), mix)
    most = found.agg(F.max("n")).first()[0] or 1
    bits = max(8, (most // rows_per_slice).bit_length())
    # Order within a source: a seeded hash, whose range is cut into slices.
    key = F.concat_ws("|", F.lit(str(mix.seed)), F.col("doc_id").cast("string"), "_text").cast("binary")
    spot = F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long")  # 60 bits, in every engine the same
    placed = light.withColumn("_spot", spot).withColumn("_slice", F.shiftrightunsigned("_spot", 60 - bits))
    sums = placed.groupBy("source", "_slice").agg(F.sum("size").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("source").orderBy("_slice").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    sums = sums.select("source", "_slice", upto.alias("_before"))
    share = shared.select("source", "source_size", "target").withColumn("_whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
    share = share.withColumn("_rest", F.round(F.col("target") - F.col("_whole") * F.col("source_size")).cast("long"))
    slice_ = sums.join(share, sums.source.eqNullSafe(share.source)).select(sums.source.alias("s"), F.col("_slice").alias("k"), "_before", "source_size", "target", "_whole", "_rest")
    within = Window.partitionBy("source", "_slice").orderBy("_spot", "doc_id", "_text")
    run = placed.withColumn("_within", F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    met = run.join(slice_, F.col("source").eqNullSafe(F.col("s")) & (F.col("_slice") == F.col("k"))).drop("s", "k")
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("_rest") - F.col("_before") - F.col("_within")))
    taken = met.withColumn("taken", (F.col("_whole") * F.col("size") + part).cast("long"))
    if not wide:
        return taken.select("doc_id", "source", *COLUMNS)
    # Other columns come back by id, text and number among equal rows.
    twin = F.row_number().over(Window.partitionBy("doc_id", "_text", "source").orderBy("size"))
    key = {"_mix_id": "doc_id", "_mix_text": "_text", "_mix_source": "source"}
    few = taken.withColumn("_mix_twin", twin).select(*(F.col(c).alias(k) for k, c in key.items()), "_mix_twin", *COLUMNS[1:])
    full = sized.withColumn("_text", _digest()).withColumn("_twin", twin)
    met = full.join(few, F.col("doc_id").eqNullSafe(F.col("_mix_id")) & (F.col("_text") == F.col("_mix_text")) & F.col("source").eqNullSafe(F.col("_mix_source")) & (F.col("_twin") == F.col("_mix_twin")))
    return met.select(*src.columns, *COLUMNS)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return mix_documents(docs, wide=False).select("doc_id", *COLUMNS)


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, source, md5(coalesce(text, '')) AS t, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS n, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS i FROM d GROUP BY source),
w AS (SELECT *, CASE i % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS w, 2.0 * n AS cap FROM s),
l AS (SELECT *, cap / w AS level FROM w),
k AS (SELECT 0.0 AS lo, (SELECT 1.5 * sum(n) / sum(w) FROM w) AS lam, (SELECT min(level) FROM l) AS hi
      UNION ALL
      SELECT level, (1.5 * sum(n) OVER () - sum(cap) OVER o) / nullif(sum(w) OVER () - sum(w) OVER o, 0), lead(level) OVER (ORDER BY level, i)
      FROM l WINDOW o AS (ORDER BY level, i)),
lam AS (SELECT min(lam) AS lam FROM k WHERE lam <= hi AND lam >= lo),
g AS (SELECT source, n, least(cap, w * lam) AS target FROM l, lam),
r AS (SELECT *, CASE WHEN n > 0 THEN floor(target / n) ELSE 0 END AS whole FROM g),
q AS (SELECT *, CAST(round(target - whole * n) AS BIGINT) AS rest FROM r),
o AS (SELECT d.*, sum(size) OVER (PARTITION BY source ORDER BY CAST('0x' || substr(md5('7|' || doc_id || '|' || t), 1, 15) AS BIGINT), doc_id, t ROWS UNBOUNDED PRECEDING) - size AS before FROM d)
SELECT doc_id, size, n AS source_size, target, CAST(whole * size + greatest(0, least(size, rest - before)) AS BIGINT) AS taken
FROM o JOIN q ON o.source IS NOT DISTINCT FROM q.source
"""
