"""Seeded samples. Draws depend on keys alone, so reruns and retried tasks agree."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataform.functions.text import draw, strip

#: Ranges of draws, a power of two.
SPANS = 256


def with_text(docs: DataFrame) -> DataFrame:
    """Documents whose text holds more than white space; all, if the frame has no text."""
    return docs.filter(F.coalesce(strip("text"), F.lit("")) != "") if "text" in docs.columns else docs


def prefix(docs: DataFrame, most: int, skip: int = 0, order: str = "doc_id") -> DataFrame:
    """Each corpus's first ``most`` documents without the first ``skip`` of them; a document after those is taken in any case.

    Ordinals count from the first document, skipped ones included. Blank documents (of a frame with ``text``) don't count.
    """
    docs, most = with_text(docs), max(most, skip + 1)
    rank = F.row_number().over(Window.partitionBy("label").orderBy(order))
    first = docs.withColumn("_rank", rank).filter(F.col("_rank") <= most)  # every task cuts its ranks before the shuffle
    return first.filter(F.col("_rank") > skip).withColumn("source_document_index", F.col("_rank").cast("long") - 1).drop("_rank")


def reservoir(docs: DataFrame, size: int, seed: int, order: str = "doc_id") -> DataFrame:
    """A uniform sample of ``size`` documents of each corpus: the smallest seeded digests, whose rank is the
    shuffled order in which they are consumed. Blank documents (of a frame with ``text``) aren't drawn."""
    docs = with_text(docs)
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), "label", F.col(order).cast("string")).cast("binary"))
    rank = F.row_number().over(Window.partitionBy("label").orderBy("_key", order))
    first = docs.withColumn("_key", key).withColumn("_rank", rank).filter(F.col("_rank") <= size)  # as in ``prefix``
    return first.withColumn("document_sample_rank", F.col("_rank").cast("long") - 1).drop("_key", "_rank")


def scanned(docs: DataFrame, most: int, skip: int = 0, order: str = "doc_id") -> DataFrame:
    """What a reservoir draws from: each corpus's first ``most`` documents (at least one) behind the first ``skip``, numbered
    from 0 behind those."""
    rank = F.row_number().over(Window.partitionBy("label").orderBy(order))
    first = with_text(docs).withColumn("_rank", rank).filter(F.col("_rank") <= skip + max(most, 1))
    return first.filter(F.col("_rank") > skip).withColumn("source_document_index", F.col("_rank").cast("long") - 1 - skip).drop("_rank")


#: Slots of a corpus that a row stands for before they are drawn.
SLOTS = 1024


def bootstrap_slots(sizes: DataFrame, replicates: DataFrame, seed: int) -> DataFrame:
    """(replicate, label, chunk_index): n draws with replacement from each corpus's n chunks (label, n), a row a draw. Stretches of slots are dealt to
    all cores before they are drawn, however few corpora there are."""
    spark = sizes.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    begin = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n").cast("long") - 1, F.lit(SLOTS).cast("long")))
    dealt = sizes.filter("n > 0").select("label", "n", begin.alias("_begin")).join(replicates).repartition(tasks, "label", "_begin", "replicate")
    slots = dealt.select("replicate", "label", "n", F.explode(F.sequence("_begin", F.least(F.col("n"), F.col("_begin") + SLOTS) - 1)).alias("i"))
    return slots.select("replicate", "label", (draw(F.lit(seed), F.col("replicate"), F.col("label"), F.col("i")) % F.col("n")).alias("chunk_index"))


def bootstrap_draws(sizes: DataFrame, replicates: DataFrame, seed: int) -> DataFrame:
    """(replicate, label, chunk_index, times): ``bootstrap_slots`` with how often each chunk was drawn."""
    return bootstrap_slots(sizes, replicates, seed).groupBy("replicate", "label", "chunk_index").agg(F.count("*").alias("times"))


def gather(chunks: DataFrame, draws: DataFrame) -> DataFrame:
    """The drawn chunks with how often each was drawn."""
    return chunks.join(draws, ["label", "chunk_index"])


def halves(chunks: DataFrame, repeats: DataFrame, seed: int) -> DataFrame:
    """Chunks split at random into halves A and B for every repeat; an odd one is left out.

    Draws are uniform below 2**32, so that equal ranges of them hold equal shares of a corpus. Counts by range tell where the halves end;
    only the two ranges in which they do are ranked, all other rows stay where they are.
    """
    value = draw(F.lit(seed), F.col("label"), F.col("repeat"), F.col("chunk_index"))
    rows = chunks.select("label", "chunk_index").join(repeats).withColumn("_draw", value).withColumn("_span", F.floor(F.col("_draw") / (2**32 // SPANS)))
    own = Window.partitionBy("repeat", "label")
    before = F.coalesce(F.sum("_k").over(own.orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = rows.groupBy("repeat", "label", "_span").agg(F.count("*").alias("_k")).withColumn("_below", before).withColumn("_h", F.floor(F.sum("_k").over(own) / 2))
    ends = lambda at: F.max(F.when((F.col("_below") < at) & (at <= F.col("_below") + F.col("_k")), F.struct("_span", "_below")))
    cuts = sums.groupBy(F.col("repeat").alias("_repeat"), F.col("label").alias("_label")).agg(F.max("_h").alias("_h"), ends(F.col("_h")).alias("_a"), ends(2 * F.col("_h")).alias("_b"))
    met = rows.join(cuts, F.col("repeat").eqNullSafe(F.col("_repeat")) & F.col("label").eqNullSafe(F.col("_label"))).filter("_h > 0 AND _span <= _b._span")
    inside = F.col("_span").isin(F.col("_a._span"), F.col("_b._span"))
    plain = met.filter(~inside).withColumn("half", F.when(F.col("_span") < F.col("_a._span"), "A").otherwise("B"))
    rank = F.row_number().over(Window.partitionBy("repeat", "label", "_span").orderBy("_draw", "chunk_index"))
    place = F.when(F.col("_span") == F.col("_a._span"), F.col("_a._below")).otherwise(F.col("_b._below")) + rank
    ranked = met.filter(inside).withColumn("_place", place).withColumn("half", F.when(F.col("_place") <= F.col("_h"), "A").when(F.col("_place") <= 2 * F.col("_h"), "B"))
    columns = ["repeat", "label", "chunk_index", "half"]
    return plain.select(columns).unionByName(ranked.filter("half IS NOT NULL").select(columns))


def half_columns(chunks: DataFrame, repeats: int, seed: int) -> DataFrame:
    """(label, chunk_index, cols): ``halves`` of the repeats 0 to ``repeats`` - 1 as one list a chunk, 2 * repeat for A and 2 * repeat + 1 for B.

    Counts by ranges of draws and the draws of the ranges in which halves end give the last draw of either half; a row a corpus
    and repeat is broadcast, and each chunk finds its halves by itself. No row a chunk and repeat is shuffled but of those ranges.
    """
    value = lambda label, repeat, index: draw(F.lit(seed), label, repeat, index)
    keys = chunks.select("label", "chunk_index").filter("label IS NOT NULL")
    rows = keys.join(F.broadcast(chunks.sparkSession.range(repeats).withColumnRenamed("id", "repeat"))).withColumn("_draw", value(F.col("label"), F.col("repeat"), F.col("chunk_index"))).withColumn("_span", F.floor(F.col("_draw") / (2**32 // SPANS)))
    own = Window.partitionBy("repeat", "label")
    before = F.coalesce(F.sum("_k").over(own.orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = rows.groupBy("repeat", "label", "_span").agg(F.count("*").alias("_k")).withColumn("_below", before).withColumn("_h", F.floor(F.sum("_k").over(own) / 2))
    ends = sums.withColumn("_end", F.explode(F.array("_h", 2 * F.col("_h")))).filter("_below < _end AND _end <= _below + _k")
    asked = ends.groupBy("repeat", "label", "_span").agg(F.first("_below").alias("_below"), F.collect_set("_end").alias("_ends"), F.first("_h").alias("_h"))
    place = F.col("_below") + F.row_number().over(Window.partitionBy("repeat", "label", "_span").orderBy("_draw", "chunk_index"))
    last = rows.join(F.broadcast(asked), ["repeat", "label", "_span"]).withColumn("_place", place).filter(F.array_contains("_ends", F.col("_place")))
    at = lambda end: F.max(F.when(F.col("_place") == end, F.struct(F.col("_draw").alias("draw"), F.col("chunk_index").alias("index"))))
    cuts = last.groupBy("label", "repeat").agg(at(F.col("_h")).alias("a"), at(2 * F.col("_h")).alias("b")).groupBy("label").agg(F.collect_list(F.struct("repeat", "a", "b")).alias("_cuts"))
    drawn = F.transform("_cuts", lambda c: F.struct(c.alias("c"), value(F.col("label"), c["repeat"], F.col("chunk_index")).alias("d")))
    upto = lambda x, half: (x["d"] < x["c"][half]["draw"]) | ((x["d"] == x["c"][half]["draw"]) & (F.col("chunk_index") <= x["c"][half]["index"]))
    col = lambda x: (2 * x["c"]["repeat"]).cast("int")
    cols = F.array_compact(F.transform("_drawn", lambda x: F.when(upto(x, "a"), col(x)).when(upto(x, "b"), col(x) + 1)))
    return keys.join(F.broadcast(cuts), "label").withColumn("_drawn", drawn).select("label", "chunk_index", cols.alias("cols")).filter(F.size("cols") > 0)


def mixture(chunks: DataFrame, pairs: DataFrame, alphas: DataFrame) -> DataFrame:
    """(base, target, alpha, label, chunk_index): the base's first chunks and the target's, by the share alpha.

    The count of target chunks is rounded half to even and taken from the base's length.
    """
    n = chunks.groupBy("label").agg(F.count("*").alias("n"))
    plan = pairs.join(n, pairs.base == n.label).drop("label").join(alphas).withColumn("n_target", F.greatest(F.lit(0), F.least(F.col("n"), F.bround(F.col("n") * F.col("alpha")).cast("long"))))
    spots = chunks.select("label", "chunk_index")
    base = plan.join(spots, (plan.base == spots.label) & (F.col("chunk_index") < F.col("n") - F.col("n_target")))
    target = plan.join(spots, (plan.target == spots.label) & (F.col("chunk_index") < F.col("n_target")))
    return base.unionByName(target).select("base", "target", "alpha", "label", "chunk_index")
