"""Token and n-gram counts, vocabularies, Jensen-Shannon divergence and rank agreement."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataform.config import JS_EPSILON, ORDERS, TOKENIZERS, VOCABULARIES, Chunking, least_vocabulary
from strataform.functions.text import ngrams, tokens
from strataform.operators.chunking import chunk
from strataform.plans.held import held

CELL = ["tokenizer", "n"]


def gram_counts(chunks: DataFrame, tokenizers: tuple[str, ...] = TOKENIZERS, orders: tuple[int, ...] = ORDERS, place: tuple[str, ...] = ("doc_id", "chunk_in_document"), by: tuple[str, ...] = ("label",), times: str | None = None) -> DataFrame:
    """(<by>, tokenizer, n, gram, cnt, first): counts of n-grams within chunks, and where each was met first.

    Every text is tokenised once a tokenizer; grams of all tokenizers and orders leave one generator and meet in one
    shuffle, after partial sums by hash. ``first`` orders as (<place>, position) does: one number, so that no sort is needed.
    ``times`` names a column of multiplicities.
    """
    weight = [F.col(times).alias("_times")] if times else []
    split = chunks.select(*by, *weight, _place(place).alias("_at"), *(tokens("text", t).alias(f"_{t}") for t in tokenizers))
    settings = [(t, n) for t in tokenizers for n in orders]
    named = lambda k: lambda g, i: F.struct(F.lit(k).alias("k"), i.alias("pos"), g.alias("gram"))
    found = [F.transform(ngrams(f"_{t}", n), named(k)) for k, (t, n) in enumerate(settings)]
    flat = split.select(*by, *(["_times"] if times else []), "_at", F.explode(F.flatten(F.array(*found)) if len(found) > 1 else found[0]).alias("g"))
    rows = flat.select(*by, *(["_times"] if times else []), F.col("g.k").alias("_k"), F.col("g.gram").alias("gram"), (F.col("_at") + F.col("g.pos")).alias("_first"))
    out = rows.groupBy(*by, "_k", "gram").agg((F.sum("_times") if times else F.count("*")).alias("cnt"), F.min("_first").alias("first"))
    of = lambda values: F.element_at(F.array(*(F.lit(v) for v in values)), F.col("_k") + 1)
    return out.select(*by, of([t for t, _ in settings]).alias("tokenizer"), of([n for _, n in settings]).alias("n"), "gram", "cnt", "first")


def word_counts(docs: DataFrame, rule: Chunking, size: int, tokenizer: str) -> DataFrame:
    """(label, tokenizer, n, gram, cnt, first), as ``gram_counts`` gives them for single words of ``docs``' chunks, of all words that are
    among the ``size`` most frequent of any corpus (ties at the end included), for every corpus. ``first`` is null for a word below
    its corpus's ``size`` most frequent.

    All words are counted with nothing but the least document that has them, a plain number. Places within documents decide
    ties alone, so they are looked up afterwards, in the least documents of the frequent words, which are few.
    """
    words = chunk(docs, rule).select("label", "doc_id", F.explode(tokens("text", tokenizer)).alias("gram"))
    counts = held(words.groupBy("label", "gram").agg(F.count("*").alias("cnt"), F.min("doc_id").alias("_doc")))
    rank = F.rank().over(Window.partitionBy("label").orderBy(F.desc("cnt")))
    high = held(counts.withColumn("rank", rank).filter(F.col("rank") <= size).select(F.col("label").alias("_label"), F.col("gram").alias("_gram"), "_doc"))

    of = F.col("label").eqNullSafe(F.col("_label"))
    some = docs.join(F.broadcast(high.select("_label", "_doc").distinct()), of & (F.col("doc_id") == F.col("_doc")), "left_semi")
    places = gram_counts(chunk(some, rule), (tokenizer,), (1,)).select("label", "gram", "first")
    first = places.join(F.broadcast(high.drop("_doc")), of & (F.col("gram") == F.col("_gram"))).select("_label", "_gram", "first")
    leading = counts.drop("_doc").join(F.broadcast(high.select(F.col("_gram").alias("gram")).distinct()), "gram", "left_semi")
    out = leading.join(F.broadcast(first), of & (F.col("gram") == F.col("_gram")), "left")
    return out.select("label", F.lit(tokenizer).alias("tokenizer"), F.lit(1).alias("n"), "gram", "cnt", "first")


def _place(place: tuple[str, ...]) -> Column:
    """A number that orders chunks as (a 64-bit id, a 31-bit number) do and leaves room for 32-bit positions."""
    if not place:
        return F.lit(0).cast("long")
    high, low = place
    wide = F.col(high).cast("decimal(38,0)") * F.lit(Decimal(10**19))
    return (wide + F.shiftleft(F.col(low).cast("long"), 32).cast("decimal(19,0)")).cast("decimal(38,0)")


def vocabulary(counts: DataFrame, size: int, by: tuple[str, ...] = ("label",)) -> DataFrame:
    """Each corpus's ``size`` most frequent grams; of equal counts those met first."""
    rank = F.row_number().over(Window.partitionBy(*by, *CELL).orderBy(F.desc("cnt"), "first"))
    return counts.withColumn("rank", rank).filter(F.col("rank") <= size)


def normalized(x: Column, within: Window) -> Column:
    """Shares of the sum; uniform where the sum isn't above 0."""
    total = F.sum(x).over(within)
    return F.when(total > 0, x / total).otherwise(1.0 / F.count("*").over(within))


def smoothed_js(x: Column, y: Column, within: Window) -> Column:
    """Each row's part of the Jensen-Shannon divergence (nats) of two count columns; summed over ``within`` it is the
    divergence. Counts are raised by a tiny constant, so empty sides are uniform."""
    eps = F.lit(JS_EPSILON)
    p, q = (x + eps) / F.sum(x + eps).over(within), (y + eps) / F.sum(y + eps).over(within)
    m = (p + q) / 2
    return 0.5 * p * F.ln(p / m) + 0.5 * q * F.ln(q / m)


def mean_rank(x: Column, within) -> Column:
    """Ascending ranks in which ties share their mean. ``within``: partition columns."""
    w = Window.partitionBy(*within)
    return F.rank().over(w.orderBy(x)) + (F.count("*").over(w.partitionBy(*within, x)) - 1) / 2


def rank_correlation(rx: str, ry: str) -> Column:
    """Pearson's coefficient of two rank columns, null where a side is constant."""
    cov = F.avg(F.col(rx) * F.col(ry)) - F.avg(rx) * F.avg(ry)
    return F.try_divide(cov, F.nullif(F.round(F.stddev_pop(rx), 12), F.lit(0.0)) * F.nullif(F.round(F.stddev_pop(ry), 12), F.lit(0.0)))


def paired(vocab: DataFrame, counts: DataFrame, pairs: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """(a, b, tokenizer, n, gram, rank, x, y): the vocabulary of a with the counts of both; 0 where b lacks one."""
    a = vocab.select(F.col("label").alias("a"), *extra, *CELL, "gram", "rank", "first", F.col("cnt").alias("x"))
    b = counts.select(F.col("label").alias("b"), *extra, *CELL, "gram", F.col("cnt").alias("y"))
    return pairs.join(a, "a").join(b, ["b", *extra, *CELL, "gram"], "left").withColumn("y", F.coalesce("y", F.lit(0)))


def cells(vocab: DataFrame, counts: DataFrame, pairs: DataFrame, sizes: tuple[int, ...] = VOCABULARIES, extra: tuple[str, ...] = ()) -> DataFrame:
    """(a, b, tokenizer, n, v, grams, js, rho): one row per directed pair and setting; short vocabularies are left out.

    What depends on a corpus and a setting alone (ranks, sums, sizes of the vocabulary's own counts) is worked out once
    a corpus; pairs only rank the other side's counts.
    """
    own = ["label", *extra, *CELL, "v"]
    w, eps = Window.partitionBy(*own), F.lit(JS_EPSILON)
    grown = vocab.withColumn("v", F.explode(F.filter(F.array(*map(F.lit, sizes)), lambda v: v >= F.col("rank"))))
    grown = grown.withColumn("rx", mean_rank(F.col("cnt"), own)).withColumn("grams", F.count("*").over(w)).withColumn("p", (F.col("cnt") + eps) / F.sum(F.col("cnt") + eps).over(w))
    need = F.coalesce(*(F.when(F.col("v") == v, F.lit(least_vocabulary(v))) for v in sizes))
    settings = grown.filter(F.col("grams") >= need).groupBy(F.col("label").alias("a"), *extra, *CELL, "gram").agg(F.collect_list(F.struct("v", "rx", "grams", "p")).alias("settings"))
    known = vocab.select(*extra, *CELL, "gram").distinct()  # few rows: most counts are dropped before they are dealt to pairs
    other = counts.join(known, [*extra, *CELL, "gram"], "left_semi").select(F.col("label").alias("b"), *extra, *CELL, "gram", F.col("cnt").alias("y"))
    met = pairs.join(settings, "a").join(other, ["b", *extra, *CELL, "gram"], "left")
    cell = ["a", "b", *extra, *CELL, "v"]
    rows = met.select("a", "b", *extra, *CELL, F.coalesce("y", F.lit(0)).alias("y"), F.explode("settings").alias("s")).select("a", "b", *extra, *CELL, "y", "s.*")
    w = Window.partitionBy(*cell)
    q, m = F.col("q"), (F.col("p") + F.col("q")) / 2
    ranked = rows.withColumn("ry", mean_rank(F.col("y"), cell)).withColumn("q", (F.col("y") + eps) / F.sum(F.col("y") + eps).over(w))
    js = 0.5 * F.col("p") * F.ln(F.col("p") / m) + 0.5 * q * F.ln(q / m)
    return ranked.groupBy(*cell).agg(F.count("*").alias("grams"), F.sum(js).alias("js"), rank_correlation("rx", "ry").alias("rho"))


def lexical_pairs(cell_rows: DataFrame, extra: tuple[str, ...] = (), strict: bool = False) -> DataFrame:
    """(a, b, lexical_js, rho): means over a pair's settings; an undefined agreement doesn't count, or with ``strict`` makes
    the mean NaN."""
    rho = F.when(F.count("rho") < F.count("*"), F.lit(float("nan"))).otherwise(F.avg("rho")) if strict else F.avg("rho")
    return cell_rows.groupBy("a", "b", *extra).agg(F.avg("js").alias("lexical_js"), rho.alias("rho"))


def ordinal_metrics(counts: DataFrame, pairs: DataFrame, size: int) -> DataFrame:
    """(a, b, grams, js, rho) over one vocabulary of unigrams, with ordinal ranks (ties in vocabulary order) and 0 for an
    undefined agreement; fewer than 8 grams give no row."""
    met = paired(vocabulary(counts, size), counts, pairs)
    w = Window.partitionBy("a", "b")
    met = met.withColumn("js", smoothed_js(F.col("x"), F.col("y"), w)).withColumn("rx", F.col("rank")).withColumn("ry", F.row_number().over(w.orderBy(F.desc("y"), "rank")))
    return met.groupBy("a", "b").agg(F.count("*").alias("grams"), F.sum("js").alias("js"), F.coalesce(rank_correlation("rx", "ry"), F.lit(0.0)).alias("rho")).filter("grams >= 8")
