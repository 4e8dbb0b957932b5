"""Corpus pairs, their classes, family means and rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def role_of(ordinal: Column) -> Column:
    return F.when(ordinal < 6, "broad").when(ordinal < 14, "targeted").otherwise("candidate")


def pair_class(a: str = "role_a", b: str = "role_b") -> Column:
    both = F.concat_ws("_", F.least(a, b), F.greatest(a, b))
    return F.when(both.isin("broad_broad", "broad_targeted", "targeted_targeted"), both).otherwise("candidate_pair")


def _sides(panel: DataFrame) -> tuple[DataFrame, DataFrame]:
    side = lambda s: panel.select(F.col("label").alias(s), F.col("ord").alias(f"ord_{s}"), F.col("role").alias(f"role_{s}"))
    return side("a"), side("b")


def unordered(panel: DataFrame) -> DataFrame:
    """(a, b, pair_class): every two corpora, a first in the panel's order. The panel holds one row a corpus."""
    a, b = _sides(panel)
    return a.join(b, F.col("ord_a") < F.col("ord_b")).select("a", "b", pair_class().alias("pair_class"))


def ordered(panel: DataFrame) -> DataFrame:
    a, b = _sides(panel)
    return a.join(b, F.col("ord_a") != F.col("ord_b")).select("a", "b", pair_class().alias("pair_class"))


def across(panel: DataFrame, role_a: str = "broad", role_b: str = "targeted") -> DataFrame:
    """Every corpus of one role with every one of another."""
    a, b = _sides(panel)
    return a.filter(F.col("role_a") == role_a).crossJoin(b.filter(F.col("role_b") == role_b)).select("a", "b", pair_class().alias("pair_class"))


def directed(panel: DataFrame) -> DataFrame:
    """(a, b, pair_class, direction): all ordered pairs; forward where a is broad and b targeted or in the panel's order."""
    a, b = _sides(panel)
    forward = F.when((F.col("role_a") == "broad") & (F.col("role_b") == "targeted"), "forward").when((F.col("role_a") == "targeted") & (F.col("role_b") == "broad"), "reverse").when(F.col("ord_a") < F.col("ord_b"), "forward").otherwise("reverse")
    return a.join(b, F.col("ord_a") != F.col("ord_b")).select("a", "b", pair_class().alias("pair_class"), forward.alias("direction"))


def family_means(pairs: DataFrame, metrics: list[str]) -> DataFrame:
    """(pair_class, pairs, <metrics>): unweighted means over a class's pairs; nulls don't count."""
    return pairs.groupBy("pair_class").agg(F.count("*").alias("pairs"), *(F.avg(m).alias(m) for m in metrics))


def directed_family(pairs: DataFrame) -> DataFrame:
    """Family means of lexical columns: both directions within a role, broad as reference only between roles."""
    return family_means(pairs.filter("pair_class <> 'broad_targeted' OR direction = 'forward'"), ["lexical_js", "rho"])


def directions(pairs: DataFrame) -> DataFrame:
    """(lexical_js|rho forward, reverse, mean of both) over broad-targeted pairs."""
    means = pairs.filter("pair_class = 'broad_targeted'").groupBy("direction").agg(F.avg("lexical_js").alias("lexical_js"), F.avg("rho").alias("rho"))
    return means.agg(*(F.max(F.when(F.col("direction") == d, F.col(m))).alias(f"{m}_{d}") for m in ("lexical_js", "rho") for d in ("forward", "reverse"))).withColumns({f"{m}_mean": (F.col(f"{m}_forward") + F.col(f"{m}_reverse")) / 2 for m in ("lexical_js", "rho")})


def matrix(pairs: DataFrame, metric: str, labels: list[str]) -> DataFrame:
    """A symmetric matrix: one row a corpus, one column for each label."""
    both = pairs.select("a", "b", metric).unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), metric))
    return both.groupBy("a").pivot("b", labels).agg(F.first(metric))


def leave_one_out(pairs: DataFrame, panel: DataFrame, metrics: list[str]) -> DataFrame:
    """Family means without each corpus in turn, in one pass over pairs and omitted labels."""
    omitted = panel.filter("role <> 'candidate'").select(F.col("label").alias("omitted"))
    kept = pairs.join(omitted, (F.col("a") != F.col("omitted")) & (F.col("b") != F.col("omitted")))
    return kept.groupBy("omitted", "pair_class").agg(F.count("*").alias("pairs"), *(F.avg(m).alias(m) for m in metrics))


def rankings(pairs: DataFrame, metrics: dict[str, bool]) -> DataFrame:
    """(metric, place, a, b, value): pairs by each metric, descending, or ascending where the flag is set."""
    long = pairs.select("a", "b", F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.lit(-1.0 if up else 1.0).alias("sign"), F.col(m).alias("value")) for m, up in metrics.items()))).alias("x")).select("a", "b", "x.*").filter("value IS NOT NULL")
    place = F.row_number().over(Window.partitionBy("metric").orderBy(F.desc(F.col("sign") * F.round("value", 9)), "a", "b"))
    return long.withColumn("place", place).select("metric", "place", "a", "b", "value")


def touching(pairs: DataFrame, labels: list[str]) -> DataFrame:
    return pairs.filter(F.col("a").isin(labels) | F.col("b").isin(labels))


def attach(pairs: DataFrame, values: DataFrame, column: str) -> DataFrame:
    """``column`` of ``values`` (a, b, column) by the two labels in either order; null where it is missing."""
    key = [F.least("a", "b").alias("_x"), F.greatest("a", "b").alias("_y")]
    return pairs.select("*", *key).join(values.select(*key, column), ["_x", "_y"], "left").drop("_x", "_y")


def by_canonical_key(rows: DataFrame) -> DataFrame:
    """Pairs with the lesser label first; ``x`` and ``y`` change places with it."""
    swap = F.col("a") > F.col("b")
    return rows.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.when(swap, F.col("y")).otherwise(F.col("x")).alias("x"), F.when(swap, F.col("x")).otherwise(F.col("y")).alias("y"))


def merged(metrics: DataFrame, names: list[str]) -> DataFrame:
    """Long (a, b, metric, value) as one row a pair."""
    return metrics.groupBy("a", "b").pivot("metric", names).agg(F.first("value"))


def multipliers(family: DataFrame) -> DataFrame:
    """How many times as far broad and targeted corpora are apart as broad ones; agreement as distance from 1."""
    at = lambda c, m: F.max(F.when(F.col("pair_class") == c, F.col(m)))
    return family.agg(F.try_divide(at("broad_targeted", "lexical_js"), at("broad_broad", "lexical_js")).alias("lexical_js_multiplier"), F.try_divide(1 - at("broad_targeted", "rho"), 1 - at("broad_broad", "rho")).alias("rho_multiplier"))


def orderings(family: DataFrame) -> DataFrame:
    """Three-valued checks: divergence rises, and agreement falls, from broad pairs to mixed ones."""
    at = lambda c, m: F.max(F.when(F.col("pair_class") == c, F.col(m)))
    return family.agg((at("broad_targeted", "lexical_js") > at("broad_broad", "lexical_js")).alias("lexical_js_held"), (at("broad_broad", "rho") > at("broad_targeted", "rho")).alias("rho_held"))


# Which class's mean should be the greater one, by metric.
ORDERINGS = {
    "lexical_js": ("broad_targeted", "broad_broad"),
    "rho": ("broad_broad", "broad_targeted"),
    "semantic_cluster_js": ("broad_targeted", "broad_broad"),
    "compression_abs_diff": ("broad_targeted", "broad_broad"),
    "top1_abs_diff": ("broad_targeted", "broad_broad"),
    "top5_abs_diff": ("broad_targeted", "broad_broad"),
}


def finite_mean(column: str) -> Column:
    """The mean of the values that are numbers and finite; null without any."""
    x = F.col(column).cast("double")
    return F.avg(F.when(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), x))


def long_form(family: DataFrame, metrics: list[str], by: tuple[str, ...] = ()) -> DataFrame:
    """(<by>, pair_class, metric, value) of a family's columns."""
    rows = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics)))
    return family.select(*by, "pair_class", rows.alias("x")).select(*by, "pair_class", "x.*")


def _classes(family: DataFrame, metrics: list[str], by: tuple[str, ...]) -> DataFrame:
    at = lambda c: F.max(F.when(F.col("pair_class") == c, F.col("value")))
    return long_form(family, metrics, by).groupBy(*by, "metric").agg(at("broad_broad").alias("bb"), at("broad_targeted").alias("bt"))


def checks(family: DataFrame, metrics: list[str], by: tuple[str, ...] = ()) -> DataFrame:
    """(<by>, metric, lhs, rhs, held) of every metric's ordering; false where a mean is missing."""
    up = F.col("metric").isin([m for m, (lhs, _) in ORDERINGS.items() if lhs == "broad_targeted"])
    lhs, rhs = F.when(up, F.col("bt")).otherwise(F.col("bb")), F.when(up, F.col("bb")).otherwise(F.col("bt"))
    return _classes(family, metrics, by).select(*by, "metric", lhs.alias("lhs"), rhs.alias("rhs"), F.coalesce(lhs > rhs, F.lit(False)).alias("held"))


def held_counts(checked: DataFrame) -> DataFrame:
    """(metric, held, total): over replicates or settings, how often each ordering held."""
    return checked.groupBy("metric").agg(F.count_if("held").alias("held"), F.count("*").alias("total"))


def separations(family: DataFrame, metrics: list[str]) -> DataFrame:
    """(metric, multiplier): mixed over broad means; agreement (rho) as distance from 1. Null without a broad mean above 0."""
    of = lambda c: F.when(F.col("metric") == "rho", 1 - F.col(c)).otherwise(F.col(c))
    return _classes(family, metrics, ()).select("metric", F.try_divide(of("bt"), of("bb")).alias("multiplier"))
