"""Places of rows in a global order, from light rows alone and without a window over a whole corpus."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataform.plans.held import held

#: Ranges that each group's order is cut into.
SPANS = 256


def fixed(bounds: DataFrame) -> DataFrame:
    """``bounds``, a row a group, worked out now and once. Sketches depend on the order in which tasks' parts arrive, so that a plan that
    worked them out in each of its branches could place a row by one set and count it by another."""
    return bounds.sparkSession.createDataFrame([tuple(r) for r in bounds.collect()], bounds.schema)


def ahead(rows: DataFrame, by: list[str], order: list[str], weight: str | None = None) -> DataFrame:
    """``rows`` with ``ahead``: how many rows (or how much ``weight``) of the same ``by`` come before, in the order of ``order`` (nulls first).

    Quantile sketches of the first column of ``order``, a number, give each group's ranges; sums of ranges are added up over ranges, and
    rows within each. Any bounds give the same places, so that sketches needn't be exact, but they are made once. Rows that share the first column share a
    range. ``rows`` should hold keys only, as they are shuffled.
    """
    rows, what = held(rows), F.col(weight) if weight else F.lit(1)
    points = [i / SPANS for i in range(1, SPANS)]
    same = lambda names: reduce(lambda x, y: x & y, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in names))
    bounds = fixed(rows.groupBy(*(F.col(c).alias(f"_{c}") for c in by)).agg(F.array_distinct(F.percentile_approx(order[0], points, 2000)).alias("_bounds")))
    span = F.coalesce(F.size(F.filter("_bounds", lambda b: b <= F.col(order[0]))), F.lit(0))
    placed = rows.join(F.broadcast(bounds), same(by)).withColumn("_span", F.greatest(span, F.lit(0))).select(*rows.columns, "_span")
    up_to = Window.partitionBy(*(f"_{c}" for c in by)).orderBy("__span").rowsBetween(Window.unboundedPreceding, -1)
    sums = placed.groupBy(*(F.col(c).alias(f"_{c}") for c in by), F.col("_span").alias("__span")).agg(F.sum(what).alias("_sum"))
    below = sums.select(*(f"_{c}" for c in by), "__span", F.coalesce(F.sum("_sum").over(up_to), F.lit(0)).alias("_below"))
    inside = Window.partitionBy(*by, "_span").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    met = placed.withColumn("_inside", F.coalesce(F.sum(what).over(inside), F.lit(0)))
    return met.join(F.broadcast(below), same([*by, "_span"])).select(*rows.columns, (F.col("_below") + F.col("_inside")).cast("long").alias("ahead"))
