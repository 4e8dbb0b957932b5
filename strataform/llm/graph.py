"""Connected components with DataFrame operations.

Alternating large-star and small-star steps: each joins every edge with the least neighbour of one of its
ends, so work per round is linear in the edges and no node's neighbours are gathered. The joins are plain
equi-joins whose small side has one row a node, which lets adaptive execution split a hot node's edges.
Every round is a table in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataform.llm.store import discard, materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """``edges`` (u > v): hang the larger (or smaller) neighbours of each node on its least one."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        out = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        out = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.filter("u <> v").distinct()


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*").alias("n"), F.sum(F.shiftright(F.xxhash64("u", "v"), 20)).alias("s")).first()
    return r.n, r.s


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (a, b): component is the least node that it reaches.

    Null ends, loops and repeated edges don't matter; no edges give no rows.
    """
    clean = edges.filter("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now = materialize(clean, "edges")
    state = _state(now)
    while state[0]:
        last, now = now, materialize(_star(_star(now, True), False), "stars")
        before, state = state, _state(now)
        discard(last)
        if state == before:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component"))).groupBy("node").agg(F.min("component").alias("component"))
