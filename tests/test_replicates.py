"""Composed corpora: only grams that can be in a vocabulary get vectors, and draws are made by all tasks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataform.operators import replicates, sampling


def _chunks(spark):
    word = lambda p: F.concat(F.lit("w"), F.pmod(F.floor(F.pow(F.pmod(F.xxhash64("id", F.lit(p)), F.lit(1000)) / 1000.0, F.lit(3)) * 900), F.lit(900)).cast("string"))
    rows = spark.range(600).withColumn("label", F.concat(F.lit("c"), (F.col("id") % 3).cast("string"))).withColumn("chunk_index", F.floor(F.col("id") / 3))
    return rows.select("label", "chunk_index", F.concat_ws(" ", *(word(p) for p in range(40))).alias("text"))


def _cells(spark, rows, **given):
    draws = sampling.bootstrap_slots(rows.groupBy("label").agg(F.count("*").alias("n")), spark.range(5).withColumnRenamed("id", "replicate"), 3)
    cols = F.explode(F.sequence(F.lit(0), F.lit(4))).alias("a_col")
    wanted = spark.createDataFrame([("c0", "c1"), ("c0", "c2"), ("c2", "c0")], "a string, b string").select(F.concat("a", "b").alias("id"), "a", "b", cols).withColumn("b_col", F.col("a_col"))
    out = replicates.composed_cells(rows, replicates.packed(draws), 5, wanted, (64,), orders=(1, 2), **given)
    return {(r.id, r.n, i): (r.js, r.rho) for i, r in enumerate(sorted(out.collect(), key=lambda r: (r.id, r.n, r.js)))}


def test_few_grams_get_vectors(spark, monkeypatch):
    rows, seen, real = _chunks(spark), [], replicates._met
    monkeypatch.setattr(replicates, "_met", lambda partial, *a: seen.append(partial.select("label", "k", "gram").distinct().count()) or real(partial, *a))
    monkeypatch.setattr(replicates, "FIRST", 3)
    pruned = _cells(spark, rows)
    first = seen[0]
    monkeypatch.setattr(replicates, "MOST_FURTHER", -1)
    plain = _cells(spark, rows)
    assert first == 3 * 2 * 3 * 64 and max(seen) > 10 * first
    assert pruned.keys() == plain.keys() and len(pruned) > 15
    for key, (js, rho) in plain.items():
        assert pruned[key] == pytest.approx((js, rho), abs=1e-12)


def test_grams_of_one_hash(spark, monkeypatch):
    hashed = replicates._hashed
    monkeypatch.setattr(replicates, "_hashed", lambda t, seed=None: F.transform(hashed(t, seed), lambda h: h if seed else F.shiftright(h, 56)))
    few = _cells(spark, _chunks(spark))
    monkeypatch.undo()
    plain = _cells(spark, _chunks(spark))
    assert few.keys() == plain.keys() and all(few[key] == pytest.approx(plain[key], abs=1e-12) for key in plain)


def test_draws_are_dealt(spark):
    draws = sampling.bootstrap_slots(spark.createDataFrame([("a", 20_000)], "label string, n long"), spark.range(3).withColumnRenamed("id", "replicate"), 1)
    sizes = draws.groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) > 4 and sum(r["count"] for r in sizes) == 60_000 and max(r["count"] for r in sizes) < 20_000
    lists = {r.chunk_index: sorted(r.cols) for r in replicates.packed(draws).collect()}
    want = {}
    for r in draws.collect():
        want.setdefault(r.chunk_index, []).append(r.replicate)
    assert lists == {k: sorted(v) for k, v in want.items()}


def test_half_columns(spark):
    rows = spark.range(1003).select((F.col("id") % 4).cast("string").alias("label"), F.floor(F.col("id") / 4).alias("chunk_index"))
    halves = sampling.halves(rows, spark.range(5).withColumnRenamed("id", "repeat"), 7)
    want = replicates.drawn(halves.withColumn("col", F.col("repeat") * 2 + (F.col("half") == "B").cast("int")), "col")
    lists = lambda df: {(r.label, r.chunk_index): sorted(r.cols) for r in df.collect()}
    assert lists(sampling.half_columns(rows, 5, 7)) == lists(want)


def test_pairs_meet_counts_not_draws(spark, monkeypatch):
    import strataform.plans.measures  # noqa: F401  it fills the catalog
    from strataform.operators import semantic
    from strataform.catalog import QUERIES

    seen, real = [], semantic.occupancy_js
    monkeypatch.setattr(semantic, "occupancy_js", lambda rows, *a, **k: seen.append(rows.count()) or real(rows, *a, **k))
    assert QUERIES["m10_bootstrap_clusters"](spark, "/root/testdata/sf0.01").count() == 9
    assert seen[0] <= 36 * 2 * 3 * 10  # pairs, sides, replicates and clusters, however many vectors


def test_vectors_travel_in_few_bytes():
    vec = np.array([[0, 255, 3], [256, 0, 1], [1 << 16, 2, 0], [1 << 32, 1, 1], [0, 0, 0], [replicates.NONE, 5, replicates.NONE]])
    rows = replicates._bytes(vec)
    assert [len(r) // 3 for r in rows] == [1, 2, 4, 8, 1, 8]
    assert (replicates._matrix(rows, 3) == vec).all() and replicates._matrix([], 3).shape == (0, 3)
