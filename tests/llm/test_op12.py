import math

import numpy as np
import pytest

from strataform.llm import whitening as W

SF = "/root/testdata/sf0.01"


def table(spark, tmp, rows, extra=True, kind="float"):
    """embeddings with columns whose names clash with the result's."""
    df = spark.createDataFrame([(i, v, 7, "x") for i, v in rows], f"vec_id long, embedding array<{kind}>, component int, whitened string")
    (df if extra else df.select("vec_id", "embedding")).coalesce(2).write.mode("overwrite").parquet(f"{tmp}/embeddings.parquet")
    return str(tmp)


def fine(v, d):
    return v is not None and len(v) == d and all(c is not None and math.isfinite(c) for c in v)


def check(got, rows, d):
    """Against numpy in exact whole numbers; signs of components are free, but one for all rows."""
    used = [(i, v) for i, v in rows if fine(v, d)]
    x = np.array([[math.floor(64 * c) + 1000000 for c in v] for _, v in used], object)
    n, s = len(x), x.sum(0)
    y = ((n * x - s) / n).astype(float)
    cov = y.T @ y / n
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1][:32], u[:, ::-1][:, :32]
    assert len(got) == n * len(e)
    dev = sorted((str(i), int(((n * r - s) ** 2).sum())) for (i, _), r in zip(used, x, strict=True) for _ in e)
    assert sorted((str(r.vec_id), r.deviation) for r in got) == dev and {r.n for r in got} == {n}
    assert all(r.explained == pytest.approx(e[r.component - 1] / np.trace(cov), rel=1e-9) for r in got if e[0] > 0 and e[r.component - 1] > 1e-9 * e[0])
    assert len({r.identity_error for r in got}) <= 1 and all(r.identity_error < 1e-9 for r in got)
    return used, y, e, u


def test_equals_numpy(spark):
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    got = W.op12_whitening(spark, SF).collect()
    used, y, e, u = check(got, rows, 64)
    of = {(r.vec_id, r.component): r.whitened for r in got}
    z = np.array([[of[i, k + 1] for k in range(32)] for i, _ in used])
    want = y @ u / np.sqrt(e)
    assert np.abs(z - want * np.sign((z * want).sum(0))).max() < 1e-7
    assert np.abs(z.T @ z / len(z) - np.eye(32)).max() < 1e-9


def test_odd_rows(spark, tmp_path):
    """Null, short, long, non-finite and huge entries go; repeated rows and ids, and null ids, count each."""
    r = np.random.default_rng(0)
    good = [(i % 40 if i % 9 else None, r.normal(size=3).tolist()) for i in range(60)] + [(5, [1.0, 2.0, 3.0])] * 4
    nan, inf = float("nan"), float("inf")
    bad = [(100, None), (101, []), (102, [1.0, None, 2.0]), (103, [1.0, nan, 2.0]), (104, [inf, 0.0, 0.0]), (105, [1.0, 2.0]), (106, [1e30, 0.0, 0.0]), (107, [1.0] * 4)]
    sf = table(spark, tmp_path, good + bad, kind="double")
    got = W.op12_whitening(spark, sf).collect()
    assert {r.vec_id for r in got} == {i for i, _ in good}
    check(got, good, 3)


def test_rank_and_size(spark, tmp_path):
    """A constant dimension, a lone row, equal rows: components without variance are null; deviations are exact beyond 2**53 and 2**63."""
    flat = [(i, [float(i), 2.0, float(-i)]) for i in range(8)]
    got = W.op12_whitening(spark, table(spark, tmp_path / "a", flat)).collect()
    check(got, flat, 3)
    assert {r.component for r in got if r.whitened is None} == {2, 3}
    for rows in ([(1, [0.5, 1.0])], [(i, [0.5, 1.0]) for i in range(5)]):
        got = W.op12_whitening(spark, table(spark, tmp_path / f"n{len(rows)}", rows)).collect()
        assert len(got) == 2 * len(rows) and all(r.whitened is None and r.explained is None and r.deviation == 0 and r.identity_error == 0 for r in got)
    far = [(0, [2.0**22, 0.0]), (1, [0.0, 0.0]), (2, [-(2.0**22), 1.0])]
    got = W.op12_whitening(spark, table(spark, tmp_path / "far", far, kind="double")).collect()
    check(got, far, 2)
    far = [(0, [2.0**40, 0.0]), (1, [0.0, 0.0]), (2, [-(2.0**40), 1.0])]
    got = W.op12_whitening(spark, table(spark, tmp_path / "wide", far, kind="double")).collect()
    assert {r.deviation for r in got if r.vec_id != 1} == {None} and {r.deviation for r in got if r.vec_id == 1} == {64**2}


def test_sums_are_exact(spark, tmp_path):
    """Sums beyond 63 bits."""
    rows = [(i, [2.0**55, float(i)]) for i in range(40)]
    model = W.fit(spark.read.parquet(f"{table(spark, tmp_path, rows, kind='double')}/embeddings.parquet"))
    assert model.sums == (40 * (2**61 + 1000000), sum(64 * i + 1000000 for i in range(40)))


def test_empty(spark, tmp_path):
    for k, rows in enumerate(([], [(1, None), (2, [])])):
        got = W.op12_whitening(spark, table(spark, tmp_path / str(k), rows))
        assert got.collect() == [] and got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
