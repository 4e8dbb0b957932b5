import math

import numpy as np

from strataform.llm import neighbours as N

SF = "/root/testdata/sf0.1"
ASKED = "id % 100 = 0"


def table(spark, tmp, rows, kind="float"):
    df = spark.createDataFrame([(i, v, 1, 0.5) for i, v in rows], f"vec_id long, embedding array<{kind}>, query_id int, score double")
    df.coalesce(2).write.mode("overwrite").parquet(f"{tmp}/embeddings.parquet")
    return str(tmp)


def brute(rows, k=10, every=100):
    """{query: [(distance, id)]} of the k nearest, by differences in doubles; rows that share the query's id don't count."""
    d = max((len(v) for _, v in rows if v), key=lambda n: sum(1 for _, v in rows if v and len(v) == n), default=0)
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v and len(v) == d and all(c is not None and math.isfinite(c) for c in v) and any(v)]
    ids, x = np.array([i for i, _ in ok]), np.array([v for _, v in ok])
    out = {}
    for i, q in ok:
        if i % every == 0:
            far = np.sqrt(((x - q) ** 2).sum(1))
            near = sorted((float(f), int(j)) for f, j in zip(far, ids, strict=True) if j != i)[:k]
            out[i] = near
    return out


def lists(got):
    out = {}
    for r in sorted(got, key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.score, r.vec_id))
        assert r["rank"] == len(out[r.query_id])
    return out


def recall(got, want):
    return sum(len({i for _, i in got.get(q, [])} & {i for _, i in near}) for q, near in want.items()) / sum(map(len, want.values()))


def test_recall_against_brute_force(spark):
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    got, want = lists(N.op13_neighbours(spark, SF).collect()), brute(rows)
    assert got.keys() == want.keys() and all(len(v) == 10 and v == sorted(v) for v in got.values())
    assert recall(got, want) >= 0.9
    x = {i: np.array(v) for i, v in rows}
    assert all(abs(s - math.dist(x[q], x[i])) < 1e-12 for q, near in got.items() for s, i in near)


def test_clustered_vectors_and_many_buckets(spark, tmp_path, monkeypatch):
    """Planted groups and one vector that a third of all rows share: few visits, small buckets and slices of a large leaf, ties by id."""
    monkeypatch.setattr(N, "BUCKET", 150)
    r = np.random.default_rng(1)
    centres = r.normal(size=(40, 12)) * 4
    rows = [(i, (centres[i % 40] + r.normal(size=12) * 0.3).astype(np.float32).tolist()) for i in range(2000)] + [(i, [1.0] * 12) for i in range(2000, 3000)]
    sf = table(spark, tmp_path, rows)
    index = N.build(spark.read.parquet(f"{sf}/embeddings.parquet"), ASKED, sample=600)
    assert index.visits < index.tree.leaves / 4 and index.recall >= N.TARGET and index.slices.max() > 3 and index.buckets >= 20
    got, want = lists(N.op13_neighbours(spark, sf).collect()), brute(rows)
    assert recall(got, want) >= 0.9
    assert all(got[q] == [(0.0, i) for i in range(2000, 3000) if i != q][:10] for q in range(2000, 3000, 100))


def test_full_visits_are_exact(spark, tmp_path):
    """With all leaves visited, lists equal brute force, near copies, repeated rows and odd vectors included."""
    r = np.random.default_rng(2)
    base = r.normal(size=5)
    rows = [(i, r.normal(size=5).tolist()) for i in range(400)] + [(1000 + i, (base + 1e-9 * i).tolist()) for i in range(30)]
    rows += [(2000, base.tolist()), (2000, base.tolist()), (2001, base.tolist()), (2001, base.tolist())]
    nan, inf = float("nan"), float("inf")
    odd = [(3000, None), (3100, []), (3200, [0.0] * 5), (3300, [1.0, None, 1.0, 1.0, 1.0]), (3400, [nan] * 5), (3500, [inf, 1.0, 1.0, 1.0, 1.0]), (3600, [1.0, 2.0]), (None, base.tolist())]
    sf = table(spark, tmp_path, rows + odd, "double")
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet")
    index = N.build(vectors, ASKED, target=1.1)
    assert index.visits == index.tree.leaves
    got, want = lists(N.search(vectors, ASKED, index).collect()), brute(rows + odd)
    assert got.keys() == want.keys() and all([i for _, i in got[q]] == [i for _, i in want[q]] for q in want)
    assert all(abs(a - b) <= 1e-15 + 1e-12 * b for q in want for (a, _), (b, _) in zip(got[q], want[q], strict=True))


def test_extreme_entries(spark, tmp_path):
    rows = [(0, [1e200, 0.0]), (1, [1e200, 1.0]), (2, [-1e200, 0.0]), (3, [1.0, 1.0]), (100, [1e-200, 0.0]), (101, [2e-200, 0.0])]
    got = lists(N.op13_neighbours(spark, table(spark, tmp_path, rows, "double")).collect())
    assert got[0][0] == (1.0, 1) and [i for _, i in got[0][1:]] == [2, 3, 100, 101] and {s for s, _ in got[0][1:]} == {inf for inf in (float("inf"),)}
    assert got[100][0] == (0.0, 101) and got[100][1][1] == 3


def test_few_rows_and_none(spark, tmp_path):
    for k, (rows, n) in enumerate([([], 0), ([(0, None)], 0), ([(1, [1.0])], 0), ([(0, [1.0])], 0), ([(0, [1.0]), (1, [2.0]), (100, [4.0])], 4)]):
        got = N.op13_neighbours(spark, table(spark, tmp_path / str(k), rows))
        assert got.columns == ["query_id", "rank", "vec_id", "score"] and got.count() == n


def test_walks():
    """Best bin first: every leaf once, the nearest child of the root's nearest path first; rows go where the walk begins."""
    r = np.random.default_rng(3)
    x = r.normal(size=(900, 4))
    t = N.Tree.fit(x)
    walks = t.visits(x[:50], t.leaves)
    assert all(sorted(w) == list(range(t.leaves)) for w in walks) and (walks[:, 0] == t.assign(x[:50])).all()
    first, slices, n = N._layout(np.array([3, 500, 0, 20, 20, 90]), 6)
    assert n == int((first + slices).max()) and slices.tolist()[1] > 3 and (slices[[0, 2, 3, 4, 5]] == 1).all()
