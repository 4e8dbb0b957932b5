"""Measures against numpy, and the invariants they keep."""

import gzip
import lzma
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataform.operators import compression, lexical, pairs, resample, scorecard, semantic


def js(x, y):
    p, q = (np.asarray(v, float) + 1e-12 for v in (x, y))
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2
    return float(0.5 * (p * np.log(p / m)).sum() + 0.5 * (q * np.log(q / m)).sum())


def ranks(x):
    x = np.asarray(x)
    return np.array([(x < v).sum() + ((x == v).sum() + 1) / 2 for v in x])


def corpus(spark, seed=0, words=120, n=60):
    r = np.random.default_rng(seed)
    rows = []
    for k, label in enumerate(("a", "b", "c")):
        for i in range(n):
            w = (r.zipf(1.3, 40) + 7 * k) % words
            rows.append((label, i, 0, " ".join(f"w{x}" for x in w)))
    return spark.createDataFrame(rows, "label string, doc_id long, chunk_in_document int, text string"), rows


def test_lexical_cells(spark):
    df, rows = corpus(spark)
    counts = lexical.gram_counts(df, ("stable",), (1,))
    p = spark.createDataFrame([(a, b) for a in "abc" for b in "abc"], "a string, b string")
    got = {(r.a, r.b): r for r in lexical.cells(lexical.vocabulary(counts, 100), counts, p, (100,)).collect()}
    total, first = {}, {}
    for label, i, _, text in rows:
        for k, w in enumerate(text.split()):
            total[label, w] = total.get((label, w), 0) + 1
            first.setdefault((label, w), (i, k))
    for a in "abc":
        vocab = sorted((w for x, w in total if x == a), key=lambda w: (-total[a, w], first[a, w]))[:100]
        for b in "abc":
            x, y = [total[a, w] for w in vocab], [total.get((b, w), 0) for w in vocab]
            r = got[a, b]
            assert r.grams == len(vocab) and r.js == pytest.approx(js(x, y), abs=1e-9) and 0 <= r.js <= math.log(2) + 1e-9
            assert r.rho == pytest.approx(np.corrcoef(ranks(x), ranks(y))[0, 1], abs=1e-9)
    assert got["a", "a"].js == pytest.approx(0, abs=1e-12) and got["a", "a"].rho == pytest.approx(1)


def test_short_vocabularies_and_constant_counts(spark):
    rows = [("a", 0, 0, "x y z"), ("b", 0, 0, "x")] + [("c", 0, 0, " ".join(f"w{i}" for i in range(70)))]
    counts = lexical.gram_counts(spark.createDataFrame(rows, "label string, doc_id long, chunk_in_document int, text string"), ("stable",), (1, 3))
    p = spark.createDataFrame([("a", "b"), ("c", "a")], "a string, b string")
    got = lexical.cells(lexical.vocabulary(counts, 256), counts, p, (256,)).collect()
    assert {(r.a, r.n) for r in got} == {("c", 1), ("c", 3)} and all(r.rho is None for r in got)
    assert all(r.js == pytest.approx(0, abs=1e-9) for r in got)  # an all-zero target is uniform, as the vocabulary is


def test_compression(spark):
    df = spark.createDataFrame([("a", 1, "zz"), ("a", 0, "é" * 300), ("b", 0, "x")], "label string, chunk_index long, text string")
    raw = ("é" * 300 + "\n\nzz").encode()
    r = compression.ratios(df, ("lzma", "gzip", "zlib")).filter("label = 'a'").first()
    assert r.lzma_ratio == len(lzma.compress(raw, preset=6)) / len(raw) and r.gzip_ratio == len(gzip.compress(raw, 9)) / len(raw) and r.zlib_ratio == len(zlib.compress(raw, 9)) / len(raw)
    assert compression.ratio("", "lzma") == 0


def vectors(spark, seed=1):
    r = np.random.default_rng(seed)
    data = {k: r.normal(k, 1 + k, size=(n, 6)).astype(np.float32) for k, n in enumerate((40, 40, 25, 1))}
    rows = [(k, i, [float(v) for v in x]) for k, xs in data.items() for i, x in enumerate(xs)]
    return spark.createDataFrame(rows, "label int, vec_id long, embedding array<float>"), {k: v.astype(float) for k, v in data.items()}


def test_spectrum(spark):
    df, data = vectors(spark)
    for r in semantic.spectrum(df.repartition(5)).collect():
        x = data[r.label]
        c = x - x.mean(0)
        v = np.clip(np.linalg.eigvalsh(c.T @ c / max(1, len(x) - 1))[::-1], 0, None)
        assert r.n == len(x) and r.total_variance == pytest.approx(v.sum(), abs=1e-6)
        if len(x) > 1:
            assert (r.top1_share, r.top5_share) == pytest.approx((v[0] / v.sum(), v[:5].sum() / v.sum())) and r.top1_share <= r.top5_share <= 1 + 1e-12


def test_wasserstein_and_clusters(spark):
    df, data = vectors(spark)
    p = spark.createDataFrame([(0, 1, "x"), (0, 2, "x")], "a int, b int, pair_class string")
    got = {(r.a, r.b): r for r in semantic.sliced_wasserstein(semantic.axis_projections(df), p, 40).collect()}
    unit = {k: x / np.linalg.norm(x, axis=1, keepdims=True) for k, x in data.items()}
    q = {k: np.quantile(x, (np.arange(40) + 0.5) / 40, axis=0) for k, x in unit.items()}
    for (a, b), r in got.items():
        d = q[a] - q[b]
        assert r.sliced_wasserstein_l1 == pytest.approx(np.abs(d).mean(), abs=1e-6) and r.sliced_wasserstein_l2 == pytest.approx(np.sqrt((d * d).mean()), abs=1e-6)
    clusters = semantic.pair_clusters(df, p, 5, 3).cache()
    assert clusters.count() == 80 + 65
    for r in semantic.occupancy_js(clusters, 5).collect():
        n = {s: np.bincount([c.cluster for c in clusters.filter((F.col("a") == r.a) & (F.col("b") == r.b) & (F.col("label") == s)).collect()], minlength=5) for s in (r.a, r.b)}
        assert r.semantic_cluster_js == pytest.approx(js(n[r.a], n[r.b]), abs=1e-9)
    zero = spark.createDataFrame([(0, 0, [0.0, 0.0])], "label int, vec_id long, embedding array<float>")
    assert semantic.normalized(zero).first().embedding == [0, 0]


def test_panel_counts(spark):
    panel = spark.createDataFrame([(f"s{i}", i) for i in range(20)], "label string, ord int").withColumn("role", pairs.role_of(F.col("ord")))
    n = {r.pair_class: r["count"] for r in pairs.unordered(panel).groupBy("pair_class").count().collect()}
    assert n["broad_broad"] == 15 and n["broad_targeted"] == 48 and n["targeted_targeted"] == 28 and sum(n.values()) == 190
    rows = pairs.unordered(panel.filter("role <> 'candidate'")).withColumn("m", F.lit(1.0))
    loo = {(r.omitted, r.pair_class): r.pairs for r in pairs.leave_one_out(rows, panel, ["m"]).collect()}
    assert loo["s0", "broad_broad"] == 10 and loo["s0", "broad_targeted"] == 40 and loo["s6", "broad_broad"] == 15 and loo["s6", "broad_targeted"] == 42
    assert pairs.matrix(rows, "m", ["s0", "s1"]).filter("a = 's0'").first().s1 == 1


def test_quantiles_and_resume(spark):
    x = np.random.default_rng(0).normal(size=37)
    r = resample.quantiles(spark.createDataFrame([("k", float(v)) for v in x], "k string, v double"), ["k"], "v").first()
    assert (r["mean"], r["median"], r.q025, r.q500, r.q975) == pytest.approx((x.mean(), np.median(x), *np.quantile(x, [0.025, 0.5, 0.975])))
    done = spark.createDataFrame([(0, 1.0), (2, 2.0), (9, 9.0)], "replicate long, value double")
    assert sorted(x.replicate for x in resample.pending(4, done).collect()) == [1, 3]
    new = spark.createDataFrame([(0, -1.0), (1, 5.0)], "replicate long, value double")
    assert sorted(map(tuple, resample.resumed(done, new, 4).collect())) == [(0, 1.0), (1, 5.0), (2, 2.0)]


def test_scorecard(spark):
    import json

    entry = scorecard.package_entry("l", "d", {"source": "s"}, {"n_chunks": 2048, "compression_ratio_lzma": 0.3, "semantic_spectrum": {"top1_share": 0.1, "top5_share": 0.2}}, [], artifact={"url": "u", "sha256": "0" * 64})
    bad = dict(entry, label="", artifact={"sha256": "X"})
    df = spark.createDataFrame([("good", json.dumps(entry)), ("bad", json.dumps(bad)), ("none", "{}")], "path string, entry string")
    got = {}
    for r in scorecard.validate_entries(df).collect():
        got.setdefault(r.path, set()).add(r.problem)
    assert "good" not in got and got["bad"] == {"label is required", "artifact.url is required", "artifact.sha256 digest"} and len(got["none"]) == 10
    registry = spark.createDataFrame([("l", "submitted", "good"), ("l", "submitted", "gone"), ("m", "x", "good"), (None, "submitted", None)], "label string, status string, path string")
    assert sorted((r.label or "", r.problem) for r in scorecard.validate_registry(registry, df).collect()) == [("", "label is required"), ("", "path is required"), ("l", "duplicate label"), ("l", "entry file is missing"), ("m", "entry label differs"), ("m", "status")]
    docs = spark.createDataFrame([("f", '{"a": [{"b": 1.0004}], "n": 3}')], "doc string, body string")
    wanted = spark.createDataFrame([("f", "a[0].b", 1.0, False), ("f", "n", 3.0, True), ("f", "n", 4.0, True), ("f", "no", 1.0, False), ("g", "n", 1.0, False)], "doc string, path string, expected double, whole boolean")
    assert [r.ok for r in scorecard.verify_values(docs, wanted).orderBy("expected", "path", "doc").collect()].count(True) == 2


@pytest.mark.parametrize("stretch", [4096, 64])
def test_wasserstein_counts_every_value(spark, monkeypatch, stretch):
    """Sizes may differ, equal ones go rank by rank, and a value in a tail counts."""
    monkeypatch.setattr(semantic, "STRETCH", stretch)
    r = np.random.default_rng(4)
    data = {0: r.normal(size=(300, 2)), 1: r.normal(size=(420, 2)) + 1, 3: r.normal(size=(300, 2))}
    data[2] = data[0].copy()
    data[2][0] = 99
    rows = [(k, p, float(v)) for k, x in data.items() for p in range(2) for v in x[:, p]]
    df = spark.createDataFrame(rows, "label int, proj int, value double")
    p = spark.createDataFrame([(0, 1, "x"), (1, 0, "x"), (0, 2, "x"), (0, 3, "x")], "a int, b int, pair_class string")
    wide = {k: np.repeat(np.sort(x, axis=0), 2100 // len(x), axis=0) for k, x in data.items()}
    got = {(g.a, g.b): g for g in semantic.exact_wasserstein(df, p).collect()}
    assert len(got) == 4 and got[0, 2].sliced_wasserstein_l1 > 0.3
    for (a, b), g in got.items():
        d = wide[a] - wide[b]
        assert (g.sliced_wasserstein_l1, g.sliced_wasserstein_l2) == pytest.approx((np.abs(d).mean(), np.sqrt((d * d).mean())))


def test_masked_pooling(spark):
    """Padded batches pool to what each text's own token rows give; padding and a mask of nothing don't count."""
    encoder, texts = semantic.HashedGrams(16, 2), ["a", "bb cc " * 40, "", "ddd ee f", None, "x " * 300]
    states, mask = encoder.encode([t or "" for t in texts])
    assert states.shape == (6, 300, 16) and mask.sum(1).tolist() == [1, 80, 1, 3, 1, 300]
    states[mask == 0] = 1e9  # whatever padding holds
    got = semantic.pooled(states, mask)
    assert np.allclose(got, [encoder.tokens(t or "").mean(0) for t in texts]) and not semantic.pooled(states, mask * 0).any()
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    for batch in (2, 16):
        rows = {r.i: r.embedding for r in semantic.embed(df, encoder, batch=batch).collect()}
        for i, v in enumerate(got):
            assert np.allclose(rows[i], v / max(np.linalg.norm(v), 1e-9), atol=1e-6)


def test_sums_of_many_keys_stay_bounded(spark, monkeypatch):
    """Tasks that pass on their sums early give the same spectra, weights and keys included."""
    r = np.random.default_rng(0)
    rows = [(f"c{i % 30}", i % 3, r.normal(size=6).tolist()) for i in range(900)]
    df = spark.createDataFrame(rows, "label string, times long, embedding array<double>").coalesce(3)
    whole = sorted(map(tuple, semantic.spectrum(df, times="times").collect()))
    assert semantic.moments(df, ["label"]).count() == 90
    monkeypatch.setattr(semantic, "SUMS_BYTES", 5 * 6 * 6 * 8)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        assert semantic.moments(df, ["label"]).count() > 90  # a task holds six keys' sums at most
        again = sorted(map(tuple, semantic.spectrum(df, times="times").collect()))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert [x[0] for x in again] == [x[0] for x in whole] and np.allclose([x[1:] for x in again], [x[1:] for x in whole])


def test_weighted_k_means_equals_repeated_rows():
    r = np.random.default_rng(1)
    x = np.concatenate([r.normal(size=(30, 3)) + 8 * k for k in range(4)])
    w = r.integers(0, 4, len(x))
    a, b = semantic.lloyd(x, 4, 5, w), semantic.lloyd(np.repeat(x, w, axis=0), 4, 5)
    assert np.allclose(np.sort(a, axis=0), np.sort(b, axis=0))


def test_steps_over_all_vectors(spark, monkeypatch):
    """Pairs that a sample was fitted to end at a fixed point of k-means over all vectors, at no more than the sample's cost."""
    r = np.random.default_rng(4)
    vecs = {g: r.normal(size=(n, 4)) + np.repeat(r.normal(size=(6, 4)) * 3, -(-n // 6), axis=0)[:n] for g, n in (("a", 300), ("b", 200), ("c", 20), ("d", 10))}
    df = spark.createDataFrame([(g, i, v.tolist()) for g, x in vecs.items() for i, v in enumerate(x)], "label string, vec_id long, embedding array<double>")
    p = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d")], "a string, b string")
    monkeypatch.setattr(semantic, "FITTED", 60)
    start = [(x.a, x.b, np.array(x.centres)) for x in semantic.pair_centres(df, p, 6, 3).collect()]
    end = semantic.refined(df, start, 50)
    near = lambda x, c: ((x[:, None] - c) ** 2).sum(2)
    for (a, b, c), (_, _, e) in zip(start, end, strict=True):
        x = np.concatenate([vecs[a], vecs[b]])
        assert near(x, e).min(1).sum() <= near(x, c).min(1).sum() + 1e-9
        own = near(x, e).argmin(1)
        assert np.allclose([x[own == j].mean(0) if (own == j).any() else e[j] for j in range(6)], e)
        assert near(x, e).min(1).sum() <= 1.1 * near(x, semantic.lloyd(x, 6, 3)).min(1).sum()
    got = {(r.a, r.b, r.label, r.vec_id): r.cluster for r in semantic.pair_clusters(df, p, 6, 3, rounds=50).collect()}
    known = {(a, b): (s if {a, b} == {"c", "d"} else e) for (a, b, s), (_, _, e) in zip(start, end, strict=True)}
    assert len(got) == 750 and all(near(vecs[g][[i]], known[a, b]).argmin() == cl for (a, b, g, i), cl in got.items())
    assert semantic.refined(df, [], 5) == []


def plain_lloyd(x, k, seeds):
    """k-means that compares every row with every centre at each step; also how many comparisons that took."""
    best, cost, sq = None, np.inf, (x * x).sum(1)
    for seed in range(seeds):
        rng = np.random.default_rng(seed)
        picked = [int(rng.integers(len(x)))]
        near = np.maximum(sq - 2 * x @ x[picked[0]] + sq[picked[0]], 0)
        for _ in range(k - 1):
            picked.append(int(rng.choice(len(x), p=near / near.sum())))
            near = np.minimum(near, np.maximum(sq - 2 * x @ x[picked[-1]] + sq[picked[-1]], 0))
        c = x[picked]
        for _ in range(100):
            d = sq[:, None] - 2 * x @ c.T + (c * c).sum(1)
            own = d.argmin(1)
            new = np.stack([x[own == j].mean(0) if (own == j).any() else c[j] for j in range(k)])
            if np.allclose(new, c):
                break
            c = new
        if (inertia := np.maximum(d.min(1), 0).sum()) < cost:
            best, cost = c, inertia
    return best


def test_bounded_steps_are_plain_steps():
    rng = np.random.default_rng(4)
    for x in (rng.normal(size=(9000, 8)), rng.normal(size=(500, 3)) * 1e3 + 1e4, np.repeat(rng.normal(size=(40, 5)), 9, axis=0)):
        assert np.allclose(semantic.lloyd(x, 6, 3), plain_lloyd(x, 6, 3), rtol=1e-9, atol=1e-9)


def test_clusters_of_a_sweep_are_counted_at_once(spark):
    rng = np.random.default_rng(8)
    df = spark.createDataFrame([(i % 3, i, [float(v) for v in rng.normal(size=4)]) for i in range(300)], "label int, vec_id long, embedding array<double>").repartition(3)
    p = spark.createDataFrame([(0, 1), (0, 2)], "a int, b int")
    got = {(r.k, r.a, r.b, r.label, r.cluster): r.n for r in semantic.cluster_counts(df, p, (3, 5), 2).groupBy("k", "a", "b", "label", "cluster").agg(F.sum("n").alias("n")).collect()}
    for k in (3, 5):
        want = {(k, r.a, r.b, r.label, r.cluster): r["count"] for r in semantic.pair_clusters(df, p, k, 2).groupBy("a", "b", "label", "cluster").count().collect()}
        assert {key: n for key, n in got.items() if key[0] == k} == want


def test_words_are_encoded_once(monkeypatch):
    """A word's grams are hashed when it is met first; results don't depend on what is kept and dropped."""
    asked, word = [], semantic.HashedGrams.word
    monkeypatch.setattr(semantic, "_CODES", {})
    monkeypatch.setattr(semantic, "KNOWN", 9)
    monkeypatch.setattr(semantic.HashedGrams, "word", lambda self, w, grams: asked.append(w) or word(self, w, grams))
    texts = ["aa bcd aa bcd aa", "x", "", "efghij k l \u00e4\u00f6\u00fc\u00df", "aa bcd", "a b c d e f g h aa"]
    for encoder in (semantic.HashedGrams(16), semantic.HashedGrams(12, 2)):
        states, mask = encoder.encode(texts)
        for k, text in enumerate(texts):
            want = np.zeros((max(1, len(text.split())), encoder.dimension))
            for i, w in enumerate(text.split()):
                for j in range(max(1, len(w) - encoder.width + 1)):
                    h = zlib.crc32(w[j : j + encoder.width].encode())
                    want[i, h % encoder.dimension] += 1 if h & 1 << 20 else -1
            assert (encoder.tokens(text) == want).all()
            assert (states[k, : len(want)] == want).all() and not states[k, len(want) :].any() and mask[k].sum() == len(want)
    assert asked[:3] == ["aa", "bcd", "x"]


def test_means_of_whole_texts():
    """An encoder's own means equal those over its tokens' rows, bytes of any length and white space of any kind; no word is looked up."""
    texts = ["", " \n ", "a", "ab  c", "é", "日本語テ x", "\U0001f642" * 3 + " z y\x1cq", "ÿ" * 9, "a b c", "x " * 700]
    for encoder in (semantic.HashedGrams(), semantic.HashedGrams(48, 2), semantic.HashedGrams(7, 5)):
        assert (encoder.means(texts) == semantic.pooled(*encoder.encode(texts))).all()
        assert not encoder.means(["", " "]).any() and encoder.means([]).shape == (0, encoder.dimension)


@pytest.mark.parametrize(("stretch", "size"), [(4096, 64 << 20), (16, 900), (16, 64 << 20)])
def test_projected_wasserstein(spark, monkeypatch, stretch, size):
    """All values of corpora of unequal sizes along random directions and axes, a hot vector among them, however they are cut and sent; rows that
    leave a task are ranges, not values."""
    monkeypatch.setattr(semantic, "STRETCH", stretch), monkeypatch.setattr(semantic, "VALUES_BYTES", size)
    rng = np.random.default_rng(3)
    x = {1: rng.normal(size=(90, 5)), 2: np.vstack([rng.normal(size=(30, 5)), np.ones((30, 5))]), 3: np.zeros((40, 5))}
    rows = [(k, i, [float(e) for e in v]) for k, m in x.items() for i, v in enumerate(m)] + [(9, 0, [1.0] * 5), (1, 99, None)]
    df = spark.createDataFrame(rows, "label int, vec_id long, embedding array<double>").repartition(3)
    p = spark.createDataFrame([(1, 2, "x"), (1, 3, "y"), (2, 7, "z")], "a int, b int, pair_class string")
    unit = {k: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300) for k, m in x.items()}
    for count in (None, 7):
        got = {(r.a, r.b): r for r in semantic.projected_wasserstein(df, p, count).collect()}
        side = {k: np.repeat(np.sort(m @ semantic.directions(5, count) if count else m, axis=0), 360 // len(m), axis=0) for k, m in unit.items()}
        assert set(got) == {(1, 2), (1, 3)}
        for (a, b), r in got.items():
            d = side[a] - side[b]
            assert (r.sliced_wasserstein_l1, r.sliced_wasserstein_l2) == pytest.approx((np.abs(d).mean(), np.sqrt((d * d).mean())), abs=1e-9)
