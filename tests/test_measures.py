"""Resampled, split and mixed corpora against numpy and the codec; the queries that SQL can't express; new sources and sinks."""

import gzip
import hashlib
import json
import lzma
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataform.operators import composed, compression, lexical, pairs, resample, sampling, scorecard, semantic
from strataform.plans import analyses, queries
from strataform.sources import readers, sinks

SF = "/root/testdata/sf0.001"
CELL = {"tokenizers": ("stable",), "orders": (1,), "sizes": (256,)}


def js(x, y):
    p, q = (np.asarray(v, float) + 1e-12 for v in (x, y))
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2
    return float(0.5 * (p * np.log(p / m)).sum() + 0.5 * (q * np.log(q / m)).sum())


def corpora(spark, names="abcd", n=24, seed=0):
    """Panel, chunks and vectors, and the same as Python lists."""
    r, texts, vecs = random.Random(seed), {}, {}
    for k, name in enumerate(names):
        words = [f"w{i}" for i in range(k * 20, k * 20 + 90)]
        texts[name] = [" ".join(r.choice(words) for _ in range(40)) + (" sorry" if r.random() < 0.3 else "") for _ in range(n)]
        vecs[name] = np.random.default_rng(k).normal(k * 0.3, 1, size=(n, 5)).astype(np.float32)
    panel = spark.createDataFrame([(x, k, "broad" if k < 2 else "targeted") for k, x in enumerate(names)], "label string, ord int, role string")
    chunks = spark.createDataFrame([(x, i, t) for x in names for i, t in enumerate(texts[x])], "label string, chunk_index long, text string").withColumn("doc_id", F.col("chunk_index")).withColumn("chunk_in_document", F.lit(0))
    vectors = spark.createDataFrame([(x, i, [float(v) for v in y]) for x in names for i, y in enumerate(vecs[x])], "label string, vec_id long, embedding array<float>")
    return panel, chunks, vectors, texts, vecs


def spectrum(x):
    c = x.astype(float) - x.astype(float).mean(0)
    v = np.clip(np.linalg.eigvalsh(c.T @ c / (len(x) - 1))[::-1], 0, None)
    return v[0] / v.sum(), v[:5].sum() / v.sum()


def words_js(a, b, size=256):
    from collections import Counter

    first, ca, cb = {}, Counter(), Counter(w for t in b for w in t.split())
    for i, t in enumerate(a):
        for j, w in enumerate(t.split()):
            ca[w] += 1
            first.setdefault(w, (i, j))
    vocab = sorted(ca, key=lambda w: (-ca[w], first[w]))[:size]
    return js([ca[w] for w in vocab], [cb[w] for w in vocab])


def ratio(texts):
    raw = "\n\n".join(texts).encode()
    return len(lzma.compress(raw, preset=6)) / len(raw)


def test_bootstrap_of_all_metrics(spark):
    panel, chunks, vectors, texts, vecs = corpora(spark)
    got = analyses.bootstrap_metrics(panel, chunks, vectors, 2, 5, k=4, **CELL).collect()
    assert [(r.replicate, r.a, r.b) for r in got] == [(i, a, b) for i in range(2) for a, b in [("a", "b"), ("a", "c"), ("a", "d"), ("b", "c"), ("b", "d"), ("c", "d")]]
    sizes = chunks.groupBy("label").agg(F.count("*").alias("n"))
    drawn = {}
    for r in sampling.bootstrap_draws(sizes, spark.range(2).withColumnRenamed("id", "replicate"), 5).collect():
        drawn.setdefault((r.replicate, r.label), []).extend([r.chunk_index] * r.times)
    fixed = {(r.a, r.b, r.label, r.vec_id): r.cluster for r in semantic.pair_clusters(vectors, pairs.unordered(panel), 4).collect()}
    for r in got:
        ia, ib = (sorted(drawn[r.replicate, x]) for x in (r.a, r.b))
        ta, tb = [texts[r.a][i] for i in ia], [texts[r.b][i] for i in ib]
        assert len(ia) == 24 and r.lexical_js == pytest.approx(words_js(ta, tb), abs=1e-9)
        assert r.compression_abs_diff == pytest.approx(abs(ratio(ta) - ratio(tb)))
        (x1, x5), (y1, y5) = spectrum(vecs[r.a][ia]), spectrum(vecs[r.b][ib])
        assert (r.top1_abs_diff, r.top5_abs_diff) == pytest.approx((abs(x1 - y1), abs(x5 - y5)), abs=1e-6)
        la, lb = [fixed[r.a, r.b, r.a, i] for i in ia], [fixed[r.a, r.b, r.b, i] for i in ib]
        k = max(la + lb) + 1
        assert r.semantic_cluster_js == pytest.approx(js(np.bincount(la, minlength=k), np.bincount(lb, minlength=k)), abs=1e-9)
    quantiles, held = analyses.bootstrap_summary(spark.createDataFrame(got))
    values = [np.mean([r.lexical_js for r in got if r.replicate == i and r.pair_class == "broad_targeted"]) for i in range(2)]
    q = quantiles.filter("metric = 'lexical_js' AND pair_class = 'broad_targeted'").first()
    assert (q["mean"], q.q025, q.q975) == pytest.approx((np.mean(values), *np.quantile(values, [0.025, 0.975])))
    assert {(r.metric, r.total) for r in held.collect()} == {(m, 2) for m in analyses.METRICS}


def test_splits(spark):
    panel, chunks, vectors, texts, vecs = corpora(spark, "ab", 25)
    got = analyses.split_metrics(chunks, vectors, 2, 3, **CELL).collect()
    assert len(got) == 4
    halves = {}
    for r in sampling.halves(chunks, spark.range(2).withColumnRenamed("id", "repeat"), 3).collect():
        halves.setdefault((r.label, r.repeat, r.half), []).append(r.chunk_index)
    for r in got:
        ia, ib = (sorted(halves[r.label, r.repeat, h]) for h in "AB")
        ta, tb = [texts[r.label][i] for i in ia], [texts[r.label][i] for i in ib]
        assert len(ia) == len(ib) == 12 and not set(ia) & set(ib)
        assert (r.lexical_js, r.compression_abs_diff, r.top1_abs_diff) == pytest.approx((words_js(ta, tb), abs(ratio(ta) - ratio(tb)), abs(spectrum(vecs[r.label][ia])[0] - spectrum(vecs[r.label][ib])[0])), abs=1e-6)
        assert 0 <= r.semantic_cluster_js <= np.log(2)
    means = [np.mean([r.lexical_js for r in got if r.label == x]) for x in "ab"]
    s = resample.split_summary(spark.createDataFrame(got), ["lexical_js"]).first()
    assert (s["mean"], s.q025) == pytest.approx((np.mean(means), np.quantile(means, 0.025)))


def test_mixtures(spark):
    panel, chunks, vectors, texts, vecs = corpora(spark)
    got = {(r.base, r.target, r.alpha): r for r in analyses.mixture_panel(panel, chunks, vectors, (0.0, 0.25, 1.0), **CELL).collect()}
    assert set(got) == {(a, b, x) for a, b in ("cd", "dc") for x in (0.0, 0.25, 1.0)}
    for (a, b, x), r in got.items():
        n = round(24 * x)
        t, v = texts[a][: 24 - n] + texts[b][:n], np.concatenate([vecs[a][: 24 - n], vecs[b][:n]])
        assert (r.top1_share, r.top5_share, r.refusal_rate, r.marker_rate) == pytest.approx((*spectrum(v), np.mean(["sorry" in y for y in t]), 0), abs=1e-6)
        assert r.lzma_ratio == pytest.approx(ratio(t if a < b or not 0 < x < 1 else texts[b][:n] + texts[a][: 24 - n]))
        assert (r.lexical_js, r.rho, r.semantic_cluster_js) == (0, 1, 0) if x == 0 else r.lexical_js == pytest.approx(words_js(texts[a], t), abs=1e-9) and 0 <= r.semantic_cluster_js <= np.log(2)


def test_codec_sees_a_sample_of_composed_corpora(spark, monkeypatch):
    panel, chunks, vectors, texts, _ = corpora(spark, "ab", 30)
    members = analyses.own_members(chunks).withColumn("times", F.when(F.col("chunk_index") < 3, 0).otherwise(2).cast("long"))
    whole = {r.label: r for r in analyses.composed_alone(chunks, vectors, members.filter("times > 0")).collect()}
    assert whole["a"].n_chunks == 54 and whole["a"].lzma_ratio == pytest.approx(ratio([t for t in texts["a"][3:] for _ in range(2)]))
    monkeypatch.setattr(analyses, "MAX_CHUNKS", 5)
    some = {r.label: r for r in analyses.composed_alone(chunks, vectors, members.filter("times > 0")).collect()}
    assert some["a"].lzma_ratio != whole["a"].lzma_ratio and (some["a"].n_chunks, some["a"].refusal_rate) == (54, whole["a"].refusal_rate)


def test_textual_grid(spark):
    panel, chunks, _, texts, _ = corpora(spark)
    got = analyses.textual_grid(panel, chunks, ("gzip", "lzma"), ("stable",), (1, 2), (256,)).collect()
    assert len(got) == 4 and all(r[f"{g}_count"] == n for r in got for g, n in (("bb", 2), ("bt", 4), ("tb", 4), ("tt", 2)))
    value = {c: ratio(texts[c]) for c in "abcd"}
    r = next(r for r in got if r.codec == "lzma" and r.n == 1)
    assert r.bt_compression_gap == pytest.approx(np.mean([value[a] - value[b] for a in "ab" for b in "cd"])) and r.bb_compression_gap == pytest.approx(0)
    assert r.tb_lexical_js == pytest.approx(np.mean([words_js(texts[b], texts[a]) for a in "ab" for b in "cd"])) and r.lexical_js_held == (r.bt_lexical_js > r.bb_lexical_js)


def test_undefined_agreement(spark):
    rows = spark.createDataFrame([("a", "b", 0.5, None), ("a", "b", 0.1, 0.4)], "a string, b string, js double, rho double")
    assert lexical.lexical_pairs(rows).first().rho == 0.4 and np.isnan(lexical.lexical_pairs(rows, strict=True).first().rho)
    x = spark.createDataFrame([(1.0,), (float("nan"),), (float("inf"),), (None,), (2.0,)], "x double")
    assert x.agg(pairs.finite_mean("x")).first()[0] == 1.5 and x.filter("x > 2").agg(pairs.finite_mean("x")).first()[0] is None
    family = spark.createDataFrame([("broad_broad", 0.2, 0.5), ("broad_targeted", 0.3, None)], "pair_class string, lexical_js double, rho double")
    assert {r.metric: r.held for r in pairs.checks(family, ["lexical_js", "rho"]).collect()} == {"lexical_js": True, "rho": False}
    assert pairs.separations(family, ["lexical_js"]).first().multiplier == pytest.approx(1.5)


def test_one_k_means_at_every_size(spark, monkeypatch):
    """Of more vectors than are fitted a fixed sample decides the centres, and all are assigned to the nearest."""
    _, _, vectors, _, vecs = corpora(spark, "ab", 60)
    p = spark.createDataFrame([("a", "b")], "a string, b string")
    for fitted in (10**5, 40):
        monkeypatch.setattr(semantic, "FITTED", fitted)
        c = np.array(semantic.pair_centres(vectors, p, 4, 2).first().centres)
        got = {(r.label, r.vec_id): r.cluster for r in semantic.pair_clusters(vectors.repartition(3), p, 4, 2).collect()}
        want = {(s, i): int(((c - x) ** 2).sum(1).argmin()) for s in "ab" for i, x in enumerate(vecs[s].astype(float))}
        assert got == want and len(got) == 120


def test_settings_of_corpora(spark, tmp_path):
    """A recipe's entries, defaults and constants; provenance joins chunks; a short corpus leaves nothing behind."""
    lines = [json.dumps({"text": "" if i % 3 == 0 else f"{i} " + "word " * 200}) + "\n" for i in range(30)]
    (tmp_path / "a.jsonl").write_text("".join(lines))
    corpora_ = [{"label": "a", "max_chunks": 6, "skip_nonempty_documents": 2}, {"label": "b", "sampling_mode": "reservoir", "max_chunks": 5, "sample_scan_documents": 10, "sample_reservoir_documents": 7, "max_chunks_per_source_document": 1, "chunk_chars": 256}]
    sinks.write_json({"defaults": {"source_type": "jsonl", "path": "a.jsonl", "chunk_chars": 512}, "corpora": corpora_}, tmp_path / "r.json")
    analyses.build_chunks(spark, f"{tmp_path}/r.json", f"{tmp_path}/out", str(tmp_path))
    chunks, known = spark.read.parquet(f"{tmp_path}/out/chunks"), spark.read.parquet(f"{tmp_path}/out/provenance")
    a = chunks.filter("label = 'a'").orderBy("chunk_index").collect()
    filled = [i for i in range(30) if i % 3]
    assert [(r.chunk_index, r.doc_id, r.chunk_in_document) for r in a] == [(2 * k + j, filled[2 + k], j) for k in range(3) for j in range(2)]
    assert all(len(r.text) <= 512 for r in a) and all(len(r.text) <= 256 for r in chunks.filter("label = 'b'").collect())
    met = chunks.join(known.drop("doc_id", "chunk_in_document", "char_start", "char_end"), ["label", "chunk_index"]).collect()
    assert len(met) == 11 and all(r.chunk_sha256 for r in met)
    b = known.filter("label = 'b'").orderBy("chunk_index").collect()
    assert [r.document_sample_rank for r in b] == list(range(5)) and len({r.doc_id for r in b}) == 5 and {r.doc_id for r in b} <= set(filled[:10])
    stats = {r.label: r for r in spark.read.parquet(f"{tmp_path}/out/statistics").collect()}
    assert (stats["a"].source_rows_seen, stats["a"].source_documents_extracted, stats["a"].source_documents_with_chunks, stats["a"].chunk_count) == (30, 20, 3, 6)
    for _ in range(2):
        with pytest.raises(ValueError, match="too few chunks: a"):
            analyses.build_chunks(spark, f"{tmp_path}/r.json", f"{tmp_path}/short", str(tmp_path), labels=["a"], chunks=10**4)
    assert not (tmp_path / "short").exists()
    with pytest.raises(ValueError, match="sampling_mode"):
        analyses.Settings.of({"sampling_mode": "odd"})
    assert analyses.Settings.of({"max_documents": 5, "max_chunks": 3}).reservoir == 12 and analyses.Settings.of({"max_documents": 5}, documents=7).scan == 7


def test_battery(spark, tmp_path):
    r = random.Random(1)
    for k, name in enumerate("abc"):
        words = [f"w{i}" for i in range(10 * k, 10 * k + 100)]
        (tmp_path / f"{name}.jsonl").write_text("".join(json.dumps({"text": " ".join(r.choice(words) for _ in range(250))}) + "\n" for _ in range(12)))
    sinks.write_json({"defaults": {"source_type": "jsonl", "max_chunks": 12}, "corpora": [{"label": x, "path": f"{x}.jsonl", "role": "broad" if x == "a" else "targeted"} for x in "abc"]}, tmp_path / "r.json")
    out, only = f"{tmp_path}/out", ["orderings", "leave_one_out", "cluster_stability"]
    assert analyses.battery(spark, f"{tmp_path}/r.json", out, str(tmp_path), only=only) == ["chunks", "vectors", "orderings", "cluster_stability", "leave_one_out"]
    assert analyses.battery(spark, f"{tmp_path}/r.json", out, str(tmp_path), only=only) == []
    text = (tmp_path / "out/summary.md").read_text()
    assert text.startswith("# Corpus matrix") and "## Orderings" in text and "- corpora: `3`" in text
    assert spark.read.parquet(f"{out}/cluster_stability").select("k").distinct().count() == 5

    panel = readers.recipe(spark, f"{tmp_path}/r.json")
    with pytest.raises(ValueError, match="not in the panel: x, y"):
        analyses.submission(spark, ["y", "a", "x"], panel, out, f"{tmp_path}/bundle")
    files = {"a": [f"{tmp_path}/a.jsonl", f"{tmp_path}/r.json"], "b": [f"{tmp_path}/b.jsonl"]}
    made = analyses.submission(spark, ["a", "b"], panel, out, f"{tmp_path}/bundle", files, "someone", archive=True)
    assert [len(r["artifacts"]) for r in made["corpora"]] == [2, 1] and made["corpora"][0]["artifacts"][0]["sha256"] == hashlib.sha256((tmp_path / "a.jsonl").read_bytes()).hexdigest()
    near = json.loads((tmp_path / "bundle/pairs.json").read_text())
    assert len(near) == 6 and (tmp_path / "bundle.zip").exists() and "| b | targeted | 1 |" in (tmp_path / "bundle/README.md").read_text()
    entries = spark.createDataFrame([(x, (tmp_path / f"bundle/entries/{x}.json").read_text()) for x in "ab"], "path string, entry string")
    assert {r.problem for r in scorecard.validate_entries(entries, public=False).collect()} == {"standalone_summary.n_chunks"}
    with pytest.raises(FileExistsError):
        analyses.submission(spark, ["a"], panel, out, f"{tmp_path}/bundle")


def test_lines_shards_and_caches(spark, tmp_path):
    (tmp_path / "x-1.jsonl").write_bytes(b"".join(b'{"i": %d}\r\n' % i if i % 5 else b"bad\n" for i in range(4000)))
    with gzip.open(tmp_path / "y-1.jsonl.gz", "wt") as f:
        f.write('{"i": 1}\n\n{"i": 2}')
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    try:
        got = readers.json_lines(spark, f"{tmp_path}/*.jsonl*").orderBy("source_index").collect()
        lines = readers.numbered_lines(spark, f"{tmp_path}/x-1.jsonl")
        assert lines.select("block").distinct().count() > 1 and [r.line_no for r in lines.orderBy("line_no").collect()] == list(range(1, 4001))
        urls = spark.createDataFrame([(f"{tmp_path}/x-1.jsonl",), (f"{tmp_path}/y-1.jsonl.gz",)], "url string")
        orders = {tuple(r.source_ref[-4:] for r in readers.shards(spark, urls, per_shard=2, seed=s).select("source_ref", "source_shard_index").distinct().orderBy("source_shard_index").collect()) for s in range(12)}
        rows = readers.shards(spark, urls, per_shard=10, seed=1).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [(r.line_no, r.source_index) for r in got] == [(i + 1, k) for k, i in enumerate(i for i in range(4000) if i % 5)] + [(1, 3200), (3, 3201)]
    assert len(orders) == 2 and len(rows) == 8 + 2 and {r.source_shard_row_index for r in rows if r.source_ref.endswith("gz")} == {0, 2}
    (tmp_path / "c/a").mkdir(parents=True)
    sinks.write_json(["one", "two"], tmp_path / "c/a/chunks.json")
    sinks.write_json(["three"], tmp_path / "c/b.chunks.json")
    df = spark.createDataFrame([(2, [5.0, 6.0]), (0, [1.0, 2.0]), (1, [3.0, 4.0])], "vec_id long, embedding array<float>")
    assert sinks.write_vectors(df, tmp_path / "c/a/embeddings.npy") == (3, 2) and np.load(tmp_path / "c/a/embeddings.npy").tolist() == [[1, 2], [3, 4], [5, 6]]
    with pytest.raises(FileNotFoundError, match="b.embeddings.npy"):
        readers.cached_paths(spark, f"{tmp_path}/c", ["a", "b"])
    assert sinks.write_vectors(df.limit(0), tmp_path / "c/b.embeddings.npy") == (0, 0)
    paths = readers.cached_paths(spark, f"{tmp_path}/c", ["a", "b"])
    assert sorted((r.label, r.chunk_index, r.text) for r in readers.cached_chunks(spark, paths).collect()) == [("a", 0, "one"), ("a", 1, "two"), ("b", 0, "three")]
    sinks.write_json({"a": [1, 2], "b": "x"}, tmp_path / "d.json")
    assert readers.json_document(spark, f"{tmp_path}/d.json").first().asDict() == {"a": [1, 2], "b": "x"}


def test_queries_without_sql(spark):
    """Values of the named queries that SQL can't express, against the libraries themselves."""
    import public_tokenizers
    import tiktoken.load

    from strataform.catalog import QUERIES

    rows = queries.chunks(spark, SF).collect()
    ranks = tiktoken.load.load_tiktoken_bpe(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    codec, want = tiktoken.Encoding("x", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), {}
    for r in rows:
        for i in codec.encode_ordinary(r.text):
            want[r.label, i] = want.get((r.label, i), 0) + 1
    assert {(r.label, r.id): r.cnt for r in QUERIES["t3_tokens_bpe"](spark, SF).collect()} == want

    encoder, of = semantic.HashedGrams(), {}
    for r in rows:
        v = encoder.tokens(r.text).mean(0)
        of.setdefault(r.label, []).append((v / np.linalg.norm(v)).astype(np.float32))
    for r in QUERIES["x2_embeddings"](spark, SF).collect():
        assert (r.n, r.top1_share, r.top5_share) == pytest.approx((len(of[r.label]), *spectrum(np.stack(of[r.label]))), abs=2e-6)
    for r in QUERIES["x3_standalone"](spark, SF).collect():
        texts = [x.text for x in sorted(rows, key=lambda x: (x.doc_id, x.chunk_in_document)) if x.label == r.label]
        assert (r.n_chunks, r.lzma_ratio, r.top1_share) == pytest.approx((len(texts), ratio(texts), spectrum(np.stack(of[r.label]))[0]), abs=2e-6)

    vecs = {}
    for r in queries.vectors(spark, SF).orderBy("vec_id").collect():
        vecs.setdefault(r.label, []).append(r.embedding)
    unit = {k: (x := np.array(v, float)) / np.linalg.norm(x, axis=1, keepdims=True) for k, v in vecs.items()}
    p = np.random.default_rng(0).normal(size=(next(iter(unit.values())).shape[1], queries.PROJECTIONS))
    p /= np.linalg.norm(p, axis=0)
    grid = int(np.lcm.reduce([len(x) for x in unit.values()]))
    if grid <= 20_000:
        wide = {k: np.repeat(np.sort(x @ p, axis=0), grid // len(x), axis=0) for k, x in unit.items()}
        for r in QUERIES["m15_sliced_wasserstein_random"](spark, SF).limit(5).collect():
            d = wide[r.a] - wide[r.b]
            assert (r.sliced_wasserstein_l1, r.sliced_wasserstein_l2) == pytest.approx((np.abs(d).mean(), np.sqrt((d * d).mean())), abs=2e-6)
    stable = QUERIES["x8_k_stability"](spark, SF).collect()
    assert {r.k for r in stable} == set(queries.CLUSTER_SWEEP) and all(0 <= r.semantic_cluster_js <= np.log(2) + 1e-6 for r in stable)
    files = sorted(x for x in os.listdir(SF))
    raw = [open(f"{SF}/{x}", "rb").read() for x in files]
    lines = "\n".join(f"{x} {hashlib.sha256(b).hexdigest()}" for x, b in zip(files, raw, strict=True))
    assert [tuple(r) for r in QUERIES["x17_integrity_manifest"](spark, SF).collect()] == [(len(raw), sum(map(len, raw)), hashlib.sha256(lines.encode()).hexdigest())]


def streamed(texts, size, codec=lambda raw: lzma.compress(raw, preset=6)):
    """The ratio of all texts, ``size`` a stream."""
    raw = ["\n\n".join(([""] if i else []) + texts[i : i + size]).encode() for i in range(0, len(texts), size)]
    return sum(len(codec(x)) for x in raw) / sum(map(len, raw))


def test_codecs_see_all_chunks(spark, monkeypatch):
    panel, chunks, vectors, texts, _ = corpora(spark)
    monkeypatch.setattr(analyses, "MAX_CHUNKS", 5)
    alone = {r.label: r for r in analyses.standalone(chunks, vectors).collect()}
    assert {x: r.lzma_ratio for x, r in alone.items()} == pytest.approx({x: streamed(t, 5) for x, t in texts.items()}) and alone["a"].n_chunks == 24
    for codec, how in (("lzma", lambda raw: lzma.compress(raw, preset=6)), ("gzip", lambda raw: gzip.compress(raw, 9, mtime=0))):
        value = {x: streamed(t, 5, how) for x, t in texts.items()}
        r = analyses.textual_grid(panel, chunks, (codec,), ("stable",), (1,), (256,)).first()
        assert r.bt_compression_gap == pytest.approx(np.mean([value[a] - value[b] for a in "ab" for b in "cd"]))


def test_codec_sees_whole_columns(spark):
    """Every chunk of every column, as often as it is there; runs of 5 numbers are streams."""
    _, chunks, _, texts, _ = corpora(spark, "ab", 23)
    cols = {(x, i): [c for c in range(60) for _ in range((i * 7 + c + ord(x)) % 3)] for x in "ab" for i in range(23)}
    rows = chunks.join(spark.createDataFrame([(*k, v) for k, v in cols.items()], "label string, chunk_index long, cols array<int>"), ["label", "chunk_index"])
    got = {(r.label, r.col): r.lzma_ratio for r in composed.ratios(rows, 60, 5).collect()}
    assert len(got) == 120
    for (x, c), value in got.items():
        raw = ["\n\n".join(([""] if i else []) + [texts[x][k] for k in range(i, min(i + 5, 23)) for _ in range(cols[x, k].count(c))]).encode() for i in range(0, 23, 5)]
        assert value == pytest.approx(sum(len(lzma.compress(y, preset=6)) for y in raw) / sum(map(len, raw)))


def test_codec_sees_whole_mixtures(spark, monkeypatch):
    """Places of a mixture are cut into streams of 5; a stream of several mixtures is packed once."""
    panel, chunks, vectors, texts, _ = corpora(spark)
    monkeypatch.setattr(analyses, "MAX_CHUNKS", 5)
    packed, real = [], compression.stream_sizes
    monkeypatch.setattr(compression, "stream_sizes", lambda rows, by, *a: packed.append(rows.select(by).distinct().count()) or real(rows, by, *a))
    got = {(r.base, r.target, r.alpha): r.lzma_ratio for r in analyses.mixture_panel(panel, chunks, vectors, (0.0, 0.25, 0.5, 1.0), **CELL).collect()}
    for (a, b, x), value in got.items():
        n = round(24 * x)
        assert value == pytest.approx(streamed(texts[a][: 24 - n] + texts[b][:n] if a < b else texts[b][:n] + texts[a][: 24 - n], 5))
    assert len(got) == 8 and packed == [5 + 5 + 2 + 3 + 4]  # of 8 x 5


def test_composed_corpora_are_cut_by_places(spark):
    _, chunks, _, texts, _ = corpora(spark, "ab", 23)
    times = {(x, i): (i * 5 + ord(x)) % 9 for x in "ab" for i in range(23)}
    members = spark.createDataFrame([("m", *k, v) for k, v in times.items()] + [("b", "b", 3, 1)], "label string, of string, chunk_index long, times long")
    got = {r.label: r.lzma_ratio for r in compression.composed_ratios(chunks, members, 4).collect()}
    assert got == pytest.approx({"m": streamed([texts[x][i] for x, i in sorted(times) for _ in range(times[x, i])], 4), "b": streamed([texts["b"][3]], 4)})


def test_codecs_leave_out_corpora_of_no_pair(spark, monkeypatch):
    panel, chunks, _, _, _ = corpora(spark)
    more = chunks.unionByName(chunks.filter("label = 'a'").withColumn("label", F.lit("z")))
    packed, real = [], compression.stream_sizes
    monkeypatch.setattr(compression, "stream_sizes", lambda rows, by, *a: packed.append(rows.select("label").distinct().count()) or real(rows, by, *a))
    analyses.textual_grid(panel, more, ("zlib",), ("stable",), (1,), (256,)).count()
    assert packed == [4]
