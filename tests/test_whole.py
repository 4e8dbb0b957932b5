"""Whole corpora without a row, task or driver that holds all of one."""

import hashlib
import lzma

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataform.operators import compression, sampling, scorecard
from strataform.sources import vector_parts as parts


def test_whole_compression(spark):
    texts = {"a": [f"text {i % 7} é" * (1 + i % 5) for i in range(23)], "b": ["", None], "c": ["x"], None: ["no label", "none"]}
    rows = [(k, i, t, 9) for k, ts in texts.items() for i, t in enumerate(ts)]
    df = spark.createDataFrame(rows, "label string, chunk_index long, text string, block int")
    got = {r.label: r.lzma_ratio for r in compression.whole_ratios(df, ("lzma",), 10).collect()}
    for label, ts in texts.items():
        joined = ["\n\n".join(([""] if i else []) + [t or "" for t in ts[i : i + 10]]).encode() for i in range(0, len(ts), 10)]
        want = sum(len(lzma.compress(x, preset=6)) for x in joined) / sum(map(len, joined))
        assert got[label] == pytest.approx(want) and sum(map(len, joined)) == len("\n\n".join(t or "" for t in ts).encode())
    one = {r.label: (r.lzma_ratio, r.zlib_ratio) for r in compression.whole_ratios(df, ("lzma", "zlib")).collect()}
    assert one == {r.label: (r.lzma_ratio, r.zlib_ratio) for r in compression.ratios(df.fillna("", "text"), ("lzma", "zlib")).collect()}
    assert compression.whole_ratios(df.limit(0)).count() == 0
    empty = spark.createDataFrame([("e", 0, None)], "label string, chunk_index long, text string")
    assert compression.whole_ratios(empty).first().lzma_ratio == 0


@pytest.mark.parametrize("spans", [1, 4, 256])
def test_halves_equal_whole_ranks(spark, monkeypatch, spans):
    monkeypatch.setattr(sampling, "SPANS", spans)
    sizes = {"a": 1, "b": 2, "c": 3, "d": 500, "e": 501, None: 40}
    chunks = spark.createDataFrame([(k, i) for k, n in sizes.items() for i in range(n)], "label string, chunk_index long")
    got = {}
    for r in sampling.halves(chunks, spark.range(3).withColumnRenamed("id", "repeat"), 5).collect():
        got.setdefault((r.label, r.repeat), {})[r.chunk_index] = r.half
    number = lambda *key: int(hashlib.md5("|".join(str(k) for k in key if k is not None).encode()).hexdigest()[:8], 16)
    for label, n in sizes.items():
        for repeat in range(3):
            order = sorted(range(n), key=lambda i: (number(5, label, repeat, i), i))
            want = {i: "A" if k < n // 2 else "B" for k, i in enumerate(order[: 2 * (n // 2)])}
            assert got.get((label, repeat), {}) == want
    assert sampling.halves(chunks.limit(0), spark.range(3).withColumnRenamed("id", "repeat"), 5).count() == 0


def test_vector_parts(spark, tmp_path):
    x = np.random.default_rng(3).normal(size=(1000, 6)).astype(np.float32)
    rows = [(i, [float(v) for v in x[i]]) for i in np.random.default_rng(4).permutation(1000)]
    df = spark.createDataFrame([(int(i), v) for i, v in rows], "vec_id long, embedding array<double>").repartition(5)
    parts.write_vector_parts(df, f"{tmp_path}/v", part_bytes=3000)
    names = sorted(p.name for p in (tmp_path / "v").iterdir())
    assert len(names) > 6 and all(n.startswith("part-") for n in names) and names[0] == "part-000000000000000.npy"
    assert np.array_equal(np.concatenate([np.load(tmp_path / "v" / n) for n in names]), x)
    back = parts.vector_parts(spark, f"{tmp_path}/v", "a").orderBy("vec_id").collect()
    assert [r.vec_id for r in back] == list(range(1000)) and np.array_equal(np.array([r.embedding for r in back], np.float32), x)
    with pytest.raises(FileExistsError):
        parts.write_vector_parts(df, f"{tmp_path}/v")
    parts.write_vector_parts(df.limit(0), f"{tmp_path}/none")
    assert parts.vector_parts(spark, f"{tmp_path}/none", "a").count() == 0
    for bad in ([(0, [1.0]), (1, [1.0, 2.0])], [(0, None), (1, [1.0])], [(0, [None]), (1, [1.0])]):
        folder = f"{tmp_path}/bad{len(list(tmp_path.iterdir()))}"
        with pytest.raises(Exception, match="vector"):
            parts.write_vector_parts(spark.createDataFrame(bad, "vec_id long, embedding array<float>"), folder)
        assert parts.vector_parts(spark, folder, "a").count() == 0


def test_integrity_by_buckets(spark, tmp_path):
    folder = tmp_path / "f"
    for i in range(30):
        p = folder / f"d{i % 3}" / f"{i}.txt"
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(f"text {i}" * i)
    lines = {}
    for p in folder.rglob("*.txt"):
        name = p.relative_to(folder).as_posix()
        lines.setdefault(hashlib.sha256(name.encode()).hexdigest()[:3], []).append(f"{name} {hashlib.sha256(p.read_bytes()).hexdigest()}")
    whole = "\n".join(f"{b} {hashlib.sha256(chr(10).join(sorted(ls)).encode()).hexdigest()}" for b, ls in sorted(lines.items()))
    r = scorecard.integrity(spark, str(folder)).first()
    assert (r.files, r.sha256) == (30, hashlib.sha256(whole.encode()).hexdigest()) and r.bytes == sum(p.stat().st_size for p in folder.rglob("*.txt"))
    (folder / "d0/0.txt").rename(folder / "d1/00.txt")
    assert scorecard.integrity(spark, str(folder)).select(F.col("sha256")).first()[0] != r.sha256


def test_files_by_blocks(spark, tmp_path, monkeypatch):
    """Names that urls escape, files of several blocks and of none; the manifest's digest is that of its sorted lines."""
    from strataform.sources import readers

    monkeypatch.setattr(readers, "DIGESTED", 1000)
    for name, raw in {"b c%20.bin": b"xy" * 1500, "a/é.bin": b"q", "a.bin": b"", "a/z": bytes(1000)}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(raw)
    files = {p.relative_to(tmp_path).as_posix(): p.read_bytes() for p in tmp_path.rglob("*") if p.is_file()}
    lines = "\n".join(f"{k} {hashlib.sha256(v).hexdigest()}" for k, v in sorted(files.items()))
    assert [tuple(r) for r in scorecard.manifest(spark, str(tmp_path)).collect()] == [(4, 4001, hashlib.sha256(lines.encode()).hexdigest())]
    plan = readers.digests(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan
