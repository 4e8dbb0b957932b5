"""Readers, sinks and the streaming ingest."""

import gzip
import json

import numpy as np
import pytest

from strataform.sources import readers, sinks


def test_json_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"t": 1}\n\nnot json\n[1]\n{"t": 2}\n{"t": 3} x\n5\n')
    with gzip.open(tmp_path / "b.jsonl.gz", "wt") as f:
        f.write('{"t": "é"}\n')
    rows = readers.json_lines(spark, f"{tmp_path}/*.jsonl*").orderBy("source_index").collect()
    assert [(r.source_ref.rsplit("/", 1)[1], r.line_no, r.source_index) for r in rows] == [("a.jsonl", 1, 0), ("a.jsonl", 5, 1), ("b.jsonl.gz", 1, 2)]


def test_shards(spark, tmp_path):
    for name in ("c4-0001.jsonl", "wiki-0001.jsonl"):
        (tmp_path / name).write_text('{"x": 1}\nbad\n{"x": 2}\n{"x": 3}\n')
    urls = spark.createDataFrame([(f"{tmp_path}/c4-0001.jsonl",), (f"{tmp_path}/wiki-0001.jsonl",)], "url string")
    assert readers.shards(spark, urls, per_shard=3).count() == 4
    assert readers.shards(spark, urls, include="wiki", per_shard=3).count() == 2
    assert readers.shards(spark, urls, exclude="wiki, c4").count() == 0


def test_dispatch_and_recipe(spark, tmp_path):
    (tmp_path / "x.txt").write_text("one\ntwo")
    assert readers.source(spark, {"source_type": "text", "path": "*.txt"}, str(tmp_path)).first().text == "one\ntwo"
    with pytest.raises(ValueError):
        readers.source(spark, {"source_type": "nope", "path": "x"})
    sinks.write_json({"defaults": {"mode": "field_text", "field": "body"}, "corpora": [{"label": "a"}, {"label": "b", "field": "text", "role": "targeted"}]}, tmp_path / "panel.json")
    got = {r.label: r for r in readers.recipe(spark, f"{tmp_path}/panel.json").collect()}
    assert (got["a"].field, got["a"].role, got["a"].mode, got["b"].field, got["b"].role, got["b"].chunk_chars) == ("body", "broad", "field_text", "text", "targeted", 768)


def test_manifest_vectors_checkpoint(spark, tmp_path):
    np.save(tmp_path / "v.npy", np.arange(6, dtype=np.float32).reshape(3, 2))
    assert [r.embedding for r in readers.vectors(spark, f"{tmp_path}/v.npy", "a").orderBy("vec_id").collect()] == [[0, 1], [2, 3], [4, 5]]
    sinks.write_json({"corpora": [{"label": "a", "embeddings": "v.npy"}, {"label": "b", "embeddings": "gone.npy"}]}, tmp_path / "m.json")
    with pytest.raises(FileNotFoundError, match="gone"):
        readers.manifest(spark, f"{tmp_path}/m.json", str(tmp_path), ("embeddings",))
    assert readers.checkpoint(spark, f"{tmp_path}/none", "replicate long").count() == 0
    sinks.append_json_lines(spark.range(2).withColumnRenamed("id", "replicate"), f"{tmp_path}/ck")
    sinks.append_json_lines(spark.range(1).withColumnRenamed("id", "replicate"), f"{tmp_path}/ck")
    assert readers.checkpoint(spark, f"{tmp_path}/ck", "replicate long").count() == 3
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad/x.json").write_text('{"replicate": 1}\n{oops\n')
    with pytest.raises(Exception):
        readers.checkpoint(spark, f"{tmp_path}/bad", "replicate long").collect()


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 0.123456, None), ("b", float("nan"), 3)], "x string, y double, z long")
    assert sinks.markdown(df, "T").splitlines()[-2:] == ["| a | 0.1235 | NA |", "| b | NA | 3 |"]
    sinks.write_new(df, f"{tmp_path}/t")
    with pytest.raises(Exception):
        sinks.write_new(df, f"{tmp_path}/t")
    sinks.write_json({"é": 1}, tmp_path / "d/j.json")
    assert json.loads((tmp_path / "d/j.json").read_text()) == {"é": 1} and (tmp_path / "d/j.json").read_text().isascii()
    info = sinks.copy_with_digest(tmp_path / "d/j.json", tmp_path / "d/k/j.json")
    sinks.package(tmp_path / "d", tmp_path / "z.zip")
    import zipfile

    assert zipfile.ZipFile(tmp_path / "z.zip").namelist() == ["j.json", "k/j.json"] and len(info["sha256"]) == 64
    assert readers.digests(spark, f"{tmp_path}/d").count() == 2


def test_stream(spark, tmp_path):
    from strataform.streaming.ingest import chunk_stream

    schema = "label string, doc_id long, text string"
    for k in range(2):
        spark.createDataFrame([("a", k, "word " * 200)], schema).write.parquet(f"{tmp_path}/in/{k}")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in/*")
        chunk_stream(stream, f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination()
        assert spark.read.parquet(f"{tmp_path}/out").count() == 2 * (k + 1)
