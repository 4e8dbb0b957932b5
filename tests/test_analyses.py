"""Whole analyses on a small panel, and the catalogue."""

import json

import pytest
from pyspark.sql import functions as F

from strataform.operators import pairs, semantic
from strataform.plans import analyses, queries
from strataform.sources import sinks

SF = "/root/testdata/sf0.001"


def test_matrix_package_and_figures(spark, tmp_path):
    panel = queries.panel(spark, SF).filter("ord IN (0, 1, 6, 7)")
    chunks = queries.indexed(spark, SF).join(panel.select("label"), "label").cache()
    vectors = semantic.embed(chunks).selectExpr("label", "chunk_index AS vec_id", "embedding")
    out = f"{tmp_path}/m"
    analyses.corpus_matrix(panel, chunks, vectors, out)
    rows = {(r.a, r.b): r for r in spark.read.parquet(f"{out}/pairs").collect()}
    assert len(rows) == 12
    for (a, b), r in rows.items():
        other = rows[b, a]
        assert r.semantic_cluster_js == other.semantic_cluster_js and r.compression_abs_diff == other.compression_abs_diff and 0 <= r.lexical_js <= 0.6932
    fam = {r.pair_class: r for r in spark.read.parquet(f"{out}/family").collect()}
    assert {k: v.pairs for k, v in fam.items()} == {"broad_broad": 1, "broad_targeted": 4, "targeted_targeted": 1}
    assert fam["broad_broad"].lexical_js == pytest.approx((rows["src0", "src1"].lexical_js + rows["src1", "src0"].lexical_js) / 2)
    figures = analyses.figure_data(out, spark)
    assert figures["lexical_js"].count() == 4 and figures["multipliers"].count() == 1
    entry = analyses.package("src0", "Source 0", {"source": "x"}, out, f"{tmp_path}/sub", spark)
    assert json.loads((tmp_path / "sub/entry.json").read_text())["label"] == "src0" and len(entry["pairs"]) == 6 and (tmp_path / "sub.zip").exists()
    with pytest.raises(ValueError):
        analyses.corpus_matrix(panel, chunks, vectors.filter("vec_id > 0"), out)


def test_bootstrap_resumes(spark, tmp_path):
    panel = queries.panel(spark, SF).filter("ord IN (0, 6)")
    chunks = queries.indexed(spark, SF).join(panel.select("label"), "label").cache()
    first = {(r.replicate, r.pair_class): r.lexical_js for r in analyses.bootstrap(panel, chunks, 2, f"{tmp_path}/ck").collect()}
    again = {(r.replicate, r.pair_class): r.lexical_js for r in analyses.bootstrap(panel, chunks, 3, f"{tmp_path}/ck", batch=2).collect()}
    assert len(first) == 2 and len(again) == 3 and all(again[k] == v for k, v in first.items())


def test_build_chunks(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text("".join(json.dumps({"body": "word " * 300 + str(i)}) + "\n" for i in range(4)) + "bad\n")
    (tmp_path / "b.jsonl").write_text("".join(json.dumps({"body": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "answer " * 100 + str(i)}]}) + "\n" for i in range(3)))
    sinks.write_json({"defaults": {"source_type": "jsonl", "field": "body"}, "corpora": [{"label": "a", "path": "a.jsonl"}, {"label": "b", "path": "b.jsonl", "mode": "message_list_last_assistant"}]}, tmp_path / "r.json")
    with pytest.raises(ValueError, match="too few"):
        analyses.build_chunks(spark, f"{tmp_path}/r.json", f"{tmp_path}/x", str(tmp_path))
    analyses.build_chunks(spark, f"{tmp_path}/r.json", f"{tmp_path}/out", str(tmp_path), allow_short=True)
    n = {r.label: r.n for r in spark.read.parquet(f"{tmp_path}/out/chunks").groupBy("label").agg(F.count("*").alias("n")).collect()}
    assert n == {"a": 8, "b": 3}
    with pytest.raises(Exception):
        analyses.build_chunks(spark, f"{tmp_path}/r.json", f"{tmp_path}/out", str(tmp_path), allow_short=True)


def test_catalogue(spark):
    import __spark_entry__ as e

    known, sql = e.queries(), e.oracle_sql()
    assert set(sql) <= set(known) and len(known) >= 60
    assert e.entry(spark).count() == 3
    assert pairs.unordered(queries.panel(spark, SF)).count() == 190


def test_queries_equal_duckdb(spark):
    from strataform.catalog import ORACLES, QUERIES
    from tests.compare import compare, duck

    con = duck(SF)
    for name in ("e4_transcript_last_assistant", "s1_tolerant_json", "c6_chunk_provenance", "a17_length_summary", "r1_vocab_topk", "m2_lexical_js_cell", "a13_leave_one_out", "m15_sliced_wasserstein_axes", "c10_split_baseline", "x14_validate_registry"):
        a, b = compare(spark, con, SF, name, QUERIES[name], ORACLES[name])
        assert a == b, name


def test_only_codecs_have_a_budget(spark, monkeypatch):
    """Draws, halves and mixtures see all chunks; with a small budget they still equal the SQL over whole tables."""
    import __spark_entry__  # noqa: F401  fills the catalog
    from strataform.catalog import ORACLES, QUERIES
    from strataform.operators import chunking
    from tests.compare import compare, duck

    monkeypatch.setattr(queries, "MAX_CHUNKS", 3)
    monkeypatch.setattr(analyses, "MAX_CHUNKS", 3)
    con = duck(SF)
    for name in ("c10_split_baseline", "a14_bootstrap_quantiles", "x10_mixture_lexical"):
        a, b = compare(spark, con, SF, name, QUERIES[name], ORACLES[name])
        assert a == b, name
    rows = queries.chunks(spark, SF)
    whole = sorted((r.label, r.doc_id, r.chunk_in_document, r.chunk_index) for r in chunking.budget(rows, 10**9).collect())
    for some in (queries.numbered(spark, SF), chunking.numbered(rows, [])):
        assert sorted((r.label, r.doc_id, r.chunk_in_document, r.chunk_index) for r in some.collect()) == whole
    n = {r.label: r.n_chunks for r in QUERIES["x3_standalone"](spark, SF).collect()}
    assert sum(n.values()) == len(whole) and max(n.values()) > 3
    assert max(r["count"] for r in queries.sampled(spark, SF).groupBy("label").count().collect()) == 3
