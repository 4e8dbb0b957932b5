"""Very long texts and urls, and columns whose names clash with the results', for every operator that its own tests don't try with them."""

import random
import zlib

import pytest
from pyspark.sql import functions as F

from strataform.llm import fingerprints, jaccard_join, license_scan, mixing, quality_classifier, quality_rules, registry, url_filter
from tests.llm import test_op1, test_op3, test_op5, test_op9, test_op10
from tests.llm.helpers import WORDS, frame, tricky

#: Names that results use, as columns of the input.
CLASHING = ["score", "predicted", "held_out", "kept", "size", "taken", "target", "source_size", "n_words", "component_id", "n_shingles", "n_tokens", "ids", "n", "form", "output", "labels", "base_labels", "fingerprint", "near_next", "first_word", "start"]
DOCUMENTS = ["op1_fingerprints", "op2_bpe", "op5_jaccard_join", "op6_quality_classifier", "op7_mixing", "op8_token_store", "op9_quality_rules", "op10_license_scan", "op11_fill_middle"]


def long_texts():
    """About a megabyte each: prose in lines, one line, one word, a near copy of the first."""
    r = random.Random(9)
    words = [r.choice(WORDS) + str(r.randrange(10**6)) for _ in range(120_000)]
    lines = "\n".join(" ".join(words[i : i + 12]) for i in range(0, len(words), 12))
    return [(500, lines), (501, " ".join(words)), (502, "z" * 1_000_000), (503, lines + "\nGNU General Public License"), (504, "short text of a few words")]


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    plain, wide = (str(tmp_path_factory.mktemp(x)) for x in ("plain", "wide"))
    docs = frame(spark, tricky())
    for folder, df in ((plain, docs), (wide, docs.select(*docs.columns, *(F.lit("x").alias(c) for c in CLASHING)))):
        df.coalesce(2).write.mode("overwrite").parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([(i, i % 2, 0) for i in range(60)], "doc_id long, quality int, toxic int").write.mode("overwrite").parquet(f"{folder}/labels.parquet")
    return plain, wide


@pytest.mark.parametrize("name", DOCUMENTS)
def test_clashing_columns(spark, folders, name):
    """Queries give the same rows, whatever else their table holds."""
    one, other = (registry.queries()[name](spark, folder) for folder in folders)
    assert one.columns == other.columns and sorted(map(str, one.collect())) == sorted(map(str, other.collect()))


def test_operators_replace_clashing_columns(spark, folders):
    """Operators that pass columns on: theirs win, others stay."""
    wide = spark.read.parquet(f"{folders[1]}/documents.parquet")
    for out in (quality_rules.quality_rules(wide), license_scan.license_scan(wide.drop("labels")), mixing.mix_documents(wide)):
        assert len(out.columns) == len(set(out.columns)) and out.count() == wide.count()


def test_long_texts(spark):
    rows = long_texts()
    docs = frame(spark, rows).repartition(3).cache()
    text = dict(rows)

    got = {r.doc_id: r for r in quality_rules.quality_rules(docs).collect()}
    for i, t in rows:
        want = test_op9.brute(t)
        assert all(got[i][k] == (pytest.approx(v) if isinstance(v, float) else v) for k, v in want.items()), i

    got = {r.doc_id: r for r in license_scan.license_scan(docs).collect()}
    for i, t in rows:
        n, hits, first, last, labels = test_op10.brute(t)
        assert (got[i].n_words, got[i].n_base, got[i].first_word, got[i].last_word, got[i].base_labels) == (n, hits, first, last, labels)

    got = {r.doc_id: r for r in jaccard_join.jaccard_classes(docs).collect()}
    assert {i: got[i].n_shingles for i in text} == {i: len(test_op5.shingles(t)) for i, t in rows}
    assert got[500].component_id == got[501].component_id == got[503].component_id == 500 and got[502].component_id == 502

    got = {r.doc_id: r for r in fingerprints.fingerprints(docs).collect()}
    assert sorted(str((i, r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9))) for i, r in got.items()) == test_op1.brute(rows)

    model = quality_classifier.fit(docs, spark.createDataFrame([(i, i % 2, 0) for i in text], "doc_id long, quality int, toxic int"))
    assert all(0 <= r.score <= 1 and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in quality_classifier.classify(docs, model).collect())
    sizes = {r.doc_id: (r.size, r.taken) for r in mixing.mix_documents(docs).collect()}
    assert {i: s for i, (s, _) in sizes.items()} == {i: len(test_op9.WORD.findall(t)) for i, t in rows} and all(t <= 2 * s for s, t in sizes.values())


def test_long_urls(spark):
    long = "a" * 200_000
    rows = [(1, f"http://x.example.com/de/{long}", None), (2, f"http://{long}.example.net/en/1", None), (3, "http://" + "b." * 50_000 + "org/fr/", None), (4, f"http://k.net/{long}?{long}#{long}", None), (5, long, None)]
    got = {r.page_id: r for r in url_filter.url_filter(test_op3.pages(spark, rows)).collect()}
    assert [got[i].verdict for i in range(1, 6)] == ["block", "allow", "allow", "block", "allow"] and [got[i].rule for i in range(1, 6)] == ["example.com/de/", "example.net/en/", "org/fr/", "net/", None]
    assert got[1].path == f"/de/{long}" and got[5].host == "" == got[5].path
