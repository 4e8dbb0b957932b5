import hashlib
from collections import Counter

import numpy as np

import corpus_pipeline as P
from strataform.llm import bpe, quality_classifier
from tests.llm import test_op5, test_op9

SF = "/root/testdata/sf0.001"


def test_stages_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    model = quality_classifier.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    good = {r.doc_id for r in quality_classifier.classify(docs, model).collect() if r.score >= 0.3}
    one = P.keep_good(spark, docs, SF)
    assert {r.doc_id for r in one.collect()} == good and one.columns == docs.columns

    def kept(text):
        m = test_op9.brute(text)
        w = test_op9.WORD.findall(text)
        lines = Counter()
        dup = 0
        for x in text.split("\n"):
            if test_op9.WORD.search(x):
                dup += sum(map(len, test_op9.WORD.findall(x))) if lines[x] else 0
                lines[x] += 1
        return not (m["base_failed"] or dup > 0.3 * m["word_chars"] or any(m[f"dup_{k}gram_share"] > s for k, s in ((5, 0.25), (8, 0.2), (12, 0.2)))) and bool(w)

    fine = {i for i in good if kept(rows[i].text)}
    two = P.keep_unrepetitive(spark, one, SF)
    assert {r.doc_id for r in two.collect()} == fine and two.columns == docs.columns
    single = {i for i, _, c in test_op5.brute([(i, rows[i].text) for i in fine]) if i == c}
    three = P.keep_one_of_each(spark, two, SF)
    assert sorted(r.doc_id for r in three.collect()) == sorted(single) and three.columns == docs.columns
    four = P.mix_sources(spark, three, SF).collect()
    times = Counter(r.doc_id for r in four)
    assert set(times) <= single and max(times.values()) <= 2 and all(r.text == rows[r.doc_id].text for r in four)
    words = lambda i: len(test_op9.WORD.findall(rows[i].text))
    total = sum(map(words, single))
    assert abs(sum(words(i) * n for i, n in times.items()) - 1.5 * total) < 0.1 * total
    codec = bpe.Codec(*bpe.vocabulary())
    want = Counter()
    for i, n in times.items():
        ids = codec.small(rows[i].text)
        want[i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(rows[i].text.encode()).hexdigest()] += n
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in P.run(spark, SF).collect()) == want


def test_odd_documents(spark, tmp_path):
    """Nulls in any column, blank and long texts, repeated rows, clashing and extra columns: every stage passes them on whole."""
    from pyspark.sql import functions as F

    from tests.llm.helpers import frame, tricky

    spark.createDataFrame([(i, i % 2, 0) for i in range(50)] + [(None, 1, 0), (7, None, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = frame(spark, tricky() + tricky()[:12] + [(None, "no id"), (None, None), (70, "word " * 30000)])
    docs = docs.withColumn("n_chars", F.when(F.col("doc_id") % 2 == 0, F.col("n_chars")))
    odd = docs.select("*", *(F.lit("x").alias(c) for c in ("score", "predicted", "kept", "size", "taken", "target", "id", "i", "t", "s", "w", "n_words", "component_id", "n_tokens", "ids")))
    for _, stage in P.STAGES:
        out = stage(spark, odd, str(tmp_path))
        rows = out.collect()
        assert stage is P.STAGES[-1][1] or out.columns == P.COLUMNS
        assert {r.doc_id for r in rows} <= {r.doc_id for r in docs.collect()}
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    once = P.keep_one_of_each(spark, odd, str(tmp_path)).collect()
    key = lambda r: (r.doc_id, r.text)
    stay, all_rows = {key(r) for r in once}, {key(r) for r in docs.collect()}
    assert len(once) == len(stay) and stay <= all_rows and {0, 1, 2, 3} <= {r.doc_id for r in once}
    sets = {k: test_op5.shingles(k[1]) for k in all_rows}
    linked = lambda a, b: sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    for gone in all_rows - stay:  # a copy or near copy, directly or by links, of one that stays
        met, new = {gone}, {gone}
        while new:
            new = {b for b in all_rows - met if any(linked(a, b) for a in new)}
            met |= new
        assert met & stay
    assert len(P.encode(spark, odd, str(tmp_path)).collect()) == docs.count()


def test_one_of_each_keeps_documents_without_an_id_of_their_own(spark):
    """Different texts under one id, or under none, aren't one document; reruns and row order don't matter."""
    say = lambda k, n=40: " ".join(f"{k}{i}" for i in range(n))
    rows = [(3, say("a")), (7, say("x")), (7, say("a") + " more"), (None, say("p")), (None, say("q")), (None, say("q")), (None, say("a")), (None, None), (None, None), (None, " "), (8, None), (8, None), (8, ""), (9, say("r")), (9, say("s"))]
    want = sorted([(3, say("a")), (7, say("x")), (None, say("p")), (None, say("q")), (None, None), (None, None), (None, " "), (8, None), (8, ""), (9, say("r")), (9, say("s"))], key=str)
    for some in (rows, rows[::-1]):
        docs = spark.createDataFrame([(i, t, "en" if k % 2 else "de", f"src{k}", k) for k, (i, t) in enumerate(some)], "doc_id long, text string, lang string, source string, n_chars long")
        assert sorted(((r.doc_id, r.text) for r in P.keep_one_of_each(spark, docs, "").collect()), key=str) == want
