"""Text functions and chunks against plain Python."""

import hashlib
import re

from pyspark.sql import functions as F

from strataform.config import Chunking
from strataform.functions import text as T
from strataform.operators import chunking, extract, sampling

TEXTS = [None, "", "  ", "  NBSP padded\x1c", "emoji 😀 a😀b", "x" * 191, "x" * 192, "x" * 768, "x" * 769, ("a" * 100 + " " * 700 + "b" * 800 + " ") * 3, "don't stop — naïve_case 3.14　ok", "a\x85b", "İstanbul ẞ"]


def frame(spark):
    return spark.createDataFrame([(f"c{i % 2}", i, t) for i, t in enumerate(TEXTS)], "label string, doc_id long, text string")


def windows(text, w=768, most=None):
    text, out = text.strip(), []
    for s in range(0, len(text), w):
        c = text[s : s + w].strip()
        if len(c) >= max(64, w // 4):
            out.append((s, min(len(text), s + w), c))
    return out[:most]


def test_strip_and_tokens(spark):
    rows = frame(spark).filter("text IS NOT NULL").select("text", T.strip("text").alias("s"), T.tokens("text", "punct").alias("p"), T.tokens("text", "stable").alias("t"), T.ngrams(T.tokens("text", "punct"), 2).alias("g")).collect()
    for r in rows:
        punct = re.findall(r"[A-Za-z0-9]+(?:'[A-Za-z0-9]+)?|[^\sA-Za-z0-9]", r.text.lower())
        assert r.s == r.text.strip() and r.p == punct and r.t == re.findall(r"[A-Za-z0-9_']+", r.text.lower())
        assert r.g == [" ".join(punct[i : i + 2]) for i in range(len(punct) - 1)]


def test_windows(spark):
    for most in (None, 1, 2):
        got = {}
        for r in chunking.chunk(frame(spark), Chunking(per_document=most)).collect():
            got.setdefault(r.doc_id, []).append((r.char_start, r.char_end, r.text))
        assert {k: sorted(v) for k, v in got.items()} == {i: windows(t, most=most) for i, t in enumerate(TEXTS) if t and windows(t, most=most)}


def test_budget_and_statistics(spark):
    chunks = chunking.chunk(frame(spark), Chunking(per_document=None))
    assert all(r.n <= 2 for r in chunking.budget(chunks, 2).groupBy("label").agg(F.count("*").alias("n")).collect())
    s = {r.label: r for r in chunking.build_statistics(frame(spark)).collect()}
    assert sum(r.source_rows_seen for r in s.values()) == len(TEXTS)
    assert sum(r.source_documents_extracted for r in s.values()) == sum(bool(t and t.strip()) for t in TEXTS)
    for r in chunking.provenance(frame(spark)).collect():
        assert r.source_text_sha256 == hashlib.sha256(TEXTS[r.doc_id].strip().encode()).hexdigest()


def test_transcripts(spark):
    p1, p2 = r"(?:^|\n)\s*Assistant:\s*", r"(?:^|\n|\s)Human:\s*"
    texts = ["\n\nHuman: hi\n\nAssistant: yes\n\nHuman: more", "\n\nHuman: no one", "Assistant: first", "\n\nHuman: a\n\nAssistant: b\n\nAssistant: c Human: d", "\n\nAssistant:", "x Assistant: inline"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.last_assistant("t").alias("r")).collect()
    for r in rows:
        m = list(re.finditer(p1, r.t))
        assert r.r == (re.split(p2, r.t[m[-1].end() :], maxsplit=1)[0].strip() if m else None)


def test_message_lists(spark):
    rows = spark.createDataFrame([(1, []), (2, None), (3, [("user", "a"), ("assistant", " b ")]), (4, [("assistant", "a"), ("user", "b")]), (5, [("assistant", None)]), (6, [("assistant", " ")])], "id long, messages array<struct<role string, content string>>")
    assert [(r.id, r.text) for r in extract.last_message(rows, "messages").collect()] == [(3, "b")]
    turns = spark.createDataFrame([("assistant", "en", d, "x") for d in (True, False, None)] + [("user", "en", None, "y"), ("assistant", "de", None, "z")], "role string, lang string, deleted boolean, text string")
    assert extract.role_language(turns, "text").count() == 2


def test_samples(spark):
    docs = spark.range(200).select(F.concat(F.lit("c"), F.col("id") % 2).alias("label"), F.col("id").alias("doc_id"))
    a = sampling.reservoir(docs, 10, 1)
    assert {(r.label, r.document_sample_rank) for r in a.collect()} == {(f"c{i}", k) for i in (0, 1) for k in range(10)}
    assert sorted(a.collect()) == sorted(sampling.reservoir(docs.repartition(7), 10, 1).collect()) != sorted(sampling.reservoir(docs, 10, 2).collect())
    want = hashlib.md5(b"5|c0|3").hexdigest()[:8]
    assert spark.range(1).select(T.draw(F.lit(5), F.lit("c0"), F.lit(3))).first()[0] == int(want, 16)
    chunks = spark.createDataFrame([(f"c{i}", k) for i in (0, 1) for k in range(5)], "label string, chunk_index long")
    halves = sampling.halves(chunks, spark.range(3).withColumnRenamed("id", "repeat"), 1)
    assert {(r.repeat, r.label, r.half): r.n for r in halves.groupBy("repeat", "label", "half").agg(F.count("*").alias("n")).collect()} == {(k, f"c{i}", h): 2 for k in range(3) for i in (0, 1) for h in "AB"}
    pairs = spark.createDataFrame([("c0", "c1")], "base string, target string")
    mixed = sampling.mixture(chunks, pairs, spark.createDataFrame([(0.0,), (0.1,), (0.3,), (0.5,), (1.0,)], "alpha double"))
    assert {(r.alpha, r.label): r.n for r in mixed.groupBy("alpha", "label").agg(F.count("*").alias("n")).collect()} == {(0.0, "c0"): 5, (0.1, "c0"): 5, (0.3, "c0"): 3, (0.3, "c1"): 2, (0.5, "c0"): 3, (0.5, "c1"): 2, (1.0, "c1"): 5}
