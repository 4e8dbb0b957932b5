"""The threshold algorithm against counting everything."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataform.operators import frequent, lexical
from strataform.plans import queries
from strataform.plans.held import release

SF = "/root/testdata/sf0.01"
COLUMNS = ["label", "tokenizer", "n", "gram", "cnt", "first"]


def corpora(spark, seed=0, hot=300):
    """A hot corpus, small ones, one without tokens and one without a name."""
    r, rows = random.Random(seed), []
    words = [f"w{int(r.paretovariate(0.7)) % 4000}" for _ in range(5000)]
    say = lambda n: " ".join(r.choice(words) for _ in range(n))
    rows += [("hot", i // 3, i % 3, say(200)) for i in range(hot)]
    rows += [(f"c{k}", i, 0, say(30)) for k in range(5) for i in range(6)]
    rows += [("blank", 1, 0, " "), ("blank", 2, 0, None), (None, 1, 0, say(50)), ("few", 1, 0, "a b a")]
    return spark.createDataFrame(rows, "label string, doc_id long, chunk_in_document int, text string").repartition(6)


def tops(counts, size):
    return sorted(map(str, lexical.vocabulary(counts, size).select(*COLUMNS, "rank").collect()))


@pytest.mark.parametrize(("size", "room", "gathered"), [(40, 6_000_000, 2_000_000), (200, 3_000, 500), (5, 100, 50)])
def test_vocabularies_equal_counting_all(spark, monkeypatch, size, room, gathered):
    """Whatever room nodes have: those that run out of it become several."""
    monkeypatch.setattr(frequent, "ROOM", room)
    monkeypatch.setattr(frequent, "GATHERED", gathered)
    chunks = corpora(spark)
    got, whole = frequent.frequent_counts(chunks, size), lexical.gram_counts(chunks)
    assert tops(got, size) == tops(whole, size)
    everything = {str(r) for r in whole.select(COLUMNS).collect()}
    assert {str(r) for r in got.collect()} <= everything  # all counts that are given are whole
    release()


def test_other_side_of_pairs(spark):
    """A corpus's frequent grams are counted in all others, too."""
    chunks = corpora(spark)
    counts, whole = frequent.frequent_counts(chunks, 50, ("stable",), (1, 2)), lexical.gram_counts(chunks, ("stable",), (1, 2))
    p = spark.createDataFrame([("hot", "c1"), ("c1", "hot"), ("c2", "few"), ("c3", "blank")], "a string, b string")
    same = [sorted(map(str, lexical.cells(lexical.vocabulary(c, 50), c, p, (50,)).withColumns({m: F.round(m, 9) for m in ("js", "rho")}).collect())) for c in (counts, whole)]
    assert same[0] == same[1] and len(same[0]) > 3
    release()


def test_gives_way_to_counting_all(spark, monkeypatch):
    chunks = corpora(spark)
    whole = tops(lexical.gram_counts(chunks), 30)
    monkeypatch.setattr(frequent, "MOST_SURVIVORS", 10)
    assert tops(frequent.frequent_counts(chunks, 30), 30) == whole
    monkeypatch.setattr(frequent, "MOST_CORPORA", 3)
    assert tops(frequent.frequent_counts(chunks, 30), 30) == whole
    release()


def test_equal_hashes(spark, monkeypatch):
    """Grams whose first hash is the same are told apart by the second."""
    monkeypatch.setattr(frequent, "_hashed", lambda t, seed=None: F.transform(frequent.tokens("text", t), lambda w: F.xxhash64(w, F.lit(seed)) if seed else F.length(w).cast("long")))
    chunks = corpora(spark, hot=40).filter("text IS NOT NULL")
    # pass 1 and 2 then see sums of several grams, which are upper bounds of none: only what pass 3 counts is looked at
    whole = {tuple(r) for r in lexical.gram_counts(chunks, ("stable",), (1,)).select("label", "gram", "cnt", "first").collect()}
    got = [tuple(r) for r in frequent.frequent_counts(chunks, 3, ("stable",), (1,)).select("label", "gram", "cnt", "first").collect()]
    assert got and set(got) <= whole and len(got) == len(set(got))
    release()


def test_few_grams_travel(spark):
    """Of the grid's grams less than a tenth leaves the tasks, all passes together."""
    sizes = queries.raw(spark, SF.replace("0.01", "0.1")).groupBy("label").agg(F.count("*").alias("n"))
    chunks = queries.chunks(spark, SF.replace("0.01", "0.1"))
    listed = [(r.label, r.n) for r in sizes.collect()]
    dealt, settings = frequent._dealt(chunks, listed, ("doc_id", "chunk_in_document")), [(t, n) for t in (0, 1) for n in (1, 2, 3)]
    top = lambda corpus, k, h, n: np.argpartition(n, len(n) - 1024)[-1024:] if len(n) > 1024 else np.arange(len(n))
    some = frequent._sent(dealt, ("punct", "stable"), settings, top).count()
    last = frequent.frequent_counts(chunks, 1024, sizes=sizes)
    assert some + last.count() < 2_000_000  # 15,268,365 sums by corpus and gram reach the shuffle otherwise
    release()


def test_empty(spark):
    chunks = corpora(spark).limit(0)
    assert frequent.frequent_counts(chunks, 10).collect() == []


def test_gram_totals(spark, monkeypatch):
    """Numbers of different grams, of all and of the most frequent equal those of plain counting, however tasks and groups are cut; also where
    64 bits of two grams' hashes are the same, and without a corpus's name. No string is shuffled."""
    chunks = corpora(spark, hot=300)
    plain = lexical.gram_counts(chunks, ("punct",), (1, 2, 3)).groupBy("label", "n").agg(F.count("*").alias("grams"), F.sum("cnt").alias("total"), F.max("cnt").alias("top"))
    want = sorted(map(str, (tuple(r) for r in plain.collect())))
    for rows, gathered, chars in ((2048, 2_000_000, 4 << 20), (7, 50, 100), (7, 2_000_000, 1000)):
        monkeypatch.setattr(frequent, "ROWS", rows), monkeypatch.setattr(frequent, "GATHERED", gathered), monkeypatch.setattr(frequent, "GROUP_CHARS", chars)
        assert sorted(map(str, (tuple(r) for r in frequent.gram_totals(chunks, "punct", (1, 2, 3)).collect()))) == want
    h, g = np.array([5, 9, 5, 5, 9], np.uint64), np.array([1, 2, 3, 1, 2], np.uint32)
    assert [x.tolist() for x in frequent._merged([h[:2], h[2:]], [g[:2], g[2:]], None)] == [[5, 5, 9], [1, 3, 2], [2, 1, 2]]
    assert frequent._merged([h], [g], [np.arange(5)])[2].tolist() == [3, 2, 5]
    assert "gram:string" not in frequent.gram_totals(chunks, "punct", (2,))._jdf.queryExecution().executedPlan().toString()


def test_growing_counts():
    """What a node gathers in parts counts as at once, beyond 32 bits too."""
    rng, node, key = np.random.default_rng(0), frequent.Node(), (0, 1)
    parts = [rng.integers(0, 50 * (i + 1), 400).astype(np.uint64) for i in range(5)]
    for p in parts:
        node.add(key, p)
        node.count()
    h, n = np.unique(np.concatenate(parts), return_counts=True)
    assert node.held == len(h) and (node.known[key][0] == h).all() and (node.known[key][1] == n).all() and node.known[key][1].dtype == np.uint32
    node.known[key] = h, np.full(len(h), 2**32 - 1, np.uint32)
    node.add(key, h[:1])
    node.count()
    assert int(node.known[key][1][0]) == 2**32


def test_word_counts(spark):
    """The vocabularies of plain counting, ties and all, without the place of every word: null and repeated ids, a corpus without a
    name, places that differ only within a document; only leading words come back, with their counts in every corpus."""
    from strataform.config import Chunking
    from strataform.operators import chunking
    from strataform.plans import held

    rule = Chunking(chars=256, per_document=None, per_corpus=None, documents=None)
    rows = [("a", 5, "zeta beta " * 40), ("a", 3, "gamma alpha " * 40), ("a", 3, "delta's beta, " * 30), ("a", -2, "x " + "rare words here " * 40), ("b", None, "alpha zeta " * 50), ("b", 9, "zeta omega " * 50), (None, 1, "beta only " * 40), ("b", 2, None)]
    docs = spark.createDataFrame(rows, "label string, doc_id long, text string")
    plain = lexical.gram_counts(chunking.chunk(docs, rule), ("punct",), (1,))
    for size in (1, 2, 3, 5, 100):
        held.release()
        got = lexical.word_counts(docs, rule, size, "punct")
        assert not any("decimal" in t for df in held._HELD for _, t in df.dtypes)  # what is held of all words are plain numbers
        of = lambda df: sorted(map(str, lexical.vocabulary(df, size).select("label", "tokenizer", "n", "gram", "cnt", "rank", "first").collect()))
        assert of(got) == of(plain)
        leading = {r.gram for r in lexical.vocabulary(plain, size).collect()}
        key = lambda df: {(r.label, r.gram, r.cnt) for r in df.collect()}
        assert {x for x in key(plain) if x[1] in leading} <= key(got) <= key(plain)
    held.release()
