import hashlib
import random

import numpy as np

from strataform.llm import bpe
from tests.llm.helpers import frame, save, tricky

ODD = ["a", "b", " ", "  ", "\n", "'", "s", "'re", "'ll", "1", "23", "é", "漢", "字", ".", "!!", "\t", "\x85", "　", "\x1c", "😀", "ß", "Z", "_", " ' ", "<|endoftext|>"]


def test_tree_equals_library():
    r = random.Random(0)
    for leaf, window in ((2, 1), (7, 2), (16, 32)):
        c = bpe.Codec(*bpe.vocabulary(), leaf=leaf, window=window)
        for _ in range(3000):
            s = "".join(r.choice(ODD) for _ in range(r.randrange(60)))
            ids = c.encode(s)
            assert ids == c.small(s), s
            assert c.decode(ids) == s.encode()


def test_join_is_associative():
    c, r = bpe.Codec(*bpe.vocabulary()), random.Random(1)
    for _ in range(300):
        s = "".join(r.choice(ODD) for _ in range(60))
        i, j = sorted(r.sample(range(len(s) + 1), 2))
        a, b, d = c.small(s[:i]), c.small(s[i:j]), c.small(s[j:])
        left = c.join(s, 0, j, len(s), c.join(s, 0, i, j, list(a), list(b)), list(d))
        assert left == c.join(s, 0, i, len(s), list(a), c.join(s, i, j, len(s), list(b), list(d))) == c.small(s)


def test_long_text_and_other_columns(spark):
    c, text = bpe.Codec(*bpe.vocabulary()), "some words, and 12 numbers; " * 40_000
    docs = spark.createDataFrame([(1, text, "x", 5), (None, text, "y", 6)], "doc_id long, text string, ids string, n_tokens int").withColumn("decoded", bpe_lit())
    got = bpe.bpe_round_trip(docs, *bpe.vocabulary()).collect()
    ids = c.small(text)
    assert {(r.n_tokens, r.ids, r.ids_sha256) for r in got} == {(len(ids), k, hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()) for k in "xy"}


def bpe_lit():
    from pyspark.sql import functions as F

    return F.lit(0)


def test_query_and_round_trip(spark, tmp_path):
    rows = tricky() + tricky()[:15] + [(300, "漢字" * 3000), (301, "a" * 9000), (302, "<|endoftext|> x")]
    c = bpe.Codec(*bpe.vocabulary())
    got = sorted(tuple(r) for r in bpe.op2_bpe(spark, save(spark, tmp_path, rows)).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect())
    want = []
    for i, t in rows:
        ids = c.small(t or "")
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want)
    docs = frame(spark, rows)
    back = bpe.bpe_decode(bpe.bpe_encode(docs, *bpe.vocabulary()), *bpe.vocabulary()).collect()
    assert all(bytes(r.decoded) == (r.text or "").encode() for r in back) and len(back) == len(rows)
    assert bpe.bpe_round_trip(docs.limit(0), *bpe.vocabulary()).count() == 0
