import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from strataform.llm import token_store as T
from tests.llm.helpers import frame, save, tricky

PATH = public_tokenizers.path("word_bpe_49k.json")


def rows():
    return tricky() + tricky()[:20] + [(None, "no id"), (70, "a\x0bB é́ ́x <|endoftext|>y ΑΣ İ ﬁ"), (71, "漢字かな" * 500)]


def test_words_equal_library():
    lib, own = Tokenizer.from_file(PATH), T.WordEncoder(PATH, 1, 2)
    texts = [t for _, t in rows()]
    for _ in range(2):
        flat, ofs = own.encode(pa.array(texts))
        assert [flat[a:b].tolist() for a, b in zip(ofs, ofs[1:], strict=False)] == [lib.encode(t or "", add_special_tokens=False).ids + [1] for t in texts]
        ends = T.cuts(flat, ofs)
        assert set(ofs[1:].tolist()) <= set(ends.tolist()) and np.diff(ends, prepend=0).max() <= T.MOST and (np.diff(ends, prepend=0) > 0).all()
    flat, ofs = own.encode(pa.array([], pa.string()))
    assert len(flat) == 0 and ofs.tolist() == [0] and len(T.cuts(flat, ofs)) == 0


def test_plain_words():
    """Joined words have the ids that they have alone, and pieces are counted as the vocabulary's own pattern does."""
    import regex

    r, lib, own = random.Random(6), Tokenizer.from_file(PATH), T.WordEncoder(PATH, 1, 2)
    signs = "abzABZéÉßÿÀ×÷.,;:!?#$%&*()'-_1 9漢İſΣσ\u0301\u0307ǅ<>"
    words = list(dict.fromkeys("".join(r.choice(signs) for _ in range(r.randrange(1, 6))).replace(" ", "") or "x" for _ in range(6000)))
    raw = [w.encode() for w in words]
    pieces = T.pieces_of(np.frombuffer(b"".join(raw), np.uint8), np.array([len(w) for w in raw]))
    pattern = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
    assert all(n == 0 or n == len(pattern.findall(w)) for w, n in zip(words, pieces.tolist(), strict=True)) and {1, 2} <= set(pieces.tolist())
    own.learn(raw)
    assert [own.ids[a : a + n].tolist() for a, n in zip(own.begin, own.size, strict=True)] == [lib.encode(w, add_special_tokens=False).ids for w in words]
    blind = T.WordEncoder(PATH, 1, 2)
    blind.ends[:] = False
    blind.learn(raw)
    assert [blind.ids[a : a + n].tolist() for a, n in zip(blind.begin, blind.size, strict=True)] == [own.ids[a : a + n].tolist() for a, n in zip(own.begin, own.size, strict=True)]


def test_words_of_one_hash(monkeypatch):
    """With a hash that tells hardly any words apart, the bytes decide."""
    lib, own = Tokenizer.from_file(PATH), T.WordEncoder(PATH, 1, 2)
    real, texts = T.W.hashes, [t for _, t in rows()]
    for weak in (True, False, True):
        monkeypatch.setattr(T.W, "hashes", (lambda b, s, e: real(b, s, e) & T.W.U(3)) if weak else real)
        flat, ofs = own.encode(pa.array(texts))
        assert [flat[a:b].tolist() for a, b in zip(ofs, ofs[1:], strict=False)] == [lib.encode(t or "", add_special_tokens=False).ids + [1] for t in texts]


def test_crc_of_parts():
    r = random.Random(0)
    for _ in range(50):
        a, b = r.randbytes(r.randrange(3000)), r.randbytes(r.randrange(70000))
        assert zlib.crc32(a + b) == int(T.shift_crc(np.array([zlib.crc32(a)]), np.array([len(b)]))[0]) ^ zlib.crc32(b)


def test_query_and_reconstruction(spark, tmp_path):
    lib = Tokenizer.from_file(PATH)
    data = sorted(rows(), key=lambda r: (r[0] is not None, r[0] or 0, len(lib.encode(r[1] or "", add_special_tokens=False).ids)))
    want, at = [], 0
    for i, t in data:
        ids = lib.encode(t or "", add_special_tokens=False).ids + [1]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids))
        at += len(ids)
    got = T.op8_token_store(spark, save(spark, tmp_path, rows())).collect()
    assert sorted(map(tuple, got), key=lambda r: r[1]) == [w[:4] for w in want]
    folder = f"{tmp_path}/store"
    name = T.write(frame(spark, rows()), folder, PATH)
    assert sorted(((r.doc_id, r.start, r.ids) for r in T.documents(spark, folder).collect()), key=lambda r: r[1]) == [(w[0], w[1], w[4]) for w in want]
    keys = [bytes(r.key) for r in T.chunks_of(spark, folder).collect()]
    assert len(keys) == len(set(keys)) < sum(len(r["keys"]) for r in T.recipes_of(spark, folder).collect())
    assert name == T.write(frame(spark, rows()).repartition(3), f"{tmp_path}/again", PATH)


def test_long_text_and_other_columns(spark, tmp_path):
    lib, text = Tokenizer.from_file(PATH), " ".join(f"word{i % 7001}" for i in range(300_000))
    docs = spark.createDataFrame([(2, text, "x", 1, 2, 3), (1, "a", "y", 4, 5, 6)], "doc_id long, text string, key string, kind int, start int, n_tokens int")
    T.write(docs, f"{tmp_path}/store", PATH)
    ids = lib.encode(text, add_special_tokens=False).ids + [1]
    got = {r.doc_id: r for r in T.digests(spark, f"{tmp_path}/store").collect()}
    assert (got[2].start, got[2].n_tokens, got[2].ids_crc32) == (got[1].n_tokens, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))


def test_damage_is_found(spark, tmp_path):
    folder = f"{tmp_path}/store"
    T.write(frame(spark, tricky()), folder, PATH)
    staged = spark.read.parquet(f"{folder}/staged")
    import pyspark.sql.functions as F

    staged.withColumn("payload", F.when(F.col("kind") == "chunk", F.concat("payload", F.lit(b"xx")))).write.partitionBy("kind").parquet(f"{tmp_path}/bad/staged")
    spark.read.parquet(f"{folder}/recipes").write.partitionBy("bucket").parquet(f"{tmp_path}/bad/recipes")
    spark.read.parquet(f"{folder}/manifest").write.parquet(f"{tmp_path}/bad/manifest")
    with pytest.raises(Exception, match="payload"):
        T.digests(spark, f"{tmp_path}/bad").collect()


def test_empty(spark, tmp_path):
    T.write(frame(spark, tricky()).limit(0), f"{tmp_path}/store", PATH)
    assert T.digests(spark, f"{tmp_path}/store").count() == 0
