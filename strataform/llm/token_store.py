"""Content-addressed store of token ids (operator 8).

Format, below one folder:

* ``kind=chunk``: ``key`` (SHA-256 of the payload) and ``payload``, ids as little-endian unsigned integers of
  ``width`` bytes. A rolling hash of the last ids cuts each document's id stream, so equal passages give
  equal chunks wherever they stand, and every distinct chunk is stored once.
* ``recipes``: one row per document in ascending ``doc_id`` (files and rows): ``start``, ``n_tokens``, the
  chunks' keys and lengths in order, and the Merkle root over the keys.
* ``manifest``: per range of documents its number of documents and ids and the Merkle root over its
  documents' roots; the root over all ranges is the store's identity.

Reading verifies every chunk against its key, every document's chunks against its root and length, and the
ranges against the manifest. A document's digest is put together from its chunks' digests (a CRC of
concatenated bytes is linear in the parts' CRCs), so no payload travels for it; ``documents`` rebuilds the
ids themselves.

Defined results: null counts as empty, which has the end id alone. Repeated rows keep a row each. Documents
without an id come first. An empty table gives an empty store. Words are found by a 64-bit hash and
recognised by their bytes. Only doc_id and text are read, whatever other columns are called. Very long texts are cut into chunks
as any; a recipe holds a key a chunk.
"""

from __future__ import annotations

import hashlib
import os
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataform.llm import words as W
from strataform.llm.store import new_path, range_bucket, steps, tasks, text_buffers

#: Ids that a rolling hash sees, the mean and the largest length of a chunk.
SEEN, MEAN, MOST = 16, 512, 4096
#: Words, their bytes and chunk keys that a worker remembers.
WORDS, BYTES, KEYS = 1_500_000, 1 << 26, 300_000


# Classes of bytes: letters of the ASCII and Latin-1 ranges, marks, others.
LETTER, MARK, OTHER = 0, 1, 2
KIND = np.full(256, OTHER, np.uint8)
KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B), 0xC3]] = LETTER
KIND[list(b".,;:!?#$%&*()")] = MARK


def pieces_of(buf: np.ndarray, length: np.ndarray) -> np.ndarray:
    """1 for words (one after another in ``buf``) of plain letters, 2 for those with marks behind, else 0.

    A pattern that takes a run of letters, or of other signs, as a piece cuts such words into so many pieces. Letters whose
    normal form or small letter depends on neighbours, or isn't a letter, aren't plain.
    """
    if not len(length):
        return np.zeros(0, np.int64)
    kind = KIND[buf]
    after = np.flatnonzero(buf[:-1] == 0xC3) + 1  # the second bytes of Latin-1 letters, without the two signs among them
    kind[after[(buf[after] != 0x97) & (buf[after] != 0xB7)]] = LETTER
    ends = np.cumsum(length)
    first = ends - length
    odd = kind == OTHER
    odd[1:] |= (kind[1:] == LETTER) & (kind[:-1] == MARK)
    odd[first] = kind[first] != LETTER  # words begin with a letter, whatever stands before them
    good = np.add.reduceat(odd.astype(np.int64), first) == 0
    return np.where(good, 1 + (kind[ends - 1] == MARK), 0)


class WordEncoder:
    """Encodes texts word by word: no token of a vocabulary that drops white space crosses it."""

    def __init__(self, path: str, end_id: int, width: int):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.type = np.dtype(f"<u{width}")
        self.end_id = end_id
        vocab, suffix = self.tokenizer.get_vocab(with_added_tokens=False), getattr(self.tokenizer.model, "end_of_word_suffix", None)
        #: By id, whether a token ends a piece of a word; none do if the vocabulary doesn't mark that.
        self.ends = np.zeros(max(vocab.values(), default=0) + 1, bool)
        if suffix:
            self.ends[[i for token, i in vocab.items() if token.endswith(suffix)]] = True
        self.forget()

    def forget(self) -> None:
        """Words in the order they were learnt: where their ids and their bytes begin, and how many there are; and their
        hashes, ascending, with the number of each one's word."""
        none = np.zeros(0, np.int64)
        self.begin, self.size, self.text, self.length = none, none, none, none
        self.ids, self.bytes = np.zeros(0, self.type), np.zeros(0, np.uint8)
        self.hash, self.number = np.zeros(0, W.U), none

    def learn(self, words: list[bytes]) -> None:
        """Add the ids of ``words``."""
        length = np.fromiter(map(len, words), np.int64, len(words))
        blob = np.frombuffer(b"".join(words), np.uint8)
        pieces = pieces_of(blob, length)
        plain, rest = np.flatnonzero(pieces), np.flatnonzero(pieces == 0)
        ids = self._joined([words[i] for i in plain.tolist()])
        last = np.flatnonzero(self.ends[ids])
        if len(last) != pieces.sum() or (len(ids) and not self.ends[ids[-1]]):  # a vocabulary without marks: one by one
            plain, rest, ids, last = plain[:0], np.arange(len(words)), ids[:0], last[:0]
        got = [x.ids for x in self.tokenizer.encode_batch_fast([words[i].decode() for i in rest.tolist()], add_special_tokens=False)]
        size, order = np.zeros(len(words), np.int64), np.argsort(np.concatenate([plain, rest]))
        size[plain] = np.diff(last[np.cumsum(pieces[plain]) - 1], prepend=-1)
        size[rest] = np.fromiter(map(len, got), np.int64, len(got))
        found = np.cumsum(size[np.concatenate([plain, rest])])
        more = lambda old, new: np.concatenate([old, new])
        self.begin, self.text = more(self.begin, found[order] - size + len(self.ids)), more(self.text, np.cumsum(length) - length + len(self.bytes))
        self.size, self.length = more(self.size, size), more(self.length, length)
        self.ids = np.concatenate([self.ids, ids.astype(self.type), np.fromiter(chain.from_iterable(got), self.type, int(size[rest].sum()))])
        self.bytes = more(self.bytes, blob)

    def _joined(self, words: list[bytes]) -> np.ndarray:
        """The ids of plain words, encoded many at once: white space parts them, so each is encoded as alone."""
        lines = [b" ".join(words[i : i + 256]).decode() for i in range(0, len(words), 256)]
        got = [x.ids for x in self.tokenizer.encode_batch_fast(lines, add_special_tokens=False)]
        return np.fromiter(chain.from_iterable(got), np.int64, sum(map(len, got)))

    def places(self, buf: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        """The number of every word ``buf[s:e]`` among the known ones, new ones learnt.

        A hash finds the number, the bytes decide: where a word isn't the one that was learnt for its hash, this
        batch's words are learnt anew, each distinct one under a number of its own.
        """
        if len(self.begin) > WORDS or len(self.bytes) > BYTES or len(self.hash) < len(self.begin):
            self.forget()
        h = W.hashes(buf, s, e)
        order = np.argsort(h)
        ranked = h[order]
        new = np.ones(len(h), bool)
        new[1:] = ranked[1:] != ranked[:-1]
        distinct, at = ranked[new], order[new]
        place = np.searchsorted(self.hash, distinct)
        unknown = np.ones(len(distinct), bool)
        if len(self.hash):
            unknown = self.hash[np.minimum(place, len(self.hash) - 1)] != distinct
        number = np.empty(len(distinct), np.int64)
        number[~unknown] = self.number[place[~unknown]]
        if unknown.any():
            first = len(self.begin)
            self.learn([buf[a:b].tobytes() for a, b in zip(s[at[unknown]].tolist(), e[at[unknown]].tolist(), strict=True)])
            number[unknown] = np.arange(first, len(self.begin))
            self.hash, self.number = np.insert(self.hash, place[unknown], distinct[unknown]), np.insert(self.number, place[unknown], number[unknown])
        word = np.empty(len(h), np.int64)
        word[order] = np.repeat(number, np.diff(np.flatnonzero(new), append=len(h)))
        if W.same_bytes(buf, s, e, self.bytes, self.text[word], self.length[word]).all():
            return word
        self.forget()
        numbers: dict[bytes, int] = {}
        word = np.array([numbers.setdefault(buf[a:b].tobytes(), len(numbers)) for a, b in zip(s.tolist(), e.tolist(), strict=True)], np.int64)
        self.learn(list(numbers))  # without hashes, so that the next batch starts again
        return word

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of all texts, each with the end id, and the offsets of texts."""
        buf, ofs, n = text_buffers(texts)
        s, e, first = W.spans(~W.SPACE[buf], ofs)
        word = self.places(buf, s, e)
        begin, size = np.append(self.begin, len(self.ids)), np.append(self.size, 1)
        word = np.insert(word, first[1:], len(self.begin))  # the end id stands after each text's words
        ids = np.append(self.ids, self.type.type(self.end_id))
        lengths = size[word]
        upto = np.cumsum(lengths)
        flat = ids[np.repeat(begin[word] - upto + lengths, lengths) + np.arange(upto[-1] if n else 0)]
        return flat, np.concatenate([[0], upto[first[1:] + np.arange(n)]]) if n else np.zeros(1, np.int64)


@lru_cache(maxsize=1)
def encoder_of(path: str, end_id: int, width: int) -> WordEncoder:
    """A worker keeps what it has learnt from task to task."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return WordEncoder(path, end_id, width)


def cuts(ids: np.ndarray, ofs: np.ndarray) -> np.ndarray:
    """Ends of chunks: where the rolling hash of the last ids says so, at texts' ends, and within ``MOST``."""
    h = W.mix(ids.astype(W.U))
    k = 1
    while k < SEEN:
        more = h.copy()
        more[k:] += h[:-k] << W.U(k)
        h, k = more, 2 * k
    at = np.flatnonzero((h >> W.U(32)) & W.U(MEAN - 1) == 0) + 1
    own = np.searchsorted(ofs, at - 1, side="right") - 1
    at = at[at - ofs[own] >= SEEN]
    ends = np.union1d(at, ofs[1:])
    gap = np.diff(ends, prepend=0)
    far = np.flatnonzero(gap > MOST)
    if len(far):
        ends = np.union1d(ends, np.concatenate([np.arange(ends[i] - gap[i] + MOST, ends[i], MOST) for i in far]))
    return ends


def merkle(leaves: list[bytes]) -> bytes:
    """The root of a binary hash tree; a lone node goes up as it is, no leaves give the hash of nothing."""
    level = leaves or [hashlib.sha256(b"").digest()]
    while len(level) > 1:
        level = [hashlib.sha256(b"".join(level[i : i + 2])).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


STAGED = "kind string, key binary, doc_id long, n_tokens long, sizes array<int>, keys array<binary>, root binary, payload binary"
TYPES = [pa.string(), pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.binary()), pa.binary(), pa.binary()]
NAMES = [x.split()[0] for x in STAGED.split(", ")]


def write(docs: DataFrame, folder: str, vocabulary: str, end_id: int = 1, width: int = 2, text: str = "text") -> str:
    """Write the store; returns its identity (hex)."""
    spark = docs.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, seen, row, part = encoder_of(vocabulary, end_id, width), set(), 0, TaskContext.get().partitionId()
        for b in steps(batches, text):
            flat, ofs = encoder.encode(b.column(b.schema.get_field_index(text)))
            ends = cuts(flat, ofs)
            raw, begin, i, out = flat.tobytes(), 0, 0, []
            last = np.searchsorted(ends, ofs[1:])
            for d, doc_id in enumerate(b.column(b.schema.get_field_index("doc_id")).to_pylist()):
                keys, sizes = [], []
                while i <= last[d]:
                    end = int(ends[i])
                    payload = raw[begin * width : end * width]
                    key = hashlib.sha256(payload).digest()
                    keys.append(key)
                    sizes.append(end - begin)
                    if key not in seen:
                        if len(seen) >= KEYS:
                            seen.clear()
                        seen.add(key)
                        out.append(("chunk", key, None, end - begin, None, None, None, payload))
                    begin, i = end, i + 1
                out.append(("recipe", b"%d.%d" % (part, row), doc_id, int(ofs[d + 1] - ofs[d]), sizes, keys, merkle(keys), None))
                row += 1
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(TYPES)], names=NAMES)

    staged = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text).mapInArrow(run, STAGED)
    staged.dropDuplicates(["kind", "key"]).write.partitionBy("kind").parquet(f"{folder}/staged")

    found = _staged(spark, folder, "recipe")
    parts = tasks(spark)
    placed = found.withColumn("bucket", range_bucket(found, "doc_id", parts))
    before, total = {}, 0
    for r in sorted(placed.groupBy("bucket").agg(F.sum("n_tokens").alias("n")).collect()):
        before[r.bucket], total = total, total + r.n
    order = Window.partitionBy("bucket").orderBy(F.col("doc_id").asc_nulls_first(), "n_tokens", "key")
    offset = F.element_at(F.create_map(*(F.lit(x) for kv in before.items() for x in kv)), F.col("bucket")) if before else F.lit(0)
    recipes = placed.withColumn("start", (F.sum("n_tokens").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_tokens") + offset).cast("long"))
    recipes.sortWithinPartitions("bucket", F.col("doc_id").asc_nulls_first(), "start").select("bucket", "doc_id", "start", "n_tokens", "sizes", "keys", "root").write.partitionBy("bucket").parquet(f"{folder}/recipes")
    manifest = _roots(recipes_of(spark, folder))
    manifest.write.parquet(f"{folder}/manifest")
    return identity(spark, folder)


def _staged(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    return spark.read.schema(STAGED).parquet(f"{folder}/staged").filter(F.col("kind") == kind)


def recipes_of(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema("doc_id long, start long, n_tokens long, sizes array<int>, keys array<binary>, root binary, bucket int").parquet(f"{folder}/recipes")


def _roots(recipes: DataFrame) -> DataFrame:
    """Per range: documents, ids and a hash tree of fixed fan-out: groups of 1024 documents, then the groups."""
    order = Window.partitionBy("bucket").orderBy("start", F.col("doc_id").asc_nulls_first(), "root")
    numbered = recipes.select("bucket", "doc_id", "start", "n_tokens", "root").withColumn("i", F.row_number().over(order) - 1)
    joined = lambda key: F.unhex(F.sha2(F.aggregate(F.array_sort(F.collect_list(F.struct(key, "root"))), F.lit(b""), lambda a, x: F.concat(a, x["root"])), 256))
    groups = numbered.groupBy("bucket", F.floor(F.col("i") / 1024).alias("g")).agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_ids"), joined("i").alias("root"))
    return groups.groupBy("bucket").agg(F.sum("n_docs").alias("n_docs"), F.sum("n_ids").alias("n_ids"), joined("g").alias("root"))


def identity(spark: SparkSession, folder: str) -> str:
    """The Merkle root over the manifest's ranges."""
    rows = spark.read.schema("bucket int, n_docs long, n_ids long, root binary").parquet(f"{folder}/manifest").collect()
    return merkle([bytes(r.root) for r in sorted(rows)]).hex()


def chunks_of(spark: SparkSession, folder: str) -> DataFrame:
    return _staged(spark, folder, "chunk").select("key", "payload")


def documents(spark: SparkSession, folder: str, width: int = 2) -> DataFrame:
    """(doc_id, start, ids): every document's ids, rebuilt from chunks and checked."""
    pieces = recipes_of(spark, folder).select("doc_id", "start", "n_tokens", "root", F.posexplode("keys").alias("i", "key"))
    rows = pieces.join(chunks_of(spark, folder), "key", "left").groupBy("doc_id", "start", "n_tokens", "root").agg(F.array_sort(F.collect_list(F.struct("i", "key", "payload"))).alias("parts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r in b.to_pylist():
                keys, raw = [p["key"] for p in r["parts"]], b"".join(p["payload"] or b"" for p in r["parts"])
                if any(hashlib.sha256(p["payload"] or b"").digest() != p["key"] for p in r["parts"]) or merkle(keys) != r["root"] or len(raw) != width * r["n_tokens"]:
                    raise ValueError(f"the store doesn't hold document {r['doc_id']} as written")
                out.append((r["doc_id"], r["start"], np.frombuffer(raw, f"<u{width}").tolist()))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.list_(pa.int64())))], names=["doc_id", "start", "ids"])

    return rows.mapInArrow(run, "doc_id long, start long, ids array<long>")


# CRC-32 as a linear map: _SHIFT[k] takes the CRC of x to that of x followed by 2**k zero bytes (without the final inversion).
def _shifts() -> np.ndarray:
    poly = 0xEDB88320
    one = [poly] + [1 << k for k in range(31)]  # one zero bit

    def times(m: list[int], v: int) -> int:
        out = 0
        for row in m:
            if v & 1:
                out ^= row
            v >>= 1
        return out

    rows = one
    for _ in range(3):
        rows = [times(rows, x) for x in rows]
    out = []
    for _ in range(40):
        out.append(rows)
        rows = [times(rows, x) for x in rows]
    return np.array(out, np.uint32)


def shift_crc(crc: np.ndarray, zeros: np.ndarray) -> np.ndarray:
    """Each CRC's share in that of its bytes followed by so many others."""
    crc = crc.astype(np.uint32, copy=True)
    for k, rows in enumerate(_shifts()):
        at = np.flatnonzero((zeros >> k) & 1)
        if len(at):
            x, y = crc[at], np.zeros(len(at), np.uint32)
            for i in range(32):
                y ^= np.where((x >> np.uint32(i)) & np.uint32(1), rows[i], np.uint32(0))
            crc[at] = y
    return crc


def digests(spark: SparkSession, folder: str, width: int = 2) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, read from the store and verified."""

    def chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = list(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
            if any(hashlib.sha256(p).digest() != k for k, p in rows):
                raise ValueError("a chunk's payload isn't what its key says")
            crc = [zlib.crc32(np.frombuffer(p, f"<u{width}").astype("<u4").tobytes()) for _, p in rows]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(p) // width for _, p in rows], pa.int64()), pa.array(crc, pa.int64())], names=["key", "n", "crc"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = lambda b, c: b.column(b.schema.get_field_index(c))
        for b in batches:
            share = shift_crc(at(b, "crc").to_numpy(), 4 * at(b, "rest").to_numpy())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(share, pa.int64())], names=[*b.schema.names, "share"])

    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rest = []
            for r in b.select(["keys", "sizes", "root", "n_tokens"]).to_pylist():
                upto = np.cumsum(r["sizes"])
                if merkle(r["keys"]) != r["root"] or upto[-1] != r["n_tokens"]:
                    raise ValueError("a recipe isn't what its root says")
                rest.append(upto[-1] - upto)
            yield pa.RecordBatch.from_arrays([*b.select(["doc_id", "start", "n_tokens", "sizes", "keys"]).columns, pa.array(rest, pa.list_(pa.int64()))], names=["doc_id", "start", "n_tokens", "sizes", "keys", "rest"])

    recipes = recipes_of(spark, folder)
    bad = _roots(recipes).exceptAll(spark.read.schema("bucket int, n_docs long, n_ids long, root binary").parquet(f"{folder}/manifest").select("bucket", "n_docs", "n_ids", "root"))
    if bad.limit(1).count():
        raise ValueError("the recipes aren't what the manifest says")
    pieces = recipes.mapInArrow(checked, "doc_id long, start long, n_tokens long, sizes array<int>, keys array<binary>, rest array<long>").select("doc_id", "start", "n_tokens", F.explode(F.arrays_zip("keys", "sizes", "rest")).alias("p")).select("doc_id", "start", "n_tokens", F.col("p.keys").alias("key"), F.col("p.sizes").cast("long").alias("n"), F.col("p.rest").alias("rest"))
    known = chunks_of(spark, folder).mapInArrow(chunk, "key binary, n long, crc long")
    met = pieces.join(known, ["key", "n"]).select("doc_id", "start", "n_tokens", "n", "rest", "crc").mapInArrow(place, "doc_id long, start long, n_tokens long, n long, rest long, crc long, share long")
    out = met.groupBy("doc_id", "start", "n_tokens").agg(F.bit_xor("share").alias("ids_crc32"), F.sum("n").alias("found"))
    whole = F.when(F.col("found") == F.col("n_tokens"), F.col("ids_crc32")).otherwise(F.raise_error(F.lit("a document's chunks are missing")))
    return out.select("doc_id", "start", "n_tokens", whole.cast("long").alias("ids_crc32"))


def op8_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = new_path(spark, "token-store")
    write(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), folder, public_tokenizers.path("word_bpe_49k.json"))
    return digests(spark, folder)
