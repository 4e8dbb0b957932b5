"""Byte-level BPE by monoid tree reduction (operator 2).

A text is halved until its parts are small; parts are encoded and neighbours joined. A join encodes
again only a window around the cut, whose ends are boundaries that no context can move: between a
letter of the listed scripts and white space or punctuation, or after an ASCII digit, every way to match
the pattern parts the text, because no alternative continues a run of letters or digits with another
class. Matches are merged each on its own, so tokens outside such a window are those of the whole text.
The window grows by doubling until both boundaries are found, or the parts end. Joining is associative
and the empty text is its identity, so the shape of the tree doesn't matter. Decoding concatenates the
bytes of halves up the tree.

Defined results: null counts as empty, an empty text has no ids. Rows are encoded each on its own.
Special tokens aren't known: their strings are ordinary text. Very long texts are encoded whole, in memory in
proportion to the text. Repeated rows and rows without an id keep a row each; an empty table gives an empty table. Other
columns pass through, except that names of the result win.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StringType, StructField, StructType

from strataform.llm.store import steps

#: Code points that are encoded without a cut.
LEAF = 1024
#: Code points on each side of a cut that are first searched for a boundary.
WINDOW = 32
#: Ids that are decoded without a cut.
DECODE_LEAF = 4096

# Scripts whose letters are letters in every version of Unicode that a regex engine may have.
LETTERS = r"A-Za-zÀ-ÖØ-öø-ɏЀ-ӿぁ-ゖァ-ヺ一-龥가-힣"
#: Matches the place right after a boundary's left character.
BOUNDARY = regex.compile(rf"(?<=[{LETTERS}])[ \n\r\t.,;:!?()0-9]|(?<=[0-9])[ \n\r\t.,;:!?()A-Za-z]")


class Codec:
    """One per Python worker: the vocabulary and the two tree reductions."""

    def __init__(self, path: str, pattern: str, leaf: int = LEAF, window: int = WINDOW):
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.small = tiktoken.Encoding("byte-level", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.bytes = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.bytes[rank] = token
        self.leaf, self.window = leaf, window

    def encode(self, text: str) -> list[int]:
        """The ids of ``text``, by halves."""
        return self._tree(text, 0, len(text))

    def _tree(self, text: str, lo: int, hi: int) -> list[int]:
        if hi - lo <= self.leaf:
            return self.small(text[lo:hi])
        mid = (lo + hi) // 2
        return self.join(text, lo, mid, hi, self._tree(text, lo, mid), self._tree(text, mid, hi))

    def join(self, text: str, lo: int, mid: int, hi: int, left: list[int], right: list[int]) -> list[int]:
        """The ids of ``text[lo:hi]`` from those of ``text[lo:mid]`` and ``text[mid:hi]``."""
        a, b = self._before(text, lo, mid), self._after(text, mid, hi)
        gone = len(self.small(text[a:mid])) if a > lo else len(left)
        over = len(self.small(text[mid:b])) if b < hi else len(right)
        del left[len(left) - gone :]
        left += self.small(text[a:b])
        left += right[over:]
        return left

    def _before(self, text: str, lo: int, mid: int) -> int:
        """The last boundary before ``mid``, or ``lo``."""
        size = self.window
        while True:
            begin = max(lo, mid - size)
            at = [m.start() for m in BOUNDARY.finditer(text, begin, mid) if m.start() > lo]
            if at or begin == lo:
                return at[-1] if at else lo
            size *= 2

    def _after(self, text: str, mid: int, hi: int) -> int:
        """The first boundary after ``mid``, or ``hi``."""
        size = self.window
        while True:
            end = min(hi, mid + size)
            found = BOUNDARY.search(text, mid + 1, end)
            if found or end == hi:
                return found.start() if found else hi
            size *= 2

    def decode(self, ids: list[int]) -> bytes:
        """The bytes of ``ids``: halves decoded alone and concatenated."""
        parts = [b"".join(map(self.bytes.__getitem__, ids[i : i + DECODE_LEAF])) for i in range(0, len(ids), DECODE_LEAF)]
        while len(parts) > 1:
            parts = [b"".join(parts[i : i + 2]) for i in range(0, len(parts), 2)]
        return parts[0] if parts else b""


def _with_ids(df: DataFrame, fields: list[StructField], arrow: list[pa.DataType], work, text: str) -> DataFrame:
    names = [f.name for f in fields]
    src = df.select([c for c in df.columns if c not in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        call = work()
        for b in steps(batches, text):
            rows = [call(t or "") for t in b.column(b.schema.get_field_index(text)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array([r[k] for r in rows], t) for k, t in enumerate(arrow))], names=[*b.schema.names, *names])

    return src.mapInArrow(run, StructType([*src.schema.fields, *fields]))


def bpe_encode(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """``docs`` with ``ids``, an array of int."""

    def work():
        codec = Codec(path, pattern)
        return lambda t: (codec.encode(t),)

    return _with_ids(docs, [StructField("ids", ArrayType(IntegerType()))], [pa.list_(pa.int32())], work, text)


def bpe_decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """``encoded`` with ``decoded``, the bytes of its ``ids`` (null ids: no bytes)."""
    src = encoded.drop("decoded")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(path, pattern)
        for b in batches:
            rows = b.column(b.schema.get_field_index("ids")).to_pylist()
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([codec.decode(r or []) for r in rows], pa.binary())], names=[*b.schema.names, "decoded"])

    return src.mapInArrow(run, StructType([*src.schema.fields, StructField("decoded", BinaryType())]))


def bpe_round_trip(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """``docs`` with the number and digest of its ids and the digest of what they decode to.

    Encodes and decodes in the same worker, so that neither ids nor bytes travel.
    """

    def work():
        codec = Codec(path, pattern)

        def call(t: str) -> tuple:
            ids = codec.encode(t)
            return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(codec.decode(ids)).hexdigest()

        return call

    fields = [StructField("n_tokens", LongType()), StructField("ids_sha256", StringType()), StructField("decoded_sha256", StringType())]
    return _with_ids(docs, fields, [pa.int64(), pa.string(), pa.string()], work, text)


def vocabulary() -> tuple[str, str]:
    """The production vocabulary's file and pattern."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return bpe_round_trip(docs, *vocabulary()).drop("text")
