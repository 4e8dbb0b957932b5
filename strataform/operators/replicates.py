"""Corpora composed of others' chunks, many at a time: replicates, halves and mixtures as vectors of counts.

A chunk carries one list, the composed corpora (columns) that it is in, once for each time. A gram's counts in all columns of its corpus are one
vector, summed element by element, so that rows are grams and not grams x replicates, and texts are tokenised once whatever the
number of columns. Mixtures have a column a segment: a corpus is cut where any mixture's share ends, a chunk is in one
segment, and running sums over segments give every prefix; a mixture is the sum of two prefixes.

Of a vocabulary only the grams that reach the ``size``-th count of some column stay (ties included). Which can is told by numbers first: a gram's count
in no column is above the sum, over chunks, of its count there times the chunk's greatest multiplicity. The grams with the greatest sums get vectors;
these give each column a count that its vocabulary can't fall below, and only further grams whose sum reaches one get vectors too. A
later pass over the texts finds where vocabularies' grams come first in each column, which settles ties, and counts them in the corpora that
theirs is compared with; cells of all columns are worked out by numpy, a corpus and setting at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataform.config import JS_EPSILON, least_vocabulary
from strataform.functions.text import tokens
from strataform.operators.frequent import GATHERED, ROOM, Tokens, _hashed
from strataform.plans.held import held

#: Bytes of vectors that a worker sums at once.
STEP_BYTES = 32 << 20
NONE = np.iinfo(np.int64).max
#: Chunks of a corpus whose lists are put together at once, and draws that a task packs at once.
BLOCK, PACKED = 1024, 2_000_000
#: Grams with the greatest bounds that get vectors at once, in vocabularies; further grams (8 bytes each, broadcast), beyond which all are counted.
FIRST, MOST_FURTHER = 8, 1_000_000
#: Bytes of vectors that a task holds before it passes them on.
HELD_BYTES = 256 << 20


def drawn(draws: DataFrame, column: str = "replicate") -> DataFrame:
    """(label, chunk_index, cols): draws (``column``, label, chunk_index[, times]) as each chunk's list of columns."""
    times = F.col("times").cast("int") if "times" in draws.columns else F.lit(1)
    return draws.groupBy("label", "chunk_index").agg(F.flatten(F.collect_list(F.array_repeat(F.col(column).cast("int"), times))).alias("cols"))


def packed(draws: DataFrame, column: str = "replicate") -> DataFrame:
    """``drawn`` of a row a draw: these travel as packed numbers, 4 bytes each, and meet by blocks of ``BLOCK`` chunks."""
    kind = dict(draws.dtypes)["label"]
    src = draws.filter("label IS NOT NULL").select("label", F.col("chunk_index").cast("long").alias("chunk_index"), F.col(column).cast("int").alias("col"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_, size = [], 0
        for b in batches:
            held_.append(b)
            size += b.num_rows
            if size >= PACKED:
                yield from sent(held_)
                held_, size = [], 0
        if size:
            yield from sent(held_)

    def sent(held_: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held_).combine_chunks()
        names = t.column(0).chunk(0).dictionary_encode()
        code, index, col = names.indices.to_numpy(zero_copy_only=False), t.column(1).to_numpy(), t.column(2).to_numpy()
        for i in range(len(names.dictionary)):
            mine = np.flatnonzero(code == i)
            block = index[mine] // BLOCK
            mine, block = mine[order := np.argsort(block, kind="stable")], block[order]
            spots = (col[mine].astype(np.int32) * BLOCK + (index[mine] % BLOCK).astype(np.int32)).astype(np.int32)
            begin = np.flatnonzero(np.diff(block, prepend=-1))
            parts = [x.tobytes() for x in np.split(spots, begin[1:])]
            yield pa.RecordBatch.from_arrays([pa.array([names.dictionary[i].as_py()] * len(begin), t.schema.field(0).type), pa.array(block[begin]), pa.array(parts, pa.binary())], names=["label", "block", "spots"])

    def unpack(group: pa.Table) -> pa.Table:
        spots = np.frombuffer(b"".join(group["spots"].to_pylist()), np.int32)
        spots = spots[np.argsort(spots % BLOCK, kind="stable")]
        at, n = np.unique(spots % BLOCK, return_counts=True)
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(spots // BLOCK))
        index = at.astype(np.int64) + group["block"][0].as_py() * BLOCK
        return pa.table([pa.array([group["label"][0].as_py()] * len(at), group.schema.field("label").type), pa.array(index), lists], names=["label", "chunk_index", "cols"])

    met = src.mapInArrow(pack, f"label {kind}, block long, spots binary")
    return met.groupBy("label", "block").applyInArrow(unpack, f"label {kind}, chunk_index long, cols array<int>")


def column_counts(rows: DataFrame, cols: DataFrame, key: str) -> DataFrame:
    """(label, col, <key>, n): how often rows (label, chunk_index, <key>) of each key are in each column. Tasks add up before anything is shuffled."""
    met = rows.select("label", "chunk_index", key).join(cols, ["label", "chunk_index"])
    return met.select("label", key, F.explode("cols").alias("col")).groupBy("label", "col", key).agg(F.count("*").alias("n"))


def segments(chunks: DataFrame, ends: DataFrame) -> DataFrame:
    """(label, chunk_index, cols): the segment that a chunk is in, of those that end at ``ends`` (label, col, end: chunks before it).
    Columns are numbered by their ends; of empty segments the last is never met. Chunks behind the last end are in none."""
    cuts = ends.groupBy("label").agg(F.array_sort(F.collect_list("end")).alias("cuts"))
    col = F.size(F.filter("cuts", lambda e: e <= F.col("chunk_index")))
    return chunks.select("label", "chunk_index").join(F.broadcast(cuts), "label").filter(col < F.size("cuts")).select("label", "chunk_index", F.array(col.cast("int")).alias("cols"))


def _reduced(values: np.ndarray, own: np.ndarray, groups: int, width: int, op: np.ufunc, rows: np.ndarray) -> np.ndarray:
    """``op`` over the rows ``values[rows]`` of each group; groups are 0 to ``groups`` - 1 and none is empty."""
    order = np.argsort(own, kind="stable")
    begin = np.searchsorted(own[order], np.arange(groups))
    out = np.empty((groups, width), np.int64)
    step, lo = max(1, STEP_BYTES // (8 * width)), 0
    while lo < groups:  # whole groups, about ``step`` rows; a single large one in pieces
        hi = max(lo + 1, int(np.searchsorted(begin, begin[lo] + step)) - 1) if lo + 1 < groups else groups
        at, end = begin[lo], begin[hi] if hi < groups else len(order)
        if end - at <= 2 * step:
            out[lo:hi] = op.reduceat(values[rows[order[at:end]]], begin[lo:hi] - at, axis=0)
        else:
            out[lo] = op.reduce([op.reduce(values[rows[order[i : min(i + step, end)]]], axis=0) for i in range(at, end, step)], axis=0)
            hi = lo + 1
        lo = hi
    return out


def _weights(lists: pa.ListArray, width: int) -> np.ndarray:
    """(chunks x columns) how often each chunk is in each column."""
    at = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy()) * width + lists.flatten().to_numpy()
    return np.bincount(at, minlength=len(lists) * width).reshape(len(lists), width)


def _by_label(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        if b.num_rows:
            names = b.column(0).dictionary_encode()
            code = names.indices.to_numpy(zero_copy_only=False)
            for i, label in enumerate(names.dictionary.to_pylist()):
                yield label, b.take(pa.array(np.flatnonzero(code == i)))


def _greatest(chunks: DataFrame, tokenizers: tuple[str, ...], settings: list[tuple[int, int]], width: int) -> DataFrame:
    """(label, k, hash, most): no gram of that hash is counted more than ``most`` times in a column."""
    kind = dict(chunks.dtypes)["label"]
    src = chunks.filter("label IS NOT NULL").select("label", F.col("cols").cast("array<int>").alias("cols"), *(_hashed(t).alias(t) for t in tokenizers))

    def summed(parts: list) -> tuple[np.ndarray, np.ndarray]:
        h, own = np.unique(np.concatenate([h for h, _ in parts]), return_inverse=True)
        return h, np.bincount(own, np.concatenate([n for _, n in parts]), len(h)).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        kinds: list = []

        def sent() -> Iterator[pa.RecordBatch]:
            for (label, k), parts in known.items():
                h, n = summed(parts)
                yield pa.RecordBatch.from_arrays([pa.array([label] * len(h), kinds[0]), pa.array(np.full(len(h), k, np.int32)), pa.array(h.view(np.int64)), pa.array(n)], names=["label", "k", "hash", "most"])

        gathered = held_ = 0
        for label, b in _by_label(batches):
            kinds[:] = [b.column(0).type]
            most = _weights(b.column(1), width).max(1)
            for k, (t, n) in enumerate(settings):
                toks = Tokens(b.column(2 + t))
                at, h = toks.grams(toks.flat.to_numpy(zero_copy_only=False).view(np.uint64), n)
                part = summed([(h, most[toks.row[at]])])
                known.setdefault((label, k), []).append(part)
                gathered += len(part[0])
            if gathered > GATHERED:
                known = {key: [summed(parts)] if len(parts) > 1 else parts for key, parts in known.items()}
                gathered, held_ = 0, sum(len(p[0][0]) for p in known.values())
                if held_ > ROOM:
                    yield from sent()
                    known = {}
        yield from sent()

    return src.mapInArrow(run, f"label {kind}, k int, hash long, most long").groupBy("label", "k", "hash").agg(F.sum("most").alias("most"))


class _Vectors:
    """A task's vectors of the grams of some hashes: sums of counts, or first places."""

    def __init__(self, hashes: np.ndarray, width: int, first: bool):
        self.h, self.first = np.unique(hashes), first
        self.vec = np.full((len(self.h), width), NONE if first else 0)
        self.second, self.grams = np.zeros(len(self.h), np.uint64), [None] * len(self.h)
        self.seen, self.more = np.zeros(len(self.h), bool), {}

    def put(self, to: np.ndarray, vec: np.ndarray) -> None:
        """``vec`` (a row a group) into the rows ``to``."""
        self.vec[to] = np.minimum(self.vec[to], vec) if self.first else self.vec[to] + vec

    def add(self, name, at: np.ndarray, h: np.ndarray, other: np.ndarray, rows: np.ndarray, values) -> None:
        """Grams that begin ``at``, in the chunks ``rows``; ``name(at)`` gives their strings, ``values(i)`` vectors of the i-th ones."""
        pos = np.minimum(np.searchsorted(self.h, h), len(self.h) - 1)
        hit = np.flatnonzero(self.h[pos] == h) if len(self.h) else np.zeros(0, np.int64)
        pos = pos[hit]
        new, i = np.unique(pos[~self.seen[pos]], return_index=True)
        if len(new):
            i = hit[~self.seen[pos]][i]
            self.seen[new], self.second[new] = True, other[i]
            for j, g in zip(new, name(at[i]), strict=True):
                self.grams[j] = g
        same = self.second[pos] == other[hit]
        for i in hit[~same]:  # two grams share a hash
            key = h[i], other[i]
            vec = values(np.array([i]))[0]
            old = self.more.get(key)
            self.more[key] = (name(at[[i]])[0], vec) if old is None else (old[0], np.minimum(old[1], vec) if self.first else old[1] + vec)
        hit, pos = hit[same], pos[same]
        order = np.argsort(pos, kind="stable")
        hit, pos, step = hit[order], pos[order], max(1, STEP_BYTES // (8 * self.vec.shape[1]))
        for lo in range(0, len(hit), step):
            groups, begin = np.unique(pos[lo : lo + step], return_index=True)
            self.put(groups, (np.minimum if self.first else np.add).reduceat(values(hit[lo : lo + step]), begin, axis=0))

    def rows(self) -> Iterator[tuple]:
        seen = np.flatnonzero(self.seen)
        for some in (seen[i : i + 4096] for i in range(0, len(seen), 4096)):
            for j, v in zip(some, _bytes(self.vec[some]), strict=True):
                yield self.grams[j], int(self.h[j].view(np.int64)), v
        for (h, _), (gram, vec) in self.more.items():
            yield gram, int(h.view(np.int64)), _bytes(vec.astype(np.int64)[None])[0]


def _vectors(chunks: DataFrame, tokenizers: tuple[str, ...], settings: list[tuple[int, int]], width: int, counted: dict, placed: dict | None = None) -> DataFrame:
    """(label, k, gram, hash, vec, place): tasks' sums of the counts of the grams of hashes ``counted`` ({(label, k): hashes}), and the first places
    (``place``) of those ``placed``."""
    kind = dict(chunks.dtypes)["label"]
    cols = [c for t in tokenizers for c in (F.coalesce(tokens("text", t), F.array().cast("array<string>")).alias(t), _hashed(t).alias(f"{t}_1"), _hashed(t, 7).alias(f"{t}_2"))]
    src = chunks.filter("label IS NOT NULL").select("label", "chunk_index", F.col("cols").cast("array<int>").alias("cols"), *cols)
    shared = chunks.sparkSession.sparkContext.broadcast({False: counted, True: placed or {}})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        kinds: list = []

        def sent() -> Iterator[pa.RecordBatch]:
            step = max(1, STEP_BYTES // (8 * width))
            for (first, label, k), v in known.items():
                out = list(v.rows())
                for part in (out[i : i + step] for i in range(0, len(out), step)):
                    m = len(part)
                    yield pa.RecordBatch.from_arrays([pa.array([label] * m, kinds[0]), pa.array([k] * m, pa.int32()), pa.array([r[0] for r in part], pa.string()), pa.array([r[1] for r in part], pa.int64()), pa.array([r[2] for r in part], pa.binary()), pa.array([first] * m)], names=["label", "k", "gram", "hash", "vec", "place"])

        size = 0
        for label, b in _by_label(batches):
            kinds[:] = [b.column(0).type]
            w, place = _weights(b.column(2), width), b.column(1).to_numpy().astype(np.int64) << 24
            for k, (t, n) in enumerate(settings):
                wanted = {first: by[label, k] for first, by in shared.value.items() if len(by.get((label, k), ()))}
                if not wanted:
                    continue
                toks = Tokens(b.column(3 + 3 * t))
                one, two = (b.column(4 + 3 * t + s).flatten().to_numpy(zero_copy_only=False).view(np.uint64) for s in (0, 1))
                at, h = toks.grams(one, n)
                other, rows = toks.grams(two, n)[1], toks.row[at]
                spot = place[rows] + at - toks.begin[rows]

                def name(at: np.ndarray, toks=toks, n=n) -> list[str]:
                    parts = [toks.flat.take(pa.array(at + i)) for i in range(n)]
                    return (pc.binary_join_element_wise(*parts, " ") if n > 1 else parts[0]).to_pylist()

                values = {False: lambda i, rows=rows: w[rows[i]], True: lambda i, rows=rows, spot=spot: np.where(w[rows[i]] > 0, spot[i][:, None], NONE)}
                for first, hashes in wanted.items():
                    if (first, label, k) not in known:
                        known[first, label, k] = _Vectors(hashes, width, first)
                        size += known[first, label, k].vec.nbytes
                    known[first, label, k].add(name, at, h, other, rows, values[first])
                if size > HELD_BYTES:
                    yield from sent()
                    known, size = {}, 0
        yield from sent()

    return src.mapInArrow(run, f"label {kind}, k int, gram string, hash long, vec binary, place boolean")


def _pruned(rows: DataFrame, tokenizers: tuple[str, ...], settings: list[tuple[int, int]], width: int, size: int, running: bool) -> tuple[DataFrame, dict] | None:
    """Counts (as of ``_met``) of all grams that can be in a vocabulary, and their hashes by (label, k); none if they are too many."""
    total = held(_greatest(rows, tokenizers, settings, width))
    rank = F.row_number().over(Window.partitionBy("label", "k").orderBy(F.desc("most"), "hash"))
    top = total.withColumn("_rank", rank).filter(F.col("_rank") <= FIRST * size).groupBy("label", "k").agg(F.collect_list("hash").alias("h"), F.min(F.struct("most", -F.col("hash").cast("decimal(20,0)"))).alias("end")).collect()
    hashes = lambda found: {(r.label, r.k): np.array(r.h, np.int64).view(np.uint64) for r in found}
    counted = hashes(top)
    met = lambda of: _met(_vectors(rows, tokenizers, settings, width, of).drop("place"), width, size, running, np.add)
    counts = held(met(counted))
    kind = dict(rows.dtypes)["label"]

    def least(f: pd.DataFrame) -> pd.DataFrame:
        vec, n = _matrix(f["vec"], width), len(f)
        vec = vec[:, vec.any(0)]
        low = int(np.partition(vec, n - size, axis=0)[n - size].min()) if n >= size else 0
        return pd.DataFrame({"label": f["label"].iloc[:1], "k": f["k"].iloc[:1], "least": [max(low, 1)]})

    low = {(r.label, r.k): r.least for r in counts.select("label", "k", "vec").groupBy("label", "k").applyInPandas(least, f"label {kind}, k int, least long").collect()}
    ends = rows.sparkSession.createDataFrame([(r.label, r.k, r.end[0], -int(r.end[1]), low.get((r.label, r.k), 1)) for r in top], f"label {kind}, k int, _most long, _hash long, _least long")
    behind = (F.col("most") < F.col("_most")) | ((F.col("most") == F.col("_most")) & (F.col("hash") > F.col("_hash")))
    further = total.join(F.broadcast(ends), ["label", "k"]).filter(behind & (F.col("most") >= F.col("_least"))).select("label", "k", "hash")
    n = further.count()
    if n > MOST_FURTHER:
        return None
    if n:
        more = hashes(further.groupBy("label", "k").agg(F.collect_list("hash").alias("h")).collect())
        counts = held(counts.unionByName(met(more)))
        counted = {key: np.concatenate([h, more[key]]) if key in more else h for key, h in counted.items()}
    return counts, counted


def _partial(chunks: DataFrame, tokenizers: tuple[str, ...], settings: list[tuple[int, int]], width: int, wanted: dict | None = None) -> DataFrame:
    """(label, k, gram, vec): a task's sums of each gram's counts, or with ``wanted`` ({(label, k): hashes}) the first places of those."""
    kind = dict(chunks.dtypes)["label"]
    cols = [c for t in tokenizers for c in (F.coalesce(tokens("text", t), F.array().cast("array<string>")).alias(t), _hashed(t).alias(f"{t}_1"), _hashed(t, 7).alias(f"{t}_2"))]
    src = chunks.select("label", "chunk_index", F.col("cols").cast("array<int>").alias("cols"), *cols)
    shared = chunks.sparkSession.sparkContext.broadcast(wanted)

    def weights(b: pa.RecordBatch) -> np.ndarray:
        lists = b.column(2)
        out = np.zeros((b.num_rows, width), np.int64)
        np.add.at(out, (np.repeat(np.arange(b.num_rows), lists.value_lengths().to_numpy()), lists.flatten().to_numpy()), 1)
        return out

    def of_corpus(label, b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        w, place = weights(b), b.column(1).to_numpy().astype(np.int64) << 24
        for t in range(len(tokenizers)):
            toks = Tokens(b.column(3 + 3 * t))
            one, two = (b.column(4 + 3 * t + s).flatten().to_numpy(zero_copy_only=False).view(np.uint64) for s in (0, 1))
            for k, (of, n) in enumerate(settings):
                if of != t:
                    continue
                at, h = toks.grams(one, n)
                other = toks.grams(two, n)[1]
                if shared.value is not None:
                    hit = np.isin(h, shared.value.get((label, k), np.zeros(0, np.uint64)))
                    at, h, other = at[hit], h[hit], other[hit]
                while len(at):  # once, unless two grams share a hash
                    _, first, own = np.unique(h, return_index=True, return_inverse=True)
                    same = other == other[first][own]
                    rows = toks.row[at[same]]
                    if shared.value is None:
                        vec = _reduced(w, own[same], len(first), width, np.add, rows)
                    else:
                        spot = place[toks.row[at]] + at - toks.begin[toks.row[at]]
                        vec = np.full((len(first), width), NONE)
                        step = max(1, STEP_BYTES // (8 * width))
                        order = np.argsort(own[same], kind="stable")
                        for i in range(0, len(order), step):
                            some = order[i : i + step]
                            groups, begin = np.unique(own[same][some], return_index=True)
                            seen = np.where(w[rows[some]] > 0, spot[same][some][:, None], NONE)
                            vec[groups] = np.minimum(vec[groups], np.minimum.reduceat(seen, begin, axis=0))
                    where = at[first]
                    gram = toks.flat.take(pa.array(where))
                    if n > 1:
                        gram = pc.binary_join_element_wise(gram, *(toks.flat.take(pa.array(where + i)) for i in range(1, n)), " ")
                    for i in range(0, len(first), max(1, STEP_BYTES // (8 * width))):
                        part = slice(i, i + max(1, STEP_BYTES // (8 * width)))
                        m = len(first[part])
                        yield pa.RecordBatch.from_arrays([pa.array([label] * m, b.column(0).type), pa.array(np.full(m, k, np.int32)), gram[part], pa.array(h[first[part]].view(np.int64)), pa.array(_bytes(vec[part]), pa.binary())], names=["label", "k", "gram", "hash", "vec"])
                    at, h, other = at[~same], h[~same], other[~same]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                names = b.column(0).dictionary_encode()
                code = names.indices.to_numpy(zero_copy_only=False)
                for i, label in enumerate(names.dictionary.to_pylist()):
                    yield from of_corpus(label, b.take(pa.array(np.flatnonzero(code == i))))

    return src.filter("label IS NOT NULL").mapInArrow(run, f"label {kind}, k int, gram string, hash long, vec binary")


def _bytes(vec: np.ndarray) -> list[bytes]:
    """Each row in the fewest bytes a number that hold its greatest; numbers aren't below 0."""
    out: list = [b""] * len(vec)
    top = vec.max(1) if vec.size else np.zeros(len(vec), np.int64)
    need = np.searchsorted([1 << 8, 1 << 16, 1 << 32], top, "right")
    for i, kind in enumerate((np.uint8, np.uint16, np.uint32, np.int64)):
        rows = np.flatnonzero(need == i)
        for j, v in zip(rows, vec[rows].astype(kind), strict=True):
            out[j] = v.tobytes()
    return out


def _matrix(column: pd.Series, width: int) -> np.ndarray:
    """Rows of ``_bytes``, whose lengths tell their kind."""
    rows, out = list(column), np.zeros((len(column), width), np.int64)
    size = np.array([len(r) for r in rows], np.int64) // max(width, 1)
    for n, kind in ((1, np.uint8), (2, np.uint16), (4, np.uint32), (8, np.int64)):
        mine = np.flatnonzero(size == n)
        if len(mine):
            out[mine] = np.frombuffer(b"".join([rows[i] for i in mine]), kind).reshape(len(mine), width)
    return out


def _met(partial: DataFrame, width: int, size: int | None, running: bool, op: np.ufunc) -> DataFrame:
    """(label, k, gram, hash, vec, top): tasks' vectors of a gram put together; ``top``: among the ``size`` greatest of its share of grams in some column."""
    kind = dict(partial.dtypes)["label"]
    buckets = int(partial.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def one(f: pd.DataFrame) -> pd.DataFrame:
        names, own = np.unique(f["gram"].to_numpy(), return_inverse=True)
        vec = _reduced(_matrix(f["vec"], width), own, len(names), width, op, np.arange(len(f)))
        vec = (np.cumsum if op is np.add else np.minimum.accumulate)(vec, axis=1) if running else vec
        first = np.zeros(len(names), np.int64)
        first[own] = f["hash"].to_numpy()
        top = np.ones(len(names), bool)
        if size and len(names) > size:
            top = ((vec >= np.partition(vec, len(names) - size, axis=0)[len(names) - size]) & (vec > 0)).any(1)
        return pd.DataFrame({"label": f["label"].iloc[0], "k": f["k"].iloc[0], "gram": names, "hash": first, "vec": _bytes(vec), "top": top})

    return partial.groupBy("label", "k", F.pmod(F.xxhash64("gram"), F.lit(buckets)).alias("_bucket")).applyInPandas(lambda f: one(f.drop(columns="_bucket", errors="ignore")), f"label {kind}, k int, gram string, hash long, vec binary, top boolean")


def _vocabularies(counts: DataFrame, width: int, size: int) -> DataFrame:
    """(label, k, gram, hash): grams that reach the ``size``-th count of a column."""
    kind = dict(counts.dtypes)["label"]

    def reach(f: pd.DataFrame) -> pd.DataFrame:
        vec, n = _matrix(f["vec"], width), len(f)
        least = np.partition(vec, n - size, axis=0)[n - size] if n > size else np.zeros(width, np.int64)
        return f.loc[((vec >= least) & (vec > 0)).any(1), ["label", "k", "gram", "hash"]]

    return counts.filter("top").select("label", "k", "gram", "hash", "vec").groupBy("label", "k").applyInPandas(reach, f"label {kind}, k int, gram string, hash long")


def _ranks(y: np.ndarray) -> np.ndarray:
    """Ascending ranks, ties their mean."""
    s = np.sort(y)
    return (np.searchsorted(s, y) + np.searchsorted(s, y, "right") + 1) / 2


def _cell(x: np.ndarray, y: np.ndarray, rx: np.ndarray) -> tuple[float, float | None]:
    """Divergence and agreement of two columns of counts; no agreement where a side's ranks are all equal."""
    p, q = x + JS_EPSILON, y + JS_EPSILON
    p, q = p / p.sum(), q / q.sum()
    m, ry = (p + q) / 2, _ranks(y)
    js = 0.5 * float((p * np.log(p / m)).sum() + (q * np.log(q / m)).sum())
    sx, sy = round(float(rx.std()), 12), round(float(ry.std()), 12)
    return js, float(((rx * ry).mean() - rx.mean() * ry.mean()) / (sx * sy)) if sx and sy else None


def composed_cells(chunks: DataFrame, cols: DataFrame, width: int, wanted: DataFrame, sizes: tuple[int, ...] = (256,), tokenizers: tuple[str, ...] = ("stable",), orders: tuple[int, ...] = (1,), running: bool = False) -> DataFrame:
    """(id, a, b, tokenizer, n, v, grams, js, rho): a row for each comparison and setting with a vocabulary large enough.

    ``chunks`` (label, chunk_index, text), ``cols`` (label, chunk_index, cols: numbers below ``width``), ``wanted``: (id, a, a_col, b, b_col[, more, more_col]), the
    column ``a_col`` of corpus a, whose vocabulary counts, and what it is compared with: a column of b, plus one of ``more`` where given. A column
    that is null holds nothing. ``running``: columns are segments, and stand for all up to them.
    """
    spark, kind = chunks.sparkSession, dict(chunks.dtypes)["label"]
    settings = [(t, n) for t in range(len(tokenizers)) for n in orders]
    rows = held(chunks.select("label", "chunk_index", "text").join(cols, ["label", "chunk_index"]))
    pruned = _pruned(rows, tokenizers, settings, width, max(sizes), running)
    counts = pruned[0] if pruned else held(_met(_partial(rows, tokenizers, settings, width), width, max(sizes), running, np.add))
    vocab = held(_vocabularies(counts, width, max(sizes)))
    picked = vocab.groupBy("label", "k").agg(F.collect_list("hash").alias("h")).collect()  # vocabularies, of all columns: bounded by corpora, columns and size
    hashes = {(r.label, r.k): np.array(r.h, np.int64).view(np.uint64) for r in picked}
    if "more" not in wanted.columns:
        wanted = wanted.withColumn("more", F.lit(None).cast(kind)).withColumn("more_col", F.lit(None).cast("int"))
    wanted = held(wanted.select("id", "a", "a_col", "b", "b_col", "more", "more_col"))
    sides = wanted.select("a", F.explode(F.array_distinct(F.array_compact(F.array("b", "more")))).alias("label")).distinct()
    if pruned:  # what other corpora's vocabularies ask of a corpus besides what was counted
        asked_of: dict = {}
        for r in sides.collect():
            for k in range(len(settings)):
                asked_of.setdefault((r.label, k), []).append(hashes.get((r.a, k), np.zeros(0, np.uint64)))
        further = {key: np.setdiff1d(np.concatenate(hs), pruned[1].get(key, np.zeros(0, np.uint64))) for key, hs in asked_of.items()}
        last = held(_vectors(rows, tokenizers, settings, width, further, hashes))
        first = _met(last.filter("place").drop("place"), width, None, running, np.minimum)
        counts = counts.unionByName(_met(last.filter("NOT place").drop("place"), width, None, running, np.add))
    else:
        first = _met(_partial(rows, tokenizers, settings, width, hashes), width, None, running, np.minimum)
    first = first.select("label", "k", "gram", F.col("vec").alias("first"))
    own = vocab.join(counts, ["label", "k", "gram"]).join(first, ["label", "k", "gram"], "left")
    mine = own.select(F.col("label").alias("a"), "k", "gram", F.lit(None).cast(kind).alias("label"), "vec", "first")
    theirs = vocab.select(F.col("label").alias("a"), "k", "gram").join(F.broadcast(sides), "a").join(counts.select("label", "k", "gram", "vec"), ["label", "k", "gram"])
    table = mine.unionByName(theirs.select("a", "k", "gram", "label", "vec", F.lit(None).cast("binary").alias("first")))
    ks = spark.range(len(settings)).select(F.col("id").cast("int").alias("k"))
    ident = dict(wanted.dtypes)["id"]
    names = [tokenizers[t] for t, _ in settings], [n for _, n in settings]

    def compare(f: pd.DataFrame, w: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(f) and len(w):
            base = f[f["label"].isna()]
            at = {g: i for i, g in enumerate(base["gram"])}
            mine, places = _matrix(base["vec"], width), _matrix(base["first"], width)
            sides = {}
            for label, g in f[f["label"].notna()].groupby("label"):
                sides[label] = np.zeros(mine.shape, np.int64)
                sides[label][[at[x] for x in g["gram"]]] = _matrix(g["vec"], width)
            nothing, k = np.zeros(len(mine), np.int64), int(f["k"].iloc[0])
            column = lambda label, c: sides[label][:, int(c)] if not pd.isna(label) and not pd.isna(c) and label in sides else nothing
            for c, some in w.groupby("a_col"):
                x = mine[:, int(c)]
                order = np.lexsort((places[:, int(c)], -x))
                order = order[x[order] > 0][: max(sizes)]
                ys = [(r, column(r.b, r.b_col)[order] + column(r.more, r.more_col)[order]) for r in some.itertuples()]
                for v in sizes:
                    n = min(v, len(order))
                    if n >= least_vocabulary(v):
                        rx = _ranks(x[order[:n]])
                        out += [(r.id, r.a, r.b, names[0][k], names[1][k], v, n, *_cell(x[order[:n]], y[:n], rx)) for r, y in ys]
        return pd.DataFrame(out, columns=["id", "a", "b", "tokenizer", "n", "v", "grams", "js", "rho"])

    asked = wanted.join(F.broadcast(ks)).select("*")
    return table.groupBy("a", "k").cogroup(asked.groupBy("a", "k")).applyInPandas(compare, f"id {ident}, a {kind}, b {kind}, tokenizer string, n int, v int, grams long, js double, rho double")
