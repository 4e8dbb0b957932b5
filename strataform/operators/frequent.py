"""The most frequent grams of every corpus, exactly, without shuffling all grams.

A threshold algorithm in three passes over the texts. Chunks are dealt by corpus first, a corpus to as many slices as its share asks for,
so that a task (a node of the algorithm) sees much of few corpora; texts are far fewer bytes than their grams.

1. Every node counts its grams as 64-bit hashes and sends its ``size`` most frequent. The ``size``-th largest sum of these is a
   lower bound b of the count that a gram needs.
2. With m nodes, a gram that reaches b reaches b / m in one node at least. Nodes send what does; of these, grams stay whose sum and
   what other nodes may hold besides could reach b.
3. Occurrences of what stays are counted by their strings, with the first place of each, for all corpora.

Nodes that run out of room send what they have and begin anew, as another node; the second pass counts its nodes, and runs again
if there were more than the first pass had. So bounds never depend on how tasks were cut. If more than ``MOST_SURVIVORS``
grams stay (as when a corpus's grams are nearly all equally rare) or there are more than ``MOST_CORPORA`` corpora, all grams are
counted by ``lexical.gram_counts``, with the same result. Counts, ranks and ties are exact: hashes only choose what pass 3 looks at,
and a gram whose hash equals a frequent one's is told from it there by a second hash.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from strataform.config import ORDERS, TOKENIZERS
from strataform.functions.text import tokens
from strataform.operators import lexical
from strataform.plans.held import held

#: Grams that pass 3 may look for (8 bytes each, broadcast), and corpora whose sizes the driver may hold.
MOST_SURVIVORS, MOST_CORPORA = 4_000_000, 10_000
#: Hashes that a node gathers before it counts them, and distinct ones that it holds before it sends.
GATHERED, ROOM = 2_000_000, 6_000_000
#: Chunks whose tokens a worker looks at once.
ROWS = 2048
#: Characters of a corpus whose grams one group counts by hash.
GROUP_CHARS = 4 << 20

U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit numbers (the finaliser of SplitMix)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of at most ``ROWS`` rows, none empty."""
    for b in batches:
        for i in range(0, b.num_rows, ROWS):
            yield b.slice(i, ROWS)


class Tokens:
    """The tokens of a batch's chunks as hashes, one after another."""

    def __init__(self, col: pa.Array):
        self.lengths = np.diff(col.offsets.to_numpy()) if len(col) else np.zeros(0, np.int64)
        self.flat = col.flatten()
        self.row = np.repeat(np.arange(len(col)), self.lengths)
        self.begin = np.cumsum(self.lengths) - self.lengths
        self.left = np.repeat(self.begin + self.lengths, self.lengths) - np.arange(len(self.row))

    def grams(self, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(where each n-gram begins, its hash)."""
        out = hashes
        for k in range(1, n):
            out = _mix(out[: len(hashes) - k] * U(0x9E3779B97F4A7C15) + hashes[k:])
        at = np.flatnonzero(self.left >= n)
        return at, out[at]


class Node:
    """Counts of grams by (corpus, setting), within bounded room."""

    def __init__(self) -> None:
        self.raw: dict[tuple[int, int], list[np.ndarray]] = {}
        self.known: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        self.gathered = self.held = 0

    def add(self, key: tuple[int, int], hashes: np.ndarray) -> None:
        self.raw.setdefault(key, []).append(hashes)
        self.gathered += len(hashes)
        if self.gathered > GATHERED:
            self.count()

    def count(self) -> None:
        """Adds what was gathered to what is known: counts of known hashes where they stand, new ones at their places. Counts take 4 bytes
        while they fit; a node holds 12 bytes a gram, twice while one (corpus, setting) grows."""
        for key in list(self.raw):
            h, n = np.unique(np.concatenate(self.raw.pop(key)), return_counts=True)
            if key in self.known and len(self.known[key][0]):
                old, cnt = self.known.pop(key)
                at = np.searchsorted(old, h)
                same = old[np.minimum(at, len(old) - 1)] == h
                if int(cnt.max()) + int(n.max(initial=0)) >= 2**32:
                    cnt = cnt.astype(np.int64)
                cnt[at[same]] += n[same].astype(cnt.dtype)
                h, n = np.insert(old, at[~same], h[~same]), np.insert(cnt, at[~same], n[~same])
            self.known[key] = h, n if n.max(initial=0) >= 2**32 else n.astype(np.uint32, copy=False)
        self.gathered, self.held = 0, sum(len(h) for h, _ in self.known.values())


Cut = Callable[[int, int, np.ndarray, np.ndarray], np.ndarray]


def _sent(dealt: DataFrame, tokenizers: tuple[str, ...], settings: list[tuple[int, int]], cut: Cut) -> DataFrame:
    """(corpus, k, hash, cnt): what ``cut`` chooses of every node's counts, and one row without a hash a node."""
    src = dealt.select("_corpus", *(_hashed(t).alias(t) for t in tokenizers))

    def sent(node: Node) -> Iterator[pa.RecordBatch]:
        node.count()
        for (corpus, k), (h, n) in node.known.items():
            pick = cut(corpus, k, h, n)
            size = len(pick) + 1
            hashes = pa.array(np.append(h[pick].view(np.int64), 0), mask=np.arange(size) == size - 1)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(size, corpus, np.int32)), pa.array(np.full(size, k, np.int32)), hashes, pa.array(np.append(n[pick].astype(np.int64), 0))], names=["corpus", "k", "hash", "cnt"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node = Node()
        for b in _slices(batches):
            corpora = b.column(0).to_numpy()
            order = np.argsort(corpora, kind="stable")
            ends = np.flatnonzero(np.diff(corpora[order], append=-1)) + 1
            for rows in np.split(order, ends[:-1]) if len(order) else []:
                some = b if len(ends) == 1 else b.take(pa.array(rows))
                for t in range(len(tokenizers)):
                    toks = Tokens(some.column(1 + t))
                    hashes = toks.flat.to_numpy(zero_copy_only=False).view(U)
                    for k, (_, n) in enumerate(settings):
                        if settings[k][0] == t:
                            node.add((int(corpora[rows[0]]), k), toks.grams(hashes, n)[1])
                if node.held > ROOM:
                    yield from sent(node)
                    node = Node()
        yield from sent(node)

    return src.mapInArrow(run, "corpus int, k int, hash long, cnt long")


def _hashes(words: Column | str, seed: int | None = None) -> Column:
    extra = [] if seed is None else [F.lit(seed)]
    return F.coalesce(F.transform(words, lambda w: F.xxhash64(w, *extra)), F.array().cast("array<long>"))


def _hashed(tokenizer: str, seed: int | None = None) -> Column:
    return _hashes(tokens("text", tokenizer), seed)


def _counted(dealt: DataFrame, tokenizers: tuple[str, ...], settings: list[tuple[int, int]], wanted: list[np.ndarray], place: tuple[str, str]) -> DataFrame:
    """(corpus, k, gram, cnt, first) of the grams whose hash is among ``wanted`` of their setting, counted by string."""
    high, low = place
    none = F.array().cast("array<string>")
    src = dealt.select("_corpus", F.coalesce(F.col(high).cast("long"), F.lit(-(2**63))).alias("_high"), F.col(low).cast("long").alias("_low"), lexical._place(place).alias("_at"), *(c for t in tokenizers for c in (F.coalesce(tokens("text", t), none).alias(t), _hashed(t).alias(f"{t}_1"))))
    src = src.select("_corpus", "_high", "_low", "_at", *(c for t in tokenizers for c in (F.col(t), F.col(f"{t}_1"), _hashes(t, 7).alias(f"{t}_2"))))  # of the tokens that are there
    shared = dealt.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            b = b.take(pa.array(np.lexsort((b.column(2).to_numpy(), b.column(1).to_numpy()))))  # so that first is least
            corpora = b.column(0).to_numpy().astype(np.int64)
            for t in range(len(tokenizers)):
                toks = Tokens(b.column(4 + 3 * t))
                one, two = (b.column(5 + 3 * t + s).flatten().to_numpy(zero_copy_only=False).view(U) for s in (0, 1))
                for k, (of, n) in enumerate(settings):
                    known = shared.value[k]
                    if of != t or not len(known):
                        continue
                    at, h = toks.grams(one, n)
                    spot = np.minimum(np.searchsorted(known, h), len(known) - 1)
                    hit = known[spot] == h
                    at, spot, other = at[hit], spot[hit], toks.grams(two, n)[1][hit]
                    key = corpora[toks.row[at]] * len(known) + spot
                    while len(key):  # once, unless two grams share a hash
                        _, first, own, cnt = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
                        same = other == other[first][own]
                        if not same.all():
                            cnt = np.bincount(own[same], minlength=len(first))
                        where = at[first]
                        gram = toks.flat.take(pa.array(where))
                        if n > 1:
                            gram = pc.binary_join_element_wise(gram, *(toks.flat.take(pa.array(where + i)) for i in range(1, n)), " ")
                        row = toks.row[where]
                        yield pa.RecordBatch.from_arrays([pa.array(corpora[row].astype(np.int32)), pa.array(np.full(len(row), k, np.int32)), gram, pa.array(cnt.astype(np.int64)), b.column(3).take(pa.array(row)), pa.array(where - toks.begin[row])], names=["corpus", "k", "gram", "cnt", "at", "pos"])
                        key, at, other = key[~same], at[~same], other[~same]

    found = src.mapInArrow(run, "corpus int, k int, gram string, cnt long, at decimal(38,0), pos long")
    return found.groupBy("corpus", "k", "gram").agg(F.sum("cnt").alias("cnt"), F.min(F.col("at") + F.col("pos")).alias("first"))


def _dealt(chunks: DataFrame, sizes: list[tuple[str, int]], place: tuple[str, str]) -> DataFrame:
    """Chunks with their corpus's number, those of a slice in one partition; a corpus has slices by its share of all."""
    spark = chunks.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions")) * 2
    total, rows, begin = sum(n for _, n in sizes) or 1, [], 0
    for i, (label, n) in enumerate(sizes):
        slices = max(1, -(-n * parts // total))
        rows.append((label, i, begin, slices))
        begin += slices
    known = spark.createDataFrame(rows, f"_label {dict(chunks.dtypes)['label']}, _corpus int, _begin int, _slices int")
    met = chunks.join(F.broadcast(known), F.col("label").eqNullSafe(F.col("_label")))  # at most MOST_CORPORA rows
    cut = F.col("_begin") + F.pmod(F.xxhash64(*place), F.col("_slices"))
    return met.select("_corpus", *place, "text", cut.alias("_slice")).repartition(max(begin, 1), "_slice")


def frequent_counts(chunks: DataFrame, size: int, tokenizers: tuple[str, ...] = TOKENIZERS, orders: tuple[int, ...] = ORDERS, place: tuple[str, str] = ("doc_id", "chunk_in_document"), sizes: DataFrame | None = None) -> DataFrame:
    """(label, tokenizer, n, gram, cnt, first), as ``lexical.gram_counts`` gives them, of all grams that are among the ``size`` most
    frequent of any corpus (ties at the end included), for every corpus: all that vocabularies and their comparison need.

    ``sizes`` (label, n): about how large each corpus is; without it chunks are counted. The first two passes run at once.
    """
    spark, everything = chunks.sparkSession, lambda: lexical.gram_counts(chunks, tokenizers, orders, place)
    listed = (sizes if sizes is not None else chunks.groupBy("label").agg(F.count("*").alias("n"))).select("label", "n").limit(MOST_CORPORA + 1).collect()
    if len(listed) > MOST_CORPORA:
        return everything()
    corpora = sorted(((r.label, r.n) for r in listed), key=lambda r: (r[0] is not None, str(r[0])))
    settings = [(t, n) for t in range(len(tokenizers)) for n in orders]
    dealt = held(_dealt(chunks, corpora, place))  # shuffled once, read by all passes

    top = lambda corpus, k, h, n: np.argpartition(n, len(n) - size)[len(n) - size :] if len(n) > size else np.arange(len(n))
    sums = _sent(dealt, tokenizers, settings, top).groupBy("corpus", "k", "hash").agg(F.sum("cnt").alias("cnt"), F.count("*").alias("nodes"))
    ranked = sums.withColumn("rank", F.row_number().over(Window.partitionBy("corpus", "k").orderBy(F.col("hash").isNull(), F.desc("cnt"))))
    bounds = ranked.groupBy("corpus", "k").agg(F.max(F.when(F.col("rank") == size, F.col("cnt"))).alias("least"), F.max(F.when(F.col("hash").isNull(), F.col("nodes"))).alias("nodes")).collect()
    least, nodes = {(r.corpus, r.k): r.least or 1 for r in bounds}, {(r.corpus, r.k): r.nodes for r in bounds}

    while True:
        need = {key: -(-b // nodes[key]) for key, b in least.items()}
        enough = lambda corpus, k, h, n, need=need: np.flatnonzero(n >= need.get((corpus, k), 1))
        some = held(_sent(dealt, tokenizers, settings, enough).groupBy("corpus", "k", "hash").agg(F.sum("cnt").alias("cnt"), F.count("*").alias("nodes")))
        seen = {(r.corpus, r.k): r.nodes for r in some.filter("hash IS NULL").collect()}
        if all((need.get(key, 1) - 1) * m < least.get(key, 1) for key, m in seen.items()):
            break
        nodes |= seen
    rows = [(c, k, b, need[c, k], seen.get((c, k), 0)) for (c, k), b in least.items()]
    limits = spark.createDataFrame(rows, "corpus int, k int, least long, need long, met long")
    may = F.col("cnt") + (F.col("met") - F.col("nodes")) * (F.col("need") - 1) >= F.col("least")
    stay = some.filter("hash IS NOT NULL").join(F.broadcast(limits), ["corpus", "k"]).filter(may).select("k", "hash").distinct().limit(MOST_SURVIVORS + 1).toArrow()
    if stay.num_rows > MOST_SURVIVORS:
        return everything()
    of, hashes = stay.column("k").to_numpy(), stay.column("hash").to_numpy()
    wanted = [np.sort(hashes[of == k].view(U)) for k in range(len(settings))]

    names = spark.createDataFrame([(i, label) for i, (label, _) in enumerate(corpora)], f"corpus int, label {dict(chunks.dtypes)['label']}")
    element = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("k") + 1)
    got = _counted(dealt, tokenizers, settings, wanted, place).join(F.broadcast(names), "corpus")
    return got.select("label", element([tokenizers[t] for t, _ in settings]).alias("tokenizer"), element([n for _, n in settings]).alias("n"), "gram", "cnt", "first")


def gram_totals(chunks: DataFrame, tokenizer: str, orders: tuple[int, ...], chars: DataFrame | None = None) -> DataFrame:
    """(label, n, grams, total, top): how many different n-grams a corpus has, how many at all, and how often its most frequent one is met.

    A gram travels as 96 bits of two hashes, sorted and packed, with its count in a task; no string and no row a gram is shuffled. Among
    10**9 grams of a corpus two would share these bits with a chance below 10**-10. ``chars`` (label, chars): about how many characters each
    corpus has, of whose hashes a group then gets a range.
    """
    spark, kind = chunks.sparkSession, dict(chunks.dtypes)["label"]
    listed = (chars if chars is not None else chunks.groupBy("label").agg(F.sum(F.length("text")).alias("chars"))).select("label", "chars").collect()
    parts = spark.sparkContext.broadcast({r.label: max(1, -(-(r.chars or 0) // GROUP_CHARS)) for r in listed})  # a row a corpus
    words = chunks.select("label", F.coalesce(tokens("text", tokenizer), F.array().cast("array<string>")).alias("w"))
    src = words.select("label", _hashes("w").alias("one"), _hashes("w", 7).alias("two"))
    names = ["label", "n", "part", "h", "k"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, size = {}, 0
        for b in _slices(batches):
            own = b.column(0).dictionary_encode(null_encoding="encode")
            corpora, code = own.dictionary.to_pylist(), own.indices.to_numpy()
            toks, two = Tokens(b.column(1)), b.column(2).flatten().to_numpy(zero_copy_only=False).view(U)
            one = toks.flat.to_numpy(zero_copy_only=False).view(U)
            for n in orders:
                at, h = toks.grams(one, n)
                g, of = toks.grams(two, n)[1].astype(np.uint32), code[toks.row[at]]
                for i, label in enumerate(corpora):
                    mine = of == i
                    known.setdefault((label, n), []).append((h[mine], g[mine]))
                size += len(h)
            if size > 2 * GATHERED:
                yield from sent(known)
                known, size = {}, 0
        yield from sent(known)

    def sent(known: dict) -> Iterator[pa.RecordBatch]:
        for (label, n), found in known.items():
            h, g, k = _merged([h for h, _ in found], [g for _, g in found], None)
            m, rows = parts.value.get(label, 1), []
            ends = [0, *np.searchsorted(h, np.array([(i << 64) // m for i in range(1, m)], U)), len(h)]
            for part, (i, j) in enumerate(zip(ends, ends[1:])):
                if j > i:
                    planes = np.concatenate([h[i:j].astype(">u8").view(np.uint8).reshape(-1, 8), g[i:j].view(np.uint8).reshape(-1, 4)], axis=1)
                    kinds = np.uint8 if k[i:j].max() < 256 else np.int64
                    rows.append((label, n, part, planes.T.tobytes(), k[i:j].astype(kinds).tobytes()))  # by planes: leading bytes of sorted hashes are alike
            if rows:
                yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], schema=schema)

    sent_schema = f"label {kind}, n int, part int, h binary, k binary"
    schema = pa.schema([("label", to_arrow_type(chunks.schema["label"].dataType)), ("n", pa.int32()), ("part", pa.int32()), ("h", pa.binary()), ("k", pa.binary())])

    def count(key: tuple, t: pa.Table) -> pa.Table:
        hs, gs, ks = [], [], []
        for h, k in zip(t["h"].to_pylist(), t["k"].to_pylist(), strict=True):
            planes = np.frombuffer(h, np.uint8).reshape(12, -1).T
            hs.append(np.ascontiguousarray(planes[:, :8]).view(">u8")[:, 0].astype(U))
            gs.append(np.ascontiguousarray(planes[:, 8:]).view(np.uint32)[:, 0])
            ks.append(np.frombuffer(k, np.uint8 if len(k) == len(planes) else np.int64).astype(np.int64))
        k = _merged(hs, gs, ks)[2]
        return pa.table([t["label"].slice(0, 1), t["n"].slice(0, 1).cast(pa.int64()), pa.array([len(k)]), pa.array([int(k.sum())]), pa.array([int(k.max())])], names=["label", "n", "grams", "total", "top"])

    counted = src.mapInArrow(run, sent_schema).groupBy("label", "n", "part").applyInArrow(count, f"label {kind}, n long, grams long, total long, top long")
    return counted.groupBy("label", "n").agg(F.sum("grams").alias("grams"), F.sum("total").alias("total"), F.max("top").alias("top"))


def _merged(hs: list[np.ndarray], gs: list[np.ndarray], ks: list[np.ndarray] | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Equal pairs of hashes once, in order, with the sum of their counts (1 each without any)."""
    h, g = np.concatenate(hs), np.concatenate(gs)
    order = np.argsort(h)
    h, g = h[order], g[order]
    alike = h[1:] == h[:-1]
    if (alike & (g[1:] != g[:-1])).any():  # two grams share 64 bits
        again = np.lexsort((g, h))
        order, h, g = order[again], h[again], g[again]
        alike = h[1:] == h[:-1]
    new = np.flatnonzero(np.concatenate([[True] * bool(len(h)), ~(alike & (g[1:] == g[:-1]))]))
    k = np.diff(new, append=len(h)) if ks is None else np.add.reduceat(np.concatenate(ks)[order], new)
    return h[new], g[new], k
