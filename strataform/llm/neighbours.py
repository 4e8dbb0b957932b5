"""Approximate nearest neighbours by a hierarchical k-means tree (operator 13).

Index. The tree is fitted to a bounded sample (``SAMPLE`` vectors, the least by a digest of their ids; fewer of very long vectors): k-means
splits a node into up to ``BRANCHES``, and a small one into fewer, until it holds at most ``LEAF`` of the sample. Every row is then put into a leaf by
descending to the nearest centre of each level.

Search. A query walks the tree best bin first: a priority queue holds the centres met so far by their distance, the
nearest is taken out, a leaf is visited, any other node puts its children in. How many leaves a query visits is calibrated: the true
neighbours of up to ``CALIBRATED`` queries (least digests) are found by brute force over all rows, in blocks, and the visits are
widened step by step until those leaves hold the ``target`` share of them. All rows of a visited leaf are compared; partners have no cap.

Spark. Leaves are dealt to buckets of about equal size, as many as a shuffle has partitions or more, so that a bucket holds at most
about ``BUCKET`` rows; a leaf larger than a bucket is cut into slices, whose rows are dealt in turn, and queries visit all its slices. Rows
and the queries that visit a bucket meet in one sorted shuffle: the rows of a bucket come first and are held as one matrix, queries
stream past it. What each bucket finds for a query is cut to the k nearest and merged. The tree and one counter a leaf reach the
driver, both bounded by the sample; neither rows nor queries do, apart from the sample and the calibrated queries.

Distances are first bounded by GEMM, then worked out as differences, in doubles, for all that may be among the k nearest.

Defined results: vectors that are null, empty, all zero, or hold null or non-finite entries take no part, nor do those of another
length than the commonest, nor rows without an id. Rows that share the query's id are the query's own. Repeated rows are each a
candidate, so that an id may be found as often as it repeats; equal queries (id and vector) are one, and queries of one id and
different vectors merge into one list, in which a row that several of them find stands once for each. Ties go to the smaller id. Entries whose squares overflow have
infinite distances. Fewer candidates than k give fewer rows; an empty table or one without queries gives an empty table. Other columns are not
read, whatever they are called.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataform.llm.store import give_back, tasks
from strataform.llm.vectors import countable, dimension, matrix

#: Vectors that the tree is fitted to, and bytes that they may take.
SAMPLE, SAMPLE_BYTES = 8192, 64 << 20
BRANCHES, LEAF, ROUNDS = 16, 24, 12
#: Queries whose true neighbours are found, the share of these that visited leaves must hold, and the factor of each widening.
CALIBRATED, TARGET, WIDER = 128, 0.96, 1.15
#: Rows of a bucket at most (about), and rows or queries that a worker compares in one step.
BUCKET, STEP = 65_536, 512
NEAREST = 10


@dataclass
class Tree:
    """Nodes in the order they were made: centres, children (none: a leaf) and each leaf's number."""

    centres: np.ndarray
    children: list[np.ndarray]
    leaf: np.ndarray
    leaves: int = field(init=False)

    def __post_init__(self) -> None:
        self.leaves = int(self.leaf.max()) + 1
        self.squares = (self.centres * self.centres).sum(1)

    @staticmethod
    def fit(x: np.ndarray, branches: int = BRANCHES, most: int = LEAF, seed: int = 0) -> Tree:
        rng, centres, children, queue = np.random.default_rng(seed), [x.mean(0)], [], [np.arange(len(x))]
        for own in queue:  # grows while it is read
            groups, made = _split(x[own], min(branches, -(-2 * len(own) // most)), rng) if len(own) > most else ([], [])
            children.append(np.arange(len(centres), len(centres) + len(made)))
            centres.extend(made)
            queue.extend(own[g] for g in groups)
        leaf, left = np.full(len(centres), -1), [0]
        n = 0
        while left:  # depth first, so that leaves near one another have near numbers
            node = left.pop()
            if len(children[node]):
                left.extend(reversed(children[node].tolist()))
            else:
                leaf[node], n = n, n + 1
        return Tree(np.array(centres), children, leaf)

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf of every row, by descending to the nearest centre (ties: the first)."""
        at, open_ = np.zeros(len(x), np.int64), np.arange(len(x))
        while len(open_):
            for node in np.unique(at[open_]):
                kids = self.children[node]
                if len(kids):
                    own = open_[at[open_] == node]
                    at[own] = kids[(self.squares[kids] - 2 * (x[own] @ self.centres[kids].T)).argmin(1)]
            open_ = open_[[len(self.children[k]) > 0 for k in at[open_]]]
        return self.leaf[at]

    def visits(self, q: np.ndarray, most: int) -> np.ndarray:
        """The first ``most`` leaves of each query, best bin first."""
        far = self.squares[None, :] - 2 * (q @ self.centres.T)
        out = np.empty((len(q), min(most, self.leaves)), np.int64)
        for i, d in enumerate(far.tolist()):
            queue, k = [(0.0, 0)], 0
            while k < out.shape[1]:
                _, node = heapq.heappop(queue)
                if self.leaf[node] >= 0:
                    out[i, k], k = self.leaf[node], k + 1
                for c in self.children[node]:
                    heapq.heappush(queue, (d[c], c))
        return out


def _split(x: np.ndarray, branches: int, rng: np.random.Generator) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Groups of rows and their means by k-means; none if all rows are equal."""
    distinct = np.unique(x, axis=0)
    if len(distinct) < 2:
        return [], []
    c = distinct[rng.choice(len(distinct), min(branches, len(distinct)), replace=False)]
    for _ in range(ROUNDS):
        own = ((c * c).sum(1) - 2 * x @ c.T).argmin(1)
        new = np.stack([x[own == j].mean(0) if (own == j).any() else c[j] for j in range(len(c))])
        if np.array_equal(new, c):
            break
        c = new
    own = ((c * c).sum(1) - 2 * x @ c.T).argmin(1)
    held = [j for j in range(len(c)) if (own == j).any()]
    return ([np.flatnonzero(own == j) for j in held], [c[j] for j in held]) if len(held) > 1 else ([], [])


def nearest(q: np.ndarray, qid: np.ndarray, x: np.ndarray, xid: np.ndarray, k: int, seen: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query's place, row's place, distance): the k nearest rows of every query, by distance, then id; rows of its own id and
    rows outside ``seen`` don't count."""
    if not len(q) or not len(x):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    with np.errstate(over="ignore", invalid="ignore"):
        qq, xx = (q * q).sum(1), (x * x).sum(1)
        far = qq[:, None] - 2 * (q @ x.T) + xx
        slack = 1e-11 * (qq + xx.max())
        odd = ~np.isfinite(far)
        far[odd] = -np.inf  # worked out below, whatever they are
    out = qid[:, None] == xid
    far[out if seen is None else out | ~seen] = np.inf
    limit = np.partition(far, k - 1, axis=1)[:, k - 1] + 2 * slack if len(x) > k else np.full(len(q), np.inf)
    limit[odd.any(1)] = np.inf
    i, j = np.nonzero((far <= limit[:, None]) & (far < np.inf))
    d = np.empty(len(i))
    for s in range(0, len(i), 1 << 15):
        with np.errstate(over="ignore"):
            diff = q[i[s : s + (1 << 15)]] - x[j[s : s + (1 << 15)]]
            d[s : s + (1 << 15)] = np.sqrt((diff * diff).sum(1))
    order = np.lexsort((xid[j], d, i))
    i, j, d = i[order], j[order], d[order]
    first = np.arange(len(i)) - np.searchsorted(i, i) < k
    return i[first], j[first], d[first]


def usable(vectors: DataFrame, key: str, column: str) -> tuple[DataFrame, int]:
    """(key, column) of the rows that take part, and the length of their vectors."""
    rows = countable(vectors.filter(F.col(key).isNotNull()), column).filter(F.exists(column, lambda v: v != 0)).select(F.col(key).cast("long").alias("id"), F.col(column).alias("x"))
    d = dimension(rows, "x")
    return rows.filter(F.size("x") == d), d


def _least(rows: DataFrame, n: int, d: int, salt: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of ``n`` rows with the least digests: each task passes on its least, a bounded number reaches the driver."""
    got = rows.orderBy(F.md5(F.concat(F.lit(salt), F.col("id").cast("string")).cast("binary")), "id").limit(n).toArrow()
    return got.column("id").to_numpy(), matrix(got.column("x").combine_chunks(), d)


@dataclass(frozen=True)
class Index:
    """The tree, how many leaves a query visits, the recall that this had when calibrated, and each leaf's first bucket and slices."""

    tree: Tree
    visits: int
    recall: float
    first: np.ndarray
    slices: np.ndarray
    buckets: int


def _batches(batches: Iterator[pa.RecordBatch], d: int, rows: int = 4096) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for b in batches:
        for i in range(0, b.num_rows, rows):
            part = b.slice(i, rows)
            yield part.column(0).to_numpy(), matrix(part.column(1), d)
    give_back()


def build(vectors: DataFrame, queries: Column | str, k: int = NEAREST, target: float = TARGET, key: str = "vec_id", column: str = "embedding", sample: int = SAMPLE, calibrated: int = CALIBRATED) -> Index | None:
    """Fit the tree, count its leaves over all rows, calibrate visits and lay out buckets; None without rows."""
    rows, d = usable(vectors, key, column)
    if not d:
        return None
    spark = vectors.sparkSession
    tree = Tree.fit(_least(rows, max(LEAF, min(sample, SAMPLE_BYTES // (8 * d))), d, "fit")[1])
    qid, q = _least(rows.filter(queries), calibrated, d, "calibrate")
    shared = spark.sparkContext.broadcast((tree, qid, q))

    def survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A task's rows of every leaf, and its nearest rows of the calibrated queries, with their leaves."""
        t, ids, qs = shared.value
        held, best = np.zeros(t.leaves, np.int64), [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)]
        for xid, x in _batches(batches, d):
            leaf = t.assign(x)
            held += np.bincount(leaf, minlength=t.leaves)
            i, j, far = nearest(qs, ids, x, xid, k)
            best = [np.concatenate([p, n]) for p, n in zip(best, (i, xid[j], far, leaf[j]), strict=True)]
            order = np.lexsort((best[1], best[2], best[0]))
            order = order[np.arange(len(order)) - np.searchsorted(best[0][order], best[0][order]) < k]
            best = [p[order] for p in best]
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.full(len(some), -1), best[0]])), pa.array(np.concatenate([held[some], best[1]])), pa.array(np.concatenate([np.zeros(len(some)), best[2]])), pa.array(np.concatenate([some, best[3]]))], names=["q", "id", "far", "leaf"])

    found = rows.mapInArrow(survey, "q long, id long, far double, leaf long")
    counted = found.filter("q < 0").groupBy("leaf").agg(F.sum("id").alias("n"), F.lit(None).cast("array<long>").alias("met"))
    order = Window.partitionBy("q").orderBy("far", "id")
    truth = found.filter("q >= 0").withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k).groupBy("q").agg(F.collect_list("leaf").alias("met"))
    got = counted.select("leaf", "n", "met").unionByName(truth.select(F.col("q").alias("leaf"), F.lit(-1).cast("long").alias("n"), "met")).collect()
    sizes, met = np.zeros(tree.leaves, np.int64), {r.leaf: r.met for r in got if r.met is not None}
    for r in got:
        if r.met is None:
            sizes[r.leaf] = r.n
    visits, recall = _calibrate(tree, q, met, target)
    return Index(tree, visits, recall, *_layout(sizes, tasks(spark)))


def _calibrate(tree: Tree, q: np.ndarray, met: dict[int, list[int]], target: float) -> tuple[int, float]:
    """Widen the visits until the visited leaves hold the target share of the true neighbours."""
    if not met:
        return tree.leaves, 1.0
    walks, wide, total = tree.visits(q, tree.leaves), 1, sum(map(len, met.values()))
    places = [np.argsort(w) for w in walks]  # a leaf's place in the walk
    at = np.concatenate([places[i][leaves] for i, leaves in met.items()])
    while (recall := float((at < wide).sum()) / total) < target and wide < tree.leaves:
        wide = min(tree.leaves, max(wide + 1, int(wide * WIDER)))
    return wide, recall


def _layout(sizes: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Each leaf's first bucket and number of slices, and the number of buckets: leaves share a bucket while it has room."""
    total = int(sizes.sum())
    room = max(1, -(-total // max(parts, -(-total // BUCKET))))
    first, slices, bucket, used = np.zeros(len(sizes), np.int64), np.ones(len(sizes), np.int64), 0, 0
    for leaf, n in enumerate(sizes.tolist()):
        if used and used + n > room:
            bucket, used = bucket + 1, 0
        first[leaf], slices[leaf] = bucket, max(1, -(-n // room))
        many = int(slices[leaf])
        bucket, used = (bucket + many - 1, -(-n // many)) if many > 1 else (bucket, used + n)
    return first, slices, bucket + 1


def search(vectors: DataFrame, queries: Column | str, index: Index, k: int = NEAREST, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(query_id, rank, <key>, score): the k nearest rows found of every row that ``queries`` (a condition on ``id``) selects."""
    rows, d = usable(vectors, key, column)
    shared = vectors.sparkSession.sparkContext.broadcast(index)
    schema, names = "bucket int, kind int, id long, leaves array<int>, x binary", ["bucket", "kind", "id", "leaves", "x"]

    def table(bucket, kind, ids, offsets, leaves, x) -> pa.RecordBatch:
        lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(leaves, pa.int32()))
        return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array(np.full(len(bucket), kind, np.int32)), pa.array(ids), lists, pa.array([r.tobytes() for r in x], pa.binary())], names=names)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows with their bucket; the slices of a large leaf are dealt in turn."""
        n = 0
        for ids, x in _batches(batches, d):
            s = shared.value
            leaf = s.tree.assign(x)
            bucket = s.first[leaf] + (n + np.arange(len(leaf))) % s.slices[leaf]
            n += len(leaf)
            yield table(bucket, 0, ids, np.arange(len(leaf) + 1), leaf, x)

    def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Queries, once for each bucket that they visit, with the leaves visited there."""
        for ids, x in _batches(batches, d, STEP):
            s = shared.value
            walks = s.tree.visits(x, s.visits)
            i, leaf = np.repeat(np.arange(len(ids)), walks.shape[1]), walks.reshape(-1)
            times = s.slices[leaf]
            begin = np.repeat(np.cumsum(times) - times, times)
            i, leaf = np.repeat(i, times), np.repeat(leaf, times)
            bucket = s.first[leaf] + np.arange(len(leaf)) - begin
            order = np.lexsort((leaf, bucket, i))
            i, leaf, bucket = i[order], leaf[order], bucket[order]
            new = np.flatnonzero(np.concatenate([[True], (i[1:] != i[:-1]) | (bucket[1:] != bucket[:-1])]))
            for k0 in range(0, len(new), 4096):  # few at once, as each carries its vector
                cut = np.append(new[k0 : k0 + 4096], new[k0 + 4096] if k0 + 4096 < len(new) else len(i))
                at = cut[:-1]
                yield table(bucket[at], 1, ids[i[at]], cut - cut[0], leaf[cut[0] : cut[-1]], x[i[at]])

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A bucket's rows come first, then its queries."""
        at, held, rows_ = None, [], None
        for b in batches:
            bucket, kind, ids = (b.column(c).to_numpy() for c in range(3))
            lists, x = b.column(3), b.column(4)
            cuts = np.flatnonzero(np.diff(bucket * 2 + kind)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(bucket)], strict=True):
                if bucket[lo] != at:
                    at, held, rows_ = bucket[lo], [], None
                raw = x.slice(lo, hi - lo)
                vecs = np.frombuffer(b"".join(raw.to_pylist()), np.float64).reshape(hi - lo, d)
                own = lists.slice(lo, hi - lo)
                leaves, counts = own.flatten().to_numpy(), own.value_lengths().to_numpy()
                if not kind[lo]:
                    held.append((ids[lo:hi], leaves, vecs))
                    continue
                if rows_ is None and held:
                    rows_, held = [np.concatenate(p) for p in zip(*held, strict=True)], []
                if rows_ is None:
                    continue  # only empty leaves in this bucket
                known, of = np.unique(rows_[1], return_inverse=True)
                spot = np.minimum(np.searchsorted(known, leaves), len(known) - 1)
                hit = known[spot] == leaves
                visited = np.zeros((hi - lo, len(known)), bool)
                visited[np.repeat(np.arange(hi - lo), counts)[hit], spot[hit]] = True
                few = max(1, min(STEP, (4 << 20) // len(rows_[0])))
                for s in range(0, hi - lo, few):
                    i, j, far = nearest(vecs[s : s + few], ids[lo + s : min(hi, lo + s + few)], rows_[2], rows_[0], k, visited[s : s + few][:, of])
                    yield pa.RecordBatch.from_arrays([pa.array(ids[lo + s + i]), pa.array(rows_[0][j]), pa.array(far)], names=["query_id", "id", "score"])
        give_back()

    dealt = rows.mapInArrow(placed, schema).unionByName(rows.filter(queries).dropDuplicates(["id", "x"]).mapInArrow(walked, schema))
    met = dealt.repartition(index.buckets, "bucket").sortWithinPartitions("bucket", "kind")
    found = met.mapInArrow(compared, "query_id long, id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(key), "score")


def neighbours(vectors: DataFrame, queries: Column | str, k: int = NEAREST, target: float = TARGET, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """Build an index of ``vectors`` and search it for the rows that ``queries`` selects."""
    index = build(vectors, queries, k, target, key, column)
    if index is None:
        return vectors.sparkSession.createDataFrame([], f"query_id long, rank int, {key} long, score double")
    return search(vectors, queries, index, k, key, column)


def op13_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"), "id % 100 = 0")
