"""Embedding whitening by a two-pass covariance (operator 12).

Entries c become whole numbers x = floor(64 c) + 1000000. Pass 1 adds up x exactly (two halves of 32 bits, so that nothing
overflows), which gives n, the sums S and the mean S / n. Pass 2 centres every row before multiplying and adds up outer
products by GEMM. Tasks keep one fixed-size partial sum each; ``treeAggregate`` merges these level by level. LAPACK's symmetric
``eigh`` gives the components; the projection (dimensions x components) is broadcast. Pass 3 measures how far the covariance of
the whitened rows is from the identity; the last pass writes them.

Centring uses whole quotient and remainder: x - S // n is a small whole number, from which (S mod n) / n is taken, so
that no digits are lost to the offset.

Defined results: vectors that are null, empty, or hold null or non-finite entries, or entries whose x doesn't fit 62 bits,
are left out, as are those of another length than the commonest (the longer, of equally common ones). Ids may be null or repeat, rows
may repeat: each row counts. Components whose eigenvalue vanishes against the largest (dimensions x machine precision) can't be
whitened: their ``whitened`` is null and they don't count in ``identity_error``. ``explained`` is null if all variances are 0. A deviation
beyond 63 bits is null. An empty table gives an empty table. Other columns are not read, whatever they are called. Vectors of more than
``MOST_DIMENSIONS`` entries are refused, which bounds what is broadcast.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataform.llm.store import give_back
from strataform.llm.vectors import countable, dimension, matrix

SCALE, OFFSET, COMPONENTS = 64, 1_000_000, 32
#: Rows that a worker looks at in one step.
STEP = 4096


@dataclass(frozen=True)
class Whitening:
    """``n`` rows with exact ``sums``; ``projection``: unit components in columns, over the roots of ``values`` (zeros: null)."""

    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    trace: float
    projection: np.ndarray

    @property
    def known(self) -> np.ndarray:
        """Which components can be whitened."""
        return self.values > max(float(self.values[0]) if len(self.values) else 0.0, 0.0) * len(self.sums) * np.finfo(float).eps


def whole(x: np.ndarray) -> np.ndarray:
    return np.floor(SCALE * x).astype(np.int64) + OFFSET


def centred(x: np.ndarray, sums: tuple[int, ...], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(x - S / n in doubles, x - S // n, S mod n)."""
    base, rest = (np.array(v, np.int64) for v in zip(*(divmod(s, n) for s in sums), strict=True))
    near = x - base
    return near - rest / n, near, rest


def deviations(near: np.ndarray, rest: np.ndarray, n: int) -> list[int | None]:
    """Sums over dimensions of (n x - S)^2, exact; None where 63 bits don't hold them."""
    far = float(np.abs(near).max(initial=0)) + 1
    if near.shape[1] * (n * far) ** 2 < 2.0**62:
        return (((n * near - rest) ** 2).sum(1)).tolist()
    exact = [sum((n * int(v) - int(r)) ** 2 for v, r in zip(row, rest, strict=True)) for row in near]
    return [v if v < 1 << 63 else None for v in exact]


def _fitting(vectors: DataFrame, column: str) -> DataFrame:
    return countable(vectors, column).filter(F.forall(column, lambda v: F.abs(v.cast("double")) < F.lit(2.0**56)))


def _of_length(vectors: DataFrame, column: str, d: int) -> DataFrame:
    return _fitting(vectors, column).filter(F.size(column) == d)


def _summed(rows: DataFrame, column: str, d: int, work: Callable[[np.ndarray], list[np.ndarray]]) -> list[np.ndarray] | None:
    """The sums of what ``work`` makes of steps of rows: tasks add up their own, ``treeAggregate`` the tasks'."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            for i in range(0, b.num_rows, STEP):
                part = work(whole(matrix(b.column(0).slice(i, STEP), d)))
                total = part if total is None else [p + q for p, q in zip(total, part, strict=True)]
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([[p.astype(p.dtype).tobytes() for p in total]], pa.list_(pa.binary())), pa.array([[p.dtype.str for p in total]], pa.list_(pa.string()))], names=["parts", "kinds"])
        give_back()

    def add(total, row):
        part = [np.frombuffer(bytes(p), k).astype(object if k == "<i8" else np.float64) for p, k in zip(row.parts, row.kinds, strict=True)]
        return part if total is None else merge(total, part)

    def merge(a, b):
        return b if a is None else a if b is None else [p + q for p, q in zip(a, b, strict=True)]

    return rows.select(column).mapInArrow(run, "parts array<binary>, kinds array<string>").rdd.treeAggregate(None, add, merge, 2)


def fit(vectors: DataFrame, column: str = "embedding", components: int = COMPONENTS) -> Whitening | None:
    """Mean and components of all vectors that count; None without any."""
    d = dimension(_fitting(vectors, column), column)
    rows = _of_length(vectors, column, d)
    one = _summed(rows, column, d, lambda x: [np.array([len(x)]), (x >> 32).sum(0), (x & 0xFFFFFFFF).sum(0)]) if d else None
    if one is None:
        return None
    n, sums = int(one[0][0]), tuple(int(h) * (1 << 32) + int(low) for h, low in zip(one[1], one[2], strict=True))

    def products(x: np.ndarray) -> list[np.ndarray]:
        y = centred(x, sums, n)[0]
        return [(y.T @ y).reshape(-1)]

    (flat,) = _summed(rows, column, d, products)
    v = flat.astype(np.float64).reshape(d, d) / n
    values, axes = np.linalg.eigh((v + v.T) / 2)
    order = np.argsort(values)[::-1][: min(components, d)]
    values, axes = np.clip(values[order], 0, None), axes[:, order]
    got = Whitening(n, sums, values, float(np.trace(v)), axes)
    return Whitening(n, sums, values, got.trace, axes / np.sqrt(np.where(got.known, values, 1.0)))


def identity_error(vectors: DataFrame, model: Whitening, column: str = "embedding") -> float:
    """The largest absolute entry of the whitened rows' covariance minus the identity, from a pass over all rows."""
    d, p = len(model.sums), model.projection[:, model.known]

    def moments(x: np.ndarray) -> list[np.ndarray]:
        z = centred(x, model.sums, model.n)[0] @ p
        return [z.sum(0), (z.T @ z).reshape(-1)]

    if not p.size:
        return 0.0
    total, square = (s.astype(np.float64) / model.n for s in _summed(_of_length(vectors, column, d), column, d, moments))
    return float(np.abs(square.reshape(len(total), -1) - np.outer(total, total) - np.eye(len(total))).max())


def whiten(vectors: DataFrame, model: Whitening, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(key, n, deviation, whitened array<double>): one narrow pass over all rows that count, with the projection broadcast."""
    d = len(model.sums)
    shared = vectors.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        known, width = m.known, m.projection.shape[1]
        for b in batches:
            for i in range(0, b.num_rows, STEP):
                part = b.slice(i, STEP)
                y, near, rest = centred(whole(matrix(part.column(1), d)), m.sums, m.n)
                z = y @ m.projection
                values = pa.array(z.reshape(-1), mask=np.tile(~known, len(z)))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, z.size + 1, width, dtype=np.int32)), values)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.full(len(z), m.n)), pa.array(deviations(near, rest, m.n), pa.int64()), lists], names=[key, "n", "deviation", "whitened"])
        give_back()

    kind = dict(vectors.dtypes)[key]
    return _of_length(vectors, column, d).select(key, column).mapInArrow(run, f"{key} {kind}, n long, deviation long, whitened array<double>")


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    model = fit(vectors)
    if model is None:
        return spark.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    share = F.array(*(F.lit(float(e) / model.trace if model.trace > 0 else None).cast("double") for e in model.values))
    rows = whiten(vectors, model).select("vec_id", "n", "deviation", F.posexplode("whitened").alias("c", "whitened"))
    return rows.select("vec_id", (F.col("c") + 1).cast("int").alias("component"), "n", "deviation", "whitened", F.get(share, F.col("c")).alias("explained"), F.lit(identity_error(vectors, model)).alias("identity_error"))
