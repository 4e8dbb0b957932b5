"""Quality classifier by regularised quadratic discriminant analysis (operator 6).

Transformed statistics of each text are modelled as one Gaussian per class with a shrunken covariance.
Fitting needs only sums and sums of products, which Spark adds up over all labelled rows (one row per
class reaches the driver, whatever the data's size). The Cholesky factor of each covariance is inverted
once and goes to the workers in the task; a score is the logistic of the difference of the two log
densities (Mahalanobis terms) plus the classes' log odds.

Rows whose crc32 of the id (as text) is divisible by 5 are never learnt from. Labels, language, source
and ids are never inputs of a score.

Defined results: a null text counts as empty and gets a score as any other; null labels or ids in
``labels`` are left out, equal label rows count once, a document with both labels counts in both classes; if a class has fewer than two rows, every score is
the smoothed share of label 1. Repeated documents are scored each on its own. Names of the result win
over columns of the input. Very long texts are read whole. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, IntegerType, StructField, StructType

from strataform.llm import words as W
from strataform.llm.store import steps, text_buffers

#: Share of each covariance that is taken from the pooled variances.
SHRINKAGE = 0.1
#: Scores from here on predict label 1.
THRESHOLD = 0.3
FOLDS = 5

SYMBOLS = W.byte_set(b"#*$%&<>")
UPPER = W.byte_set(range(0x41, 0x5B))
LETTER = W.byte_set([*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC0, 0x100)])  # ASCII letters and first bytes of others
DIGIT = W.byte_set(range(0x30, 0x3A))
STOP = W.byte_set(b".,;?")
NAMES = ["log_words", "word_length", "symbols", "pipes", "shouts", "upper", "digits", "stops", "distinct", "stutter", "lines"]


def statistics(texts: pa.Array) -> np.ndarray:
    """One row of transformed statistics per text."""
    buf, ofs, n = text_buffers(texts)
    word = ~W.SPACE[buf]
    s, e, first = W.spans(word, ofs)
    n_words = np.diff(first)
    per = 1.0 / np.maximum(n_words, 1)
    count = lambda table: W.sums(table[buf], ofs)
    letters = np.maximum(count(LETTER), 1)
    h, own = W.hashes(buf, s, e), W.owners(first)
    _, later = W.repeated(h ^ W.mix(np.arange(n, dtype=W.U))[own])
    stutter = np.zeros(len(h), bool)
    stutter[1:] = (h[1:] == h[:-1]) & (own[1:] == own[:-1])
    share = lambda x: np.sqrt(np.minimum(x, 4.0))  # noqa: E731  spreads small shares, bounds odd ones
    return np.stack(
        [
            np.log1p(n_words),
            np.log1p(np.minimum(W.sums(word & W.HEAD[buf], ofs) * per, 100.0)),
            share(count(SYMBOLS) * per),
            share(count(W.byte_set(b"|")) * per),
            share(count(W.byte_set(b"!")) * per),
            share(count(UPPER) / letters),
            share(count(DIGIT) * per),
            share(count(STOP) * per),
            share((n_words - W.sums(later, first)) * per),
            share(W.sums(stutter, first) * per),
            share(count(W.byte_set(b"\n")) * per),
        ],
        axis=1,
    )


@dataclass(frozen=True)
class Model:
    """Per class: mean, inverse Cholesky factor, half log determinant and log prior. ``flat``: the score if unfitted."""

    classes: tuple | None
    flat: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.classes is None:
            return np.full(len(x), self.flat)
        zero, one = (prior - half - 0.5 * (((x - mean) @ root.T) ** 2).sum(1) for mean, root, half, prior in self.classes)
        return np.round(1.0 / (1.0 + np.exp(np.clip(zero - one, -40, 40))), 6)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def _mapped(df: DataFrame, names: list[str], work, text: str) -> DataFrame:
    """``df`` with double columns ``names`` that ``work`` makes from the statistics of ``text``."""
    src = df.select([c for c in df.columns if c not in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches, text):
            got = work(statistics(b.column(b.schema.get_field_index(text))))
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(got[:, k]) for k in range(len(names)))], names=[*b.schema.names, *names])

    return src.mapInArrow(run, StructType([*src.schema.fields, *(StructField(k, DoubleType()) for k in names)]))


def fit(docs: DataFrame, labels: DataFrame, shrinkage: float = SHRINKAGE, text: str = "text") -> Model:
    """Learn from every labelled row that isn't held out."""
    marked = labels.select(F.col("doc_id").alias("id"), F.col("quality").cast("int").alias("y")).filter(F.col("id").isNotNull() & F.col("y").isin(0, 1) & ~held_out(F.col("id"))).distinct()
    learnt = docs.select(F.col("doc_id").alias("id"), text).filter(F.col("id").isNotNull() & ~held_out(F.col("id")))
    stats = _mapped(learnt, NAMES, lambda x: x, text).drop(text).join(marked, "id")
    pairs = [(i, j) for i in range(len(NAMES)) for j in range(i, len(NAMES))]
    rows = stats.groupBy("y").agg(F.count("*").alias("n"), *(F.sum(k).alias(k) for k in NAMES), *(F.sum(F.col(NAMES[i]) * F.col(NAMES[j])).alias(f"p{i}_{j}") for i, j in pairs)).collect()
    n = {r.y: r.n for r in rows}
    flat = (n.get(1, 0) + 1) / (sum(n.values()) + 2)
    if min(n.get(0, 0), n.get(1, 0)) < 2:
        return Model(None, round(flat, 6))
    mean, spread = {}, {}
    for r in rows:
        m = mean[r.y] = np.array([r[k] for k in NAMES]) / r.n
        c = np.zeros((len(NAMES), len(NAMES)))
        for i, j in pairs:
            c[i, j] = c[j, i] = r[f"p{i}_{j}"] / r.n - m[i] * m[j]
        spread[r.y] = c
    pooled = np.diag(sum(n[y] * np.diag(spread[y]) for y in n) / sum(n.values())) + 1e-4 * np.eye(len(NAMES))
    classes = []
    for y in (0, 1):
        factor = np.linalg.cholesky((1 - shrinkage) * spread[y] + shrinkage * pooled)
        classes.append((mean[y], np.linalg.inv(factor), float(np.log(np.diag(factor)).sum()), float(np.log(n[y]))))
    return Model(tuple(classes), round(flat, 6))


def classify(docs: DataFrame, model: Model, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """``docs`` with ``score`` and ``predicted``: one narrow pass."""
    src = docs.drop("score", "predicted", "held_out")
    out = _mapped(src, ["score"], lambda x: model.scores(x)[:, None], text)
    return out.withColumn("held_out", held_out(F.col("doc_id"))).withColumn("predicted", (F.col("score") >= threshold).cast(IntegerType())).withColumn("held_out", F.col("held_out").cast(BooleanType()))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return classify(docs, model).select("doc_id", "held_out", "score", "predicted")
