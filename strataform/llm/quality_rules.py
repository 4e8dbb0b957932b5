"""Quality rules from repetition coverage (operator 9).

For every text, rolling hashes of several n-gram lengths (numpy) tell which words lie in an n-gram
that the text holds more than once; the characters of those words, and of lines that repeat an
earlier line, are measured against all characters in words.

Defined results: a null or empty text has no words, fails the base rule and isn't kept. Repeated rows
are judged each on its own. Extra columns pass through untouched, and clashing ones are dropped in
favour of the measures. Very long texts are measured whole. Shares equal to a limit pass. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from strataform.llm import words as W
from strataform.llm.store import steps, text_buffers

SYMBOLS = W.byte_set(b"#*$%&|<>")


@dataclass(frozen=True)
class Rules:
    """Limits. Shares are of the characters in words.

    ``lengths``: n-gram lengths, the first being the base rule's; ``limits``: the largest share of
    characters inside n-grams of that length that occur twice or more; ``line_limit``: the largest share
    inside lines equal to an earlier line.
    """

    min_words: int = 10
    max_repeat_percent: int = 20
    lengths: tuple[int, ...] = (5, 8, 12)
    limits: tuple[float, ...] = (0.25, 0.20, 0.20)
    line_limit: float = 0.30


FIELDS = [("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("dup_line_share", pa.float64())]


def measure(texts: pa.Array, rules: Rules = Rules()) -> dict[str, np.ndarray]:
    """The measures of every text of an arrow string array."""
    buf, ofs, n = text_buffers(texts)
    word = ~W.SPACE[buf]
    s, e, first = W.spans(word, ofs)
    n_words = np.diff(first)
    points = np.zeros(len(buf) + 1, np.int64)
    np.cumsum(word & W.HEAD[buf], out=points[1:])
    word_chars = np.diff(points[ofs])
    out = {"n_words": n_words, "word_chars": word_chars, "n_symbols": W.sums(SYMBOLS[buf], ofs)}

    own = W.owners(first)
    salt = W.mix(np.arange(n, dtype=W.U))
    chars = points[e] - points[s]
    total_chars = np.maximum(word_chars, 1)
    h = W.hashes(buf, s, e)
    for k in rules.lengths:
        at = np.flatnonzero(W.inside(first, k))
        again, _ = W.repeated(W.windows(h, k)[at] ^ salt[own[at]])
        within = W.covered_at(at[again], k, len(h))
        if k == rules.lengths[0]:
            out["n_repeat_words"] = W.sums(within, first)
        out[f"dup_{k}gram_share"] = W.sums(np.where(within, chars, 0), first) / total_chars

    # Lines: runs between \n. One with a word counts.
    ls, le, lfirst = W.spans(buf != 10, ofs)
    holds = points[le] > points[ls]
    ls, le = ls[holds], le[holds]
    lfirst = np.concatenate([[0], np.cumsum(holds)])[lfirst]
    later = W.equal_spans(buf, ls, le, W.owners(lfirst), salt)
    out["n_dup_lines"] = W.sums(later, lfirst)
    out["dup_line_share"] = W.sums(np.where(later, points[le] - points[ls], 0), lfirst) / total_chars
    return out


def quality_rules(docs: DataFrame, rules: Rules = Rules(), text: str = "text") -> DataFrame:
    """``docs`` with the measures, ``base_failed`` and ``kept``; one narrow pass, no shuffle."""
    fields = [*FIELDS, *((f"dup_{k}gram_share", pa.float64()) for k in rules.lengths)]
    keep = [c for c in docs.columns if c not in {f for f, _ in fields} | {"base_failed", "kept"}]
    src = docs.select(keep)
    kinds = {pa.int64(): LongType(), pa.float64(): DoubleType()}
    schema = StructType([*src.schema.fields, *(StructField(f, kinds[t]) for f, t in fields)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches, text):
            m = measure(b.column(b.schema.get_field_index(text)), rules)
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(m[f], t) for f, t in fields)], names=[*b.schema.names, *(f for f, _ in fields)])

    failed = (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words"))
    bad = F.col("dup_line_share") > rules.line_limit
    for k, limit in zip(rules.lengths, rules.limits, strict=True):
        bad |= F.col(f"dup_{k}gram_share") > limit
    return src.mapInArrow(run, schema).withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & ~bad)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns for every document, then the shares."""
    out = quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.drop("text")


def _oracle(rules: Rules = Rules()) -> str:
    """The same measures in DuckDB's SQL."""
    ctes, shares = [], []
    for k in rules.lengths:
        ctes.append(
            f"g{k} AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM (SELECT doc_id, i, array_to_string(w[i : i + {k - 1}], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - {k - 2})) AS i FROM w WHERE len(w) >= {k}))),"
            f" c{k} AS (SELECT DISTINCT doc_id, i + j AS i FROM (SELECT doc_id, i, unnest(range(0, {k})) AS j FROM g{k} WHERE c > 1)),"
            f" s{k} AS (SELECT doc_id, count(*) AS n, sum(length(x)) AS chars FROM c{k} JOIN p USING (doc_id, i) GROUP BY doc_id)"
        )
        shares.append(f"coalesce(s{k}.chars, 0) / greatest(word_chars, 1)::DOUBLE AS dup_{k}gram_share")
    joins = " ".join(f"LEFT JOIN s{k} USING (doc_id)" for k in rules.lengths)
    bad = " OR ".join([f"dup_line_share > {rules.line_limit}", *(f"dup_{k}gram_share > {m}" for k, m in zip(rules.lengths, rules.limits, strict=True))])
    blank = r"[\x20\x09-\x0D]"
    return rf"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, i, w[i] AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM w)),
{", ".join(ctes)},
l AS (SELECT doc_id, l, length(regexp_replace(l, '{blank}', '', 'g')) AS chars, count(*) AS c FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM w) GROUP BY ALL),
dup AS (SELECT doc_id, sum(c - 1) AS n, sum((c - 1) * chars) AS chars FROM l WHERE chars > 0 GROUP BY doc_id),
b AS (SELECT doc_id, len(w) AS n_words, length(regexp_replace(t, '{blank}', '', 'g')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols FROM w),
m AS (SELECT doc_id, n_words, word_chars, n_symbols, CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(s{rules.lengths[0]}.n, 0) AS BIGINT) AS n_repeat_words,
  coalesce(dup.chars, 0) / greatest(word_chars, 1)::DOUBLE AS dup_line_share, {", ".join(shares)} FROM b LEFT JOIN dup USING (doc_id) {joins}),
f AS (SELECT *, n_words < {rules.min_words} OR 100 * n_repeat_words > {rules.max_repeat_percent} * n_words AS base_failed FROM m)
SELECT *, NOT base_failed AND NOT ({bad}) AS kept FROM f
"""


ORACLE_SQL = _oracle()
