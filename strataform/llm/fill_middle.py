"""Fill-in-middle transformation by an Aho-Corasick event scan (operator 11).

One automaton finds two sorts of events in a text: ASCII white space, where the class of characters changes, and the
three sentinels. Between two changes all characters are of one class, so that how many units a gap holds follows from its
length: as many as code points, or one run. So the changes alone, with the units before each, are the rank table in which
the place of any unit is looked up: a binary search, then arithmetic within the gap. Texts that hold a sentinel are
told by the same scan, and the sentinels of an output by the same automaton when it is taken apart.

Units: ``codepoint`` (each code point) or ``run`` (a maximal run of ASCII white space, or of anything else).

A text of n units is cut after the smaller and the larger of two draws from 0 to n, which depend on seed and id alone.
Outputs: plain, the text; psm, ``<P>`` prefix ``<S>`` suffix ``<M>`` middle; spm, ``<S>`` suffix ``<P>`` prefix ``<M>`` middle. A sentinel
can't arise where a piece meets a sentinel, since each begins with ``<`` and ends with ``>`` and holds neither within,
so that an output of three sentinels can be taken apart without a doubt.

Defined results: null counts as empty, and an empty text is plain. Texts with a sentinel are plain, whole. A null id draws as
the text ``null`` does. Repeated ids, and so repeated rows, are cut by the same draws, each in its own text. Names of
the result win over columns of the input; others are kept. Texts are read whole, however long; tasks look at a few MB at
once. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from strataform.llm.store import steps

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
BLANKS = " \t\n\v\f\r"
UNITS = ("codepoint", "run")


@dataclass(frozen=True)
class Shares:
    """Percent of texts that are left plain, and of the others how many have the suffix first."""

    plain: int = 10
    suffix_first: int = 20


def automaton() -> ahocorasick.Automaton:
    """White space has the value 0, the sentinels 1 to 3."""
    out = ahocorasick.Automaton()
    for c in BLANKS:
        out.add_word(c, 0)
    for k, mark in enumerate((PREFIX, SUFFIX, MIDDLE), 1):
        out.add_word(mark, k)
    out.make_automaton()
    return out


class Ranks:
    """Where the class changes in a text, and the units before each change."""

    def __init__(self, machine: ahocorasick.Automaton, text: str, units: str):
        self.marks: list[tuple[int, int]] = []  # (end of a sentinel, which)
        blank = np.array([e for e, kind in machine.iter(text) if not kind or self.marks.append((e + 1, kind))], np.int64)
        begins = blank[np.diff(blank, prepend=-2) > 1]
        ends = blank[np.diff(blank, append=len(text) + 1) > 1] + 1
        bounds = np.empty(2 * len(begins), np.int64)
        bounds[0::2], bounds[1::2] = begins, ends
        bounds = np.concatenate([[0], bounds, [len(text)]])
        self.at = bounds[np.diff(bounds, prepend=-1) > 0]  # no empty gaps at either end
        self.gaps = np.diff(self.at)
        self.held = self.gaps if units == "codepoint" else np.ones_like(self.gaps)
        self.before = np.concatenate([[0], np.cumsum(self.held)])

    @property
    def units(self) -> int:
        return int(self.before[-1])

    def place(self, rank: int) -> int:
        """The code point before which ``rank`` units stand."""
        k = int(np.searchsorted(self.before, rank, "right")) - 1
        return int(self.at[k]) if k == len(self.gaps) else int(self.at[k] + (rank - self.before[k]) * (self.gaps[k] // self.held[k]))


def draws(key: Column, seed: int = 1) -> list[Column]:
    """Four numbers below 2**32 that depend on seed and key alone."""
    text = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null"))), 256)
    return [F.conv(F.substring(text, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def fill_middle(docs: DataFrame, units: str = "codepoint", shares: Shares = Shares(), seed: int = 1, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with n (units), form, prefix_units and middle_units (null if plain), and ``output``: one narrow pass."""
    if units not in UNITS:
        raise ValueError(f"units must be one of {UNITS}")
    made = [("n", LongType()), ("form", StringType()), ("prefix_units", LongType()), ("middle_units", LongType()), ("output", StringType())]
    names = ["_h1", "_h2", "_h3", "_h4"]
    kept = [c for c in docs.columns if c not in {n for n, _ in made}]
    src = docs.select(*kept, *(h.alias(n) for h, n in zip(draws(F.col(key), seed), names, strict=True)))
    schema = StructType([*(f for f in src.schema.fields if f.name not in names), *(StructField(n, t) for n, t in made)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton()
        for b in steps(batches, text):
            col = lambda name, b=b: b.column(b.schema.get_field_index(name)).to_pylist()
            rows = [_cut(machine, t or "", units, shares, *h) for t, *h in zip(col(text), *map(col, names), strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in kept), *(pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True))], names=[*kept, *(n for n, _ in made)])

    return src.mapInArrow(run, schema)


def _cut(machine, text: str, units: str, shares: Shares, h1: int, h2: int, h3: int, h4: int) -> tuple:
    ranks = Ranks(machine, text, units)
    n = ranks.units
    if not text or ranks.marks or h3 % 100 >= 100 - shares.plain:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    i, j = ranks.place(a), ranks.place(b)
    if h4 % 100 < shares.suffix_first:
        return n, "spm", a, b - a, "".join((SUFFIX, text[j:], PREFIX, text[:i], MIDDLE, text[i:j]))
    return n, "psm", a, b - a, "".join((PREFIX, text[:i], SUFFIX, text[j:], MIDDLE, text[i:j]))


def taken_apart(machine, output: str, form: str) -> str:
    """The text of an output: its pieces stand between the ends of its sentinels."""
    if form == "plain":
        return output
    end = {kind: e for e, kind in Ranks(machine, output, "codepoint").marks}
    first, second = (1, 2) if form == "psm" else (2, 1)
    one, two, middle = output[end[first] : end[second] - len(PREFIX)], output[end[second] : end[3] - len(MIDDLE)], output[end[3] :]
    prefix, suffix = (one, two) if form == "psm" else (two, one)
    return prefix + middle + suffix


def restore(rows: DataFrame) -> DataFrame:
    """``rows`` with ``restored``: the texts that outputs (form, output) were made of."""
    src = rows.drop("restored")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton()
        for b in steps(batches, "output"):
            col = lambda name, b=b: b.column(b.schema.get_field_index(name)).to_pylist()
            texts = [taken_apart(machine, o, f) for o, f in zip(col("output"), col("form"), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], names=[*b.schema.names, "restored"])

    return src.mapInArrow(run, StructType([*src.schema.fields, StructField("restored", StringType())]))


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = fill_middle(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).drop("text")
    out = restore(cut)
    return out.select("doc_id", "n", "form", F.col("prefix_units").alias("prefix_chars"), F.col("middle_units").alias("middle_chars"), F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


ORACLE_SQL = """
WITH h AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS h FROM documents),
d AS (SELECT doc_id, t, CAST(length(t) AS BIGINT) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM h),
f AS (SELECT doc_id, t, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
 CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d),
p AS (SELECT *, substring(t, 1, a) AS pre, substring(t, a + 1, b - a) AS mid, substring(t, b + 1) AS suf FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
 sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256 FROM p
"""
