"""Document fingerprints as invertible Bloom lookup sketches (operator 1, DataFrame functions only).

A text's paragraphs are hashed to 64-bit digests: lines, long ones in stretches of ``STRETCH`` code points, but in a text's opening (``OPENING``) shorter
pieces that end with a word, so that short texts have several too.
Each digest goes into one cell of each of three tables; a cell holds a count and the XOR of its digests and of
their check hashes. Cells of two versions subtract; what both share cancels, and peeling cells that hold one
digest recovers the digests in which the versions differ. Where peeling gets stuck, the pair is tried again
with twice the cells or more, sized by the counts, until it comes out.

The likeness of two fingerprints is the Jaccard index of their paragraph sets, from the recovered difference:
(a + b - d) / (a + b + d); two texts without paragraphs are alike (1).

Defined results: null counts as empty. Paragraphs that repeat in a text count once. Ids that repeat are
ordered by text. A null id comes last in descending order. A lone document follows itself. An empty table
gives an empty table. Only doc_id and text are read, whatever other columns are called. Very long texts are hashed
whole; pairs of more than ``IN_ROW`` paragraphs are peeled as rows, with the same result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataform.llm.store import discard, materialize, range_bucket, tasks

STRETCH = 256
#: Stretches of a text's opening, one after another: code points, and the least and most that a piece of a line has there.
OPENING = ((64, 12, 32), (192, 48, 96))
#: Cells of each table of a fingerprint, and rounds of peeling.
CELLS, ROUNDS = 32, 14
#: Pairs with more paragraphs than this are peeled as rows instead of within a row.
IN_ROW = 3000

ZERO = "named_struct('n', 0, 'k', 0L, 'h', 0L)"


def digests(text: Column) -> Column:
    """The distinct 64-bit digests of a text's paragraphs."""
    at, parts = 1, []
    for size, least, most in OPENING:
        word = rf"[^\n]{{{least},{most}}}?(?=\s)|[^\n]{{1,{most}}}"
        parts.append(F.regexp_extract_all(F.substring(text, at, size), F.lit(word), F.lit(0)))
        at += size
    parts.append(F.regexp_extract_all(F.substring(text, F.lit(at), F.greatest(F.length(text), F.lit(1))), F.lit(rf"[^\n]{{1,{STRETCH}}}"), F.lit(0)))
    return F.array_distinct(F.transform(F.concat(*parts), lambda p: F.xxhash64(p)))


def sketch(digest: str, c: str) -> Column:
    """The cells of the digests in column ``digest``: three tables of ``c``, one after another. A table's entries are sorted by cell, so that
    a cell folds over its own entries alone."""
    run = "slice(s, cast(array_position(p, j) as int), cast(size(p) + 2 - array_position(r, j) - array_position(p, j) as int))"
    fold = f"aggregate({run}, {ZERO}, (a, x) -> named_struct('n', a.n + 1, 'k', a.k ^ x.k, 'h', a.h ^ x.h))"
    cells = f"transform(sequence(0, {c} - 1), j -> if(array_position(p, j) = 0, {ZERO}, {fold}))"
    entry = lambda t: f"named_struct('j', cast(pmod(xxhash64(d, {t}), {c}) as int), 'k', d, 'h', xxhash64(d, 9))"
    table = lambda t: f"transform(array(sort_array(transform({digest}, d -> {entry(t)}))), s -> transform(array(transform(s, x -> x.j)), p -> transform(array(reverse(p)), r -> {cells})[0])[0])[0]"
    return F.expr(f"concat({table(1)}, {table(2)}, {table(3)})")


def subtract(a: str, b: str) -> Column:
    return F.expr(f"zip_with({a}, {b}, (x, y) -> named_struct('n', x.n - y.n, 'k', x.k ^ y.k, 'h', x.h ^ y.h))")


def peel(cells: str, c: str) -> Column:
    """(cells, found, more): what is left of the cells, and how many digests were recovered. A round takes out all
    digests that stand alone in a cell; the first that finds none is the last."""
    spot = lambda t: f"cast(pmod(xxhash64(x.k, {t}), {c}) as int)"
    alone = "filter(acc.cells, x -> abs(x.n) = 1 and x.h = xxhash64(x.k, 9))"
    keys = f"array_distinct(transform(p, x -> named_struct('n', x.n, 'k', x.k, 'h', x.h, 'a', {spot(1)}, 'b', {c} + {spot(2)}, 'e', 2 * {c} + {spot(3)})))"
    out = "transform(acc.cells, (y, j) -> aggregate(q, y, (s, x) -> if(x.a = j or x.b = j or x.e = j, named_struct('n', s.n - x.n, 'k', s.k ^ x.k, 'h', s.h ^ x.h), s)))"
    step = f"transform(array({alone}), p -> if(size(p) = 0, named_struct('cells', acc.cells, 'found', acc.found, 'more', false), transform(array({keys}), q -> named_struct('cells', {out}, 'found', acc.found + size(q), 'more', true))[0]))[0]"
    return F.expr(f"aggregate(sequence(1, {ROUNDS}), named_struct('cells', {cells}, 'found', 0, 'more', true), (acc, r) -> if(acc.more, {step}, acc))")


def empty(cells: str) -> Column:
    return F.expr(f"forall({cells}, x -> x.n = 0 and x.k = 0L and x.h = 0L)")


def encoded(cells: str) -> Column:
    """A sketch as text: for each cell 1 byte of count, 8 of digests and 4 of check hashes, in base 64."""
    one = "concat(lpad(hex(x.n & 255), 2, '0'), lpad(hex(x.k), 16, '0'), lpad(hex(x.h & 4294967295L), 8, '0'))"
    return F.expr(f"base64(unhex(array_join(transform({cells}, x -> {one}), '')))")


def likeness(a: Column, b: Column, d: Column) -> Column:
    return F.when(a + b == 0, F.lit(1.0)).otherwise((a + b - d) / F.greatest(a + b + d, F.lit(1)))


def differences(pairs: DataFrame) -> DataFrame:
    """(pair, d): by how many digests ``ka`` and ``kb`` of each pair (pair, ka, kb) differ, by sketches alone.

    ``cells`` starts from the number of digests and doubles for the pairs that peeling couldn't resolve.
    """
    left = pairs.select("pair", "ka", "kb", F.greatest(F.lit(4 * CELLS), F.pow(2, F.ceil(F.log2((F.size("ka") + F.size("kb") + 2) / 2)))).cast("int").alias("c"))
    done = None
    while True:
        small = left.filter(F.size("ka") + F.size("kb") <= IN_ROW)
        got = small.withColumn("a", sketch("ka", "c")).withColumn("b", sketch("kb", "c")).withColumn("diff", subtract("a", "b")).withColumn("p", peel("diff", "c"))
        got = got.select("pair", F.when(empty("p.cells"), F.col("p.found")).alias("d"))
        got = materialize(got.unionByName(_as_rows(left.filter(F.size("ka") + F.size("kb") > IN_ROW))), "differences")
        found = got.filter("d IS NOT NULL")
        done = found if done is None else done.unionByName(found)
        stuck = got.filter("d IS NULL").select("pair")
        if not stuck.limit(1).count():
            return done
        left = materialize(left.join(stuck, "pair").withColumn("c", F.col("c") * 2), "stuck")


def _as_rows(pairs: DataFrame) -> DataFrame:
    """``differences`` for pairs of very many digests: cells are rows, and each round looks at one table, where
    a digest stands in one cell only. All rows of a pair share a partition, so rounds don't shuffle."""
    if not pairs.limit(1).count():
        return pairs.select("pair", F.lit(0).alias("d"))
    spot = lambda t: (F.lit(t - 1) * F.col("c") + F.pmod(F.xxhash64("k", F.lit(t)), F.col("c"))).cast("int")
    add = lambda df: df.groupBy("pair", "c", "cell").agg(F.sum("n").alias("n"), F.bit_xor("k").alias("k"), F.bit_xor("h").alias("h"))
    signed = F.expr("concat(transform(ka, k -> named_struct('n', 1L, 'k', k)), transform(kb, k -> named_struct('n', -1L, 'k', k)))")
    rows = pairs.repartition("pair").select("pair", "c", F.explode(signed).alias("x")).select("pair", "c", "x.*").withColumn("h", F.xxhash64("k", F.lit(9)))
    cells = add(rows.select("pair", "c", "n", "k", "h", F.explode(F.array(spot(1), spot(2), spot(3))).alias("cell")))
    cells = materialize(cells, "cells")
    before = -1
    while True:
        last, cells = cells, cells.repartition("pair")
        for t in (1, 2, 3):
            alone = (F.abs("n") == 1) & (F.col("h") == F.xxhash64("k", F.lit(9))) & (F.col("cell") >= (t - 1) * F.col("c")) & (F.col("cell") < t * F.col("c"))
            take = [F.struct(spot(u).alias("cell"), (-F.col("n")).alias("n"), F.col("k"), F.col("h")) for u in (1, 2, 3)]
            same = F.struct("cell", "n", "k", "h")
            count = F.struct(F.lit(-1).alias("cell"), F.lit(1).cast("long").alias("n"), F.lit(0).cast("long").alias("k"), F.lit(0).cast("long").alias("h"))
            moved = cells.select("pair", "c", F.explode(F.when(alone, F.array(same, *take, count)).otherwise(F.array(same))).alias("x")).select("pair", "c", "x.*")
            cells = add(moved)
        cells = materialize(cells.filter("cell < 0 OR n <> 0 OR k <> 0 OR h <> 0"), "cells")
        r = cells.agg(F.sum(F.when(F.col("cell") < 0, F.col("n"))).alias("found"), F.count_if(F.col("cell") >= 0).alias("open")).first()
        discard(last)
        if not r.open or r.found == before:
            break
        before = r.found
    got = cells.groupBy("pair").agg(F.sum(F.when(F.col("cell") < 0, F.col("n"))).alias("d"), F.count_if(F.col("cell") >= 0).alias("open"))
    both = pairs.select("pair").join(got, "pair", "left")
    return both.select("pair", F.when(F.coalesce(F.col("open"), F.lit(0)) == 0, F.coalesce(F.col("d"), F.lit(0))).cast("int").alias("d"))


def followed(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text, next_text): the text of the next row in descending order, the first after the last.

    Rows are dealt out by ranges of the key; the last row of each range is repeated as the first of the range
    that follows it (one row a range), and of the first range after the last.
    """
    src = docs.select(F.col(key).cast("long").alias(key), F.coalesce(F.col(text), F.lit("")).alias(text))
    placed = src.withColumn("bucket", range_bucket(src, key, tasks(docs.sparkSession)))
    tops = sorted(placed.groupBy("bucket").agg(F.max(key).alias("top")).collect())
    own = placed.withColumn("carried", F.lit(False))
    if tops:
        carried = [(r.top, tops[(i + 1) % len(tops)].bucket) for i, r in enumerate(tops)]
        to = F.coalesce(*(F.when(F.col(key).eqNullSafe(F.lit(top)), F.lit(b)) for top, b in carried))
        tip = F.col(key).isin([t for t, _ in carried if t is not None])
        tip = tip | F.col(key).isNull() if any(t is None for t, _ in carried) else tip
        rows = src.filter(tip).withColumn("bucket", to).withColumn("carried", F.lit(True)).filter("bucket IS NOT NULL")
        own = own.unionByName(rows)
    order = Window.partitionBy("bucket").orderBy(F.col("carried").desc(), F.col(key).asc_nulls_first(), text)
    return own.withColumn("next_text", F.lag(text).over(order)).filter("NOT carried").select(key, text, "next_text")


def fingerprints(docs: DataFrame) -> DataFrame:
    """For every document its fingerprint, that of its text edited with the next document's, and likenesses."""
    n = F.length("text")
    edited = F.concat(F.expr("substring(text, 1, cast(n_chars - floor(n_chars / 2) as int))"), F.expr("substring(next_text, 1, cast(floor(n_chars / 2) as int))"))
    c = str(CELLS)
    rows = followed(docs).withColumn("n_chars", n.cast("long")).withColumn("edited", edited)
    rows = rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), digests(F.col("text")).alias("ka"), digests(F.col("edited")).alias("ke"), digests(F.col("next_text")).alias("kn"))
    rows = rows.withColumn("a", sketch("ka", c)).withColumn("e", sketch("ke", c)).withColumn("x", sketch("kn", c))
    rows = rows.withColumn("de", subtract("a", "e")).withColumn("dn", subtract("a", "x")).withColumn("pe", peel("de", c)).withColumn("pn", peel("dn", c))
    known = lambda p: F.when(empty(f"{p}.cells"), F.col(f"{p}.found"))
    rows = rows.select("doc_id", "n_chars", "edited_sha256", encoded("a").alias("fingerprint"), encoded("e").alias("edited_fingerprint"), *(F.size(f"k{s}").alias(f"n{s}") for s in "aen"), known("pe").alias("fe"), known("pn").alias("fn"), "ka", "ke", "kn")
    again = F.col("fe").isNull() | F.col("fn").isNull()
    rows = rows.withColumn("ka", F.when(again, F.col("ka"))).withColumn("ke", F.when(F.col("fe").isNull(), F.col("ke"))).withColumn("kn", F.when(F.col("fn").isNull(), F.col("kn")))
    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "sketches")
    retry = lambda f, k, bit: rows.filter(F.col(f).isNull()).select((F.col("row") * 2 + bit).alias("pair"), "ka", F.col(k).alias("kb"))
    got = differences(retry("fe", "ke", 0).unionByName(retry("fn", "kn", 1)))
    late = got.groupBy(F.shiftright("pair", 1).alias("row")).agg(F.max(F.when(F.col("pair") % 2 == 0, F.col("d"))).alias("le"), F.max(F.when(F.col("pair") % 2 == 1, F.col("d"))).alias("ln"))
    stuck = rows.filter(again).join(late, "row", "left").withColumn("fe", F.coalesce("fe", "le")).withColumn("fn", F.coalesce("fn", "ln")).drop("le", "ln")
    whole = rows.filter(~again).unionByName(stuck.select(rows.columns))
    near = lambda s: likeness(F.col("na"), F.col(f"n{s}"), F.col(f"f{s}")).alias("near_edited" if s == "e" else "near_next")
    return whole.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", near("e"), near("n"))


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
