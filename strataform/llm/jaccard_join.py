"""N-gram Jaccard join by grouped prefixes (operator 5).

A document's set holds its distinct shingles of five words (64-bit hashes). Sets of equal content are one
class. With shingles in one order for all sets, rare ones first, two sets of Jaccard index ``PERCENT`` or more
share a shingle among the first few of each (their prefixes). Classes of the same prefix and size form a
group. Group pairs are filtered first, then the groups that passed are expanded and their members verified.

Pairs are never rows. Every group has one block: groups are dealt to blocks by the prefix shingle that they
share with most others, so that a family of near copies lies in a few blocks, and a large block is split.
Two blocks whose prefixes share a shingle are a cell, and so is a block with itself. A cell's worker counts the common
prefix shingles of all its group pairs and passes on the groups that can reach the threshold with another,
by connected parts. A part's classes are expanded, dealt to cells again if they are many, and a worker
compares their whole sets. It returns, for each class, how many it links with and one class that
links lead to there: rows in proportion to classes, though a family of n near copies has up to n(n-1)/2 links, and
every pair of classes is compared in one cell only. ``jaccard_join`` gives the links themselves, as many as there are.

The order of shingles only decides how many candidates there are, never which links are found. It puts those
last that workers met in many documents (``COMMON`` of them at most).

Defined results: a null text, or one without words, has an empty set, links with nothing and is its own
component. Fewer than five words are one shingle. Rows equal in text are linked. Repeated ids count as one
document for the component's id; a null id is never the smallest unless there is no other. An empty table
gives an empty table. Columns other than doc_id and text are not read, whatever their names. Very long texts
are hashed whole; a set that is larger than a block's limit is a block of its own.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataform.llm import words as W
from strataform.llm.graph import components
from strataform.llm.store import discard, materialize, steps, text_buffers

SHINGLE, PERCENT = 5, 80
#: Shingles that may be put last for being common; counters of a task's pass over them, and how many documents
#: of a task a shingle must be met in.
COMMON, COUNTERS, MET = 200_000, 1 << 25, 4
#: Bits of the filter over ids of documents with candidates.
SPOTS = 1 << 25
#: Shingles of a block, and as how many a small set counts; a task holds the sets of two blocks.
BLOCK, LEAST = 200_000, 400
#: How many groups a prefix shingle must be in to be a home; a group without one is a block of its own.
HOME = 32
#: Numbers of the table with a row a set and a column a shingle that is multiplied at once.
TABLE = 1 << 22


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """The distinct shingle hashes of every text, ascending."""
    buf, ofs, n = text_buffers(texts)
    buf = W.LOWER[buf]
    s, e, first = W.spans(~W.SPACE[buf], ofs)
    h = W.hashes(buf, s, e)
    grams, out, begin = W.windows(h, SHINGLE), [], first.tolist()
    for a, b in zip(begin, begin[1:], strict=False):
        if b - a >= SHINGLE:
            out.append(np.unique(grams[a : b - SHINGLE + 1]))
        else:
            out.append(W.windows(h[a:b], b - a) if b > a else grams[:0])
    return out


def class_of(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def mark_of(text: str) -> Column:
    """The digest that stands for a text (null for a null one)."""
    return F.unhex(F.md5(text))


def prefix_size(n: int) -> int:
    """How many of ``n`` ordered shingles must hold one that a similar set's prefix has."""
    return n - (PERCENT * n + 99) // 100 + 1


def prefix(s: np.ndarray, late: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The first shingles of a set; ``late``: places in the list of common ones, or -1; ``last``: their ranks."""
    k = prefix_size(len(s))
    rare = s[late < 0]
    if len(rare) >= k:
        return rare[:k]
    common = s[late >= 0]
    return np.concatenate([rare, common[np.argsort(last[late[late >= 0]])]])[:k]


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """How many numbers each pair of ``sets`` (distinct within a set) has in common, as a square table."""
    m = len(sets)
    size = [len(s) for s in sets]
    if m == 2:
        out = np.diag(size)
        out[0, 1] = out[1, 0] = len(np.intersect1d(*sets, assume_unique=True))
        return out
    flat, own = np.concatenate(sets), np.repeat(np.arange(m), size)
    order = np.argsort(flat, kind="stable")
    flat, own = flat[order], own[order]
    new = np.ones(len(flat), bool)
    new[1:] = flat[1:] != flat[:-1]
    column = np.cumsum(new) - 1
    several = (np.bincount(column) > 1)[column]  # what one set alone holds is in no overlap
    own, column = own[several], column[several]
    column = np.cumsum(np.diff(column, prepend=-1) > 0) - 1
    out, width = np.zeros((m, m), np.int64), max(1, TABLE // m)
    for k in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, [k, k + width])
        table = np.zeros((m, min(width, int(column[-1]) + 1 - k)), np.float32)
        table[own[a:b], column[a:b] - k] = 1
        out += (table @ table.T).astype(np.int64)
    out[np.arange(m), np.arange(m)] = size
    return out


def parts(linked: np.ndarray) -> np.ndarray:
    """For every row of a symmetric table of booleans the least row that it reaches."""
    label = np.arange(len(linked))
    while True:
        least = np.minimum(label, np.where(linked, label, len(label)).min(axis=1, initial=len(label)))
        least = np.minimum(least, least[least])
        if (least == label).all():
            return label
        label = least


def may_reach(low: np.ndarray, high: np.ndarray, common: np.ndarray) -> np.ndarray:
    """Which pairs of groups can hold sets that reach the threshold: a square table.

    Their sets have ``low`` to ``high`` shingles, their prefixes ``common`` ones in common. Behind the prefix that
    ends earlier lie as many shingles as that set has there.
    """
    x, y = low[:, None], low[None, :]
    fits = (100 * high[:, None] >= PERCENT * y) & (100 * high[None, :] >= PERCENT * x)
    need = (PERCENT * (x + y) + 99 + PERCENT) // (100 + PERCENT)
    behind = (PERCENT * np.maximum(high[:, None], high[None, :]) + 99) // 100 - 1
    return fits & (common > 0) & (common + behind >= need)


def common_shingles(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (ascending) and ranks of common shingles: at most ``COMMON`` pairs of numbers reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = np.zeros(COUNTERS, np.uint8)
        for b in steps(batches):
            sets = {class_of(s): s for s in shingle_sets(b.column(b.schema.get_field_index("text"))) if len(s)}
            if not sets:
                continue
            h, n = np.unique(np.concatenate(list(sets.values())), return_counts=True)
            slot = (h % W.U(COUNTERS)).astype(np.int64)
            now = np.minimum(counters[slot].astype(np.int64) + n, 255)
            counters[slot] = now
            hot = now >= MET
            yield pa.RecordBatch.from_arrays([pa.array(h[hot].view(np.int64)), pa.array(n[hot])], names=["h", "n"])

    met = docs.select("text").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    top = met.filter(F.col("n") >= MET).orderBy(F.desc("n"), "h").limit(COMMON).toPandas()
    h, n = top["h"].to_numpy(np.int64).view(W.U), top["n"].to_numpy(np.int64)
    order = np.argsort(h)
    h, n = h[order], n[order]
    rank = np.empty(len(h), np.int64)
    rank[np.lexsort((h, n))] = np.arange(len(h))
    return h, rank


def _sets(docs: DataFrame, common: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(doc_id, mark, n, cls, grp, prefix) of every document; a task gives a group's prefix once."""
    shared = docs.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, rank = shared.value
        seen: set[int] = set()
        for b in steps(batches):
            sets = shingle_sets(b.column(b.schema.get_field_index("text")))
            flat = np.concatenate(sets) if sets else np.zeros(0, W.U)
            late = np.full(len(flat), -1)
            if len(known):
                at = np.minimum(np.searchsorted(known, flat), len(known) - 1)
                late = np.where(known[at] == flat, at, -1)
            begin, heads, groups, classes = 0, [], [], []
            for s in sets:
                n = len(s)
                classes.append(class_of(s) if n else None)
                if not n:
                    groups.append(None)
                    heads.append(None)
                    continue
                head = prefix(s, late[begin : begin + n], rank)
                begin += n
                group = int.from_bytes(hashlib.blake2b(head.tobytes() + b"%d" % n, digest_size=8).digest(), "little", signed=True)
                groups.append(group)
                heads.append(None if group in seen else head.view(np.int64))
                seen.add(group)
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index("doc_id")), b.column(b.schema.get_field_index("mark")), pa.array([len(s) for s in sets], pa.int64()), pa.array(classes, pa.binary()), pa.array(groups, pa.int64()), pa.array(heads, pa.list_(pa.int64()))], names=["doc_id", "mark", "n", "cls", "grp", "prefix"])

    return docs.select("doc_id", mark_of("text").alias("mark"), "text").mapInArrow(run, "doc_id long, mark binary, n long, cls binary, grp long, prefix array<long>")


CELL = ["x", "y"]
PART = [*CELL, "part", "i", "j"]


def _by_cell(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """The rows of each cell; a partition has them together."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.zeros(batch.num_rows, bool)
        for k in keys:
            v = batch.column(batch.schema.get_field_index(k)).to_numpy()
            ends[1:] |= v[1:] != v[:-1]
        if held:
            last, first = held[-1], batch.slice(0, 1)
            ends[0] = any(last.column(last.schema.get_field_index(k))[last.num_rows - 1] != first.column(first.schema.get_field_index(k))[0] for k in keys)
        cut = [0, *np.flatnonzero(ends).tolist(), batch.num_rows] if not ends[0] else [*np.flatnonzero(ends).tolist(), batch.num_rows]
        for n, (a, b) in enumerate(zip(cut, cut[1:], strict=False)):
            if held and (n or ends[0]):
                yield pa.concat_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.concat_batches(held)


def _apart(side: np.ndarray) -> np.ndarray:
    """Which pairs a cell of two blocks compares: those of both. A block with itself (side 2) compares all."""
    out = (side[:, None] != side[None, :]) | (side[:, None] == 2)
    np.fill_diagonal(out, False)
    return out


def _candidates(groups: DataFrame, shared: DataFrame) -> DataFrame:
    """(x, y, part, side, grp), written: groups that can reach the threshold with another of their part of the cell (x, y)."""
    # A block is what one shingle is home to, or a slice of that where it is too large.
    groups = materialize(groups, "groups")
    weight = F.greatest(F.size("tokens"), F.lit(LEAST))
    slices = groups.groupBy("home").agg(F.ceil(F.sum(weight) / BLOCK).alias("slices"))
    dealt = materialize(groups.join(slices, "home").withColumn("block", F.xxhash64("home", F.pmod(F.xxhash64("grp"), F.col("slices")))).drop("home", "slices"), "dealt")
    blocks = shared.join(dealt.select("grp", "block", "low", "high"), "grp").groupBy("token", "block").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    side = lambda k: blocks.select("token", F.col("block").alias(k), F.col("low").alias(f"low_{k}"), F.col("high").alias(f"high_{k}"))
    x, y = F.least("low_x", "low_y"), F.greatest("high_x", "high_y")
    near = (100 * F.col("high_x") >= PERCENT * F.col("low_y")) & (100 * F.col("high_y") >= PERCENT * F.col("low_x"))
    met = side("x").join(side("y"), "token").filter((F.col("x") < F.col("y")) & near)
    # A pair of groups has no more common prefix shingles than their blocks.
    count = met.groupBy("x", "y").agg(F.count("*").alias("k"), F.min(F.col("low_x")).alias("low_x"), F.min(F.col("low_y")).alias("low_y"), F.max(y).alias("high"))
    need = F.ceil((F.col("low_x") + F.col("low_y")) * PERCENT / (100 + PERCENT) - 1e-6)
    cells = materialize(count.filter(F.col("k") + F.ceil(F.col("high") * PERCENT / 100) - 1 >= need).select("x", "y"), "cells")
    own = dealt.groupBy("block").agg(F.sum("classes").alias("classes")).filter("classes > 1").select(F.col("block").alias("x"), F.col("block").alias("y"))
    ends = cells.select("x", "y", F.col("x").alias("block"), F.lit(0).alias("side")).unionByName(cells.select("x", "y", F.col("y").alias("block"), F.lit(1).alias("side"))).unionByName(own.select("x", "y", F.col("x").alias("block"), F.lit(2).alias("side")))
    rows = ends.join(dealt, "block").select("x", "y", "side", "grp", "low", "high", "classes", "tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in _by_cell(batches, CELL):
            side, grp, low, high, classes = (cell.column(k).to_numpy() for k in range(2, 7))
            tokens = cell.column(7)
            begin, flat = tokens.offsets.to_numpy(), tokens.values.to_numpy()
            good = _apart(side) & may_reach(low, high, overlaps([flat[a:b] for a, b in zip(begin, begin[1:], strict=False)]))
            stays = good.any(axis=1) | ((side == 2) & (classes > 1))
            if stays.any():
                some = cell.take(pa.array(np.flatnonzero(stays)))
                yield pa.RecordBatch.from_arrays([*some.columns[:2], pa.array(parts(good)[stays], pa.int64()), *some.columns[2:4]], names=[*CELL, "part", "side", "grp"])

    found = materialize(rows.repartition(*CELL).sortWithinPartitions(*CELL).mapInArrow(run, "x long, y long, part long, side int, grp long"), "candidates")
    discard(groups, dealt, cells)
    return found


def _verified(cells: DataFrame, texts: DataFrame, pairs: bool) -> DataFrame:
    """Links of the cells (PART, side, cls, size): (a, b, links, others) of classes that link, or the pairs (a, b).

    ``b``: a class that links of the cell lead to, the same for all that they connect; ``links``: with how many classes
    ``a`` links there; ``others``: how many documents those hold.
    """
    rows = cells.join(texts, "cls").select(*PART, "side", "upper", "cls", "size", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in _by_cell(batches, PART):
            side, upper, size = (cell.column(k).to_numpy() for k in (5, 6, 8))
            cls, sets = cell.column(7).to_pylist(), []
            for batch in steps(iter([cell])):
                sets += shingle_sets(batch.column(9))
            common, n = overlaps(sets), np.array([len(s) for s in sets])
            linked = _apart(side) & _apart(upper) & (100 * common >= PERCENT * (n[:, None] + n[None, :] - common)) & (common > 0)
            if pairs:
                a, b = np.nonzero(np.triu(linked))
                ends = [sorted((cls[i], cls[k])) for i, k in zip(a, b, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([e[k] for e in ends], pa.binary()) for k in (0, 1)], names=["a", "b"])
                continue
            links = linked.sum(axis=1)
            at = np.flatnonzero(links)
            first = parts(linked)
            yield pa.RecordBatch.from_arrays([pa.array([cls[i] for i in at], pa.binary()), pa.array([cls[first[i]] for i in at], pa.binary()), pa.array(links[at], pa.int64()), pa.array((linked @ size)[at], pa.int64())], names=["a", "b", "links", "others"])

    dealt = rows.repartition(*PART).sortWithinPartitions(*PART)
    return dealt.mapInArrow(run, "a binary, b binary" if pairs else "a binary, b binary, links long, others long")


def _linked(docs: DataFrame, pairs: bool) -> tuple[DataFrame, DataFrame]:
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    common = common_shingles(docs)
    whole = materialize(_sets(docs, common), "sets")

    # Shingles that prefixes of two groups hold.
    tokens = whole.filter("prefix IS NOT NULL").select("grp", F.explode("prefix").alias("token")).repartition("token").dropDuplicates(["token", "grp"])
    shared = materialize(tokens.withColumn("met", F.count("*").over(Window.partitionBy("token"))).filter("met > 1"), "shared")
    members = materialize(whole.drop("prefix"), "members")
    discard(whole)
    classes = materialize(members.filter("n > 0").groupBy("cls").agg(F.min("doc_id").alias("doc_id"), F.min("grp").alias("grp"), F.min("n").alias("n"), F.count("*").alias("size")), "classes")
    of = shared.groupBy("grp").agg(F.max(F.when(F.col("met") >= HOME, F.struct("met", "token"))).alias("home"), F.collect_list("token").alias("tokens")).select("grp", "home.token", "tokens")
    sizes = classes.groupBy("grp").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.count("*").alias("classes"))
    groups = sizes.join(of, "grp", "left").filter("tokens IS NOT NULL OR classes > 1").select("grp", "low", "high", "classes", F.coalesce("token", "grp").alias("home"), F.coalesce("tokens", F.array().cast("array<long>")).alias("tokens"))
    found = _candidates(groups, shared)
    discard(shared)

    # Expansion: the classes of a part, dealt to slices if their sets are many or large.
    weight = F.greatest("n", F.lit(LEAST))
    expanded = found.join(classes, "grp").select(*CELL, "part", "side", "cls", "n", "size")
    slices = expanded.groupBy(*CELL, "part").agg(F.ceil(F.sum(weight) / BLOCK).alias("slices"))
    sliced = expanded.join(slices, [*CELL, "part"]).withColumn("slice", F.pmod(F.xxhash64("cls"), F.col("slices")))
    dealt = sliced.select("*", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("other"))
    where = F.when(F.col("slice") == F.col("other"), 2).otherwise((F.col("slice") > F.col("other")).cast("int"))
    cells = materialize(dealt.select(*CELL, "part", F.least("slice", "other").alias("i"), F.greatest("slice", "other").alias("j"), "side", where.alias("upper"), "cls", "size"), "cells")
    wanted = materialize(cells.select("cls").distinct().join(classes, "cls").select("cls", F.col("doc_id").alias("id")), "wanted")
    texts = materialize(_texts(docs, wanted), "texts")
    links = materialize(_verified(cells, texts, pairs), "links")
    discard(classes, found, cells, wanted, texts)
    return members.drop("grp"), links


def jaccard_join(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members (doc_id, mark, n, cls) and links (a, b) of the documents (doc_id, text).

    Members have a row a document: the digest of its text, the size of its set and the set's class (null for an empty
    set). Documents of one class are linked; links are all pairs a < b of classes whose sets are similar, once each.
    """
    return _linked(docs, True)


def jaccard_groups(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members as of ``jaccard_join`` and, instead of links, (a, b, links, others) of classes ``a`` that link.

    A class has a row a cell: ``links`` and ``others`` (classes and documents that it links with) add up; the edges
    (a, b) connect what links connect. Rows are in proportion to classes, however many links there are.
    """
    return _linked(docs, False)


def link_counts(members: DataFrame, links: DataFrame) -> DataFrame:
    """(doc_id, mark, n_links) of every document: how many other documents it is linked with, exact copies included."""
    size = members.filter("n > 0").groupBy("cls").agg(F.count("*").alias("size"))
    ends = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    other = ends.join(size.withColumnRenamed("cls", "b"), "b").groupBy(F.col("a").alias("cls")).agg(F.sum("size").alias("others"))
    per = size.join(other, "cls", "left").select("cls", (F.col("size") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    return members.join(per, "cls", "left").select("doc_id", "mark", F.coalesce("n_links", F.lit(0)).alias("n_links"))


def named_components(members: DataFrame, links: DataFrame) -> DataFrame:
    """(doc_id, mark, n, cls, component) of documents with words: the least class of the component."""
    label = materialize(components(links), "components")
    return members.filter("n > 0").join(label, members.cls == label.node, "left").select("doc_id", "mark", "n", "cls", F.coalesce("component", "cls").alias("component"))


def jaccard_classes(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links) of every document (doc_id, text)."""
    members, links = jaccard_groups(docs)
    label = components(links)
    others = links.groupBy(F.col("a").alias("cls")).agg(F.sum("others").alias("others"))
    size = members.filter("n > 0").groupBy("cls").agg(F.count("*").alias("size"), F.min("doc_id").alias("doc_id"))
    known = size.join(others, "cls", "left").join(label.withColumnRenamed("node", "cls"), "cls", "left")
    known = materialize(known.select("cls", "doc_id", F.coalesce("component", "cls").alias("component"), (F.col("size") - 1 + F.coalesce("others", F.lit(0))).alias("n_links")), "known")
    discard(links)
    ids = known.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    of = known.join(ids, "component").select("cls", "component_id", "n_links")
    some = members.filter("n > 0").join(of, "cls").select("doc_id", F.col("n").alias("n_shingles"), "component_id", "n_links")
    empty = members.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_links"))
    return some.unionByName(empty)


def _spot(key: str) -> int:
    return zlib.crc32(key.encode()) % SPOTS


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(cls, text) of the wanted classes (cls, id).

    A bitmap of fixed size over hashes of the wanted ids keeps most other texts from being shuffled; the join by
    class is what decides. A task passes on one text of a class.
    """
    at = (F.crc32(F.coalesce(F.col("id").cast("string"), F.lit("")).cast("binary")) % SPOTS + 1).alias("at")  # bitmaps count from 1
    rows = wanted.select(at).groupBy(F.bitmap_bucket_number("at").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits")).collect()
    size = 32768 // 8
    bits = np.zeros(SPOTS // 8, np.uint8)
    for r in rows:
        bits[(r.k - 1) * size : r.k * size] = np.frombuffer(r.bits, np.uint8)
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, seen = shared.value, set()
        for b in steps(batches):
            at = np.array([_spot("" if i is None else str(i)) for i in b.column(0).to_pylist()], np.int64)
            some = b.take(pa.array(np.flatnonzero((known[at >> 3] >> (at & 7).astype(np.uint8)) & 1)))
            keys, good = [], []
            for i, s in enumerate(shingle_sets(some.column(1)) if some.num_rows else []):
                if len(s) and (key := class_of(s)) not in seen:
                    seen.add(key)
                    keys.append(key)
                    good.append(i)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), some.column(1).take(pa.array(good, pa.int64()))], names=["cls", "text"])

    return docs.select("doc_id", "text").mapInArrow(run, "cls binary, text string").join(wanted.select("cls"), "cls", "left_semi").dropDuplicates(["cls"])


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (
  SELECT DISTINCT doc_id, md5(array_to_string(w[i : i + 4], ' ')) AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5)
  UNION ALL SELECT doc_id, md5(array_to_string(w, ' ')) FROM w WHERE len(w) BETWEEN 1 AND 4),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
both_ AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM both_ JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 80 * (x.n + y.n - i)),
sym AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS d, doc_id AS r FROM documents UNION SELECT reach.d, sym.b FROM reach JOIN sym ON sym.a = reach.r)
SELECT d AS doc_id, coalesce(n.n, 0) AS n_shingles, min(r) AS component_id, coalesce(any_value(l.n_links), 0) AS n_links FROM reach LEFT JOIN n ON n.doc_id = d
LEFT JOIN (SELECT a, count(*) AS n_links FROM sym GROUP BY a) l ON l.a = d GROUP BY d, n.n
"""
