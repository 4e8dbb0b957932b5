import random
import re
from collections import defaultdict

import numpy as np
import pytest

from strataform.llm import jaccard_join as J
from tests.llm.helpers import save, tricky

WORD = re.compile("[^\x20\x09-\x0d]+")


def shingles(text):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}


def brute(rows):
    sets = [(i, frozenset(shingles(t))) for i, t in rows]
    by, up = defaultdict(list), {}
    distinct = sorted({s for _, s in sets if s}, key=len)
    for k, s in enumerate(distinct):
        for x in s:
            by[x].append(k)
    find = lambda x: x if up.setdefault(x, x) == x else find(up[x])
    for k, s in enumerate(distinct):
        both = defaultdict(int)
        for x in s:
            for m in by[x]:
                if m > k:
                    both[m] += 1
        for m, n in both.items():
            if 100 * n >= 80 * (len(s) + len(distinct[m]) - n):
                up[find(k)] = find(m)
    index = {s: k for k, s in enumerate(distinct)}
    least = {}
    for i, s in sets:
        if s and i is not None:
            c = find(index[s])
            least[c] = min(i, least.get(c, i))
    return sorted(((i, len(s), least.get(find(index[s])) if s else i) for i, s in sets), key=str)


def counts(rows):
    """(id, number of other rows that it links with), all pairs compared."""
    sets = [frozenset(shingles(t)) for _, t in rows]
    alike = lambda x, y: bool(x and y) and 100 * len(x & y) >= 80 * len(x | y)
    return sorted(((rows[i][0], sum(alike(x, y) for j, y in enumerate(sets) if j != i)) for i, x in enumerate(sets)), key=str)


def family(seed=3):
    """Near copies of one text at growing distances, and documents that share a passage."""
    r = random.Random(seed)
    words = [f"w{r.randrange(10**6)}" for _ in range(120)]
    passage = " ".join(f"p{i}" for i in range(30))
    rows = []
    for k in range(60):
        w = list(words)
        for _ in range(r.randrange(6)):
            w[r.randrange(len(w))] = f"x{r.randrange(10**6)}"
        rows.append((1000 + k, " ".join(w[: len(w) - r.randrange(4)])))
    for k in range(60):
        rows.append((2000 + k, " ".join([*(f"y{r.randrange(10**6)}" for _ in range(r.randrange(5, 25))), passage, *(f"z{r.randrange(10**6)}" for _ in range(4))])))
    return rows


@pytest.mark.parametrize("met", [6, 2])
def test_equals_brute_force(spark, tmp_path, monkeypatch, met):
    monkeypatch.setattr(J, "MET", met)
    rows = tricky() + tricky(9)[18:40] + [(None, "a b c d e"), (None, "null id only"), (3, "one"), (3, "other text under an id")] + family()
    got = J.op5_jaccard_join(spark, save(spark, tmp_path, rows)).collect()
    assert sorted((tuple(r)[:3] for r in got), key=str) == brute(rows)
    assert sorted(((r.doc_id, r.n_links) for r in got), key=str) == counts(rows)


def test_given_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows, got = [(r.doc_id, r.text) for r in docs.collect()], J.jaccard_classes(docs).collect()
    assert sorted((tuple(r)[:3] for r in got), key=str) == brute(rows)
    assert sorted(((r.doc_id, r.n_links) for r in got), key=str) == counts(rows)


def test_empty(spark):
    assert J.jaccard_classes(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert [J.prefix_size(n) for n in (1, 4, 5, 10, 101)] == [1, 1, 2, 3, 21]


def test_every_link_is_found(spark, tmp_path):
    """All pairs of similar sets are links, also those that other links connect already, and every document has its count."""
    rows = family() + [(5000, family()[0][1]), (5001, None), (None, family()[1][1])]
    sets = [frozenset(shingles(t)) for _, t in rows]
    alike = lambda x, y: bool(x and y) and 100 * len(x & y) >= 80 * len(x | y)
    distinct = list({s for s in sets if s})
    want = sum(alike(x, y) for i, x in enumerate(distinct) for y in distinct[:i])
    members, links = J.jaccard_join(spark.read.parquet(save(spark, tmp_path, rows) + "/documents.parquet"))
    found = [(r.a, r.b) for r in links.collect()]
    assert len(found) == len(set(found)) == want > len(distinct)
    counts = sorted(((r.doc_id, r.n_links) for r in J.link_counts(members, links).collect()), key=str)
    assert counts == sorted(((rows[i][0], sum(alike(x, y) for j, y in enumerate(sets) if j != i)) for i, x in enumerate(sets)), key=str)


@pytest.mark.parametrize("block,least,table", [(3000, 100, 1 << 22), (200, 1, 500)])
def test_families_over_many_blocks(spark, tmp_path, monkeypatch, block, least, table):
    """Blocks too small for a family, and groups of several classes, compare each pair once all the same."""
    monkeypatch.setattr(J, "BLOCK", block)
    monkeypatch.setattr(J, "LEAST", least)
    monkeypatch.setattr(J, "TABLE", table)
    rows = family() + family(8) + [(7000 + k, " ".join([*(f"a{i}" for i in range(100)), *(f"b{k}_{i}" for i in range(k % 9))])) for k in range(40)]
    tail = [f"q{i}" for i in range(80)]
    rows += [(8000 + k, " ".join([*tail[: 70 - k % 3], f"r{k}", *tail[70:]])) for k in range(40)]
    got = J.op5_jaccard_join(spark, save(spark, tmp_path, rows)).collect()
    assert sorted((tuple(r)[:3] for r in got), key=str) == brute(rows)
    assert sorted(((r.doc_id, r.n_links) for r in got), key=str) == counts(rows)
    members, links = J.jaccard_join(spark.read.parquet(f"{tmp_path}/documents.parquet"))
    found = [(r.a, r.b) for r in links.collect()]
    assert len(found) == len(set(found)) and all(a < b for a, b in found)
    assert sorted(((r.doc_id, r.n_links) for r in J.link_counts(members, links).collect()), key=str) == counts(rows)


def test_tables_of_overlaps():
    r = random.Random(4)
    for m in (1, 2, 3, 40):
        sets = [np.array(sorted(r.sample(range(200), r.randrange(60))), np.uint64) for _ in range(m)]
        want = [[len(np.intersect1d(a, b)) for b in sets] for a in sets]
        assert J.overlaps(sets).tolist() == want
        near = np.array([[i != k and (i - k) % 7 == 0 for i in range(m)] for k in range(m)])
        assert J.parts(near).tolist() == [k % 7 for k in range(m)]
    long = [np.arange(k, k + 10**6, dtype=np.uint64) for k in (0, 5, 10**5)]
    assert J.overlaps(long).tolist() == [[10**6, 10**6 - 5, 900_000], [10**6 - 5, 10**6, 900_005], [900_000, 900_005, 10**6]]


def test_rows_stay_in_proportion(spark, tmp_path):
    """A family of n near copies: rows of candidates and of its connections grow with n, its links with the square."""
    for n in (50, 200):
        rows = [(k, " ".join([*(f"a{i}" for i in range(100)), f"b{k}"])) for k in range(n)]
        _, edges = J.jaccard_groups(spark.read.parquet(save(spark, tmp_path / str(n), rows) + "/documents.parquet"))
        assert edges.count() == n and edges.agg({"links": "sum"}).first()[0] == n * (n - 1)
