import re
from collections import defaultdict

import pytest

from strataform.llm import mixing
from tests.llm.helpers import frame, save, tricky

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(sizes, weights=(3, 1, 2), total=1.5, epochs=2):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    target, open_, left = {}, set(names), total * sum(sizes.values())
    while open_:
        share = left / sum(w[s] for s in open_)
        above = {s for s in open_ if share * w[s] > epochs * sizes[s]}
        if not above:
            return target | {s: share * w[s] for s in open_}
        for s in above:
            target[s] = float(epochs * sizes[s])
            left -= target[s]
        open_ -= above
    return target


def check(rows, got):
    size = defaultdict(int)
    for r in rows:
        size[r.source] += len(WORD.findall(r.text or ""))
    want, taken = brute(size), defaultdict(int)
    assert len(got) == len(rows)
    for r in got:
        assert r.source_size == size[r.source] and r.target == pytest.approx(want[r.source]) and 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 1 for s in size)
    return sorted(map(str, got))


def test_equals_brute_force(spark):
    docs = frame(spark, tricky() + tricky()[10:30]).withColumnRenamed("lang", "size")
    rows = docs.collect()
    first = check(rows, mixing.mix_documents(docs).collect())
    assert first == check(rows, mixing.mix_documents(docs.repartition(3), rows_per_slice=5).collect())
    assert first == check(rows, mixing.mix_documents(docs.repartition(3)).collect())
    assert {r.text for r in rows} == {r.text for r in mixing.mix_documents(docs).collect()}


def test_query(spark, tmp_path):
    rows = tricky(4, 200)
    folder = save(spark, tmp_path, rows)
    source = {r.doc_id: r for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = mixing.op7_mixing(spark, folder).collect()
    assert {(r.doc_id, r.size) for r in got} == {(i, len(WORD.findall(t or ""))) for i, t in rows}
    taken = defaultdict(int)
    for r in got:
        taken[source[r.doc_id].source, r.target] += r.taken
    assert all(abs(n - t) <= 1 for (_, t), n in taken.items())
    assert sorted(map(str, got)) == sorted(map(str, mixing.op7_mixing(spark, folder).collect()))


def test_water_filling(spark):
    import random

    r = random.Random(2)
    for k in range(4):
        sizes = {f"s{i}" if i else None: r.choice([0, 1, 10, 1000, 10**6]) for i in range(r.randrange(1, 9))}
        df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        want = brute(sizes)
        assert {x.source: x.target for x in mixing.targets(df).collect()} == {s: pytest.approx(t) for s, t in want.items()}, k


def test_empty(spark):
    assert mixing.mix_documents(frame(spark, tricky()).limit(0)).count() == 0
    assert mixing.mix_documents(frame(spark, tricky()[:3])).agg({"taken": "sum"}).first()[0] == 0
