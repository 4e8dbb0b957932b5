"""Every registered query runs and gives rows; those with DuckDB text equal it on the smallest tables."""

import pytest

import __spark_entry__ as entry
from strataform.operators import chunking
from strataform.plans import queries
from tests.compare import compare, duck

SF = "/root/testdata/sf0.001"
#: Queries whose right result on the smallest tables has no rows.
MAY_BE_EMPTY = {"j8_positional_zip"}
NAMES = [n for n in entry.queries() if not n.startswith("op") and n != "pipeline"]


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    make, sql = entry.queries()[name], entry.oracle_sql().get(name)
    if sql:
        ours, theirs = compare(spark, con, SF, name, make, sql)
        assert ours == theirs
    else:
        assert make(spark, SF).collect() or name in MAY_BE_EMPTY
    spark.catalog.clearCache()


def test_panel_of_odd_names(spark, tmp_path):
    """Names without a number are candidates behind all others; no source is no corpus."""
    rows = [(i, "text", "en", s, 4) for i, s in enumerate(["src3", "src10", "web", "srcx", "src7@src10@0.5", None, "src3"])]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.label: (r.ord, r.role) for r in queries.panel(spark, str(tmp_path)).collect()}
    assert got["src3"] == (3, "broad") and got["src10"] == (10, "targeted") and len(got) == 5
    assert all(got[x][0] >= 2**32 and got[x][1] == "candidate" for x in ("web", "srcx", "src7@src10@0.5")) and len({o for o, _ in got.values()}) == 5


@pytest.mark.parametrize("row", [(), ("file", "row")])
def test_provenance_of_repeated_ids(spark, tmp_path, row):
    """Rows that share an id, or a whole text, keep one ordinal each."""
    long = "word " * 40
    rows = [(1, long, "en", "src0", 0), (1, long * 9, "en", "src0", 0), (1, long, "en", "src0", 0), (None, long, "en", "src0", 0), (0, " ", "en", "src0", 0), (2, long, "en", None, 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(2).write.parquet(f"{tmp_path}/documents.parquet")
    docs = queries.documents(spark, str(tmp_path)) if row else queries.raw(spark, str(tmp_path))
    got = chunking.provenance(docs, queries.WHOLE, row).collect()
    assert sorted((r.label or "", r.source_document_index, r.chunk_in_document) for r in got) == sorted([("", 0, 0), *(("src0", i, 0) for i in range(4)), *(("src0", next(r.source_document_index for r in got if r.source_text_chars > 1000), k) for k in (1, 2))])


def test_places_by_ranges(spark, monkeypatch):
    """Places equal a window over everything: nulls, repeats, groups without a name, more ranges than rows; weights too."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from strataform.operators import ordinals

    rows = [(g, None if i % 11 == 0 else (i * 7919) % 60 - 20, i, i % 4) for g in ("a", None, "b") for i in range(200 if g == "a" else 9)]
    df = spark.createDataFrame(rows, "g string, o long, t long, w long")
    w = Window.partitionBy("g").orderBy("o", "t").rowsBetween(Window.unboundedPreceding, -1)
    for spans in (2, 16, 256):
        monkeypatch.setattr(ordinals, "SPANS", spans)
        for weight, what in ((None, F.lit(1)), ("w", F.col("w"))):
            got = ordinals.ahead(df, ["g"], ["o", "t"], weight)
            want = df.withColumn("ahead", F.coalesce(F.sum(what).over(w), F.lit(0)).cast("long"))
            assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert ordinals.ahead(df.limit(0), ["g"], ["o", "t"]).collect() == []


def test_numbers_of_chunks(spark, tmp_path):
    """Chunks are numbered by id, then by row, whatever repeats; blank and short documents have none."""
    from collections import Counter

    rows = [(i % 5 if i % 7 else None, " " if i % 6 == 5 else "word " * (20 + 40 * (i % 9)), "en", f"src{i % 2}" if i % 4 else None, 0) for i in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.numbered(spark, str(tmp_path)).collect()
    n = Counter(r.label for r in got)
    assert sorted((r.label or "", r.chunk_index) for r in got) == sorted((k or "", i) for k, m in n.items() for i in range(m))
    for label in n:
        own = sorted((r for r in got if r.label == label), key=lambda r: r.chunk_index)
        assert [r.doc_id is not None for r in own] == sorted(r.doc_id is not None for r in own) and [r.doc_id for r in own if r.doc_id is not None] == sorted(r.doc_id for r in own if r.doc_id is not None)
        assert all(b.chunk_in_document in (0, a.chunk_in_document + 1) for a, b in zip(own, own[1:]))


def test_ranks_of_values(spark, monkeypatch):
    """Distinct values with a hot one among them, in ranges."""
    from strataform.operators import semantic

    rows = [(g, p, v) for g, m in (("a", 90), ("b", 40)) for p in (0, 1) for v in [float((i * 37 + p) % 53) for i in range(m)] + [7.0] * 60]
    df = spark.createDataFrame(rows, "label string, proj int, value double")
    for stretch in (4096, 8):
        monkeypatch.setattr(semantic, "STRETCH", stretch)
        for r in semantic.ranked_values(df).collect():
            own = [v for g, p, v in rows if (g, p) == (r.label, r.proj)]
            assert (r.c, r.i, r.n) == (own.count(r.value), sum(v < r.value for v in own), len(own))
    p = spark.createDataFrame([("a", "b", "x")], "a string, b string, pair_class string")
    got = semantic.exact_wasserstein(df, p).first()
    import numpy as np

    side = lambda g, k: np.repeat(np.sort([v for x, q, v in rows if (x, q) == (g, k)]), {"a": 100, "b": 150}[g])
    d = [side("a", k) - side("b", k) for k in (0, 1)]
    assert abs(got.sliced_wasserstein_l1 - np.mean([np.abs(x).mean() for x in d])) < 1e-9 and abs(got.sliced_wasserstein_l2 - np.sqrt(np.mean([(x * x).mean() for x in d]))) < 1e-9


def test_skipped_rows_as_sql_counts_them(spark, tmp_path):
    """Blank texts count, rows without an id come last, repeated ids and a missing source are harmless."""
    rows = [(i // 2 if i % 5 else None, (" ", None, "text")[i % 3], "en", f"src{i % 2}" if i % 7 else None, 0) for i in range(90)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    ours, theirs = compare(spark, duck(str(tmp_path)), str(tmp_path), "e12_skip_first", entry.queries()["e12_skip_first"], entry.oracle_sql()["e12_skip_first"])
    assert ours == theirs
