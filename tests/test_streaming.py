"""Budgets and samples over a stream: several triggers and a restart give the batch result."""

import random

import pytest

from strataform.plans import analyses
from strataform.streaming import ingest

SCHEMA = "label string, doc_id long, text string"


def documents(n=400):
    r = random.Random(5)
    return [(r.choice(["hot", "hot", "b", "c"]) if i % 50 else None, i, " " if i % 9 == 0 else None if i % 13 == 0 else f"{i} " + "word " * r.randrange(10, 400)) for i in range(n)]


@pytest.mark.parametrize("spec", [
    {"max_documents": 60, "skip_nonempty_documents": 4, "max_chunks": 70, "chunk_chars": 256},
    {"max_documents": 3, "skip_nonempty_documents": 9, "max_chunks": 7},
    {"sampling_mode": "reservoir", "sample_scan_documents": 90, "sample_reservoir_documents": 12, "max_chunks": 15, "skip_nonempty_documents": 3},
])
def test_triggers_give_the_batch_result(spark, tmp_path, spec):
    s, rows = analyses.Settings.of(spec), documents()
    source, target, checkpoint = (f"{tmp_path}/{x}" for x in ("in", "out", "log"))
    want = analyses.corpus_chunks(spark.createDataFrame([r for r in rows if r[0]], SCHEMA), s)
    part = lambda a, b: spark.createDataFrame(rows[a:b], SCHEMA).coalesce(1).write.mode("append").parquet(source)
    stream = lambda: spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
    bounds = [0, 40, 41, 150, 260, 400]
    for run in (bounds[:4], bounds[3:]):
        for a, b in zip(run, run[1:]):
            part(a, b)
        q = ingest.choose_stream(stream(), s, target, checkpoint)
        q.awaitTermination()
        assert q.exception() is None
    taken = spark.read.parquet(target)
    key = ["label", "chunk_index", "doc_id", "source_document_index", "document_sample_rank", "chunk_sha256"]
    assert sorted(map(str, ingest.finished_chunks(taken, s).select(key).collect())) == sorted(map(str, want.select(key).collect()))
    assert want.select("doc_id").distinct().count() <= taken.count() <= 3 * 60  # three corpora's budgets; a reservoir's candidates are fewer here
