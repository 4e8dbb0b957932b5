import zlib

import numpy as np
import pyarrow as pa

from strataform.llm import quality_classifier as Q
from tests.llm.helpers import frame, save, tricky

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    got = Q.op6_quality_classifier(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").toPandas()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]).all()
    held = got[got.held_out]
    assert len(held) > 40 and (held.predicted == held.quality).mean() > 0.95
    assert got.score.between(0, 1).all() and ((got.score >= 0.3) == (got.predicted == 1)).all()


def test_densities_equal_brute_force(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = Q.fit(docs.select("doc_id", "text"), labels)
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = [r for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 5]
    x = Q.statistics(pa.array([texts[r.doc_id] for r in rows]))
    y = np.array([r.quality for r in rows])
    pooled = np.diag(sum((y == c).sum() * x[y == c].var(0) for c in (0, 1)) / len(y)) + 1e-4 * np.eye(x.shape[1])
    logs = []
    for c in (0, 1):
        s = (1 - Q.SHRINKAGE) * np.cov(x[y == c].T, bias=True) + Q.SHRINKAGE * pooled
        d = x - x[y == c].mean(0)
        logs.append(np.log((y == c).sum()) - 0.5 * np.linalg.slogdet(s)[1] - 0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(s), d))
    want = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -40, 40)))
    assert np.allclose(model.scores(x), want, atol=2e-5)


def test_defined_cases(spark, tmp_path):
    docs = frame(spark, [*tricky(), (None, "a b"), (3, "one")]).withColumnRenamed("lang", "score")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = Q.fit(docs, none)
    out = Q.classify(docs, model)
    assert out.count() == len(tricky()) + 2 and {r.score for r in out.collect()} == {0.5}
    odd = spark.createDataFrame([(i, i % 2 if i else None, 0) for i in range(60)] + [(None, 1, 0), (7, 1, 0)], "doc_id long, quality int, toxic int")
    out = Q.classify(docs, Q.fit(docs, odd)).collect()
    assert all(0 <= r.score <= 1 and r.held_out is not None for r in out)
    assert Q.classify(docs.limit(0), model).count() == 0
    save(spark, tmp_path, tricky())
