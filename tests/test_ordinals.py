"""Places in a global order when sketches differ from one evaluation to the next."""

import random

from pyspark.sql import functions as F

from strataform.operators import ordinals, semantic


def _moody(kind):
    """Bounds as of a sketch that gives others whenever it is worked out."""
    draw = F.udf(lambda top, n: sorted(random.uniform(0, top) for _ in range(n)), "array<double>")
    return lambda column, points, accuracy: draw(F.max(column).cast("double"), F.lit(len(points))).cast(f"array<{kind}>")


def test_places_of_moody_bounds(spark, monkeypatch):
    monkeypatch.setattr(ordinals.F, "percentile_approx", _moody("long"))
    rows = spark.range(3000).select((F.col("id") % 3).alias("label"), F.col("id").alias("doc_id"))
    got = ordinals.ahead(rows, ["label"], ["doc_id"]).collect()
    assert len(got) == 3000 and all(r.ahead == r.doc_id // 3 for r in got)


def test_ranks_of_moody_bounds(spark, monkeypatch):
    monkeypatch.setattr(semantic.F, "percentile_approx", _moody("double"))
    monkeypatch.setattr(semantic, "STRETCH", 10)
    rows = spark.range(2000).select((F.col("id") % 2).alias("label"), F.lit(0).alias("proj"), F.floor(F.col("id") / 2).cast("double").alias("value"))
    got = semantic.ranked_values(rows).collect()
    assert len(got) == 2000 and all(r.i == r.value and r.n == 1000 for r in got)
