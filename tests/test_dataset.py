"""The dataset source: what is read, in which order, and what isn't."""

from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from strataform.sources import dataset as D


@pytest.fixture
def folder(tmp_path):
    for config in ("a", "b"):
        for split, n in (("train", 500), ("test", 20)):
            (tmp_path / config / split).mkdir(parents=True)
            for part in range(2):
                rows = {"i": list(range(n * part, n * (part + 1))), "text": [f"{config} {split} {i}" if i % 9 else None for i in range(n * part, n * (part + 1))], "v": [[float(i)] for i in range(n)]}
                pq.write_table(pa.table(rows), tmp_path / config / split / f"{part}.parquet", row_group_size=120)
    return str(tmp_path)


def test_columns_config_and_split(spark, folder):
    rows = D.dataset(spark, folder, ["text", "i"], "a", "train")
    assert rows.columns == ["text", "i", *D.PLACE] and rows.rdd.getNumPartitions() == 10
    got = rows.collect()
    assert Counter((r.i, r.text) for r in got) == Counter((i, f"a train {i}" if i % 9 else None) for i in range(1000))
    assert all(r.source_file.endswith(f"a/train/{r.i // 500}.parquet") and r.source_row == r.i % 500 and r.source_row_group == r.i % 500 // 120 for r in got)
    assert D.dataset(spark, folder).count() == 2 * 1040 and "v" in D.dataset(spark, folder, split="train", config="b").columns
    with pytest.raises(Exception, match="no 'valid'"):
        D.dataset(spark, folder, config="a", split="valid").collect()


def test_seeded_order(spark, folder):
    order = lambda seed, buffer=50: [r.i for r in D.dataset(spark, folder, ["i"], "a", "train", seed, buffer).collect()]
    one, again, other, plain = order(1), order(1), order(2), order(None)
    assert one == again != other and plain == list(range(1000)) and sorted(one) == sorted(other) == plain
    assert order(1, 1) != one  # buffers matter; the least still passes all rows on
    assert sorted(order(1, 1)) == plain


@pytest.mark.parametrize("buffer", [1, 7, 64, 1000])
def test_buffer(buffer):
    """All rows leave once, none earlier than the buffer lets it, and about evenly."""
    batches = lambda: (pa.RecordBatch.from_arrays([pa.array(range(i, min(300, i + 40)))], names=["x"]) for i in range(0, 300, 40))
    out = [x for b in D.shuffled(batches(), buffer, 3) for x in b.column(0).to_pylist()]
    assert sorted(out) == list(range(300)) and out == [x for b in D.shuffled(batches(), buffer, 3) for x in b.column(0).to_pylist()]
    assert all(place >= x - buffer for place, x in enumerate(out))
    if buffer == 1000:
        assert abs(np.corrcoef(range(300), out)[0, 1]) < 0.2
    assert list(D.shuffled(iter([]), buffer, 3)) == []
