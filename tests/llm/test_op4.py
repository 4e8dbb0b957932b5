import base64
import gzip
import hashlib
import random

import pytest

from strataform.llm import warc
from tests.llm.helpers import tricky


def pages(spark, rows):
    return spark.createDataFrame([(i, f"http://h.example/{i}\r\nX: y" if i and i % 3 else None, t, 1) for i, t in rows], "page_id long, url string, html string, payload long")


def brute(rows):
    raw = [(i, (t or "").encode()) for i, t in rows]
    last = {}
    for i, p in raw:
        last[p] = max(last.get(p, -1), -1 if i is None else i)
    out = []
    for i, p in raw:
        revisit = last[p] != -1 and i != last[p]
        out.append((i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "revisit" if revisit else "response", last[p] if revisit else None))
    return sorted(out, key=str)


def test_round_trip_equals_brute_force(spark, tmp_path):
    rows = tricky() + [(100 + i, t) for i, t in tricky()[:20]] + [(5, "a b c d e"), (None, "null id"), (None, "one"), (500, "é" * 70000), (501, "é" * 70000), (502, "WARC/1.1\r\n\r\nWARC-Type: x\r\n\r\n" * 2000)]
    pages(spark, rows).write.parquet(f"{tmp_path}/pages.parquet")
    got = warc.op4_warc(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)
    folder = f"{tmp_path}/archive"
    warc.write(pages(spark, rows), folder, segment_bytes=700)
    whole = {(r.page_id, r.payload_digest): r for r in warc.read(spark, folder).collect()}
    assert all(bytes(whole[i, base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()].payload or b"") in ((t or "").encode(), b"") for i, t in rows)
    assert bytes(whole[500, base64.b32encode(hashlib.sha1(("é" * 70000).encode()).digest()).decode()].payload or b"") == b"" and bytes(whole[501, base64.b32encode(hashlib.sha1(("é" * 70000).encode()).digest()).decode()].payload) == ("é" * 70000).encode()
    files = [x for x in __import__("pathlib").Path(folder).glob("part-*")]
    assert sum(gzip.decompress(f.read_bytes()).count(b"WARC-Type: continuation\r\n") for f in files) > 300


def test_least_bytes_and_empty(spark, tmp_path):
    warc.write(pages(spark, [(1, "a"), (2, "a"), (3, "long"), (4, "long")]), f"{tmp_path}/a", least_bytes=2)
    assert sorted((r.page_id, r.record_type, r.refers_to) for r in warc.read(spark, f"{tmp_path}/a").collect()) == [(1, "response", None), (2, "response", None), (3, "revisit", 4), (4, "response", None)]
    pages(spark, []).write.parquet(f"{tmp_path}/pages.parquet")
    assert warc.op4_warc(spark, str(tmp_path)).count() == 0


def test_long_payloads_and_other_columns(spark, tmp_path):
    rows = [(1, "0123456789é" * 300_000), (2, "0123456789é" * 300_000), (3, "x"), (4, "y" * 2_500_000)]
    odd = pages(spark, rows).selectExpr("*", "1 AS record_type", "2 AS page", "'q' AS digest", "3 AS n", "4 AS k")
    odd.write.parquet(f"{tmp_path}/pages.parquet")
    assert sorted(map(tuple, warc.op4_warc(spark, str(tmp_path)).collect()), key=str) == brute(rows)


def test_framing():
    r = random.Random(0)
    for n in (0, 1, 4095, 4096, 4097, 20000):
        p = r.randbytes(n)
        assert warc.decode_chunks(warc.frame_chunks(p)) == p
    assert warc.decode_chunks(b"3;x=y\r\nabc\r\n0\r\nTrailer: 1\r\n\r\n") == b"abc"
    with pytest.raises(ValueError):
        warc.decode_chunks(b"3\r\nabcd\r\n0\r\n\r\n")
