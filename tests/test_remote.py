"""Shards over HTTP: caps, compression, breaks and ranges."""

import gzip
import http.server
import json
import random
import threading

import pytest
import zstandard

from strataform.sources import remote

TEXT = b"".join(json.dumps({"i": i, "text": random.Random(i).randbytes(40).hex()}).encode() + b"\n" if i % 10 else b"{broken\n" if i % 20 else b"\n" for i in range(20000))
FILES = {"/a-1.jsonl": TEXT, "/a-2.jsonl.gz": gzip.compress(TEXT[: len(TEXT) // 2].rpartition(b"\n")[0] + b"\n") + gzip.compress(TEXT), "/b-1.jsonl.zst": zstandard.compress(TEXT), "/c-0.jsonl": b""}


@pytest.fixture
def server():
    class Handler(http.server.BaseHTTPRequestHandler):
        sent, asked, broken, ranges = 0, [], 0, True

        def do_GET(self):
            body, at = FILES.get(self.path), 0
            if body is None:
                return self.send_error(404)
            Handler.asked.append((self.path, self.headers.get("Range")))
            if Handler.ranges and (r := self.headers.get("Range")):
                at = int(r.removeprefix("bytes=").rstrip("-"))
                if at >= len(body):
                    return self.send_error(416)
            self.send_response(206 if at else 200)
            self.send_header("Content-Length", str(len(body) - at))
            self.end_headers()
            end = len(body)
            if Handler.broken > 0:
                Handler.broken, end = Handler.broken - 1, min(end, at + 150_000)
            try:
                for i in range(at, end, 8192):
                    self.wfile.write(body[i : min(i + 8192, end)])
                    Handler.sent += min(8192, end - i)
            except OSError:
                pass

        def log_message(self, *args):
            pass

    s = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    s.handler, s.url = Handler, f"http://127.0.0.1:{s.server_address[1]}"
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield s
    s.shutdown()


def frame(spark, server, names):
    return spark.createDataFrame([(server.url + n,) for n in names], "url string")


def test_caps(spark, server):
    """Bytes that travel follow the cap, not the shard; malformed lines are counted, blank ones use up the cap."""
    rows = remote.capped_shards(spark, frame(spark, server, FILES), 100).collect()
    by = {}
    for r in rows:
        by.setdefault(r.source_ref.removeprefix(server.url), []).append(r)
    assert set(by) == set(FILES) - {"/c-0.jsonl"}
    for got in by.values():
        assert [r.source_shard_row_index for r in got] == [i for i in range(100) if i % 20] and sum(r.malformed for r in got) == 5 and all((r.row is None) == r.malformed for r in got)
        assert [json.loads(r.line)["i"] for r in got if not r.malformed] == [i for i in range(100) if i % 10]
        assert max(r.bytes_read for r in got) <= 2 * remote.BLOCK
    assert {r.source_ref.removeprefix(server.url): r.source_shard_index for r in rows} == {"/a-1.jsonl": 0, "/a-2.jsonl.gz": 1, "/b-1.jsonl.zst": 2}
    few = max(r.bytes_read for r in rows)
    some = remote.capped_shards(spark, frame(spark, server, ["/a-1.jsonl"]), 5000).agg({"bytes_read": "max"}).first()[0]
    assert few < some < 0.3 * len(TEXT) + 2 * remote.BLOCK


def test_breaks(spark, server, monkeypatch):
    """Connections that end early are taken up by range, or by passing over what is known; the result is the same."""
    whole = [x.decode() for x in TEXT.split(b"\n")]
    for ranges in (True, False):
        server.handler.ranges, server.handler.broken, server.handler.asked = ranges, 3 if ranges else 1, []
        got = list(remote.lines(remote.inflated(remote.blocks(server.url + "/a-1.jsonl", wait=0), "/a-1.jsonl")))
        assert got == whole[:-1] and [r for _, r in server.handler.asked][:2] == [None, "bytes=150000-"]
    server.handler.ranges, server.handler.broken = True, 10**6
    got = list(remote.lines(remote.inflated(remote.blocks(server.url + "/a-2.jsonl.gz", wait=0), "/a-2.jsonl.gz")))  # progress each time
    assert len(got) > 29000
    with pytest.raises(OSError):
        list(remote.blocks("http://127.0.0.1:9/none", tries=2, wait=0))
    with pytest.raises(OSError):
        list(remote.blocks(server.url + "/missing", wait=0))


def test_choice_and_files(spark, server, tmp_path):
    (tmp_path / "a-7.jsonl").write_bytes(b'{"i": 1}\r\n\r\n[1]\n{"i": 2}')
    urls = frame(spark, server, FILES).unionByName(spark.createDataFrame([(f"file://{tmp_path}/a-7.jsonl",)], "url string"))
    rows = remote.capped_shards(spark, urls, 10, include="a", seed=3).collect()
    assert {r.source_ref.split("/")[-1] for r in rows} == {"a-1.jsonl", "a-2.jsonl.gz", "a-7.jsonl"} and {r.source_shard_index for r in rows} == {0, 1, 2}
    assert [(r.source_shard_row_index, r.malformed) for r in rows if r.source_ref.endswith("a-7.jsonl")] == [(0, False), (2, True), (3, False)]
    assert remote.capped_shards(spark, urls, 0).collect() == [] and remote.capped_shards(spark, urls.limit(0), 5).collect() == []
