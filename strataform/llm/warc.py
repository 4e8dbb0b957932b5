"""WARC archives with segmented records (operator 4).

Writing: one record per page, each a gzip member; a response's HTTP message is framed in chunks and, where
it is long, cut into a first segment and continuation records. Of equal payloads the page with the largest
id is the response, other pages get revisit records. Files hold about ``FILE_BYTES`` before compression and
are written by Spark's own committer, so a retried task leaves no half file.

Reading: records are parsed by their stated lengths, continuations are grouped by the record they continue
and ordered by segment number, the total length is verified, chunked framing is decoded, and the payload is
held against its digest. Revisits are resolved to the response they name.

Defined results: a null html is an empty payload; equal payloads count from 0 bytes on (``least_bytes``).
Rows that repeat both id and payload share a verdict and get records of their own. A null id is the smallest
and stays null. A null url is written as ``urn:none``, control characters in urls are percent-encoded. An
empty table gives no records. Other columns aren't stored, whatever their names. A very long payload is cut into as many
segments as it needs; reading holds one record's whole payload at a time.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataform.llm.store import new_path

#: Payload bytes of an archive file, of a record before it is segmented, and of a chunk of the framing.
FILE_BYTES, SEGMENT_BYTES, CHUNK_BYTES = 16 << 20, 32 << 10, 4 << 10
DATE = "2024-01-01T00:00:00Z"
HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def record_id(page_id: int | None, sha1: str, copy: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{page_id} {sha1} {copy}')}>"


def frame_chunks(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """Chunked transfer coding of ``payload``."""
    parts = [payload[i : i + size] for i in range(0, len(payload), size)]
    return b"".join(b"%x\r\n%b\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n"


def decode_chunks(body: bytes) -> bytes:
    """The payload of a chunked body; chunk extensions and trailers are skipped."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0].strip(), 16)
        at = end + 2
        if not size:
            return b"".join(out)
        if body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("a chunk doesn't end where its size says")
        out.append(body[at : at + size])
        at += size + 2


def message_payload(block: bytes) -> bytes:
    """The payload of an HTTP message."""
    head, _, body = block.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in head.split(b"\r\n")[1:])}
    return decode_chunks(body) if fields.get(b"transfer-encoding", b"").lower() == b"chunked" else body


def record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    """One record as a gzip member. Its last byte is 0 as members are short; the writer's line end supplies it."""
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", len(block))])
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    out = pack.compress(b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n") + pack.flush()
    assert out[-1] == 0, "a record of 16 MB or more"
    return out[:-1]


def page_records(page_id: int | None, url: str | None, payload: bytes, sha1: str, copy: int, refers_to: str | None, segment: int) -> list[bytes]:
    """The records of one page: a revisit, or a response and its continuations."""
    mine, digest = record_id(page_id, sha1, copy), base32(bytes.fromhex(sha1))
    uri = "".join(c if c > " " else f"%{ord(c):02X}" for c in url) if url else "urn:none"
    page = [] if page_id is None else [("Page-Id", page_id)]
    head = lambda kind, name: [("WARC-Type", kind), ("WARC-Record-ID", name), ("WARC-Date", DATE), ("WARC-Target-URI", uri)]
    known = [("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http;msgtype=response"), *page]
    if refers_to:
        return [record([*head("revisit", mine), ("WARC-Profile", REVISIT), ("WARC-Refers-To", refers_to), *known], b"HTTP/1.1 200 OK\r\n\r\n")]
    block = HEAD + frame_chunks(payload)
    parts = [block[i : i + segment] for i in range(0, len(block), segment)]
    if len(parts) == 1:
        return [record([*head("response", mine), *known], block)]
    out = [record([*head("response", mine), ("WARC-Segment-Number", 1), *known], parts[0])]
    for i, part in enumerate(parts[1:], 2):
        more = [("WARC-Segment-Origin-ID", mine), ("WARC-Segment-Number", i)]
        if i == len(parts):
            more.append(("WARC-Segment-Total-Length", len(block)))
        out.append(record([*head("continuation", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{mine} {i}')}>"), *more], part))
    return out


def write(pages: DataFrame, folder: str, least_bytes: int = 0, segment_bytes: int = SEGMENT_BYTES) -> None:
    """Write ``pages`` (page_id, url, html) as archives below ``folder``."""
    spark = pages.sparkSession
    src = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload")).withColumn("sha1", F.sha1("payload"))
    src = src.withColumn("k", F.coalesce(F.col("page_id").cast("string"), F.lit("")))
    ids = src.select("page_id", "k", "sha1", F.octet_length("payload").alias("n"))
    mean = (ids.agg(F.avg("n")).first()[0] or 0) + 1024
    # The payload's response by digest, then by page: payloads move once, by a key that is never hot, and stay
    # where the join put them.
    last = ids.filter(F.col("n") >= least_bytes).groupBy("sha1").agg(F.max("page_id").alias("last"), F.count("*").alias("copies")).filter("copies > 1 AND last IS NOT NULL").select("sha1", "last")
    revisits = ids.select("page_id", "k", "sha1").distinct().join(last, "sha1").filter(~F.col("page_id").eqNullSafe(F.col("last"))).select("k", "sha1", "last")
    placed = src.join(revisits, ["k", "sha1"], "left").withColumn("copy", F.row_number().over(Window.partitionBy("k", "sha1").orderBy("url")) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in (b.slice(i, 64) for i in range(0, b.num_rows, 64)):
                out = []
                for r in row.to_pylist():
                    refers_to = None if r["last"] is None else record_id(r["last"], r["sha1"], 0)
                    out += page_records(r["page_id"], r["url"], r["payload"], r["sha1"], r["copy"], refers_to, segment_bytes)
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])

    records = placed.select("page_id", "url", "payload", "sha1", "last", "copy").mapInArrow(run, "record binary")
    records.select(F.col("record").cast("string").alias("value")).write.option("lineSep", "\x00").option("maxRecordsPerFile", max(1, int(FILE_BYTES / mean))).text(folder)


def parse(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records (fields, block) of an archive, of gzip members or plain."""
    raw = []
    while content[:2] == b"\x1f\x8b":
        member = zlib.decompressobj(31)
        raw.append(member.decompress(content))
        if not member.eof:
            raise ValueError("an archive ends within a member")
        content = member.unused_data
    data = b"".join(raw) or content
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        version, *lines = data[at:end].decode().split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError("no record where one should begin")
        fields = dict(x.split(": ", 1) for x in lines)
        size = int(fields["Content-Length"])
        block = data[end + 4 : end + 4 + size]
        if data[end + 4 + size : end + 8 + size] != b"\r\n\r\n":
            raise ValueError("a record doesn't end where its length says")
        yield fields, block
        at = end + 8 + size


ROW = "key string, page_id long, type string, refers string, digest string, seg int, total long, block binary, n long, payload binary"
KINDS = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.binary()]
COLS = [x.split()[0] for x in ROW.split(", ")]


def _finished(key, page_id, kind, refers, digest, block: bytes | None, keep: bool) -> tuple:
    """A whole record's row: its payload is decoded and held against its digest."""
    if kind == "revisit":
        return (key, page_id, kind, refers, digest, 0, None, None, None, None)
    payload = message_payload(block)
    if base32(hashlib.sha1(payload).digest()) != digest:
        raise ValueError(f"the payload of {key} isn't what its digest says")
    return (key, page_id, kind, None, digest, 0, None, None, len(payload), payload if keep else None)


def read(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to[, payload]) of every page in the archives."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0):
                out = []
                for f, block in parse(content.as_py()):
                    page_id, digest = (int(f["Page-Id"]) if "Page-Id" in f else None), f.get("WARC-Payload-Digest", "").removeprefix("sha1:")
                    seg, total = int(f.get("WARC-Segment-Number", 0)), f.get("WARC-Segment-Total-Length")
                    if seg:
                        out.append((f.get("WARC-Segment-Origin-ID") or f["WARC-Record-ID"], page_id, f["WARC-Type"], None, digest, seg, int(total) if total else None, block, None, None))
                    else:
                        out.append(_finished(f["WARC-Record-ID"], page_id, f["WARC-Type"], f.get("WARC-Refers-To"), digest, block, payloads))
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(KINDS)], names=COLS)

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r in b.to_pylist():
                parts = r["parts"]
                block = b"".join(p["block"] for p in parts)
                if [p["seg"] for p in parts] != list(range(1, len(parts) + 1)) or parts[-1]["total"] != len(block):
                    raise ValueError(f"segments of {r['key']} are missing")
                out.append(_finished(r["key"], r["page_id"], "response", None, r["digest"], block, payloads))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(KINDS)], names=COLS)

    # Small batches: a row is an archive file.
    rows = spark.read.format("binaryFile").load(folder).select("content").mapInArrow(scan, ROW)
    first = F.col("type") != "continuation"
    parts = F.sort_array(F.collect_list(F.when(F.col("seg") > 0, F.struct("seg", "total", "block"))))
    groups = rows.groupBy("key").agg(F.max(F.when(first, F.struct("page_id", "type", "refers", "digest", "n", "payload"))).alias("r"), parts.alias("parts")).select("key", "r.*", "parts")
    whole = groups.mapInArrow(_resolve(assemble), ROW)
    responses = whole.filter("type = 'response'").select(F.col("key").alias("refers"), F.col("page_id").alias("refers_to"), F.col("n").alias("payload_bytes"), F.col("digest").alias("response_digest"))
    columns = ["page_id", "payload_bytes", F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), "refers_to"] + (["payload"] if payloads else [])
    plain = whole.filter("type = 'response'").withColumn("refers_to", F.lit(None).cast("long")).withColumn("payload_bytes", F.col("n"))
    found = whole.filter("type = 'revisit'").join(responses, "refers", "left")
    same = F.when(F.col("response_digest") == F.col("digest"), F.col("payload_bytes")).otherwise(F.raise_error(F.lit("a revisit names no response with its digest")).cast("long"))
    return plain.select(columns).unionByName(found.withColumn("payload_bytes", same).select(columns))


def _resolve(assemble):
    """Rows without segments pass; others are put together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b.to_pylist()
            done = [(r["key"], r["page_id"], r["type"], r["refers"], r["digest"], 0, None, None, r["n"], r["payload"]) for r in rows if not r["parts"]]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in done], t) for k, t in enumerate(KINDS)], names=COLS)
            if open_ := [i for i, r in enumerate(rows) if r["parts"]]:
                yield from assemble(iter([b.take(pa.array(open_))]))

    return run


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_path(spark, "warc")
    write(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    return read(spark, folder, payloads=False)
