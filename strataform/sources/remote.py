"""Shards that are read as a stream and only as far as their cap.

A partition is a shard: bytes come in blocks, are decompressed as they come, and reading ends with the last line that
counts. A connection that breaks is taken up again by byte range, so that no byte is read twice; blocks that came before are
neither asked for nor decompressed again.
"""

from __future__ import annotations

import time
import urllib.error
import urllib.request
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataform.operators.extract import components
from strataform.sources.readers import component_of, csv_set, object_of

BLOCK, TRIES, TIMEOUT = 64 << 10, 5, 60
#: Lines that a task passes on at once.
ROWS = 1000


def blocks(url: str, tries: int = TRIES, wait: float = 0.5) -> Iterator[bytes]:
    """The bytes behind a url (http, https or file). A break is tried again from where it happened, ``tries`` times in a row without any
    progress; a server that ignores ranges sends everything again, of which the known part is passed over."""
    at, left, whole = 0, tries, None
    while True:
        try:
            ranged = {"Range": f"bytes={at}-"} if at else {}
            with urllib.request.urlopen(urllib.request.Request(url, headers=ranged), timeout=TIMEOUT) as r:
                skip = at if at and getattr(r, "status", None) != 206 else 0
                length = r.headers.get("Content-Length")
                whole = int(length) + at - skip if length else whole
                while skip:
                    skip -= len(r.read(min(skip, BLOCK))) or skip
                while block := r.read(BLOCK):
                    at, left = at + len(block), tries
                    yield block
            if whole is None or at >= whole:
                return
            raise OSError(f"{url} ended at {at} of {whole} bytes")
        except urllib.error.HTTPError as e:
            if e.code == 416 and at:  # nothing behind what is known
                return
            if e.code < 500 and e.code != 429:
                raise
            error: Exception = e
        except OSError as e:  # refused, reset, timed out, ended early
            error = e
        left -= 1
        if left <= 0:
            raise error
        time.sleep(wait)


def inflated(raw: Iterator[bytes], name: str) -> Iterator[bytes]:
    """Decompressed as far as it is asked for: gzip (members one after another), zstd, or as it is, by the name's ending."""
    name = name.split("?")[0]
    if name.endswith((".zst", ".zstd")):
        import zstandard

        codec = zstandard.ZstdDecompressor().decompressobj(read_across_frames=True)
        for block in raw:
            yield codec.decompress(block)
    elif name.endswith(".gz"):
        codec = zlib.decompressobj(31)
        for block in raw:
            while block:
                yield codec.decompress(block)
                block = codec.unused_data
                if codec.eof:
                    codec = zlib.decompressobj(31)
    else:
        yield from raw


def lines(parts: Iterator[bytes]) -> Iterator[str]:
    """Lines that aren't blank are passed on as text, blank ones as empty; ends are \\n or \\r\\n."""
    rest = b""
    for part in parts:
        *whole, rest = (rest + part).split(b"\n")
        for line in whole:
            yield line.decode("utf-8", "replace").strip()
    if rest:
        yield rest.decode("utf-8", "replace").strip()


def capped_shards(spark: SparkSession, urls: DataFrame, per_shard: int, include: str | None = None, exclude: str | None = None, seed: int | None = None) -> DataFrame:
    """(source_ref, source_shard_index, source_shard_row_index, line, row, malformed, bytes_read): the first ``per_shard`` lines of every shard (url), by
    component and in seeded order as ``readers.shards`` has them.

    Malformed and blank lines use up the cap; malformed ones are kept with a null ``row``, so that they can be counted, blank ones go. ``bytes_read``
    is what had come from the source when a line was passed on.
    """
    picked = components(urls.withColumn("component", component_of("url")), csv_set(include), csv_set(exclude)).select("url").distinct()
    key = F.col("url") if seed is None else F.md5(F.concat_ws("|", F.lit(str(seed)), "url").cast("binary"))
    listed = [r.url for r in picked.orderBy(key, "url").collect()]  # a manifest's urls
    if not listed:
        return spark.createDataFrame([], "source_ref string, source_shard_index int, source_shard_row_index long, line string, row variant, malformed boolean, bytes_read long")
    dealt = spark.createDataFrame(spark.sparkContext.parallelize(list(enumerate(listed)), len(listed)), "i int, url string")

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for i, url in zip(f["i"], f["url"]):
                seen, out = 0, []

                def counted(url=url):
                    nonlocal seen
                    for block in blocks(url):
                        seen += len(block)
                        yield block

                for k, line in enumerate(lines(inflated(counted(), url)) if per_shard > 0 else ()):
                    if line:
                        out.append((url, i, k, line, seen))
                    if len(out) >= ROWS or k + 1 >= per_shard:
                        yield pd.DataFrame(out, columns=["source_ref", "source_shard_index", "source_shard_row_index", "line", "bytes_read"])
                        out = []
                    if k + 1 >= per_shard:
                        break
                yield pd.DataFrame(out, columns=["source_ref", "source_shard_index", "source_shard_row_index", "line", "bytes_read"])

    rows = dealt.mapInPandas(read, "source_ref string, source_shard_index int, source_shard_row_index long, line string, bytes_read long")
    whole = rows.withColumn("row", object_of("line"))
    return whole.select("source_ref", "source_shard_index", "source_shard_row_index", "line", "row", F.col("row").isNull().alias("malformed"), "bytes_read")
