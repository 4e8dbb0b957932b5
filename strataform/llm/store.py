"""Durable intermediate tables, arrow batch helpers and global ordering for the llm operators.

Everything that cuts lineage is written as Parquet below ``spark.checkpoint.dir`` (shared by all
machines), so a lost executor costs a reread and never a wrong or failed result.
"""

from __future__ import annotations

import atexit
import ctypes
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Only for sessions that name no shared folder (tests on one machine).
LOCAL_DIR = "file:///tmp/checkpoints"
#: Bytes of text that one vectorised step of a Python operator looks at (a longer document comes alone).
STEP_BYTES = 2 << 20


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; on one machine, where it is unset, a local folder."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
    return (named or LOCAL_DIR).rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared one, deleted when the driver's Python ends."""
    path = f"{shared_dir(spark)}/strataform-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
    atexit.register(delete, spark, path)
    return path


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder of intermediate data through Hadoop's file system; nothing happens once Spark is gone."""
    sc = spark.sparkContext
    if sc._jsc is None:
        return
    try:
        where = sc._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001  at exit the gateway may already be closed
        return


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and return a scan of what was written."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``materialize`` that nothing will read again."""
    for table in tables:
        delete(table.sparkSession, table.written_to)


def tasks(spark: SparkSession) -> int:
    """Partitions that a shuffle of this session makes."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def steps(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[pa.RecordBatch]:
    """Cut arrow batches so that each holds about ``STEP_BYTES`` of ``column``: memory stays bounded."""
    for batch in batches:
        col = batch.column(batch.schema.get_field_index(column))
        if not batch.num_rows:
            continue
        _, ofs, _ = text_buffers(col)
        begin = 0
        while begin < batch.num_rows:
            end = begin + 1
            limit = ofs[begin] + STEP_BYTES
            if ofs[-1] > limit:
                end = max(end, int(ofs.searchsorted(limit, side="right")) - 1)
            else:
                end = batch.num_rows
            yield batch.slice(begin, end - begin)
            begin = end
    give_back()


def give_back() -> None:
    """Return freed memory to the machine: a worker that waits for its next task shouldn't hold what the last one took."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library keeps its own counsel
        return


def text_buffers(col: pa.Array):
    """UTF-8 bytes (uint8 view), offsets (int64, from 0) and validity of a string column; null counts as empty."""
    import numpy as np

    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    if col.null_count:
        col = col.fill_null("")
    _, raw, data = col.buffers()
    ofs = np.frombuffer(raw, np.int64, len(col) + 1, col.offset * 8)
    if data is None:
        return np.zeros(0, np.uint8), ofs - ofs[0], len(col)
    return np.frombuffer(data, np.uint8)[ofs[0] : ofs[-1]], ofs - ofs[0], len(col)


def range_bucket(df: DataFrame, key: str, parts: int) -> Column:
    """A column that numbers value ranges of the long ``key`` in ascending order (null: range 0).

    The bounds are approximate quantiles: ``parts`` numbers reach the driver, whatever the data's size.
    Equal keys always share a bucket, and the expression gives the same answer each time it is evaluated.
    """
    bounds = df.select(F.col(key).cast("long").alias(key)).agg(F.percentile_approx(key, [i / parts for i in range(1, parts)], 2000)).first()[0] if parts > 1 else None
    bounds = sorted(set(bounds or []))
    return bucket_of(F.col(key), bounds)


def bucket_of(key: Column, bounds: list[int]) -> Column:
    """Binary search as nested CASE: how many of ``bounds`` are below or at ``key``."""

    def search(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(key >= F.lit(bounds[mid]), search(mid + 1, hi)).otherwise(search(lo, mid))

    return F.when(key.isNull(), F.lit(0)).otherwise(search(0, len(bounds)))
