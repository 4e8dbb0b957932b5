"""A dataset of Parquet files as a Spark data source: planned partitions, configuration, split, columns, and a seeded shuffle buffer.

``spark.dataSource.register(Dataset)``, then ``spark.read.format("strataform_dataset").option(...).load(path)``, or ``dataset``. A
folder holds files as they are, or in ``<config>/<split>`` or ``<split>``; partitions are row groups. Files are opened by
pyarrow, so paths must be ones that it reads (local, hdfs, s3); tables that only Spark reaches are ``readers.table``'s.

With a ``seed`` a partition's rows go through a buffer of ``buffer`` rows: a row that comes in takes the place of a random one, which leaves.
Partitions are taken in a seeded order of their own. The same seed, files and buffer give the same order, on any number of machines; a
partition that is read again gives the same rows. Memory is bounded by the buffer and a batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pf
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import from_arrow_schema
from pyspark.sql.types import LongType, StringType, StructType

#: Rows of the shuffle buffer unless told otherwise, and rows that are read at once.
BUFFER, BATCH = 10_000, 2048
PLACE = ["source_file", "source_row_group", "source_row"]


@dataclass
class Group(InputPartition):
    path: str
    row_group: int
    first: int
    seed: int


def files(path: str, config: str | None = None, split: str | None = None) -> list[str]:
    """Parquet files of a path (a file or a folder) for a configuration and split, in order."""
    fs, root = pf.FileSystem.from_uri(path) if "://" in path else (pf.LocalFileSystem(), path)
    scheme = path.split("://")[0] + "://" if "://" in path else ""
    for part in (config, split):
        if part and fs.get_file_info(f"{root}/{part}").type == pf.FileType.Directory:
            root = f"{root}/{part}"
        elif part:
            raise FileNotFoundError(f"{path} has no {part!r}")
    info = fs.get_file_info(root)
    if info.type == pf.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.type == pf.FileType.File else fs.get_file_info(pf.FileSelector(root, recursive=True))
    return sorted(scheme + f.path for f in found if f.type == pf.FileType.File and f.path.endswith(".parquet"))


def opened(path: str) -> pq.ParquetFile:
    fs, root = pf.FileSystem.from_uri(path) if "://" in path else (pf.LocalFileSystem(), path)
    return pq.ParquetFile(fs.open_input_file(root))


def shuffled(batches: Iterator[pa.RecordBatch], buffer: int, seed: int) -> Iterator[pa.RecordBatch]:
    """Rows by way of a buffer: each that comes in takes a random place, and what was there leaves. Batches go in and out whole."""
    rng, held = np.random.default_rng(seed), None
    for b in batches:
        t = pa.Table.from_batches([b])
        rows = t if held is None else pa.concat_tables([held, t])
        out = max(0, rows.num_rows - buffer)
        order = np.arange(rows.num_rows)
        left = np.empty(out, np.int64)
        for i in range(out):  # the buffer's places are the first ones; row buffer + i comes in
            spot = int(rng.integers(buffer))
            left[i], order[spot] = order[spot], buffer + i
        yield from rows.take(left).combine_chunks().to_batches()
        held = rows.take(order[: min(buffer, rows.num_rows)]).combine_chunks()
    if held is not None:
        yield from held.take(rng.permutation(held.num_rows)).combine_chunks().to_batches()


class Reader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.fields = [f.name for f in schema.fields if f.name not in PLACE]
        self.options = options
        self.seed = int(options["seed"]) if options.get("seed") else None
        self.buffer = int(options.get("buffer") or BUFFER)

    def partitions(self) -> list[Group]:
        out = []
        for path in files(self.options["path"], self.options.get("config"), self.options.get("split")):
            meta, first = opened(path).metadata, 0
            for g in range(meta.num_row_groups):
                out.append(Group(path, g, first, (self.seed or 0) * 1_000_003 + len(out)))
                first += meta.row_group(g).num_rows
        order = np.random.default_rng(self.seed).permutation(len(out)) if self.seed is not None else range(len(out))
        return [out[i] for i in order] or [Group("", 0, 0, 0)]

    def read(self, partition: Group) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        rows = self.placed(partition)
        yield from shuffled(rows, self.buffer, partition.seed) if self.seed is not None else rows

    def placed(self, p: Group) -> Iterator[pa.RecordBatch]:
        at = p.first
        for b in opened(p.path).iter_batches(BATCH, row_groups=[p.row_group], columns=self.fields):
            place = [pa.array([p.path] * b.num_rows), pa.array(np.full(b.num_rows, p.row_group, np.int64)), pa.array(np.arange(at, at + b.num_rows))]
            at += b.num_rows
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in self.fields), *place], names=[*self.fields, *PLACE])


class Dataset(DataSource):
    """Options: path, config, split, columns (comma-separated; all if missing), seed, buffer."""

    @classmethod
    def name(cls) -> str:
        return "strataform_dataset"

    def schema(self) -> StructType:
        found = files(self.options["path"], self.options.get("config"), self.options.get("split"))
        if not found:
            raise FileNotFoundError(f"no Parquet files below {self.options['path']}")
        whole = from_arrow_schema(opened(found[0]).schema_arrow, prefer_timestamp_ntz=False)
        named = [c.strip() for c in (self.options.get("columns") or "").split(",") if c.strip()]
        out = StructType([whole[c] for c in named] if named else list(whole.fields))
        return out.add(PLACE[0], StringType()).add(PLACE[1], LongType()).add(PLACE[2], LongType())

    def reader(self, schema: StructType) -> Reader:
        return Reader(schema, dict(self.options))


def dataset(spark: SparkSession, path: str, columns: list[str] | None = None, config: str | None = None, split: str | None = None, seed: int | None = None, buffer: int = BUFFER) -> DataFrame:
    """Rows of a dataset with their file, row group and place; only ``columns`` are read."""
    spark.dataSource.register(Dataset)
    said = {"columns": ",".join(columns or []), "config": config, "split": split, "seed": seed, "buffer": buffer}
    return spark.read.format(Dataset.name()).options(**{k: str(v) for k, v in said.items() if v not in (None, "")}).load(path)
