"""Vectors as a folder of two-dimensional .npy parts, written and read by tasks.

A table is sorted by id, each task writes parts of at most ``PART_BYTES`` under names of its own attempt, and the commit, which sees names and row
counts alone, gives them their final names: ``part-<number of the first vector>.npy``. A task that is run again or whose job fails leaves nothing that a
reader would take. Paths must be ones that pyarrow opens (local, hdfs, s3) and that all machines share.

Defined results: an empty table gives a folder without parts; null vectors, vectors of different lengths and an existing folder are errors; ids may repeat (their order then is
open) or be null (first). Entries become 32-bit floats.
"""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pf
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

PART_BYTES = 64 << 20


def filesystem(path: str) -> tuple[pf.FileSystem, str]:
    return pf.FileSystem.from_uri(path) if "://" in path else (pf.LocalFileSystem(), path)


@dataclass
class Written(WriterCommitMessage):
    partition: int
    parts: list[tuple[str, int, int]]


class Writer(DataSourceArrowWriter):
    def __init__(self, folder: str, part_bytes: int):
        self.folder, self.part_bytes = folder.rstrip("/"), part_bytes

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, root = filesystem(self.folder)
        fs.create_dir(f"{root}/_open", recursive=True)
        out, rows, size = [], [], 0
        name = f"{root}/_open/{uuid.uuid4().hex}"

        def flush():
            x = np.concatenate(rows)
            buffer = io.BytesIO()
            np.save(buffer, x)
            with fs.open_output_stream(f"{name}-{len(out)}") as f:
                f.write(buffer.getbuffer())
            out.append((f"{name}-{len(out)}", *x.shape))

        for batch in iterator:
            col = batch.column("embedding")
            if not batch.num_rows:
                continue
            lengths = col.value_lengths()
            if col.null_count or len(lengths.unique()) != 1:
                raise ValueError("vectors must not be null and must have one length")
            values = col.flatten()
            if values.null_count:
                raise ValueError("an entry of a vector is null")
            x = np.asarray(values, np.float32).reshape(batch.num_rows, -1)
            step = max(1, self.part_bytes // max(1, 4 * x.shape[1]))
            for i in range(0, len(x), step):
                piece = x[i : i + step]
                if rows and (size + piece.nbytes > self.part_bytes or rows[0].shape[1] != piece.shape[1]):
                    flush()
                    rows, size = [], 0
                rows.append(piece)
                size += piece.nbytes
        if rows:
            flush()
        return Written(TaskContext.get().partitionId(), out)

    def commit(self, messages: list[Written | None]) -> None:
        fs, root = filesystem(self.folder)
        parts = [p for m in sorted((m for m in messages if m), key=lambda m: m.partition) for p in m.parts]
        if len({d for _, _, d in parts}) > 1:
            self.abort(messages)
            raise ValueError("vectors must have one length")
        first = 0
        for path, n, _ in parts:
            fs.move(path, f"{root}/part-{first:015d}.npy")
            first += n
        self._clear(fs, root)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*filesystem(self.folder))

    def _clear(self, fs: pf.FileSystem, root: str) -> None:
        if fs.get_file_info(f"{root}/_open").type == pf.FileType.Directory:
            fs.delete_dir(f"{root}/_open")


class VectorParts(DataSource):
    """Options: path, part_bytes."""

    @classmethod
    def name(cls) -> str:
        return "strataform_vectors"

    def schema(self) -> StructType:
        return StructType.fromDDL("embedding array<float>")

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        return Writer(self.options["path"], int(self.options.get("part_bytes") or PART_BYTES))


def write_vector_parts(df: DataFrame, folder: str, column: str = "embedding", part_bytes: int = PART_BYTES) -> None:
    """Write one corpus's vectors (vec_id, ``column``) in the order of ``vec_id``."""
    fs, root = filesystem(folder)
    if fs.get_file_info(root).type != pf.FileType.NotFound:
        raise FileExistsError(folder)
    fs.create_dir(root, recursive=True)
    df.sparkSession.dataSource.register(VectorParts)
    rows = df.select("vec_id", df[column].cast("array<float>").alias("embedding")).orderBy("vec_id").select("embedding")
    rows.write.format(VectorParts.name()).mode("append").option("part_bytes", part_bytes).save(folder)


def vector_parts(spark: SparkSession, folder: str, label: str) -> DataFrame:
    """(label, vec_id, embedding) of a folder of parts, numbered from 0 over all of them."""
    from strataform.sources.readers import vectors

    fs, root = filesystem(folder)
    if not any(f.path.endswith(".npy") for f in fs.get_file_info(pf.FileSelector(root))):
        return spark.createDataFrame([], "label string, vec_id long, embedding array<float>")
    return vectors(spark, f"{folder.rstrip('/')}/part-*.npy", label)
