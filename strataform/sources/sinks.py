"""Sinks: JSON, JSON lines, Parquet, Markdown, packages and figure data."""

from __future__ import annotations

import hashlib
import json
import math
import shutil
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_json(value: object, path: str | Path) -> None:
    """Small results of the driver: indented ASCII with a newline at the end."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(json.dumps(value, indent=2, ensure_ascii=True) + "\n")


def append_json_lines(df: DataFrame, folder: str) -> None:
    df.write.mode("append").json(folder)


def write_new(df: DataFrame, folder: str, overwrite: bool = False) -> None:
    """Parquet; an existing folder is an error unless it may be replaced."""
    df.write.mode("overwrite" if overwrite else "errorifexists").parquet(folder)


def cell(value: object) -> str:
    """Four decimals, or NA for null and what isn't finite."""
    if isinstance(value, bool) or not isinstance(value, (int, float)):
        return "NA" if value is None else str(value)
    if isinstance(value, int):
        return str(value)
    return f"{value:.4f}" if math.isfinite(value) else "NA"


def markdown(df: DataFrame, title: str, most: int = 1000) -> str:
    """A title and a table of a small frame; more than ``most`` rows are an error rather than cut."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report of more than {most} rows")
    lines = [f"# {title}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join([*lines, *("| " + " | ".join(map(cell, r)) + " |" for r in rows)]) + "\n"


def report(title: str, notes: list[str], sections: dict[str, DataFrame]) -> str:
    """A report: a title, notes as a list, and a table under a heading for each frame."""
    parts = [f"# {title}\n", "".join(f"- {n}\n" for n in notes)]
    parts += [markdown(df, name).replace("# ", "## ", 1) for name, df in sections.items()]
    return "\n".join(p for p in parts if p)


def write_vectors(df: DataFrame, path: str | Path, column: str = "embedding") -> tuple[int, int]:
    """One corpus's vectors in the order of ``vec_id`` as a two-dimensional .npy file; rows pass one partition at a time.

    Returns the shape. No vectors give no rows and no columns.
    """
    import numpy as np

    shape = df.agg(F.count("*").alias("n"), F.max(F.size(column)).alias("d")).first()
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    if not shape.n:
        np.save(path, np.zeros((0, 0), np.float32))
        return 0, 0
    out = np.lib.format.open_memmap(path, "w+", np.float32, (shape.n, shape.d))
    for i, r in enumerate(df.select("vec_id", column).orderBy("vec_id").toLocalIterator()):
        out[i] = r[1]
    out.flush()
    return shape.n, shape.d


def package(folder: str | Path, target: str | Path) -> None:
    """A deflated archive of a folder, in the order of names."""
    folder = Path(folder)
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(x for x in folder.rglob("*") if x.is_file()):
            z.write(p, p.relative_to(folder).as_posix())


def copy_with_digest(source: str | Path, target: str | Path) -> dict:
    target = Path(target)
    target.parent.mkdir(parents=True, exist_ok=True)
    shutil.copyfile(source, target)
    raw = target.read_bytes()
    return {"path": str(target), "sha256": hashlib.sha256(raw).hexdigest(), "bytes": len(raw)}
