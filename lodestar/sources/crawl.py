"""A scan of directory trees by tasks, level by level, where what can't be read is a row and stops nothing else."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.sources import files

ENTRY = "path string, kind string, length long, modified double, operation string, error string"
#: Entries that a task hands on at once.
ROWS = 10_000

Entry = tuple[str, str, int | None, float | None, str | None, str | None]


def failure(path: str, operation: str, error: Exception) -> Entry:
    return path, "error", None, None, operation, type(error).__name__


def list_directory(path: str) -> Iterator[Entry]:
    """The entries of one directory: file, directory or other (links and devices, which are not followed), or error."""
    if "://" in path and not path.startswith("file://"):
        system, inner = pafs.FileSystem.from_uri(path)
        base = path.rstrip("/")
        for info in system.get_file_info(pafs.FileSelector(inner)):
            kind = {pafs.FileType.File: "file", pafs.FileType.Directory: "directory"}.get(info.type, "other")
            yield f"{base}/{info.base_name}", kind, info.size if kind == "file" else None, info.mtime.timestamp() if info.mtime else None, None, None
        return
    base = path.rstrip("/")
    with os.scandir(path.removeprefix("file://") or "/") as entries:
        for entry in entries:
            # A name that is no UTF-8 can't be a column's value, so its file couldn't be found again.
            name = os.fsencode(entry.name).decode("utf-8", "replace")
            try:
                entry.name.encode()
                kind = "directory" if entry.is_dir(follow_symlinks=False) else "file" if entry.is_file(follow_symlinks=False) else "other"
                found = entry.stat(follow_symlinks=False)
                yield f"{base}/{name}", kind, found.st_size if kind == "file" else None, found.st_mtime, None, None
            except (OSError, UnicodeError) as error:
                yield failure(f"{base}/{name}", "read_metadata", error)


def crawl(spark: SparkSession, roots: list[str], profile: str = "explicit", listed_by: Callable[[str], Iterator[Entry]] = list_directory) -> DataFrame:
    """path, kind, length, modified (seconds), operation, error of all that lies below ``roots``.

    kind is file, directory, skipped (a directory that the profile leaves out), other, or error with the operation that
    failed and its kind; a directory whose listing breaks off keeps the rows that came before. Each level is a round: tasks list
    its directories, each streaming its entries, and the rows are a checkpoint, so lost executors cost a level at most. Roots that
    repeat or lie below others are listed once; no roots give no rows.
    """
    plain = sorted({r.rstrip("/") or "/" for r in roots})
    tops = [r for r in plain if not any(r != o and r.startswith(o.rstrip("/") + "/") for o in plain)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in ENTRY.split(", ")]

        def frame(rows: list[Entry]) -> pd.DataFrame:
            return pd.DataFrame(rows, columns=columns).astype({"length": "Int64", "modified": "float64"})

        held: list[Entry] = []
        for batch in batches:
            for path in batch["path"]:
                try:
                    for entry in listed_by(path):
                        held.append(entry)
                        if len(held) >= ROWS:
                            yield frame(held)
                            held = []
                except OSError as error:
                    held.append(failure(path, "read_directory", error))
        if held:
            yield frame(held)

    level = spark.createDataFrame([(r,) for r in tops], "path string")
    out = None
    while True:
        found = level.repartition("path").mapInPandas(run, ENTRY)
        entered = files.wanted_directory(F.concat("path", F.lit("/")), profile)
        rows = found.withColumn("kind", F.when((F.col("kind") == "directory") & ~entered, "skipped").otherwise(F.col("kind"))).checkpoint()
        out = rows if out is None else out.unionByName(rows)
        level = rows.where("kind = 'directory'").select("path")
        if level.isEmpty():
            return out
