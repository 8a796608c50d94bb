"""Contiguous shards of nearly equal bytes.

Rows get one global order (range partitions, sorted). Each partition adds up its own bytes; the totals, one row per
partition, give every partition its offset; a row's offset in the whole then says between which equal targets it lies.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.shared import sorted_rows, utf8, written

SHARDS = 24
ROW_OVERHEAD = 8


def local_prefixes(rows: DataFrame, size: str) -> DataFrame:
    """Adds ``part`` and, within it, ``before`` (bytes of earlier rows) and ``place`` (number of earlier rows)."""
    names = rows.columns
    plain = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, total, count = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            sizes = batch.column(size).to_numpy(zero_copy_only=False).astype(np.int64)
            ends = total + np.cumsum(sizes)
            n = len(sizes)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, part, np.int32)), pa.array(ends - sizes), pa.array(np.arange(count, count + n, dtype=np.int64))], [*names, "part", "before", "place"])
            if n:
                total, count = int(ends[-1]), count + n

    return rows.mapInArrow(run, f"{plain}, part int, before long, place long")


def prefix_sums(rows: DataFrame, size: str, *keys: str) -> DataFrame:
    """Adds the global ``before`` and ``place`` of each row in the order of ``keys``, and ``total``.

    The ordered table is written once, so both reads see the same partitions even if executors are lost. What is
    broadcast has one row per partition. Equal keys may stand in either order; callers name enough keys.
    """
    local = written(local_prefixes(sorted_rows(rows, *keys), size), "prefix")
    totals = local.groupBy("part").agg((F.max(F.col("before") + F.col(size))).alias("bytes"), F.count(F.lit(1)).alias("rows"))
    # A row for each partition: the window over all of them is one small task.
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    offsets = totals.select("part", F.coalesce(F.sum("bytes").over(earlier), F.lit(0)).alias("_bytes"), F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("_rows"), F.sum("bytes").over(every).alias("total"))
    joined = local.join(F.broadcast(offsets), "part")
    return joined.withColumn("before", F.col("before") + F.col("_bytes")).withColumn("place", F.col("place") + F.col("_rows")).drop("part", "_bytes", "_rows")


def shard_of(shards: int) -> Column:
    """The shard in whose equal share of all bytes a row's middle byte lies. Whole numbers: exact up to 9e18 / 2 / shards bytes."""
    return F.expr(f"CAST(least((2 * before + size) * {shards} div (2 * total), {shards} - 1) AS int)")


def stored_prefixes(rows: DataFrame) -> DataFrame:
    """Adds to rows (_row, size, _file, _at) the ``start`` of their run, and ``before`` and ``place`` within it.

    A run is what a task reads of a file without a gap; ``start`` is its first row's number in the file.
    """
    names = rows.columns
    plain = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, following, start, total = None, -1, 0, 0
        for whole in batches:
            at = 0
            while at < whole.num_rows:
                places, files = whole.column("_at").to_numpy(), whole.column("_file")
                if files[at].as_py() != file or places[at] != following:
                    file, start, total = files[at].as_py(), int(places[at]), 0
                # The run goes on as far as the file is the same and the numbers follow each other.
                same = pa.compute.equal(files.slice(at), files[at]).to_numpy(zero_copy_only=False) & (places[at:] == places[at] + np.arange(whole.num_rows - at))
                n = len(same) if same.all() else int(same.argmin())
                batch = whole.slice(at, n)
                sizes = batch.column("size").to_numpy()
                ends = total + np.cumsum(sizes)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, start)), pa.array(ends - sizes), pa.array(places[at : at + n] - start)], [*names, "start", "before", "place"])
                total, following, at = int(ends[-1]), int(places[at + n - 1]) + 1, at + n

    return rows.mapInArrow(run, f"{plain}, start long, before long, place long")


def shard_stored(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """The columns of ``docs`` with size, text_crc32, shard and slot, cut in the order in which ``docs`` is stored.

    The order is that of the files' numbers and of the rows in them, so what a writer has shuffled stays shuffled; a
    ``docs`` that is not read from files is stored first. Rows are not moved: runs of rows add up their bytes, the
    totals, a row per run, give each run its offset. Null text has no bytes; repeated rows are rows of their own; an
    empty table gives no rows. Columns of ``docs`` that are named like one of the four are left out.
    """
    added = ("size", "text_crc32", "shard", "slot")
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    try:
        stored = packed.select("_row", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_at"))
    except AnalysisException:
        stored = written(packed, "stored").select("_row", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_at"))
    text = utf8(F.col("_row.text"))
    sized = stored.select("_row", (F.octet_length(text).cast("long") + ROW_OVERHEAD).alias("size"), F.crc32(text).alias("text_crc32"), "_file", "_at")
    local = written(stored_prefixes(sized), "runs")
    totals = local.groupBy("_file", "start").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    number = F.regexp_extract("_file", r"(\d+)", 1).cast("long")
    earlier = Window.orderBy(number, "_file", "start").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_file", "start", F.coalesce(F.sum("bytes").over(earlier), F.lit(0)).alias("_bytes"), F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("_rows"), F.sum("bytes").over(Window.partitionBy()).alias("total"))
    placed = local.join(F.broadcast(offsets), ["_file", "start"]).withColumn("before", F.col("before") + F.col("_bytes")).withColumn("place", F.col("place") + F.col("_rows")).withColumn("shard", shard_of(shards))
    firsts = placed.groupBy("shard").agg(F.min("place").alias("first"))  # a row for each shard
    out = placed.join(F.broadcast(firsts), "shard")
    return out.select(*[F.col(f"_row.`{c}`").alias(c) for c in docs.columns if c not in added], "size", "text_crc32", "shard", (F.col("place") - F.col("first")).alias("slot"))


def assign_shards(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every document.

    The order is doc_id (nulls last), then checksum, then size. A row belongs to the shard in whose equal share of all
    bytes its middle byte lies, so a shard misses its target by half a row at each end at most. Rows that repeat a
    doc_id are rows of their own. Fewer rows than shards leave shards empty; an empty table gives no rows.
    """
    text = utf8(F.col("text"))
    rows = docs.select("doc_id", (F.octet_length(text).cast("long") + ROW_OVERHEAD).alias("size"), F.crc32(text).alias("text_crc32"))
    placed = prefix_sums(rows, "size", "doc_id", "text_crc32", "size")
    placed = placed.withColumn("shard", shard_of(shards))
    firsts = placed.groupBy("shard").agg(F.min("place").alias("first"))  # a row for each shard
    return placed.join(F.broadcast(firsts), "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("place") - F.col("first")).alias("slot"))
