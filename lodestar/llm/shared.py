"""Folders, tables and small numeric helpers that the operators of this subpackage share.

Whatever has to outlive an executor is a Parquet table below ``spark.checkpoint.dir``, the folder that
the cluster names and that every machine sees.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions.vectorised import small_batches

_work: list[str] = []


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A new path below the cluster's shared folder; only a session without one gets a local folder (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        root = "file://" + tempfile.gettempdir() + "/lodestar-shared"
    path = f"{root.rstrip('/')}/lodestar-{purpose}-{uuid.uuid4().hex}"
    _work.append(path)
    return path


def written(df: DataFrame, purpose: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """``df`` as a table in the shared folder, reread: lineage ends there, and lost executors cost nothing."""
    path = shared_dir(df.sparkSession, purpose)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Delete the tables that ``written`` made in this process; results read from them must be consumed before."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    while _work:
        path = jvm.org.apache.hadoop.fs.Path(_work.pop())
        path.getFileSystem(conf).delete(path, True)


#: A key of more than one in so many rows is hot. Fewer keys than this can be, whatever the data.
HOT_KEYS = 10_000


def looked_up(rows: DataFrame, side: DataFrame, key: str, *spread: str, total: int | None = None, nulls: bool = False) -> DataFrame:
    """``rows`` left-joined with ``side`` (at most one row a ``key``), with no hot key in one task.

    What ``side`` has on hot keys is fewer than HOT_KEYS rows and is broadcast; rows with such a key are dealt by the
    hash of ``spread``, the others by key. ``nulls``: rows without a key are many and stay out of the join. ``total`` is
    the number of rows, if it is known.
    """
    if total is None:
        total = rows.count()
    values = [c for c in side.columns if c != key]
    if nulls:
        alone = rows.where(F.col(key).isNull()).select("*", *[F.lit(None).cast(side.schema[c].dataType).alias(c) for c in values])
        return looked_up(rows.where(F.col(key).isNotNull()), side, key, *spread, total=total).unionByName(alone)
    hot = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > total // HOT_KEYS + 1).select(key)
    known = side.join(F.broadcast(hot), key, "left_semi").select(key, F.lit(True).alias("_hot"), *[F.col(c).alias(f"_hot_{c}") for c in values])
    marked = rows.join(F.broadcast(known), key, "left")
    # The second join needs nothing of rows with a hot key, so their salt may be any. A constant salt would be optimised away.
    salted = marked.withColumn("_salt", F.when(F.col("_hot"), F.xxhash64(*spread)).otherwise(F.xxhash64(key)))
    joined = salted.join(side.withColumn("_salt", F.xxhash64(key)), [key, "_salt"], "left")
    return joined.select(*rows.columns, *[F.when(F.col("_hot"), F.col(f"_hot_{c}")).otherwise(F.col(c)).alias(c) for c in values])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8(column: Column) -> Column:
    """The bytes of a text; null counts as the empty text."""
    return F.encode(F.coalesce(column, F.lit("")), "UTF-8")


def sorted_rows(df: DataFrame, *keys: str) -> DataFrame:
    """Range-partitioned and sorted by ``keys``, nulls last, so that partitions are in global order."""
    order = [F.col(k).asc_nulls_last() for k in keys]
    return df.repartitionByRange(*order).sortWithinPartitions(*order)
