"""Vectorised functions that can be defined before a session exists."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def vectorised(kind: str) -> Callable[[Callable], Callable[..., Column]]:
    """Makes a function of series a function of columns; the pandas UDF is made when it is first used on columns."""

    def wrap(function: Callable) -> Callable[..., Column]:
        @functools.wraps(function)
        def column(*columns: Column | str) -> Column:
            return F.pandas_udf(function, kind)(*columns)

        return column

    return wrap


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of at most 8 MB in this session: a worker holds a few of them, whatever the texts' lengths."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    size = spark.conf.get(name, "64m").lower().rstrip("b")
    scale = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30}.get(size[-1:], 1)
    if int(size.rstrip("kmg")) * scale > 8 << 20:
        spark.conf.set(name, str(8 << 20))
