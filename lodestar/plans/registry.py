"""Where queries are registered, with the SQL each is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a function under its own name."""

    def register(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql:
            ORACLE_SQL[function.__name__] = sql
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def literal(value: object) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, (list, tuple)):
        return "[" + ", ".join(map(literal, value)) + "]"
    return repr(value) if isinstance(value, (int, float)) else "'" + str(value).replace("'", "''") + "'"


def values_sql(columns: str, rows: list[tuple]) -> str:
    """A SELECT of literal rows; columns with types, as in ``a BIGINT, b VARCHAR``."""
    parts = [c.strip().split(" ", 1) for c in columns.split(",")]
    casts = ", ".join(f"CAST({n} AS {t}) AS {n}" for n, t in parts)
    return f"SELECT {casts} FROM (VALUES {', '.join('(' + ', '.join(map(literal, r)) + ')' for r in rows)}) AS v({', '.join(n for n, _ in parts)})"
