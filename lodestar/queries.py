"""Registered queries of the engine and the SQL each is held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestar.plans import metric_queries, retrieval_queries, store_queries, text_queries  # noqa: F401  they register
from lodestar.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "flagship"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Required-all keyword search with BM25 over a corpus."""
    return retrieval_queries.ft_bm25_topk(spark, sf_dir)
