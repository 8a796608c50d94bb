"""Rank fusion of several channels, and folding of hits to one per candidate."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RRF_K = 60


def reciprocal_rank_fusion(channels: DataFrame, k: int = RRF_K, carry: str | None = None) -> DataFrame:
    """query_id, doc_id, score, rank from rows (query_id, channel, rank, doc_id).

    A document that a channel has twice counts twice. Ties are broken by doc_id as a string. ``carry`` names a column of
    which the first value in channel order, then rank, is kept.
    """
    k = max(1, k)
    sums = [F.round(F.sum(1.0 / (k + F.col("rank"))), 12).alias("score")]
    if carry:
        sums.append(F.min_by(carry, F.when(F.col(carry).isNotNull(), F.struct("channel", "rank"))).alias(carry))
    fused = channels.groupBy("query_id", F.col("doc_id").cast("string").alias("doc_id")).agg(*sums)
    return fused.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")))


def hybrid(lexical: DataFrame, semantic: DataFrame, top: int, k: int = RRF_K) -> DataFrame:
    """Keyword and vector hits fused and cut; what a keyword hit carries takes precedence over a vector hit's."""
    parts = [part.select("query_id", F.lit(n).alias("channel"), "rank", "doc_id") for n, part in ((0, lexical), (1, semantic))]
    return reciprocal_rank_fusion(parts[0].unionByName(parts[1]), k).where(F.col("rank") <= top)


def fold(hits: DataFrame, fallback: str = "doc") -> DataFrame:
    """The first hit of each candidate, in the order of rank; a hit without candidate stands for itself.

    fallback: ``doc`` keys such hits by document, ``version`` by version.
    """
    own = F.concat(F.lit("doc:"), F.col("doc_id").cast("string")) if fallback == "doc" else F.concat(F.lit("version:"), F.col("version_id").cast("string"))
    first = Window.partitionBy("query_id", F.coalesce(F.concat(F.lit("candidate:"), F.col("candidate_key")), own)).orderBy("rank")
    return hits.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def fold_and_number(hits: DataFrame, top: int) -> DataFrame:
    """Folded by candidate or version, renumbered from 1, ``top`` per query."""
    order = Window.partitionBy("query_id").orderBy("rank")
    return fold(hits, "version").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
