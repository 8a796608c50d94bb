"""A training corpus in five stages, each a table in the shared folder and each over all that the one before kept.

toxicity: documents that the compression distance rejects go. jaccard: of each group of near duplicates the document
with the smallest doc_id stays, of repeated rows one. decontaminate: documents that hold a window of a benchmark item
go. mix: sources are brought to their target weights, which repeats documents or leaves them out. shard: what is left is
cut, in the mixed order, into contiguous shards of nearly equal bytes.

All stages: an empty table gives an empty table, columns beside doc_id, text and source are carried whatever their
names, and rows are told apart by doc_id and text together, never by doc_id alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.llm import decontaminate, jaccard, mixing, sharding, toxicity
from lodestar.llm.shared import small_batches, table, written


def numbered(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """The columns of ``docs`` as c0, c1, ..., so that no other column can clash with them, and ``text``."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    return docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names, strict=True)], F.col("text")), names


def named(rows: DataFrame, names: list[str], docs: DataFrame) -> DataFrame:
    return rows.select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)])


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with a score below 0.5; the model is fitted on the labelled rows of ``docs`` outside the held-out fold.

    Null and empty texts score 0 and stay, as does everything if too few rows are labelled. A score of exactly 0.5 goes.
    Rows with one text score alike, so repeats stay or go together.
    """
    small_batches(spark)
    rows, names = numbered(docs)
    scored = toxicity.with_score(rows, toxicity.fit(docs, table(spark, sf_dir, "labels")), *names)
    return named(scored.where("score < 0.5"), names, docs)


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates the rows with its smallest doc_id, and of rows that repeat doc_id and text one.

    Of two rows with one doc_id and different texts each is judged by its own text. Of repeated rows the one stays that
    comes first by all its columns. Null, empty and blank texts are duplicates of nothing but their own repeats; rows
    without doc_id all stay.
    """
    small_batches(spark)
    rows, names = numbered(docs)
    doc_id = F.col(names[docs.columns.index("doc_id")])
    marked = rows.withColumn("_hash", F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))).withColumn("_id", doc_id.cast("long"))
    others = jaccard.with_components(docs.select("doc_id", "text")).where("doc_id <> component_id").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct()
    left = marked.where("_id IS NOT NULL").join(others, ["_id", "_hash"], "left_anti")
    # Maps have no order of their own, but a text.
    order = [F.to_json(F.struct(n)) if "map<" in rows.schema[n].dataType.simpleString() else F.col(n) for n in names]
    # Partial aggregation leaves a row of each repeat in a task before the shuffle.
    whole = left.groupBy("_id", "_hash", F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256)).agg(F.min_by(F.struct(*names), F.struct(*order)).alias("_row")).select("_row.*")
    return named(whole.unionByName(rows.where(doc_id.isNull()).select(*names)), names, docs)


def remove_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text holds no window of a benchmark item; null, empty and wordless texts hold none and stay."""
    small_batches(spark)
    rows, names = numbered(docs)
    found = decontaminate.with_overlap(rows, table(spark, sf_dir, "benchmark"), *names)
    return named(found.where("n_hit = 0"), names, docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for every copy that the mix takes, in mixed order, at most three of a document.

    Null is a source of its own. Rows that agree in doc_id and text share a fate. Texts without words count 0 and go with
    the block they are in; a source of nothing but such texts gives nothing.
    """
    return mixing.mix(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The columns of ``docs`` with size, text_crc32, shard and slot; the order is that in which ``docs`` is stored."""
    return sharding.shard_stored(docs)


STAGES = [
    ("toxicity", remove_toxic),
    ("jaccard", remove_near_duplicates),
    ("decontaminate", remove_contaminated),
    ("mix", mix_sources),
    ("shard", shard),
]

#: Compression lengths and seeded permutations are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
