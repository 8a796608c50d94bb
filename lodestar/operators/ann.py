"""Approximate vector search: an inverted file over quantised vectors, exact re-ranking and an exact way for short lists.

Every vector lies in the list of its nearest centroid, as a product-quantised code: its direction is cut into stretches,
and each stretch is the number of the nearest of 256 stretches learned from a bounded sample. A query looks into the lists
nearest to it, scores their codes by table lookups with its own unquantised stretches (asymmetric distance), and takes its
best candidates to their full vectors, whose cosines alone decide. A query that gets fewer than k hits is searched exactly.

How many lists a query looks into is measured when the index is built, on the sample: the fewest that hold the wanted share
of true neighbours. Vectors without cluster structure make that many; the answer stays right, only the saving shrinks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.operators.vectors import nearest
from lodestar.sources.snapshots import Store

#: Vectors that centroids and stretches are learned from, at most: those with the smallest hashes of their keys.
SAMPLE, ROUNDS = 20_000, 10
MOST_LISTS, CODES, STRETCH = 4096, 256, 4
#: Share of true neighbours that the lists a query looks into must hold, on ASKED vectors of the sample.
RECALL, ASKED = 0.95, 300
#: Candidates of a query whose full vectors are looked at; vectors and queries that meet in a block.
RERANKED, PAGE, QUERY_PAGE = 200, 4096, 512
#: Queries that are sent to their lists at once.
PROBED = 64
#: Folders of the published codes.
BUCKETS = 64


def int8_codes(v: Column) -> Column:
    """scale and codes: each value as a multiple, from -127 to 127, of the largest magnitude's 127th part. A zero vector has zero codes."""
    top = F.array_max(F.transform(v, lambda x: F.abs(x.cast("double"))))
    scale = F.when(top > 0, top / 127).otherwise(F.lit(1.0))
    return F.struct(scale.alias("scale"), F.transform(v, lambda x: F.round(x.cast("double") / scale).cast("tinyint")).alias("codes"))


def int8_dot(asked: Column, code: Column) -> Column:
    """Asymmetric: the query's own values against codes, scaled once."""
    products = F.zip_with(asked, code["codes"], lambda x, c: x.cast("double") * c)
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x) * code["scale"]


@dataclass
class Model:
    """Centroids (lists, dimension), codebooks (stretches, CODES, length of a stretch) and the number of lists to look into."""

    centroids: np.ndarray
    books: np.ndarray
    probes: int

    def codes(self, rows: np.ndarray) -> np.ndarray:
        cut = rows.reshape(len(rows), len(self.books), -1)
        return np.stack([_closest(cut[:, s], book) for s, book in enumerate(self.books)], axis=1).astype(np.uint8)

    def tables(self, asked: np.ndarray) -> np.ndarray:
        """(queries, stretches, CODES): products of each stretch of a query with those of the book."""
        return np.einsum("qsd,scd->qsc", asked.reshape(len(asked), len(self.books), -1), self.books)


def _closest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(1) - 2 * rows @ centres.T).argmin(1)


def _means(rows: np.ndarray, k: int, unit: bool) -> np.ndarray:
    """k-means from evenly spaced rows; a centre without rows stays where it is. Equal rows give equal centres."""
    centres = rows[np.linspace(0, len(rows) - 1, k).astype(int)].copy()
    for _ in range(ROUNDS):
        of = _closest(rows, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, of, rows)
        some = np.bincount(of, minlength=k)
        centres[some > 0] = sums[some > 0] / some[some > 0, None]
        if unit:
            centres = _unit(centres)
    return centres


def _unit(rows: np.ndarray) -> np.ndarray:
    lengths = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, lengths, out=np.zeros_like(rows), where=lengths > 0)


def _matrix(column: pa.ListArray, rows: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(rows, -1)


def train(vectors: DataFrame, key: str = "vec_id", values: str = "embedding") -> Model:
    """Learns from at most SAMPLE vectors; only they come to the driver."""
    some = vectors.where(F.col(values).isNotNull())
    total = some.count()
    chosen = some.orderBy(F.xxhash64(key), key).limit(SAMPLE).select(F.col(values).cast("array<float>").alias("v")).toArrow()
    if not total:
        return Model(np.zeros((1, 0), np.float32), np.zeros((0, CODES, 0), np.float32), 1)
    rows = _unit(_matrix(chosen["v"].combine_chunks(), chosen.num_rows))
    stretches = max(1, rows.shape[1] // STRETCH)
    while rows.shape[1] % stretches:
        stretches -= 1
    lists = int(min(MOST_LISTS, max(1, round(total**0.5)), len(rows)))
    centroids = _means(rows, lists, True)
    cut = rows.reshape(len(rows), stretches, -1)
    books = np.stack([_means(cut[:, s], CODES, False) for s in range(stretches)])
    asked = rows[:: max(1, len(rows) // ASKED)]
    true = np.argsort(-(asked @ rows.T), axis=1, kind="stable")[:, :10]
    place = np.argsort(np.argsort(-(asked @ centroids.T), axis=1), axis=1)  # of each list, for each query
    found = np.sort(np.take_along_axis(place, _closest(rows, centroids)[true], axis=1).ravel())
    return Model(centroids, books, int(found[min(len(found) - 1, int(RECALL * len(found)))]) + 1)


def coded(vectors: DataFrame, model: Model, key: str = "vec_id", values: str = "embedding") -> DataFrame:
    """bucket, list, n, rows: pages of about PAGE (key, code) of each list. A vector that many rows have makes many pages."""
    source = vectors.select(F.col(key), F.col(values).cast("array<float>").alias("_v")).where("_v IS NOT NULL")
    kind = source.schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                rows = _unit(_matrix(batch.column(1), batch.num_rows))
                codes = pa.array([c.tobytes() for c in model.codes(rows)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_closest(rows, model.centroids), pa.int32()), codes], [key, "list", "code"])

    rows = source.mapInArrow(run, f"`{key}` {kind}, list int, code binary")
    # At most MOST_LISTS rows.
    sizes = rows.groupBy("list").agg((1 + F.floor(F.count(F.lit(1)) / PAGE)).alias("_pages"))
    dealt = rows.join(F.broadcast(sizes), "list").withColumn("_page", F.pmod(F.xxhash64(key), F.col("_pages")))
    pages = dealt.groupBy("list", "_page").agg(F.collect_list(F.struct(F.col(key).alias("key"), "code")).alias("rows"))
    return pages.select((F.col("list") % BUCKETS).alias("bucket"), "list", "rows")


def model_table(spark: SparkSession, model: Model) -> DataFrame:
    """kind, place, number, values: centroids, stretches and the number of lists; bounded by MOST_LISTS and CODES."""
    rows = [("centroid", 0, i, c.tolist()) for i, c in enumerate(model.centroids)] + [("book", s, i, c.tolist()) for s, b in enumerate(model.books) for i, c in enumerate(b)]
    return spark.createDataFrame([*rows, ("probes", 0, model.probes, [])], "kind string, place int, number int, values array<float>").coalesce(1)


def publish(store: Store, generation: str, base: str | None, vectors: DataFrame, key: str = "vec_id", values: str = "embedding") -> dict:
    """A generation with the model and the codes of all vectors."""
    model = train(vectors, key, values)
    return store.publish({"ann_model": model_table(vectors.sparkSession, model), "ann_codes": coded(vectors, model, key, values)}, generation, base)


def read_model(table: DataFrame) -> Model:
    rows = sorted(table.collect(), key=lambda r: (r.kind, r.place, r.number))
    part = lambda kind: np.array([r["values"] for r in rows if r.kind == kind], np.float32)
    places = {r.place for r in rows if r.kind == "book"}
    return Model(part("centroid"), part("book").reshape(len(places), CODES, -1 if places else 0), next(r.number for r in rows if r.kind == "probes"))


def candidates(pages: DataFrame, model: Model, queries: DataFrame, values: str = "embedding") -> DataFrame:
    """query_id, key, approx: the RERANKED best codes of each query in the lists it looks into.

    Pages of codes meet pages of queries by list, so that a task holds one block of each; a block keeps RERANKED a query.
    """
    source = queries.select(F.col("query_id").cast("string"), F.col(values).cast("array<float>").alias("_v"))
    kind = pages.schema["rows"].dataType.elementType["key"].dataType.simpleString()

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, PROBED):  # a query goes on once a list
                some = batch.slice(start, PROBED)
                asked = _unit(_matrix(some.column(1), some.num_rows))
                at = np.argsort(-(asked @ model.centroids.T), axis=1, kind="stable")[:, : model.probes]
                whose = pa.array(np.repeat(np.arange(len(asked)), at.shape[1]))
                yield pa.RecordBatch.from_arrays([some.column(0).take(whose), pa.array(at.ravel(), pa.int32()), some.column(1).take(whose)], ["query_id", "list", "v"])

    probes = source.mapInArrow(probe, "query_id string, list int, v array<float>")
    sizes = probes.groupBy("list").agg((1 + F.floor(F.count(F.lit(1)) / QUERY_PAGE)).alias("_pages"))
    asked = probes.join(F.broadcast(sizes), "list").groupBy("list", F.pmod(F.xxhash64("query_id"), F.col("_pages")).alias("_page")).agg(F.collect_list(F.struct("query_id", "v")).alias("asked"))
    blocks = pages.join(asked.select("list", "asked"), "list").select("rows", "asked")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                rows, queries_ = batch.column(0).slice(i, 1).flatten(), batch.column(1).slice(i, 1).flatten()
                names, vectors_ = queries_.flatten()
                keys, binary = rows.flatten()
                codes = np.frombuffer(b"".join(binary.to_pylist()), np.uint8).reshape(len(keys), -1)
                tables = model.tables(_unit(_matrix(vectors_, len(names))))
                approx = sum(tables[:, s, codes[:, s]] for s in range(codes.shape[1]))
                best = np.argpartition(-approx, RERANKED - 1, axis=1)[:, :RERANKED] if len(keys) > RERANKED else np.tile(np.arange(len(keys)), (len(names), 1))
                whose = np.repeat(np.arange(len(names)), best.shape[1])
                yield pa.RecordBatch.from_arrays([names.take(pa.array(whose)), keys.take(pa.array(best.ravel())), pa.array(np.take_along_axis(approx, best, 1).ravel().astype(np.float64))], ["query_id", "key", "approx"])

    found = blocks.mapInArrow(score, f"query_id string, key {kind}, approx double")
    order = Window.partitionBy("query_id").orderBy(F.desc("approx"), "key")
    return found.withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= RERANKED).drop("_place")


def reranked(found: DataFrame, vectors: DataFrame, queries: DataFrame, k: int, key: str, values: str) -> DataFrame:
    """query_id, key, score, rank: the k candidates with the largest cosines, ties by key."""
    full = vectors.select(F.col(key).alias("key"), F.col(values).cast("array<float>").alias("_v"))
    asked = queries.select(F.col("query_id").cast("string"), F.col(values).cast("array<float>").alias("_q"))
    both = found.join(full, "key").join(asked, "query_id").select("query_id", "key", "_v", "_q")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                v, q = (_unit(_matrix(batch.column(c), batch.num_rows).astype(np.float64)) for c in (2, 3))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array((v * q).sum(1))], ["query_id", "key", "score"])

    scored = both.mapInArrow(run, f"query_id string, key {full.schema['key'].dataType.simpleString()}, score double").withColumn("score", F.round("score", 6))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "key")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).withColumnRenamed("key", key)


def search(pages: DataFrame, model: Model, vectors: DataFrame, queries: DataFrame, k: int, allowed: DataFrame | None = None, key: str = "vec_id", values: str = "embedding") -> DataFrame:
    """query_id, key, score, rank. ``allowed`` (key) cuts candidates before the k best are taken.

    A query whose candidates give fewer than k hits is searched exactly among all allowed vectors, so its list is full
    wherever enough vectors are allowed. Vectors that are null are in no list; queries that are null find nothing.
    """
    queries = queries.where(F.col(values).isNotNull())
    open_ = vectors if allowed is None else vectors.join(allowed.select(key), key, "left_semi")
    hits = reranked(candidates(pages, model, queries, values), open_, queries, k, key, values)
    if vectors.sparkSession.sparkContext.getCheckpointDir():
        hits = hits.checkpoint()  # read three times below
    some = queries.select(F.col("query_id").cast("string").alias("query_id"), values)
    short = some.join(hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= k), "query_id", "left_anti")
    filled = nearest(open_, short, k, key, values)
    return hits.join(short.select("query_id"), "query_id", "left_anti").unionByName(filled.select(hits.columns))
