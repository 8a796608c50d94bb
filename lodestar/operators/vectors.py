"""Vector retrieval, exact: matrix products of blocks, each task keeping its own k best."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

#: Queries searched together; their matrix is what a task holds besides its batch.
MOST_QUERIES = 4096
#: Vectors and queries whose products are held at once: 16 MB.
BLOCK, QUERY_BLOCK = 4096, 512
DIMENSIONS = range(1, 65_537)


def cosine(a: Column, b: Column) -> Column:
    """0 if either vector has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms > 0, dot(a, b) / norms).otherwise(0.0)


def check_contract(model_id: str, dimension: int, asked_model: str, vector: list[float]) -> bool:
    """False if the model is another one: the result is then empty. A wrong dimension is an error."""
    if dimension not in DIMENSIONS or len(vector) != dimension or not all(map(np.isfinite, vector)):
        raise ValueError("vector does not fit the model")
    return model_id == asked_model


def nearest(vectors: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", values: str = "embedding") -> DataFrame:
    """query_id, key, score, rank of the k most similar vectors of each query, ties by key.

    queries: query_id, embedding. They are searched in blocks of MOST_QUERIES, each a pass over the vectors, which stay
    where they are; each task keeps k rows a query and sends them to the shuffle at its end. Vectors of another length than a query's are an error.
    """
    asked = queries.select(F.col("query_id").cast("string"), F.col(values).cast("array<float>")).toLocalIterator()
    found = block_scores(vectors, list(itertools.islice(asked, MOST_QUERIES)), k, key, values)
    while block := list(itertools.islice(asked, MOST_QUERIES)):
        found = found.unionByName(block_scores(vectors, block, k, key, values))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.col(key).asc())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def block_scores(vectors: DataFrame, asked: list, k: int, key: str, values: str) -> DataFrame:
    """query_id, key, score of the k most similar vectors of each task and query, ties by key."""
    names = [r[0] for r in asked]
    matrix = np.array([r[1] for r in asked], np.float64).reshape(len(asked), -1 if asked else 0)
    lengths = np.linalg.norm(matrix, axis=1, keepdims=True)
    matrix = np.divide(matrix, lengths, out=np.zeros_like(matrix), where=lengths > 0)
    source = vectors.select(F.col(key), F.col(values).cast("array<float>").alias("_v")).where("_v IS NOT NULL")
    kind, of = source.schema[0].dataType.simpleString(), to_arrow_type(source.schema[0].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [_nothing(of) for _ in range(0, len(names), QUERY_BLOCK)]
        for batch in batches:
            for at in range(0, batch.num_rows if names else 0, BLOCK):
                piece = batch.slice(at, BLOCK)
                rows = piece.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(piece.num_rows, -1)
                if rows.shape[1] != matrix.shape[1]:
                    raise ValueError("vectors and queries differ in dimension")
                norms = np.linalg.norm(rows, axis=1, keepdims=True)
                unit = np.divide(rows, norms, out=np.zeros_like(rows), where=norms > 0).T
                for i, best in enumerate(held):
                    held[i] = _better(best, _rounded(matrix[i * QUERY_BLOCK : (i + 1) * QUERY_BLOCK] @ unit), piece.column(0), k)
        for i, best in enumerate(held):
            if best.num_rows:
                whose = pa.array([names[i * QUERY_BLOCK + q] for q in best["q"].to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([whose, *(best[c].combine_chunks() for c in ("key", "score"))], ["query_id", key, "score"])

    return source.mapInArrow(run, f"query_id string, `{key}` {kind}, score double")


def _nothing(kind: pa.DataType) -> pa.Table:
    return pa.table({"q": pa.array([], pa.int32()), "key": pa.array([], kind), "score": pa.array([], pa.float64())})


def _rounded(similar: np.ndarray) -> np.ndarray:
    """Six digits, halves away from zero: what ranks are decided by, so that ties go to the key. What is no number is no hit."""
    return np.nan_to_num(np.copysign(np.floor(np.abs(similar) * 1e6 + 0.5) / 1e6, similar) + 0.0, nan=-np.inf)


def _better(best: pa.Table, similar: np.ndarray, keys: pa.Array, k: int) -> pa.Table:
    """The k best of each query among ``best`` (q, key, score) and a block of scores (queries, keys), ties by key."""
    least = np.partition(similar, -k, axis=1)[:, -k] if similar.shape[1] > k else np.full(len(similar), -np.inf)
    q, scores = best["q"].to_numpy(), best["score"].to_numpy()
    if len(q):  # a query that has k cannot get worse
        full = np.bincount(q, minlength=len(similar)) >= k
        worst = np.full(len(similar), np.inf)
        np.minimum.at(worst, q, scores)
        least = np.where(full, np.maximum(least, worst), least)
    new, at = np.nonzero((similar >= least[:, None]) & (similar > -np.inf))
    if not len(new):
        return best
    both = pa.concat_tables([best, pa.table({"q": pa.array(new, pa.int32()), "key": keys.take(pa.array(at)), "score": pa.array(similar[new, at])}, best.schema)])
    both = both.take(pc.sort_indices(both, [("q", "ascending"), ("score", "descending"), ("key", "ascending")]))
    of = both["q"].to_numpy()
    starts = np.flatnonzero(np.diff(of, prepend=-1))
    place = np.arange(len(of)) - np.repeat(starts, np.diff(starts, append=len(of)))
    return both.filter(pa.array(place < k)).combine_chunks()


def filtered_after(hits: DataFrame, allowed: DataFrame, key: str = "vec_id") -> DataFrame:
    """Vectors are filtered after the cut-off, so fewer than k may stay; ranks are those before."""
    return hits.join(allowed.select(key), key, "left_semi")


def embed(texts: DataFrame, model: Callable[[list[str]], np.ndarray], dimension: int, batch: int = 256, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, embedding by a model that takes lists of at most ``batch`` texts; outputs are checked."""
    kind = texts.schema[key].dataType.simpleString()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for at in range(0, len(part), batch):
                some = part.iloc[at : at + batch]
                out = np.asarray(model(some[text].fillna("").tolist()), np.float32)
                if out.shape != (len(some), dimension) or not np.isfinite(out).all():
                    raise ValueError("model output does not fit its contract")
                yield pd.DataFrame({key: some[key], "embedding": list(out)})

    return texts.select(key, text).mapInPandas(run, f"`{key}` {kind}, embedding array<float>")


def changed(targets: DataFrame, base: DataFrame) -> DataFrame:
    """Targets whose (doc_id, version_id) the base does not have: only these are embedded anew."""
    return targets.join(base.select("doc_id", "version_id"), ["doc_id", "version_id"], "left_anti")
