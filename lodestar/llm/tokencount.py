"""Token counts by an exact length histogram.

Documents are grouped by their encoded length; the histogram answers every later question. Its suffix sums give, for a
context limit L, the documents that do not fit, the tokens of those that do, and the tokens left if all are cut at L.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Folder of the public vocabularies; only the driver reads it, and sends the ranks (about 1 MB) to the executors.
VOCABULARIES = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
#: The published pre-tokenisation of this vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters encoded at once. Longer texts are cut where a blank is followed by a letter, which never is inside a token.
PIECE = 65_536
_cut = re.compile(r"(?<=[^\W\d_]) (?=[^\W\d_])")
_encoders: dict[bytes, object] = {}


def load_ranks(folder: str = VOCABULARIES, name: str = VOCABULARY) -> bytes:
    return Path(folder, name).read_bytes()


def encoder(ranks: bytes):
    """The tokenizer, built once a worker."""
    import tiktoken

    if ranks not in _encoders:
        pairs = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
        _encoders[ranks] = tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=pairs, special_tokens={})
    return _encoders[ranks]


def pieces(text: str) -> Iterator[str]:
    """``text`` in parts of about PIECE characters that are encoded as the whole would be."""
    at = 0
    while len(text) - at > PIECE and (cut := _cut.search(text, at + PIECE)):
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


def token_length(text: str | None, enc) -> int:
    return sum(len(enc.encode_ordinary(p)) for p in pieces(text)) if text else 0


def count_tokens(docs: DataFrame, ranks: bytes, text: str = "text") -> DataFrame:
    """The encoded length of each text, as the single column ``n_tokens``; null and empty texts have length 0."""
    shared = docs.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(shared.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([token_length(t.as_py(), enc) for t in batch.column(0)], pa.int64())], ["n_tokens"])

    return docs.select(F.col(text).cast("string").alias(text)).mapInArrow(run, "n_tokens long")


def length_histogram(lengths: DataFrame) -> DataFrame:
    """n_tokens, n_docs: one row per length that occurs. Lengths are aggregated in each task before the shuffle."""
    return lengths.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_docs"))


def with_suffix_sums(histogram: DataFrame) -> DataFrame:
    """The answers for each length L that occurs, used as the context limit.

    docs_within, tokens_within: documents of at most L tokens and their tokens. docs_over: documents that exceed L.
    tokens_truncated: tokens left when every document is cut at L. quantile: share of documents within L.
    The histogram has one row per distinct length, so its size is bounded by the longest document, not by the corpus.
    """
    order = Window.orderBy("n_tokens")
    upto, after, every = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(1, Window.unboundedFollowing), Window.partitionBy()
    tokens = F.col("n_tokens") * F.col("n_docs")
    return histogram.select(
        "n_tokens",
        "n_docs",
        tokens.alias("tokens"),
        F.sum("n_docs").over(upto).alias("docs_within"),
        F.sum(tokens).over(upto).alias("tokens_within"),
        F.coalesce(F.sum("n_docs").over(after), F.lit(0)).alias("docs_over"),
        (F.sum(tokens).over(upto) + F.col("n_tokens") * F.coalesce(F.sum("n_docs").over(after), F.lit(0))).alias("tokens_truncated"),
        (F.sum("n_docs").over(upto) / F.sum("n_docs").over(every)).alias("quantile"),
    )


def answer(suffix: DataFrame, limits: list[int]) -> DataFrame:
    """A row for each of ``limits``, which need not occur as lengths: docs_over, tokens_within, tokens_truncated."""
    asked = suffix.sparkSession.createDataFrame([(int(x),) for x in limits], "context_limit long")
    over = F.col("n_tokens") > F.col("context_limit")
    return (
        suffix.join(F.broadcast(asked), F.lit(True), "right")
        .groupBy("context_limit")
        .agg(
            F.coalesce(F.sum(F.when(over, F.col("n_docs"))), F.lit(0)).alias("docs_over"),
            F.coalesce(F.sum(F.when(~over, F.col("tokens"))), F.lit(0)).alias("tokens_within"),
            F.coalesce(F.sum(F.least("n_tokens", "context_limit") * F.col("n_docs")), F.lit(0)).alias("tokens_truncated"),
        )
    )


def token_report(spark: SparkSession, docs: DataFrame, folder: str = VOCABULARIES) -> DataFrame:
    """Histogram and suffix sums of all documents. Repeated rows count each time; an empty table gives no rows."""
    return with_suffix_sums(length_histogram(count_tokens(docs, load_ranks(folder))))
