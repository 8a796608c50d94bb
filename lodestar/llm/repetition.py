"""Quality rules on repetition: how much of a text lies inside n-grams and lines that the text holds more than once.

All texts of an Arrow batch are one numpy array of words. A word has an exact number (no hash stands for it), and n-grams
of several lengths have rolling hashes of those numbers, each length made of the one before by one multiplication and
one addition. The contract's counts of repeated words are exact; a text is judged by characters inside duplicates.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words of an n-gram, and the percentage of a text's characters in repeated n-grams of that length above which it is too much.
NGRAMS = {5: 40, 6: 38, 7: 36, 8: 34, 9: 32, 10: 30}
#: Percentage of the characters in lines that lie in lines which repeat an earlier one.
LINE_CHARS = 30
LEAST_WORDS = 50

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
BASE = np.uint64(0x9E3779B97F4A7C15)

FIELDS = ["n_words", "word_chars", "n_symbols", "n_lines", "line_chars", "n_dup_lines", "dup_line_chars", "n_repeat_words"]
TYPES = [(c, pa.int64()) for c in [*FIELDS, *(f"dup_chars_{n}" for n in NGRAMS)]]


def _mixed(x: np.ndarray) -> np.ndarray:
    """64 well-mixed bits of each number (the finaliser of splitmix64)."""
    x = (x.astype(np.uint64) + np.uint64(1)) * BASE
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _twice(values: np.ndarray) -> np.ndarray:
    """Which values occur more than once."""
    return pd.Series(values).duplicated(keep=False).to_numpy()


def _covered(starts: np.ndarray, n: int, words: int) -> np.ndarray:
    """Words inside windows of ``n`` words that begin at ``starts``."""
    edges = np.bincount(starts, minlength=words + 1) - np.bincount(starts + n, minlength=words + 1)
    return np.cumsum(edges[:words]) > 0


def measure(texts: list[bytes]) -> dict[str, np.ndarray]:
    """Counts for each text, as FIELDS and ``dup_chars_n`` name them."""
    k = len(texts)
    ends = np.cumsum([len(t) + 1 for t in texts], dtype=np.int64)
    joined = b"\n".join(texts) + b"\n" if k else b""
    data = np.frombuffer(joined, np.uint8)
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])  # code points before each byte
    inside = np.concatenate([[False], ~SPACE[data], [False]]).astype(np.int8)
    edge = np.diff(inside)
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    doc = np.searchsorted(ends, first, "right")
    chars = points[last] - points[first]
    names = np.empty(len(first), object)
    names[:] = joined.split()
    word = pd.factorize(names)[0].astype(np.int64)
    per = lambda mask, by=doc, weights=None: np.bincount(by[mask], None if weights is None else weights[mask], minlength=k).astype(np.int64)
    every = np.ones(len(word), bool)
    symbols = np.concatenate([[0], np.cumsum(SYMBOL[data])])
    found = {"n_words": per(every), "word_chars": per(every, weights=chars), "n_symbols": symbols[ends] - symbols[np.concatenate([[0], ends[:-1]])] if k else np.zeros(0, np.int64)}
    found |= _lines(texts, joined, points, last)
    # Windows of three words by exact numbers: of the pair, then of pair and third word, then of those and the text.
    pairs = pd.factorize(word[:-1] * (word.max(initial=0) + 1) + word[1:])[0].astype(np.int64)
    triples = pd.factorize(pairs[:-1] * (word.max(initial=0) + 1) + word[2:])[0].astype(np.int64)
    whole = np.flatnonzero(doc[2:] == doc[:-2])
    again = whole[_twice(triples[whole] * (k + 1) + doc[whole])] if len(whole) else whole
    found["n_repeat_words"] = per(_covered(again, 3, len(word)))
    mixed, apart = _mixed(word), _mixed(doc + (1 << 40))
    rolled = mixed
    for n in range(2, max(NGRAMS) + 1):
        rolled = rolled[:-1] * BASE + mixed[n - 1 :]
        if n in NGRAMS:
            whole = np.flatnonzero(doc[n - 1 :] == doc[: len(rolled)]) if len(rolled) else np.zeros(0, np.int64)
            again = whole[_twice(rolled[whole] ^ apart[whole])] if len(whole) else whole
            found[f"dup_chars_{n}"] = per(_covered(again, n, len(word)), weights=chars)
    return found


def _lines(texts: list[bytes], joined: bytes, points: np.ndarray, words: np.ndarray) -> dict[str, np.ndarray]:
    """Lines with a word, and those of them that equal an earlier line of their text, counted and in code points."""
    lines = joined[:-1].split(b"\n") if texts else []
    length = np.fromiter(map(len, lines), np.int64, len(lines))
    end = np.cumsum(length + 1) - 1
    start = end - length
    size = points[end] - points[start]
    doc = np.repeat(np.arange(len(texts)), [t.count(b"\n") + 1 for t in texts])
    filled = np.searchsorted(words, start, "right") < np.searchsorted(words, end, "right")
    names = np.empty(len(lines), object)
    names[:] = lines
    number = pd.factorize(names)[0].astype(np.int64) * (len(texts) + 1) + doc
    again = np.zeros(len(lines), bool)
    again[filled] = pd.Series(number[filled]).duplicated().to_numpy()
    count = lambda mask, weights=None: np.bincount(doc[mask], None if weights is None else weights[mask], minlength=len(texts)).astype(np.int64)
    return {"n_lines": count(filled), "line_chars": count(filled, size), "n_dup_lines": count(again), "dup_line_chars": count(again, size)}


def repetition(docs: DataFrame, *keys: str, text: str = "text") -> DataFrame:
    """``keys``, the counts, ``base_failed`` and ``kept``. A null or empty text counts as one without words and fails.

    ``kept`` is false where a base rule fails, or where too many characters lie in n-grams that occur twice or more (first
    occurrences included) or in lines that repeat an earlier line.
    """
    rows = docs.select(*keys, F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8").alias("_bytes"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in keys), *(f"{c} bigint" for c, _ in TYPES)])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = measure(batch.column("_bytes").to_pylist())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keys), *(pa.array(found[c], t) for c, t in TYPES)], names=[*keys, *(c for c, _ in TYPES)])

    out = rows.mapInArrow(counted, schema)
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    much = 100 * F.col("dup_line_chars") > LINE_CHARS * F.col("line_chars")
    for n, share in NGRAMS.items():
        much = much | (100 * F.col(f"dup_chars_{n}") > share * F.col("word_chars"))
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & ~much)
