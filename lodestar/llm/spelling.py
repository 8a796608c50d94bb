"""Spelling variants: words one edit apart, found in an inverted index of positional q-grams, and the form each stands for.

Two words that differ by one inserted, deleted or replaced code point share most of their positional bigrams: of the
longer one's, an edit spoils two at most, and the others stand in the same place or one further. So each word is looked
up in an index from bigram and place to the words that have it; the postings of its bigrams, under limits of length and
place, are merged in order, and words met often enough are compared code point by code point.

The index is dealt out by what two near words must have in common: cut the longer one anywhere, and the edit lies on one
side, so the other side's letters are equal. A part of the index holds the words of length m or m - 1 with equal first,
or equal last, letters. A part with more than MOST words is cut again in what its letters leave open, as often as it
takes; a part whose letters leave nothing more to cut has a few words for each letter of the alphabet.
"""

from __future__ import annotations

import heapq
from collections import Counter, defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.shared import looked_up, written

RUN = "[A-Za-zÀ-ÿ]"
LEAST_LENGTH, LEAST_COUNT, FACTOR, DAMAGE = 6, 5, 5, 199
#: Words of a part of the index that one task holds at once; larger parts are cut.
MOST = 2000
Q = 2

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PART = "part string, word string, m int, head int, tail int"
PAIR = "word string, other string"


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, n): words of at least LEAST_LENGTH code points that occur LEAST_COUNT times or more in all texts.

    One run in DAMAGE, chosen by a hash of document and run, loses a code point. A null text has no runs; a null doc_id
    hashes as the empty text. Runs shorter than LEAST_LENGTH never count, so only longer ones are looked for.
    """
    lowered = F.translate(F.col("text"), UPPER, LOWER)
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), F.explode(F.regexp_extract_all(lowered, F.lit(f"({RUN}{{{LEAST_LENGTH},}})"), F.lit(1))).alias("run"))
    h = F.crc32(F.concat("doc_id", F.lit(":"), "run").cast("binary"))
    hashed = runs.withColumn("h", h)
    gone = F.pmod(F.col("h"), F.length("run")).cast("int")
    word = F.when(F.col("h") % DAMAGE == 0, F.concat(F.substring(F.col("run"), F.lit(1), gone), F.substring(F.col("run"), gone + 2, F.length("run")))).otherwise(F.col("run"))
    words = hashed.select(word.alias("word")).where(F.length("word") >= LEAST_LENGTH)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_COUNT)


def parts(rows: DataFrame) -> DataFrame:
    """Each row (word, m, head, tail) twice: by the first and by the last half of what lies between ``head`` and ``tail``.

    ``m`` is the length of the longer word of a pair. If its open middle has k letters, then either the first ceil(k / 2)
    of these are equal or the last floor(k / 2) are. The shorter word has a letter less, but as many at either end.
    """
    k = F.col("m") - F.col("head") - F.col("tail")
    first, last = F.col("head") + F.ceil(k / 2).cast("int"), F.col("tail") + F.floor(k / 2).cast("int")
    sides = F.explode(F.array(F.struct(first.alias("head"), F.col("tail").alias("tail")), F.struct(F.col("head").alias("head"), last.alias("tail")))).alias("side")
    cut = rows.where(k > 1).select("word", "m", sides).select("word", "m", "side.head", "side.tail").distinct()
    key = F.concat_ws(":", "m", "head", "tail", F.substring(F.col("word"), F.lit(1), F.col("head")), F.substring(F.col("word"), F.length("word") - F.col("tail") + 1, F.col("tail")))
    return cut.select(key.alias("part"), "word", "m", "head", "tail")


def one_edit(a: str, b: str) -> bool:
    """Whether exactly one code point is inserted, deleted or replaced between ``a`` and ``b``."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    short, long = sorted((a, b), key=len)
    p = next((i for i, (x, y) in enumerate(zip(short, long, strict=False)) if x != y), len(short))
    return short[p + (len(a) == len(b)) :] == long[p + 1 :]


class Index:
    """Positional bigrams of some words: (bigram, place) to the ascending numbers of the words that have it there."""

    def __init__(self, words: list[str]):
        self.words = sorted(words, key=len)  # numbers ascend with length, so a limit of length is a range of numbers
        self.postings: dict[tuple[str, int], list[int]] = defaultdict(list)
        for i, word in enumerate(self.words):
            for place in range(len(word) - Q + 1):
                self.postings[word[place : place + Q], place].append(i)

    def near(self, i: int) -> Iterator[str]:
        """Words with a smaller number than ``i`` and one edit apart: merge, count, compare."""
        word = self.words[i]
        lists = []
        for place in range(len(word) - Q + 1):
            for at in (place - 1, place):  # the other word is as long or one shorter, so a bigram stays or moves back
                found = self.postings.get((word[place : place + Q], at))
                if found:
                    lists.append(found)
        # Of the longer word's bigrams an edit spoils Q at most.
        bound = len(word) - Q + 1 - Q
        last, count = -1, 0
        for j in heapq.merge(*lists):
            if j >= i:
                break
            if j != last:
                last, count = j, 0
            count += 1
            if count == bound and one_edit(word, self.words[j]):
                yield self.words[j]


def matched(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Near pairs of each part of the index; rows come sorted by part, and a part has a bounded number of words."""
    part, words, shape = None, [], None
    for batch in batches:
        pairs: list[tuple[str, str]] = []
        for name, word, m, head, tail in batch.itertuples(index=False):
            if name != part:
                pairs.extend(_pairs(words, shape))
                part, words, shape = name, [], (m, head, tail)
            words.append(word)
        yield pd.DataFrame(pairs, columns=["word", "other"])
    yield pd.DataFrame(list(_pairs(words, shape)), columns=["word", "other"])


def _pairs(words: list[str], shape: tuple[int, int, int] | None) -> Iterator[tuple[str, str]]:
    if len(words) < 2:
        return
    index = Index(words)
    for i, word in enumerate(index.words):
        if len(word) == shape[0]:  # the longer word of a pair has the part's length
            for other in index.near(i):
                yield word, other


def near_pairs(words: DataFrame, most: int = MOST) -> DataFrame:
    """(word, other), both ways, for all of ``words`` (distinct, not null, of more than four code points) one edit apart."""
    length = F.length("word")
    rows = words.select("word", F.explode(F.array(length, length + 1)).alias("m"), F.lit(0).alias("head"), F.lit(0).alias("tail"))
    found = None
    while True:
        dealt = written(parts(rows), "parts")
        sizes = dealt.groupBy("part").agg(F.count(F.lit(1)).alias("k"), F.max(F.when(F.length("word") == F.col("m"), 1)).alias("longer")).where((F.col("k") > 1) & F.col("longer").isNotNull())
        sized = written(looked_up(dealt, sizes.select("part", "k"), "part", "word").where(F.col("k") > 1), "parts")
        open_ = F.col("m") - F.col("head") - F.col("tail") > 1
        small = sized.where((F.col("k") <= most) | ~open_).select("part", "word", "m", "head", "tail")
        pairs = small.repartition("part").sortWithinPartitions("part").mapInPandas(matched, PAIR)
        found = pairs if found is None else found.unionByName(pairs)
        rows = sized.where((F.col("k") > most) & open_).select("word", "m", "head", "tail")
        if rows.isEmpty():
            break
    found = written(found, "near")
    return found.unionByName(found.select(F.col("other").alias("word"), F.col("word").alias("other"))).distinct()


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): from each word along ``form`` to the last. Forms grow in count, so paths end; a step doubles the way."""
    now = written(forms.select("word", F.coalesce("form", "word").alias("root")), "roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        # Only words that are still on the way are joined; a word is the form of no more words than its length allows near it.
        step = now.join(ahead, "root").select("word", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved"))
        now = written(step, "roots")
        if now.where("moved").isEmpty():
            return now.select("word", "root")
        now = now.select("word", "root")


def variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n for each word of the vocabulary. Texts without words give no rows.

    ``form`` is the near word with the largest ``n`` (of equals the first in code-point order), if it is FACTOR times the word's.
    """
    words = written(vocabulary(docs), "words")
    pairs = near_pairs(words)
    counts = words.select(F.col("word").alias("other"), F.col("n").alias("other_n"))
    best = pairs.join(counts, "other").groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other"))).alias("best"))
    known = words.join(best, "word", "left")
    form = F.when(-F.col("best.less") >= FACTOR * F.col("n"), F.col("best.other"))
    known = written(known.select("word", form.alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(form.isNotNull(), -F.col("best.less")).alias("form_n")), "forms")
    return known.join(roots(known), "word").select("word", "form", "root", "n", "n_near", "form_n")
