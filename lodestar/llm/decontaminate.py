"""Benchmark decontamination by winnowing.

Test items and documents are fingerprinted alike: of every WINDOW consecutive K-gram hashes the smallest is kept. A span
of SPAN = WINDOW + K - 1 words that both share has all its K-grams in both, so the same smallest one, so a common
fingerprint: no shared span of that length is missed. Fingerprints are joined, and each hit is extended to the SPAN-word
windows around it, which are compared word by word.

A benchmark of up to BROADCAST_BYTES is broadcast: the join is a binary search in the sorted test fingerprints, and
documents are never shuffled. A larger one is joined by shuffle. Of the documents' fingerprints those pass that a Bloom
filter of the test fingerprints, of bounded size, lets through; they are joined with the test side, each with the words
around it, so a hit is extended where it is found. The cost beyond one pass over the documents is in proportion to what
passes. Both ways give the same rows.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.jaccard import Words
from lodestar.llm.media import sliced
from lodestar.llm.shared import looked_up, written

SPAN, K = 10, 5
WINDOW = SPAN - K + 1
#: Bytes of item text in a block. Its tables take some 30 times that in a worker, which keeps KEPT of them.
BLOCK_BYTES, KEPT = 2 << 20, 2
#: A benchmark of more item text than this is joined by shuffle.
BROADCAST_BYTES = BLOCK_BYTES * KEPT
#: Bits of the Bloom filter for each test fingerprint, at most and in a part that one task makes: 64 MB, 128 KB.
BLOOM_EACH, BLOOM_BITS, BLOOM_PART = 16, 1 << 29, 1 << 20
#: Documents with one fingerprint that meet the test side in one task.
LONG = 10_000
#: Text handled at once in a worker.
BATCH_BYTES = 4 << 20
#: A-Z to a-z; every ASCII character but digits and letters to a blank. Bytes of other characters are parts of words.
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_tables: dict[tuple[str, int], Block] = {}


def words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_WORDS).split() if text else []


def grams(codes: np.ndarray, n: int) -> np.ndarray:
    """64-bit hash of the n codes from each position on."""
    count = max(0, len(codes) - n + 1)
    out = np.zeros(count, np.uint64)
    for j in range(n):
        out = (out * np.uint64(0x9E3779B97F4A7C15)) ^ codes[j : j + count]
        out ^= out >> np.uint64(29)
    return out


def winnowed(hashes: np.ndarray, usable: np.ndarray) -> np.ndarray:
    """Marks the smallest hash of each window of WINDOW hashes; ``usable`` says which windows count."""
    kept = np.zeros(len(hashes), bool)
    n = len(hashes) - WINDOW + 1
    if n <= 0:
        return kept
    least = hashes[:n].copy()
    for j in range(1, WINDOW):
        np.minimum(least, hashes[j : j + n], out=least)
    for j in range(WINDOW):
        kept[j : j + n] |= (hashes[j : j + n] == least) & usable
    return kept


class Block:
    """Fingerprints and windows of some test items."""

    def __init__(self, items: list[tuple[str, str]]):
        texts = [words(t) for _, t in items]
        self.ids = [i for i, _ in items]
        self.vocabulary = {w: k for k, w in enumerate(dict.fromkeys(w for t in texts for w in t), 1)}
        # A random 64-bit code for each word; 0 stands for words that no item has.
        self.codes = np.concatenate([[np.uint64(0)], np.random.default_rng(7).integers(1, 2**64, len(self.vocabulary), np.uint64)])
        by: dict[int, dict[tuple[int, ...], set[int]]] = {}
        prints = [np.zeros(0, np.uint64)]
        for k, text in enumerate(texts):
            n = min(SPAN, len(text))
            if not n:
                continue
            numbers = [self.vocabulary[w] for w in text]
            held = by.setdefault(n, {})
            for i in range(len(numbers) - n + 1):
                held.setdefault(tuple(numbers[i : i + n]), set()).add(k)
            if n == SPAN:
                hashes = grams(self.codes[numbers], K)
                prints.append(hashes[winnowed(hashes, np.ones(max(0, len(hashes) - WINDOW + 1), bool))])
        self.prints = np.unique(np.concatenate(prints))
        self.tables = {}
        for n, held in by.items():
            rows = np.array(list(held), np.int64).reshape(-1, n)
            hashes = np.array([grams(self.codes[r], n)[0] for r in rows], np.uint64)
            order = np.argsort(hashes, kind="stable")
            owners = list(held.values())
            self.tables[n] = (hashes[order], rows[order], [owners[i] for i in order])

    def numbers(self, texts: list[list[bytes]]) -> np.ndarray:
        """The words of all texts as vocabulary numbers, a 0 after each text."""
        get = self.vocabulary.get
        return np.array([k for t in texts for k in (*[get(w, 0) for w in t], 0)], np.int64)

    def hits(self, numbers: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(n, positions, rows of the table of n) of every window of an item that occurs."""
        codes = self.codes[numbers]
        unknown = np.concatenate([[0], np.cumsum(numbers == 0)])
        for n, (hashes, rows, _) in self.tables.items():
            count = len(numbers) - n + 1
            if count <= 0:
                continue
            start = unknown[n:] == unknown[:count]  # windows without a foreign word
            if n == SPAN:
                fingerprints = grams(codes, K)
                kept = np.flatnonzero(winnowed(fingerprints, start))
                at = np.searchsorted(self.prints, fingerprints[kept])
                kept = kept[self.prints[np.minimum(at, len(self.prints) - 1)] == fingerprints[kept]] if len(self.prints) else kept[:0]
                near = np.zeros(count, bool)
                for j in range(WINDOW):  # the windows that hold the fingerprint
                    at = kept - j
                    near[at[(at >= 0) & (at < count)]] = True
                start &= near
            places = np.flatnonzero(start)
            found = np.zeros(len(places), np.uint64)
            for j in range(n):
                found = (found * np.uint64(0x9E3779B97F4A7C15)) ^ codes[places + j]
                found ^= found >> np.uint64(29)
            at = np.searchsorted(hashes, found)
            same = hashes[np.minimum(at, len(hashes) - 1)] == found
            places, at = places[same], at[same]
            # Entries with one hash stand side by side; each is compared with the words.
            while len(places):
                equal = np.ones(len(places), bool)
                for j in range(n):
                    equal &= rows[at, j] == numbers[places + j]
                if equal.any():
                    yield n, places[equal], at[equal]
                more = ~equal & (at + 1 < len(hashes))
                more[more] = hashes[at[more] + 1] == hashes[at[more]]
                places, at = places[more], at[more] + 1


def blocks(benchmark: DataFrame) -> Iterator[list[tuple[str, str]]]:
    """The items, as (id, text), in blocks of about BLOCK_BYTES; the driver holds one block at a time."""
    some, size = [], 0
    for item_id, text in benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")), F.col("text").cast("string")).where("text IS NOT NULL").toLocalIterator():
        some.append((item_id, text))
        size += len(text.encode("utf-8", "surrogatepass"))
        if size >= BLOCK_BYTES:
            yield some
            some, size = [], 0
    yield some


def with_overlap(docs: DataFrame, benchmark: DataFrame, *keep: str) -> DataFrame:
    """The columns ``keep`` of every row with n_words, n_hit, n_items, items_sha256. Whole texts."""
    size = benchmark.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    return (by_broadcast if size <= BROADCAST_BYTES else by_shuffle)(docs, benchmark, *keep)


def found_prints(numbers: np.ndarray, lengths: list[int] | None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(n, places, prints) of one text, given the hashes of its words.

    A test item (no ``lengths``) has its winnowed grams, or if it is shorter than SPAN its whole text. A document has its
    winnowed grams and every run of the given lengths.
    """
    if len(numbers) >= SPAN:
        hashes = grams(numbers, K)
        kept = np.flatnonzero(winnowed(hashes, np.ones(len(hashes) - WINDOW + 1, bool)))
        yield SPAN, kept, hashes[kept]
    for n in [len(numbers)] if lengths is None else lengths:
        if 0 < n < SPAN and n <= len(numbers):
            hashes = grams(numbers ^ np.uint64(n), n)
            yield n, np.arange(len(hashes)), hashes


def around(text: list[bytes], at: int, n: int) -> tuple[list[bytes], bytes, list[bytes]]:
    """The words before (nearest first), in and after what a fingerprint stands for; a short item has no others."""
    size, reach = (K, SPAN - K) if n == SPAN else (n, 0)
    return text[max(0, at - reach) : at][::-1], b" ".join(text[at : at + size]), text[at + size : at + size + reach]


_PRINTS = "array<struct<n:int,at:long,print:long,before:array<binary>,gram:binary,after:array<binary>>>"
_PRINTS_ARROW = pa.list_(pa.struct([("n", pa.int32()), ("at", pa.int64()), ("print", pa.int64()), ("before", pa.list_(pa.binary())), ("gram", pa.binary()), ("after", pa.list_(pa.binary()))]))


def fingerprinted(docs: DataFrame, text: str, lengths: list[int] | None, bloom=None) -> DataFrame:
    """``docs`` without ``text``, with n_words, ``mark`` (a digest of the words) and its prints that ``bloom`` lets through.

    Rows without such prints have a null mark. ``bloom`` is a broadcast array of bits.
    """
    kept = [c for c in docs.columns if c != text]
    plain = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.select(*kept).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words()
        bits = None if bloom is None else bloom.value
        for whole in batches:
            for batch in sliced(whole, text, BATCH_BYTES):
                sizes, marks, prints = [], [], []
                for value in batch.column(text).to_pylist():
                    ws = words(value)
                    numbers = np.fromiter((known[w] for w in ws), np.uint64, len(ws))
                    found = []
                    for n, places, hashes in found_prints(numbers, lengths):
                        if bits is not None:
                            some = passes(bits, hashes)
                            places, hashes = places[some], hashes[some]
                        for at, h in zip(places.tolist(), hashes.view(np.int64).tolist(), strict=True):
                            before, gram, after = around(ws, at, n)
                            found.append({"n": n, "at": at, "print": h, "before": before, "gram": gram, "after": after})
                    sizes.append(len(ws))
                    marks.append(hashlib.sha256(b" ".join(ws)).digest() if found else None)
                    prints.append(found or None)
                columns = [pa.array(sizes, pa.int64()), pa.array(marks, pa.binary()), pa.array(prints, _PRINTS_ARROW)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *columns], [*kept, "n_words", "mark", "prints"])

    return docs.select(*kept, text).mapInArrow(run, f"{plain}n_words long, mark binary, prints {_PRINTS}")


def passes(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    mask = np.uint64(8 * len(bits) - 1)
    out = np.ones(len(hashes), bool)
    for at in (hashes & mask, (hashes >> np.uint64(29)) & mask):
        out &= (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
    return out


def bloom_filter(prints: DataFrame) -> np.ndarray:
    """A Bloom filter of the column ``print``, as bytes; its parts are made in tasks."""
    n = prints.count()
    size = BLOOM_PART
    while size < min(BLOOM_BITS, BLOOM_EACH * n):
        size *= 2
    bit = lambda shift: F.shiftrightunsigned("print", shift).bitwiseAND(F.lit(size - 1))
    parted = prints.select(F.explode(F.array(bit(0), bit(29))).alias("bit")).distinct().select((F.col("bit") / BLOOM_PART).cast("int").alias("part"), (F.col("bit") % BLOOM_PART).cast("int").alias("bit"))

    def part(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        bits = np.zeros(BLOOM_PART, np.uint8)
        bits[rows["bit"].to_numpy()] = 1
        return pd.DataFrame({"part": [int(key[0])], "bits": [np.packbits(bits, bitorder="little").tobytes()]})

    out = np.zeros(size // 8, np.uint8)
    for r in parted.groupBy("part").applyInPandas(part, "part int, bits binary").toLocalIterator():  # size / 8 bytes in all
        out[r.part * (BLOOM_PART // 8) : (r.part + 1) * (BLOOM_PART // 8)] = np.frombuffer(r.bits, np.uint8)
    return out


def by_shuffle(docs: DataFrame, benchmark: DataFrame, *keep: str) -> DataFrame:
    """The join by shuffle. Texts with the same words are one until the end, where each row looks its own up."""
    sc = docs.sparkSession.sparkContext
    text, own = "text", [f"kept{i}" for i in range(len(keep))]
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.col("text").cast("string").alias(text)).where(F.col(text).isNotNull())
    tests = written(fingerprinted(items, text, None).select("item", F.explode("prints").alias("p")).select("item", "p.*").distinct(), "tests")
    # At most SPAN - 1 lengths.
    lengths = [r.n for r in tests.where(F.col("n") < SPAN).select("n").distinct().collect()]
    bloom = sc.broadcast(bloom_filter(tests.select("print")))
    plain = docs.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(keep, own, strict=True)], F.col("text").cast("string").alias(text))
    marked = written(fingerprinted(plain, text, lengths, bloom), "marked")
    texts = marked.where("mark IS NOT NULL").groupBy("mark").agg(F.first("prints").alias("prints"))
    seen = written(texts.select("mark", F.explode("prints").alias("p")).select("mark", "p.*"), "prints")
    # A frequent fingerprint's documents are dealt over parts, each of which has the test side's rows.
    parts = seen.groupBy("print").agg(F.ceil(F.count(F.lit(1)) / LONG).cast("int").alias("parts"))
    left = looked_up(seen, parts, "print", "mark", "at").withColumn("part", F.pmod(F.xxhash64("mark", "at"), F.col("parts")).cast("int"))
    right = tests.join(parts, "print").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    right = right.select("print", "part", "item", *[F.col(c).alias(f"{c}_i") for c in ("n", "before", "gram", "after")])
    alike = lambda c: f"size(filter(sequence(1, {SPAN - K}), i -> size({c}) >= i AND size({c}_i) >= i AND slice({c}, 1, i) = slice({c}_i, 1, i)))"
    pairs = left.join(right, ["print", "part"]).where("n = n_i AND gram = gram_i").withColumn("back", F.expr(alike("before"))).withColumn("on", F.expr(alike("after")))
    hits = pairs.where(f"n < {SPAN} OR back + on >= {SPAN - K}").select("mark", "item", F.struct((F.col("at") - F.col("back")).alias("a"), F.expr(f"at + on + IF(n < {SPAN}, n, {K})").alias("b")).alias("span"))
    # Spans in order of their beginning: what reaches beyond the furthest end so far is new.
    counted = F.aggregate(
        F.array_sort("spans"),
        F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n")),
        lambda acc, s: F.struct(F.greatest(acc["end"], s["b"]).alias("end"), (acc["n"] + F.greatest(F.lit(0).cast("long"), s["b"] - F.greatest(acc["end"], s["a"]))).alias("n")),
        lambda acc: acc["n"],
    )
    summed = hits.groupBy("mark").agg(F.collect_set("span").alias("spans"), F.array_sort(F.collect_set("item")).alias("items"))
    overlap = written(summed.select("mark", counted.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256")), "overlap")
    # The rest of a row tells rows of one text apart.
    out = looked_up(marked.drop("prints"), overlap, "mark", *own, nulls=True)
    none = hashlib.sha256(b"").hexdigest()
    return out.select(*[F.col(k).alias(c) for c, k in zip(keep, own, strict=True)], "n_words", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_hit", "n_items")], F.coalesce("items_sha256", F.lit(none)).alias("items_sha256"))


def by_broadcast(docs: DataFrame, benchmark: DataFrame, *keep: str) -> DataFrame:
    """The join by broadcast of at most BROADCAST_BYTES of items. Narrow."""
    sc = docs.sparkSession.sparkContext
    shared = [sc.broadcast(b) for b in blocks(benchmark)]
    run_id = uuid.uuid4().hex  # workers outlive a query
    plain = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.select(*keep).schema)
    text = "_text" if "_text" not in keep else "__text"

    def table(k: int) -> Block:
        key = run_id, k
        if key not in _tables:
            if len(_tables) >= KEPT:
                _tables.clear()
            _tables[key] = Block(shared[k].value)
        return _tables[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in sliced(whole, text, BATCH_BYTES):
                texts = [words(t) for t in batch.column(text).to_pylist()]
                lengths = np.array([len(t) for t in texts], np.int64)
                first = np.concatenate([[0], np.cumsum(lengths + 1)])
                marks = np.zeros(first[-1] + 1, np.int64)
                items: list[set[str]] = [set() for _ in texts]
                for k in range(len(shared)):
                    block = table(k)
                    for n, places, at in block.hits(block.numbers(texts)):
                        np.add.at(marks, places, 1)
                        np.add.at(marks, places + n, -1)
                        owners = block.tables[n][2]
                        doc = np.searchsorted(first, places, side="right") - 1
                        for d, row in np.unique(np.stack([doc, at]), axis=1).T.tolist():
                            items[d].update(block.ids[i] for i in owners[row])
                covered = np.concatenate([[0], np.cumsum(np.cumsum(marks)[:-1] > 0)])
                hit = covered[first[1:]] - covered[first[:-1]]
                columns = [pa.array(lengths), pa.array(hit.astype(np.int64)), pa.array([len(i) for i in items], pa.int64()), pa.array([hashlib.sha256(",".join(sorted(i)).encode()).hexdigest() for i in items], pa.string())]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *columns], [*keep, "n_words", "n_hit", "n_items", "items_sha256"])

    return docs.select(*keep, F.col("text").cast("string").alias(text)).mapInArrow(run, f"{plain}n_words long, n_hit long, n_items long, items_sha256 string")


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every document.

    Null and empty texts have no words. Items without words are in no document; a null item_id counts as the empty id,
    and rows that repeat an item_id are one item. An empty benchmark hits nothing. Other columns are ignored.
    """
    return with_overlap(docs.select("doc_id", "text"), benchmark, "doc_id").withColumn("contaminated", F.col("n_hit") > 0)
