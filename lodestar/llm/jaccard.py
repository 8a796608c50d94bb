"""N-gram Jaccard join by vertical partitioning.

A document is the set of its 5-word shingles. The global order of shingles is cut into fragments, twice.

First by hash range: tasks send what they hold of each range, and a range's task finds the shingles that several
documents have, with their document frequency. A document links to nothing unless three quarters of its shingles are
shared, so most documents end here; the others get their shared shingles back, ordered rare first.

Then by that order (frequency class, then hash): documents that share a shingle of their prefixes are candidates. Their
overlap is counted fragment by fragment, as separate rows, and summed per pair; a sum that reaches the threshold is a
link. No linked pair is missed: the prefix is what a pair of Jaccard similarity 0.75 must share.

Only components are asked for, so pairs inside a component need no check. A first round links each document with one
head of its candidates. Of the candidate pairs whose components differ then, those whose signatures (bit sets of shared
shingles) leave no room for enough overlap are no links; a second round checks the likeliest of each document and
component, the third all that are left. Equal sets are one class
from the start: in each task before anything is sent, and over all rows by digest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm.components import components
from lodestar.llm.media import sliced
from lodestar.llm.shared import looked_up, written

SHINGLE = 5
#: A pair links when 7 * overlap >= 3 * (size + size), which is a similarity of 0.75.
#: Shingles that a task gathers before it sends them, documents likewise, and shingles in a range. A gathering sends each
#: range one blob, so the more both hold, the fewer blobs there are; their size is bounded by a worker's memory.
GATHER, GATHER_DOCS, RANGE = 1_600_000, 60_000, 2_000_000
#: Blobs shrink as the data grow, since more ranges share a gathering. Where fewer shingles than this would be in one, each
#: is a row of its own, whose cost does not depend on the size of the data.
LEAST_BLOB = 16
#: Candidates are compared within a shingle; lists longer than this are cut in parts that meet in tasks of their own.
LONG = 2000
#: Hashes have 48 bits, so that a shingle and its document's place in the gathering fit one number.
HASH_BITS, MANY = 48, 0xFFFF
#: Fragments of the global order: two by frequency, each cut in four by hash.
FRAGMENTS = 8
BATCH_BYTES = 2 << 20
SENT = "target long, gathering long, blob binary"
#: A shingle's own row: hash and document's place in one number, and how many documents of the gathering have it; and its
#: answer, with the number of documents that have it anywhere.
SENT_ROW, ANSWER_ROW, ROWS_AT_ONCE = np.dtype([("pair", "<u8"), ("count", "<u4")]), np.dtype([("pair", "<u8"), ("frequency", "<u8")]), 100_000
#: Bits of a set's signature, in words of 64. Bit k is set if a shared shingle's hash ends in k.
SIGNATURE = 512
ROWS = "doc_id long, text_hash long, n_shingles long, class binary, shared long, signature array<long>, fragments array<array<long>>"
_GOLD, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


class Words(dict):
    """64-bit hashes of words; forgets all when it has become large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    return (x ^ (x >> np.uint64(29))) * _GOLD


def words(text: str | None) -> list[bytes]:
    """Runs of characters other than ASCII white space, A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def shingles(texts: list[str | None], known: Words) -> tuple[np.ndarray, np.ndarray]:
    """(document's place, 48-bit hash) of every shingle of every text. Fewer words than SHINGLE make one shingle."""
    lists = [words(t) for t in texts]
    sizes = np.array([len(w) for w in lists], np.int64)
    total = int(sizes.sum())
    codes = np.fromiter((known[w] for ws in lists for w in ws), np.uint64, total)
    place = np.repeat(np.arange(len(lists)), sizes)
    n = max(0, total - SHINGLE + 1)
    hashes = np.full(n, SHINGLE, np.uint64)
    for j in range(SHINGLE):
        hashes = mixed(hashes + codes[j : j + n])
    whole = place[:n] == place[SHINGLE - 1 :] if n else np.zeros(0, bool)
    places, hashes = place[:n][whole], hashes[whole]
    short = np.flatnonzero((sizes > 0) & (sizes < SHINGLE))
    if len(short):
        first = np.cumsum(sizes) - sizes
        ends = []
        for d in short:
            h = np.array([sizes[d]], np.uint64)
            for j in range(sizes[d]):
                h = mixed(h + codes[first[d] + j])
            ends.append(h)
        places, hashes = np.concatenate([places, short]), np.concatenate([hashes, *ends])
    return places, hashes >> np.uint64(64 - HASH_BITS)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed blob, each split in byte planes."""
    parts = [np.array([len(arrays)], "<i8").tobytes()]
    for a in arrays:
        width = a.dtype.itemsize
        parts += [np.array([len(a), width], "<i8").tobytes(), a.view(np.uint8).reshape(-1, width).T.tobytes()]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def unpack(blob: bytes) -> list[np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(blob)
    at, out = 8, []
    for _ in range(int(np.frombuffer(data, "<i8", 1)[0])):
        n, width = (int(x) for x in np.frombuffer(data, "<i8", 2, at))
        at += 16
        out.append(np.ascontiguousarray(np.frombuffer(data, np.uint8, n * width, at).reshape(width, n).T).reshape(-1).view(f"<u{width}"))
        at += n * width
    return out


def sent(targets: np.ndarray | list[int], name: int, blobs: pa.Array | list[bytes]) -> pa.RecordBatch:
    blobs = blobs if isinstance(blobs, pa.Array) else pa.array(blobs, pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(targets, pa.int64()), pa.array(np.full(len(targets), name, np.int64)), blobs], ["target", "gathering", "blob"])


def as_binary(rows: np.ndarray) -> pa.Array:
    """Records of one width as binary values."""
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * np.int32(rows.dtype.itemsize)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(rows.tobytes())])


def gathered(name: int, ids: list[int | None], texts: list[int], pairs: np.ndarray, ranges: int, plain: bool = False) -> Iterator[pa.RecordBatch]:
    """What a gathering sends: a header to a target of its own, and to each hash range what lies in it.

    texts: hashes of the texts. pairs: hash and document's place in one number, of all its documents. plain: a row for
    each shingle instead of a blob for each range.
    """
    pairs.sort()
    pairs = pairs[np.concatenate([[True], pairs[1:] != pairs[:-1]])] if len(pairs) else pairs
    place, key = (pairs & np.uint64(0xFFFF)).astype(np.int64), pairs >> np.uint64(16)
    n = np.bincount(place, minlength=len(ids))
    sums = np.zeros((2, len(ids)), np.uint64)
    np.add.at(sums[0], place, mixed(key + np.uint64(1)))
    np.add.at(sums[1], place, mixed(key ^ _GOLD))
    # Of equal sets one document stays; those without doc_id take no part.
    named = np.array([i is not None for i in ids], bool)
    seen: set[tuple[int, int, int]] = set()
    stays = np.zeros(len(ids), bool)
    for d in np.flatnonzero(named & (n > 0)):
        identity = (int(sums[0, d]), int(sums[1, d]), int(n[d]))
        stays[d] = identity not in seen
        seen.add(identity)
    some = stays[place]
    place, key = place[some], key[some]
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    counts = np.diff(np.concatenate([starts, [len(key)]])) if len(key) else np.zeros(0, np.int64)
    several = np.repeat(counts > 1, counts)
    shared_here = (key[several] << np.uint64(16)) | place[several].astype(np.uint64)
    holder = np.where(counts > 1, MANY, place[starts]).astype("<u2")
    unique = key[starts]
    header = pack(np.array([i or 0 for i in ids], "<i8"), np.array(texts, "<i8"), named.view(np.uint8), n.astype("<u4"), sums[0], sums[1], stays.view(np.uint8), shared_here)
    yield sent([-1 - name], name, [header])
    target = (unique * np.uint64(1 << 15)) // np.uint64(max(1, -(-(1 << 63) // ranges)))
    if plain:
        for at in range(0, len(unique), ROWS_AT_ONCE):
            some = slice(at, at + ROWS_AT_ONCE)
            rows = np.empty(len(unique[some]), SENT_ROW)
            rows["pair"], rows["count"] = (unique[some] << np.uint64(16)) | holder[some], counts[some]
            yield sent(target[some].astype(np.int64), name, as_binary(rows))
        return
    cuts = np.searchsorted(target, np.arange(ranges + 1, dtype=np.uint64)) if len(unique) else []
    for r in range(ranges if len(unique) else 0):
        a, b = int(cuts[r]), int(cuts[r + 1])
        if a < b:
            steps = np.diff(unique[a:b], prepend=np.uint64(0))
            steps = steps if steps[1:].max(initial=0) >= 1 << 32 or b - a < 2 else np.concatenate([[steps[0] >> np.uint64(32), steps[0] & np.uint64(0xFFFFFFFF)], steps[1:]]).astype("<u4")
            yield sent([r], name, [pack(steps, holder[a:b], counts[a:b][holder[a:b] == MANY].astype("<u4"))])


def send(docs: DataFrame, ranges: int, plain: bool = False) -> DataFrame:
    """Cuts each partition in gatherings, named by partition and number, so that a task that runs again names alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, ids, texts, held, size = Words(), [], [], [], 0
        name = TaskContext.get().partitionId() << 32

        def out() -> Iterator[pa.RecordBatch]:
            yield from gathered(name, ids, texts, np.concatenate(held) if held else np.zeros(0, np.uint64), ranges, plain)

        for whole in batches:
            for batch in (part.slice(at, GATHER_DOCS) for part in sliced(whole, "text", BATCH_BYTES) for at in range(0, part.num_rows, GATHER_DOCS)):
                # Blank texts have no shingles but take places, of which 16 bits are there.
                if ids and (size >= GATHER or len(ids) + batch.num_rows > GATHER_DOCS):
                    yield from out()
                    ids, texts, held, size, name = [], [], [], 0, name + 1
                place, hashes = shingles(batch.column("text").to_pylist(), known)
                held.append((hashes << np.uint64(16)) | (place + len(ids)).astype(np.uint64))
                size += len(hashes)
                ids += batch.column("doc_id").to_pylist()
                texts += batch.column("hash").to_pylist()
        if ids:
            yield from out()

    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long"), text.alias("text"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("hash")).mapInArrow(run, SENT)


def frequencies(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each key the sum of the counts of all that equal it."""
    order = np.argsort(keys, kind="stable")
    starts = np.flatnonzero(np.concatenate([[True], keys[order][1:] != keys[order][:-1]]))
    out = np.empty(len(keys), np.int64)
    out[order] = np.repeat(np.add.reduceat(counts[order], starts), np.diff(np.concatenate([starts, [len(keys)]])))
    return out


def find_shared(key: tuple, rows: pd.DataFrame, plain: bool = False) -> pd.DataFrame:
    """Of one range: which shingles several documents have, answered to each gathering that sent them."""
    if key[0] < 0:
        return rows[["gathering", "blob"]].assign(header=True)
    if plain:
        given = np.frombuffer(b"".join(rows["blob"]), SENT_ROW)
        frequency = frequencies(given["pair"] >> np.uint64(16), given["count"].astype(np.int64))
        some = frequency > 1
        answers = np.empty(int(some.sum()), ANSWER_ROW)
        answers["pair"], answers["frequency"] = given["pair"][some], frequency[some]
        return pd.DataFrame({"gathering": rows["gathering"].to_numpy()[some], "blob": as_binary(answers).to_pylist(), "header": False})
    keys, holders, counts, lengths = [], [], [], []
    for blob in rows["blob"]:
        steps, holder, many = unpack(blob)
        if steps.dtype.itemsize == 4:
            steps = np.concatenate([[(np.uint64(steps[0]) << np.uint64(32)) | np.uint64(steps[1])], steps[2:].astype(np.uint64)])
        count = np.ones(len(holder), np.int64)
        count[holder == MANY] = many
        keys.append(np.cumsum(steps, dtype=np.uint64))
        holders.append(holder)
        counts.append(count)
        lengths.append(len(holder))
    frequency = frequencies(np.concatenate(keys), np.concatenate(counts))
    out, at = [], 0
    for name, k, holder, n in zip(rows["gathering"], keys, holders, lengths, strict=True):
        some = frequency[at : at + n] > 1
        if some.any():
            out.append((name, pack(k[some], frequency[at : at + n][some].astype("<u8"), holder[some]), False))
        at += n
    return pd.DataFrame(out, columns=["gathering", "blob", "header"])


def collect_shared(key: tuple, rows: pd.DataFrame, plain: bool = False) -> pd.DataFrame:
    """Of one gathering: a row per document; those that can link have their shared shingles, in the global order."""
    ids, texts, named, n, s0, s1, stays, here = unpack(rows["blob"][rows["header"]].iloc[0])
    blobs = rows["blob"][~rows["header"]]
    if plain:
        given = np.frombuffer(b"".join(blobs), ANSWER_ROW)
        keys, frequency, holder = given["pair"] >> np.uint64(16), given["frequency"], given["pair"] & np.uint64(0xFFFF)
    else:
        answers = [unpack(b) for b in blobs]
        keys, frequency, holder = (np.concatenate([a[i] for a in answers]) if answers else np.zeros(0, np.uint64) for i in range(3))
    order = np.argsort(keys, kind="stable")
    keys, frequency, holder = keys[order], frequency[order], holder[order].astype(np.int64)
    hashes, places = here >> np.uint64(16), (here & np.uint64(0xFFFF)).astype(np.int64)
    alone = holder != MANY
    frequency_here = frequency[np.searchsorted(keys, hashes)] if len(hashes) else np.zeros(0, np.uint64)
    place = np.concatenate([holder[alone], places])
    level = np.concatenate([frequency[alone], frequency_here]).astype(np.float64)
    # The class of a frequency is its number of binary digits; the order is by class, then by hash.
    ordered = (np.log2(np.maximum(level, 1)).astype(np.uint64) << np.uint64(HASH_BITS)) | np.concatenate([keys[alone], hashes])
    by = np.lexsort((ordered, place))
    place, ordered = place[by], ordered[by]
    shared = np.bincount(place, minlength=len(ids))
    ends = np.cumsum(shared)
    fragments: list[list[np.ndarray] | None] = [None] * len(ids)
    signatures: list[np.ndarray | None] = [None] * len(ids)
    for d in np.flatnonzero((stays > 0) & (4 * shared >= 3 * n.astype(np.int64)) & (n > 0)):
        mine = ordered[ends[d] - shared[d] : ends[d]]
        part = np.where(mine >> np.uint64(HASH_BITS) >= 4, 4, 0) + (mine >> np.uint64(HASH_BITS - 2) & np.uint64(3)).astype(np.int64)
        bits = np.zeros(SIGNATURE, np.uint8)
        bits[(mine & np.uint64(SIGNATURE - 1)).astype(np.int64)] = 1
        signatures[d] = np.packbits(bits).view("<i8")
        fragments[d] = [mine[part == f].astype(np.int64) for f in range(FRAGMENTS)]
    classes = [int(a).to_bytes(8, "big") + int(b).to_bytes(8, "big") + int(c).to_bytes(4, "big") if k and c else None for a, b, c, k in zip(s0, s1, n, named, strict=True)]
    return pd.DataFrame({"doc_id": pd.array(np.where(named > 0, ids.view(np.int64), 0), "Int64").copy(), "text_hash": texts.view(np.int64), "n_shingles": n.astype(np.int64), "class": classes, "shared": shared, "signature": signatures, "fragments": fragments}).assign(doc_id=lambda x: x["doc_id"].mask(named == 0))


def overlap(pairs: DataFrame, segments: DataFrame, sizes: DataFrame) -> DataFrame:
    """The linked ones of ``pairs`` (a, b): partial overlaps are counted in each fragment and summed per pair."""
    left = segments.select(F.col("class").alias("a"), "fragment", F.col("segment").alias("of_a"))
    right = segments.select(F.col("class").alias("b"), "fragment", F.col("segment").alias("of_b"))
    partial = pairs.join(right, "b").join(left, ["a", "fragment"]).select("a", "b", F.size(F.array_intersect("of_a", "of_b")).alias("partial"))
    summed = partial.groupBy("a", "b").agg(F.sum("partial").alias("overlap"))
    n = sizes.select("class", "n_shingles")
    both = summed.join(n.toDF("a", "n_a"), "a").join(n.toDF("b", "n_b"), "b")
    return both.where("7 * overlap >= 3 * (n_a + n_b)").select("a", "b", "overlap")


def with_components(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id of every row of ``docs`` (doc_id, text).

    Null, empty and blank texts have no shingles and are their own component. A row without doc_id takes no part in
    links; its component_id is null. Rows that repeat a doc_id are rows of their own with possibly different components;
    ``text_hash`` (64 bits of the text, null as empty) tells them apart. An empty table gives no rows; other columns are
    ignored. Gatherings are cut by the rows of a partition in their order, so ``docs`` has to be a table that is read,
    not the result of a shuffle, whose order may differ when a lost task runs again.
    """
    spark = docs.sparkSession
    # Words have some 6 bytes; the number of ranges only has to be in proportion.
    size = docs.select(F.sum(F.octet_length(F.col("text").cast("string"))).alias("n")).first()["n"] or 0
    ranges = max(1, -(-size // (6 * RANGE)))
    plain = GATHER < LEAST_BLOB * ranges
    answered = send(docs, ranges, plain).groupBy("target").applyInPandas(lambda key, rows: find_shared(key, rows, plain), "gathering long, blob binary, header boolean")
    rows = written(answered.groupBy("gathering").applyInPandas(lambda key, rows: collect_shared(key, rows, plain), ROWS), "shingles")
    narrow = rows.select("doc_id", "text_hash", "n_shingles", "class")
    heads = narrow.where("class IS NOT NULL").groupBy("class").agg(F.min("doc_id").alias("head"))
    # A class may come from several gatherings; all have the same shingles.
    sets = written(rows.where("fragments IS NOT NULL").groupBy("class").agg(F.first("n_shingles").alias("n_shingles"), F.first("shared").alias("shared"), F.first("signature").alias("signature"), F.first("fragments").alias("fragments")), "sets")
    segments = sets.select("class", F.posexplode("fragments").alias("fragment", "segment")).where(F.size("segment") > 0)
    links = link(sets, segments)
    if links.isEmpty():
        named = heads.select("class", F.col("head").alias("component_id"))
    else:
        labels = components(links)
        least = labels.join(heads, labels["node"] == heads["class"]).groupBy("label").agg(F.min("head").alias("component_id"))
        linked = looked_up(labels, least, "label", "node").select(F.col("node").alias("class"), "component_id")
        named = heads.join(linked, "class", "left").select("class", F.coalesce("component_id", "head").alias("component_id"))
    out = looked_up(narrow, named, "class", "doc_id", "text_hash", nulls=True)
    return out.select("doc_id", "text_hash", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def link(sets: DataFrame, segments: DataFrame) -> DataFrame:
    """Links (a, b) between classes whose components are those of all links."""
    # Unshared shingles come first in the order, so they fill the prefix first.
    unshared = F.col("n_shingles") - F.col("shared")
    prefix = F.expr("n_shingles - (3 * n_shingles + 3) div 4 + 1") - unshared
    ordered = F.array_sort(F.flatten("fragments"))
    postings = written(
        sets.where(prefix > 0)
        .select("class", "n_shingles", unshared.alias("unshared"), F.posexplode(F.slice(ordered, 1, prefix.cast("int"))).alias("at", "shingle"))
        .select("class", "n_shingles", "unshared", (F.col("unshared") + F.col("at")).alias("at"), "shingle"),
        "postings",
    )
    # The head of a shingle is the document with the fewest shingles of its own: most copies link with it.
    rank = F.struct("unshared", "class", "n_shingles")
    several = postings.groupBy("shingle").agg(F.min(rank).alias("head"), F.min("class").alias("low"), F.max("class").alias("high")).where("low <> high").select("shingle", "head")
    posted = postings.count()
    votes = looked_up(postings, several, "shingle", "class", total=posted).where("class <> head.class").where(close(F.col("head.n_shingles"), F.col("n_shingles")))
    tallied = votes.groupBy("class", F.col("head.class").alias("a")).agg(F.count(F.lit(1)).alias("votes"), F.min("head.unshared").alias("own"))
    # A largest tally is found with partial aggregation, so a frequent class is no hot key.
    first = tallied.groupBy("class").agg(F.max_by("a", F.struct("votes", -F.col("own"), "a")).alias("a")).select("a", F.col("class").alias("b"))
    star = written(overlap(first, segments, sets).select("a", "b"), "star")
    pairs = written(open_pairs(postings, sets, components(star), posted), "pairs")
    # Of a document's candidates in another component the likeliest first: the others mostly join with it.
    likely = pairs.groupBy("a", "label_b").agg(F.max_by("b", F.struct("most", "b")).alias("b")).select("a", "b")
    star = star.unionByName(written(overlap(likely, segments, sets).select("a", "b"), "star"))
    labels = components(star)
    side = lambda c: labels.select(F.col("node").alias(c), F.col("label").alias(f"now_{c}"))
    rest = pairs.select("a", "b").join(side("a"), "a", "left").join(side("b"), "b", "left").where(F.coalesce("now_a", "a") != F.coalesce("now_b", "b")).select("a", "b")
    rest = written(rest.join(likely, ["a", "b"], "left_anti"), "rest")
    return star.unionByName(overlap(rest, segments, sets).select("a", "b"))


def open_pairs(postings: DataFrame, sets: DataFrame, labels: DataFrame, posted: int) -> DataFrame:
    """a, b, label_b and the most that they may share, of all candidates in different components."""
    labelled = postings.join(labels, postings["class"] == labels["node"], "left").select("class", "n_shingles", "at", "shingle", F.coalesce("label", "class").alias("label"))
    open_ = labelled.groupBy("shingle").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count(F.lit(1)).alias("n")).where("low <> high").select("shingle", F.ceil(F.col("n") / LONG).cast("int").alias("parts"))
    signed = sets.select("class", "shared", *[F.col("signature")[i].alias(f"s{i}") for i in range(SIGNATURE // 64)])
    # Either side of a long list is dealt over its parts: each row once to the left, and to every part of the right.
    left = looked_up(labelled, open_, "shingle", "class", total=posted).where("parts IS NOT NULL").join(signed, "class")
    right = left.select("shingle", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), *[F.col(c).alias(f"{c}_b") for c in left.columns if c not in ("shingle", "parts")])
    left = left.withColumn("part", F.pmod(F.xxhash64("class"), F.col("parts")).cast("int")).drop("parts")
    # At the first shingle that a linked pair shares, what follows must suffice; later ones need not pass.
    needed = 3 * (F.col("n_shingles") + F.col("n_shingles_b"))
    follow = 7 * F.least(F.col("n_shingles") - F.col("at"), F.col("n_shingles_b") - F.col("at_b")) >= needed
    # A bit that only one signature has stands for a shingle that only this set has.
    only = lambda x, y: sum((F.bit_count(F.col(f"s{i}{x}").bitwiseAND(F.bitwise_not(F.col(f"s{i}{y}")))) for i in range(SIGNATURE // 64)), F.lit(0))
    most = F.least(F.col("shared") - only("", "_b"), F.col("shared_b") - only("_b", ""))
    different = (F.col("class") < F.col("class_b")) & (F.col("label") != F.col("label_b"))
    pairs = left.join(right, (left["shingle"] == right["shingle"]) & (left["part"] == right["part"]) & different & close(F.col("n_shingles"), F.col("n_shingles_b")) & follow & (7 * most >= needed))
    return pairs.groupBy(F.col("class").alias("a"), F.col("class_b").alias("b")).agg(F.first("label_b").alias("label_b"), F.first(most).alias("most"))


def close(n: Column, m: Column) -> Column:
    """Sizes that a linked pair can have."""
    return (4 * n >= 3 * m) & (4 * m >= 3 * n)
