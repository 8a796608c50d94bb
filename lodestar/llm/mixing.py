"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Each source is cut into BLOCKS hash blocks. Its target, in words, becomes a quota of blocks: whole epochs and, for the
rest, blocks of a permutation that fit and come nearest to it. The tree then splits the quotas of all sources among the
output shards: each node draws how many blocks of every source go left, without replacement, until a leaf is a shard.
Shards take disjoint runs of each source's permuted blocks and shuffle their rows locally.

Sources are planned in parallel, however many there are: the driver only holds totals of GROUPS groups of sources. The
tree first splits the quotas of the groups; each group then splits its share among its sources by the same tree, with
the group's count at each node given. That is the same distribution as one tree over all sources.

Every random choice derives from SEED and the rows' values, so reruns and retried tasks decide alike.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm.shared import written
from lodestar.llm.sharding import prefix_sums

BLOCKS = 1024
SHARDS = 16
SEED = 20_240_501
#: Groups of sources that the driver splits.
GROUPS = 256
#: Bytes of text in a slice of a shard; the rows of a shard are dealt over as many slices as that takes.
SLICE_BYTES = 64 << 20
#: No document is taken more often than this.
MOST = 3
#: Weights of the sources in order, repeating.
WEIGHTS = (1, 2, 3)
_WORD = r"[^\x20\x09-\x0D]+"
SEQUENCE = "source string, source_size long, target double, blocks array<int>, sequence array<int>"
SPLIT = "source string, block int, source_size long, target double, shards array<int>"


def words(text: Column) -> Column:
    """Number of runs of characters other than ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit(_WORD)), F.lit(0)).cast("long")


def with_blocks(docs: DataFrame) -> DataFrame:
    """Adds ``size``, ``mark`` (a hash of doc_id and text) and ``block``. Rows with one mark share a block and so a fate."""
    marked = docs.withColumn("size", words(F.col("text"))).withColumn("mark", F.xxhash64(F.lit(SEED), F.col("doc_id"), F.col("text")))
    return marked.withColumn("block", F.pmod("mark", F.lit(BLOCKS)).cast("int"))


def with_targets(sizes: DataFrame) -> DataFrame:
    """Adds ``target`` to a table (source, source_size): all words, shared by weight, at most MOST times a source's own.

    Weights go round by code point of the source, null last. What stands above the limit is shared anew by weight among
    the others until none is above; if every source is at its limit, the limits hold. A source is above its limit if the
    share of a unit weight exceeds its ``ratio``, so those at the limit are always the ones of smallest ratios. The
    driver only holds sums.
    """
    ranked = prefix_sums(sizes.select("source", F.col("source").cast("binary").alias("_point"), "source_size"), "source_size", "_point")
    weight = F.get(F.array(*[F.lit(float(w)) for w in WEIGHTS]), F.pmod("place", F.lit(len(WEIGHTS))).cast("int"))
    known = written(ranked.select("source", "source_size", weight.alias("weight")).withColumn("ratio", MOST * F.col("source_size") / F.col("weight")), "weights")
    total = known.agg(F.sum("source_size")).first()[0] or 0
    unit = 0.0
    while True:
        at_limit = F.col("ratio") < unit
        limits, weights = known.agg(F.sum(F.when(at_limit, MOST * F.col("source_size"))), F.sum(F.when(~at_limit, F.col("weight")))).first()
        if not weights:
            unit = float("inf")
            break
        following = (total - (limits or 0)) / weights
        if following <= unit:
            break
        unit = following
    return known.select("source", "source_size", F.least(MOST * F.col("source_size").cast("double"), F.lit(unit) * F.col("weight")).alias("target"))


def generator(*names: object) -> np.random.Generator:
    digest = hashlib.sha256("\0".join(map(str, (SEED, *names))).encode("utf-8", "surrogatepass")).digest()
    return np.random.default_rng(int.from_bytes(digest[:8], "big"))


def named(source: str | None) -> str:
    return "null" if source is None else "=" + source


def block_sequence(source: str | None, sizes: np.ndarray, target: float) -> list[int]:
    """The blocks that a source gives, in order: an epoch is a permutation of all, the last one ends at the quota.

    Of the last epoch's permutation a block is taken if it still fits; at the end one more, if that comes nearer.
    """
    total, out = int(sizes.sum()), []
    if not total:
        return out
    epochs = min(MOST, int(target // total))
    for epoch in range(epochs):
        out += generator("epoch", named(source), epoch).permutation(len(sizes)).tolist()
    rest = target - epochs * total
    if epochs < MOST and rest > 0:
        order, left = generator("epoch", named(source), epochs).permutation(len(sizes)), rest
        skipped = []
        for block in order.tolist():
            if sizes[block] <= left:
                out.append(block)
                left -= int(sizes[block])
            else:
                skipped.append(block)
        if skipped:
            least = min(skipped, key=lambda b: (sizes[b], b))
            if sizes[least] - left < left:
                out.append(least)
    return out


def split_quotas(quotas: np.ndarray, first: int, shards: int, out: np.ndarray, given: np.ndarray | None = None, name: str = "") -> None:
    """Splits block quotas among shards first .. first + shards - 1, recursively; ``given`` has the counts of shards."""
    if shards == 1:
        out[first] = quotas
        return
    left = shards // 2
    count = int(quotas.sum()) * left // shards if given is None else int(given[first : first + left].sum())
    drawn = generator("node", name, first, shards).multivariate_hypergeometric(quotas, count, method="marginals") if quotas.sum() else np.zeros_like(quotas)
    split_quotas(drawn, first, left, out, given, name)
    split_quotas(quotas - drawn, first + left, shards - left, out, given, name)


def sequence_of(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """Of one source: which of its blocks hold rows, and the order in which it gives blocks."""
    rows = rows.sort_values("block")
    sizes = np.zeros(BLOCKS, np.int64)
    sizes[rows["block"]] = rows["words"]
    source, size, target = rows["source"].iloc[0], int(rows["source_size"].iloc[0]), float(rows["target"].iloc[0])
    source = None if pd.isna(source) else source
    held = set(rows["block"].tolist())
    # Blocks without rows give nothing and take no place in a shard.
    sequence = [b for b in block_sequence(source, sizes, target) if b in held]
    return pd.DataFrame({"source": [source], "source_size": [size], "target": [target], "blocks": [sorted(held)], "sequence": [sequence]})


def plan(blocked: DataFrame, shards: int = SHARDS) -> DataFrame:
    """source, block, source_size, target and ``shards``, the array of the shards that take the block, once per copy.

    Sizes are summed over all rows, in each task before the shuffle; only sums per source and block leave it. The driver
    holds GROUPS times ``shards`` counts.
    """
    spark = blocked.sparkSession
    sums = written(blocked.groupBy("source", "block").agg(F.sum("size").alias("words")), "blocks")
    goals = with_targets(sums.groupBy("source").agg(F.sum("words").alias("source_size"))).withColumnRenamed("source", "_source")
    joined = sums.join(goals, sums["source"].eqNullSafe(goals["_source"])).select("source", "block", "words", "source_size", "target")
    # One source has at most BLOCKS rows.
    sequences = written(joined.groupBy("source").applyInPandas(sequence_of, SEQUENCE).withColumn("group", F.pmod(F.xxhash64(F.lit(SEED), "source"), F.lit(GROUPS)).cast("int")), "sequences")
    quotas = np.zeros(GROUPS, np.int64)
    for group, n in sequences.groupBy("group").agg(F.sum(F.size("sequence"))).collect():
        quotas[group] = n
    taken = np.zeros((shards, GROUPS), np.int64)
    split_quotas(quotas, 0, shards, taken)

    def split(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        group = int(key[0])
        rows = rows.assign(order=[named(None if pd.isna(s) else s) for s in rows["source"]]).sort_values("order")
        counts = np.array([len(s) for s in rows["sequence"]], np.int64)
        out = np.zeros((shards, len(rows)), np.int64)
        split_quotas(counts, 0, shards, out, taken[:, group], str(group))
        found = []
        for i, r in enumerate(rows.itertuples()):
            to = np.repeat(np.arange(shards), out[:, i])  # shard k takes the next run of the sequence
            copies: dict[int, list[int]] = {int(b): [] for b in r.blocks}
            for block, shard in zip(r.sequence, to, strict=True):
                copies[int(block)].append(int(shard))
            found += [(None if pd.isna(r.source) else r.source, b, r.source_size, r.target, c) for b, c in copies.items()]
        return pd.DataFrame(found, columns=["source", "block", "source_size", "target", "shards"])

    return written(sequences.groupBy("group").applyInPandas(split, SPLIT), "plan")


#: A plan of up to so many rows (some 60 bytes each) is broadcast; a larger one is joined by shuffle.
BROADCAST_ROWS = 200_000


def apply_plan(blocked: DataFrame, planned: DataFrame) -> DataFrame:
    """Joins the plan to the rows. A null source is a source of its own."""
    small = planned.count() <= BROADCAST_ROWS
    side = planned.withColumnRenamed("source", "_source").withColumnRenamed("block", "_block")
    side = F.broadcast(side) if small else side
    return blocked.join(side, blocked["source"].eqNullSafe(side["_source"]) & (blocked["block"] == side["_block"]), "left").drop("_source", "_block")


def shuffle_key(shard: Column, copy: Column) -> Column:
    """Where a copy stands in its shard: rows are sorted by this number."""
    return F.xxhash64(F.lit(SEED), shard, copy.cast("int"), "mark")


def mix_plan(docs: DataFrame) -> DataFrame:
    """A row per document: doc_id, size, source_size, target, taken, shards, keys.

    ``shards`` are the output shards that the tree gives the copies of the document to, ``keys`` where each stands in
    its shard. Null text has size 0. A source whose texts have no words has target 0 and gives nothing. An empty table
    gives no rows. Rows that repeat a doc_id are documents of their own; those that also repeat the text share a fate.
    Other columns are ignored.
    """
    blocked = with_blocks(docs.select("doc_id", "text", F.col("source").cast("string").alias("source"))).drop("text")
    applied = apply_plan(blocked, plan(blocked.select("source", "size", "block")))
    keys = F.transform("shards", shuffle_key)
    return applied.select("doc_id", "size", "source_size", "target", (F.col("size") * F.size("shards")).alias("taken"), "shards", keys.alias("keys"))


def mix(docs: DataFrame) -> DataFrame:
    """The mixed corpus: the columns of ``docs``, a row for every copy taken, shuffled within its shard.

    Shards are dealt over slices of about SLICE_BYTES, so no task holds a whole shard. The rows' order, by partition and
    within it, is the mix: written as it is, a file holds whole slices, shard by shard, each shuffled.
    """
    names = docs.columns
    columns = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)]
    blocked = with_blocks(docs.select("doc_id", "text", F.col("source").cast("string").alias("source"), F.struct(*columns).alias("_row")))
    copies = apply_plan(blocked.select("source", "mark", "block", "_row"), plan(blocked.select("source", "size", "block")))
    drawn = copies.select("_row", "mark", F.posexplode("shards").alias("_copy", "_shard"))
    dealt = drawn.withColumn("_key", shuffle_key(F.col("_shard"), F.col("_copy")))
    bytes_ = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    slices = max(1, -(-bytes_ // (SLICE_BYTES * SHARDS)))
    slice_ = F.pmod(F.shiftright("_key", 8), F.lit(slices))
    # Rows that agree in doc_id and text tie, so all their columns decide; maps have no order of their own, but a text.
    whole = [F.to_json(F.struct(F.col(f"_row.{f.name}"))) if "map<" in f.dataType.simpleString() else F.col(f"_row.{f.name}") for f in copies.schema["_row"].dataType.fields]
    dealt = dealt.repartition(SHARDS * slices, "_shard", slice_).sortWithinPartitions("_shard", slice_, "_key", F.xxhash64(*whole))
    return dealt.select(*[F.col(f"_row.c{i}").alias(c) for i, c in enumerate(names)])
