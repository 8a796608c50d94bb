"""A keyword index that grows by segments.

A publication writes one immutable segment, the postings of its own documents, and ``gone``: the lengths of the documents
that left or were replaced, each with the segment in which it was alive. Nothing older is written again until segments are
due for a merge, which the next publication takes into its own segment. A document is alive in at most one segment, so
segments have no order and any of them may be merged. The journal's entry lists the segments with their numbers of
documents and tokens, so readers know the averages without a job, and which folders the entry still needs.

Document frequencies are exact: those of the segments less those of dead postings, so scores are those of an index that
is built anew.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lodestar.operators import fulltext
from lodestar.operators.fulltext import Index
from lodestar.sources.snapshots import Read, Store, Table

#: So many segments of one tier make one of the next, and so many lists of the dead become one.
FANOUT = 8
#: Tokens of a segment in the lowest tier; each tier above has FANOUT times as many.
TIER_TOKENS = 1_000_000
#: A segment with a larger share of dead documents is merged at the next publication.
DEAD_SHARE = 0.5

POSTINGS, TERMS, LENGTHS, GONE = "index_postings", "index_terms", "index_lengths", "index_gone"


def listed(head: dict | None) -> list[dict] | None:
    """The segments of an entry; None if its index is not in segments."""
    return (head or {}).get("facts", {}).get("segments")


def total(fields: dict[str, list[int]], which: int) -> int:
    """Documents (0, of the largest field) or tokens (1, of all fields)."""
    counts = [n[which] for n in fields.values()]
    return sum(counts) if which else max(counts, default=0)


def tier(segment: dict) -> int:
    tokens, level = total(segment["fields"], 1), 0
    while tokens > TIER_TOKENS:
        tokens, level = tokens / FANOUT, level + 1
    return level


def due(segments: list[dict]) -> list[dict]:
    """Segments that the next publication merges into its own: FANOUT of a tier with it, and those of mostly dead documents."""
    taken: list[dict] = []
    for level in range(1 + max(map(tier, segments), default=0)):
        # The new segment counts in the lowest tier, and what a tier has merged with it in the next.
        if sum(tier(s) == level for s in segments) + bool(taken or not level) >= FANOUT:
            taken = [s for s in segments if tier(s) <= level]
    return [s for s in segments if s in taken or total(s["dead"], 0) > DEAD_SHARE * total(s["fields"], 0)]


class Segments:
    """The segments of one entry, as tables."""

    def __init__(self, store: Store, head: dict):
        self.store, self.head, self.all = store, head, listed(head) or []

    def table(self, name: str, of: list[dict]) -> DataFrame:
        """A table of some segments."""
        return self._read(name, [s["generation"] for s in of])

    def _read(self, name: str, generations: list[str]) -> DataFrame:
        schema = StructType.fromJson(self.head["schemas"][name])
        if not generations:
            return self.store.spark.createDataFrame([], schema)
        return union([self.store.read(g, name, schema) for g in generations])

    def gone(self) -> DataFrame:
        """doc_id, field, length, segment of the dead."""
        return self._read(GONE, self.head["facts"]["gone"])

    def alive(self, rows: DataFrame, of: list[dict]) -> DataFrame:
        """Rows (doc_id, segment, ...) without the dead; where no segment has any, nothing is joined."""
        if not any(s["dead"] for s in of):
            return rows
        return fulltext.leaving(rows, *self._dead(of), "doc_id", "segment")

    def _dead(self, of: list[dict]) -> tuple[DataFrame, int]:
        """The dead of some segments, and how many they are at most."""
        dead = self.gone().where(F.col("segment").isin(*[s["number"] for s in of])).select("doc_id", "segment").distinct()
        return dead, sum(total(s["dead"], 0) for s in of)

    def lengths(self, of: list[dict]) -> DataFrame:
        return self.alive(self.table(LENGTHS, of), of)

    def parts(self, name: str, wanted: list[str] | None) -> list[tuple[DataFrame, list[dict]]]:
        """A table by terms: a scan a segment, since each has buckets of its own; those with dead documents apart."""
        out = []
        for dirty in (False, True):
            some = [s for s in self.all if bool(s["dead"]) == dirty]
            scans = []
            for s in some:
                rows = self.table(name, [s])
                if wanted is not None:
                    rows = rows.where(F.col("bucket").isin(*[fulltext.bucket_of(F.lit(t), s["buckets"]) for t in wanted]) & F.col("term").isin(*wanted))
                scans.append(rows.drop("bucket"))
            out += [(union(scans), some)] if scans else []
        return out or [(self.table(name, []).drop("bucket"), [])]

    def index(self, wanted: list[str] | None = None) -> Index:
        """The index of what is alive, cut to some terms if they are given; buckets of other terms are not opened."""
        some = None if wanted is None else sorted(set(wanted))
        postings = self.parts(POSTINGS, some)
        alive = [self.alive(rows, of) for rows, of in postings]
        counted = [rows.select("term", "field", "df", "cf") for rows, _ in self.parts(TERMS, some)]
        for rows, of in postings:
            if any(s["dead"] for s in of):
                dead = fulltext.leaving(rows.select("term", "field", "tf", "doc_id", "segment"), *self._dead(of), "doc_id", "segment", how="left_semi")
                counted.append(dead.groupBy("term", "field").agg((-F.count(F.lit(1))).alias("df"), (-F.sum("tf")).alias("cf")))
        terms = union(counted).groupBy("term", "field").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf")).where("df > 0")
        return Index(union(alive).drop("segment"), self.lengths(self.all).drop("segment"), self.stats(), terms, cut=self.index)

    def stats(self) -> DataFrame:
        """field, average, docs from the entry alone."""
        sums: dict[str, list[int]] = {}
        for segment in self.all:
            for sign, side in ((1, "fields"), (-1, "dead")):
                for field, counts in segment[side].items():
                    so_far = sums.setdefault(field, [0, 0])
                    so_far[0] += sign * counts[0]
                    so_far[1] += sign * counts[1]
        rows = [(f, tokens / docs, docs) for f, (docs, tokens) in sorted(sums.items()) if docs]
        columns = {"field": pa.string(), "average": pa.float64(), "docs": pa.int64()}
        return self.store.spark.createDataFrame(pa.table({n: pa.array([r[i] for r in rows], t) for i, (n, t) in enumerate(columns.items())}))


def union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def by_field(rows: DataFrame, *keys: str) -> list:
    """Documents and tokens; a row for each segment and field."""
    return rows.groupBy(*keys, "field").agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum("length"), F.lit(0)).alias("tokens")).collect()


def change(store: Store, head: dict | None, generation: str, added: Index, leaving: DataFrame | None = None, purge: bool = False, base: Index | None = None) -> tuple[dict[str, DataFrame | Table], Callable[[Read], dict]]:
    """What the generation after ``head`` publishes: its tables, and the facts of its entry.

    ``leaving`` (doc_id) die; documents that are replaced must be among them. ``base`` is an index that is not in segments,
    taken into the new one. ``purge`` merges every segment that holds dead documents, so that none of their postings is left.
    """
    now = Segments(store, head) if listed(head) is not None else None
    segments = now.all if now else []
    merged, gone, lists = due(segments), None, head["facts"]["gone"] if now else []
    number = head["facts"]["next"] if now else 1
    if purge and segments:
        holding = set() if leaving is None else {r.segment for r in now.lengths(segments).join(leaving.select("doc_id"), "doc_id", "left_semi").select("segment").distinct().collect()}
        merged = [s for s in segments if s in merged or s["dead"] or s["number"] in holding]
    kept = [s for s in segments if s not in merged]
    stay = lambda rows: rows if leaving is None else rows.join(leaving.select("doc_id"), "doc_id", "left_anti")
    postings, lengths = [added.postings.drop("bucket")], [added.lengths]
    if base is not None:
        postings, lengths = [*postings, stay(base.postings.drop("bucket"))], [*lengths, stay(base.lengths)]
    if merged:
        postings.append(stay(now.alive(now.table(POSTINGS, merged), merged)).drop("segment", "bucket"))
        lengths.append(stay(now.lengths(merged)).drop("segment"))
    mark = lambda rows: rows.withColumn("segment", F.lit(number))
    whole = fulltext.index_of(mark(union(postings)), mark(union(lengths)))
    tables = {name: made for name, made in whole.tables("index_").items() if name != "index_stats"}
    if kept and leaving is not None:
        gone = now.lengths(kept).join(leaving.select("doc_id"), "doc_id", "left_semi")
    together = len(lists) + 1 >= FANOUT
    if together and kept:
        before = now.gone().where(F.col("segment").isin(*[s["number"] for s in kept]))
        gone = before if gone is None else gone.unionByName(before)
    tables[GONE] = mark(added.lengths).limit(0) if gone is None else gone.select("doc_id", "field", "length", "segment")

    def facts(read: Read) -> dict:
        died: dict[int, dict[str, list[int]]] = {}
        for r in by_field(read(GONE), "segment"):
            died.setdefault(r.segment, {})[r.field] = [r.docs, r.tokens]
        out = []
        for segment in kept:
            dead = {} if together else {f: list(n) for f, n in segment["dead"].items()}
            for field, counts in died.get(segment["number"], {}).items():
                dead[field] = [a + b for a, b in zip(dead.get(field, [0, 0]), counts, strict=True)]
            if dead != segment["fields"]:
                out.append({**segment, "dead": dead})
        fields = {r.field: [r.docs, r.tokens] for r in by_field(read(LENGTHS))}
        if fields:
            out.append({"number": number, "generation": generation, "buckets": fulltext.layout(read(LENGTHS))[0], "fields": fields, "dead": {}})
        still = [generation] if together else [*lists, generation]
        still = still if any(s["dead"] for s in out) else []
        return {"segments": out, "gone": still, "next": number + 1, "uses": sorted({*still, *(s["generation"] for s in out)})}

    return tables, facts
