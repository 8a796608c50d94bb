"""Keyword retrieval: query planning, postings, matching, BM25 and top-k."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.functions.text import let
from lodestar.sources.snapshots import Read, Table

K1, B = 1.2, 0.75
TOKEN_BYTES = 40
QUERY_BYTES, QUERY_TERMS, TERM_BYTES, MOST_RESULTS = 4096, 16, 256, 100
QUOTES = "\"“”"
# Words that make a query one about a place or a degree.
PLACES = ("beijing", "shanghai", "shenzhen", "guangzhou", "hangzhou", "chengdu", "wuhan", "北京", "上海", "深圳", "广州", "杭州", "成都", "武汉")
DEGREE_WORDS = ("bachelor", "master", "phd", "doctor", "degree", "本科", "硕士", "博士", "学历")


@dataclass
class Plan:
    """A planned query. ``groups`` are alternatives; each has required and excluded parts, a part being its tokens."""

    text: str
    terms: list[str]
    limit: int
    groups: list[tuple[list[tuple[str, ...]], list[tuple[str, ...]]]] = field(default_factory=list)

    def __repr__(self) -> str:
        return f"Plan(<redacted>, terms={len(self.terms)}, limit={self.limit})"


def logical_terms(query: str) -> list[tuple[str, bool]]:
    """(value, quoted) in order; a missing end quote is taken as given at the end."""
    out = []
    for m in re.finditer(rf"[{QUOTES}]([^{QUOTES}]*)(?:[{QUOTES}]|$)|(\S+)", query):
        value = (m[1] or "").strip() if m[2] is None else m[2]
        if value:
            out.append((value, m[2] is None))
    return out


def is_operator(value: str) -> bool:
    return re.sub(r"^[\W_]+|[\W_]+$", "", value) in ("AND", "OR", "NOT")


def plan_query(query: str, limit: int = 10) -> Plan:
    """Compatibility form, repeated terms dropped unless the query has explicit operators, bounds checked."""
    if not query.strip():
        raise ValueError("search query is empty")
    found = logical_terms(unicodedata.normalize("NFKC", query))
    explicit = any(is_operator(v) and not q for v, q in found)
    kept: dict[tuple[str, bool, int], None] = {}
    for i, (value, quoted) in enumerate(found):
        kept[(" ".join(value.split()), quoted, i if explicit else 0)] = None
    parts = [(v, q) for v, q, _ in kept]
    text = " ".join(f'"{v}"' if q else v for v, q in parts)
    searchable = [v for v, q in parts if q or not is_operator(v)]
    if len(text.encode()) > QUERY_BYTES or not 1 <= len(searchable) <= QUERY_TERMS or any(len(v.encode()) > TERM_BYTES for v in searchable):
        raise ValueError("search query is outside semantic bounds")
    return Plan(text, text.split(), max(1, min(MOST_RESULTS, limit)), boolean_groups(parts))


Literal = tuple[tuple[str, ...], bool]  # tokens of a part, and whether it is asked for


def boolean_groups(parts: list[tuple[str, bool]]) -> list[tuple[list[tuple[str, ...]], list[tuple[str, ...]]]]:
    """A query as alternatives, each of required and excluded parts; alternatives without a required part match nothing.

    OR binds least, AND or nothing more, NOT and a minus most; parentheses nest. What is unbalanced is taken leniently:
    an end without a beginning is ignored, a beginning without an end lasts to the end.
    """
    symbols: list[str | Literal] = []
    for value, quoted in parts:
        symbols += [(tuple(tokens_of(value)), True)] if quoted else _symbols(value)
    groups, at = _either(symbols, 0, True)
    while at < len(symbols):  # past an end without a beginning
        rest, at = _either(symbols, at + 1, True)
        groups = _both(groups, rest)
    kept = []
    for group in groups:
        required, excluded = [t for t, asked in group if asked], [t for t, asked in group if not asked]
        if required and not set(required) & set(excluded):
            kept.append((required, excluded))
    return kept


def _symbols(value: str) -> list[str | Literal]:
    """An unquoted value as parentheses, operators and a part. Parentheses inside a value belong to it."""
    out: list[str | Literal] = []
    while value[:1] in ("(", "-", "+") and value:
        out += [{"(": "(", "-": "NOT"}[value[0]]] if value[0] != "+" else []
        value = value[1:]
    inner = value.rstrip(")")
    ends = max(0, len(value) - len(inner) - max(0, inner.count("(") - inner.count(")")))
    inner = value[: len(value) - ends]
    if is_operator(inner):
        out.append(re.sub(r"^[\W_]+|[\W_]+$", "", inner))
    elif tokens := tokens_of(inner):
        out.append((tuple(tokens), True))
    return out + [")"] * ends


def _either(symbols: list, at: int, asked: bool) -> tuple[list[dict[Literal, None]], int]:
    """Alternatives from ``at`` to the end of this level. Not asked for: none of them may hold, so all their opposites."""
    sides = []
    while True:
        side, at = _all(symbols, at, asked)
        sides += [side] if side is not None else []
        if at >= len(symbols) or symbols[at] == ")":
            break
        at += 1  # OR
    out = sides[0] if sides else []
    for side in sides[1:]:
        out = _any(out, side) if asked else _both(out, side)
    return out, at


def _all(symbols: list, at: int, asked: bool) -> tuple[list[dict[Literal, None]] | None, int]:
    """What stands side by side, up to OR or the end of the level; None if nothing does."""
    out, negated = None, False
    while at < len(symbols) and symbols[at] not in (")", "OR"):
        symbol = symbols[at]
        at += 1
        if symbol in ("AND", "NOT"):
            negated = not negated if symbol == "NOT" else negated
            continue
        if symbol == "(":
            one, at = _either(symbols, at, asked != negated)
            at += 1
            if not one:
                continue
        else:
            one = [{(symbol[0], asked != negated): None}]
        out = one if out is None else _both(out, one) if asked else _any(out, one)
        negated = False
    return out, at


def _any(a: list, b: list) -> list:
    return a + [g for g in b if g not in a]


def _both(a: list, b: list) -> list:
    """Every pair of alternatives together. Sixteen terms make a few hundred at most, since each stands in the query once."""
    out: list[dict[Literal, None]] = []
    for x in a or [{}]:
        for y in b or [{}]:
            both = {**x, **y}
            if both not in out:
                out.append(both)
    return out


def tokens_of(text: str) -> list[str]:
    """Runs of letters and digits in lower case, without those over TOKEN_BYTES."""
    return [t for t in re.findall(r"[^\W_]+", text.lower()) if len(t.encode()) <= TOKEN_BYTES]


def tokens(c: Column) -> Column:
    return F.filter(F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), lambda t: F.octet_length(t) <= TOKEN_BYTES)


def query_shape(query: Column) -> dict[str, Column]:
    """Number of terms, flags and bucket of a query column, for statistics over query logs."""
    parts = F.filter(F.regexp_extract_all(query, F.lit(r'["“”][^"“”]*(?:["“”]|$)|\S+'), F.lit(0)), lambda p: F.regexp_replace(p, r'["“”\s]+', "") != "")
    quoted = lambda p: p.rlike('^["“”]')
    low = F.lower(query)
    any_of = lambda words: F.greatest(*[low.contains(w) for w in words])
    flags = {
        "term_count": F.size(parts),
        "has_boolean": F.exists(parts, lambda p: ~quoted(p) & p.rlike(r"^[^\p{L}\p{N}]*(?:AND|OR|NOT)[^\p{L}\p{N}]*$")),
        "has_phrase": F.exists(parts, quoted),
        "has_location": any_of(PLACES),
        "has_years": query.rlike("[0-9]"),
        "has_degree": any_of(DEGREE_WORDS),
        "has_skill": F.exists(parts, lambda p: p.rlike(r"\p{L}")),
    }
    n = flags["term_count"]
    by_field = (n >= 2) & (flags["has_location"] | flags["has_years"] | flags["has_degree"])
    flags["bucket"] = F.when(flags["has_boolean"], "hybrid").when(flags["has_phrase"], "semantic").when(by_field, "field_filter").when(n <= 1, "single_term").when(n == 2, "and_2").when(n <= 5, "and_3_5").otherwise("and_6_16")
    return flags


#: Tokens of a bucket of a published index, and documents of a file in it; buckets are a power of two.
BUCKET_TOKENS, SLICE_DOCS, LEAST_BUCKETS, MOST_BUCKETS = 4_000_000, 2_000_000, 8, 1 << 15
#: Fields whose postings are made at once, and documents that leave an index by a broadcast.
PIECE, MOST_BROADCAST = 64, 1_000_000


@dataclass
class Index:
    """postings: term, doc_id, field, tf, length (of the field), positions. lengths: doc_id, field, length.

    stats: field, average, docs. terms: term, field, df, cf. A published index has ``buckets`` parts, by a hash of the
    term; readers name the terms they need and see only the files of their buckets. An index in segments has ``cut``.
    """

    postings: DataFrame
    lengths: DataFrame
    stats: DataFrame
    terms: DataFrame
    buckets: int = 0
    cut: Callable[[list[str]], Index] | None = None

    def of(self, wanted: list[str]) -> Index:
        """The index cut to some terms; of a published one other buckets are never opened."""
        some = sorted(set(wanted))
        if self.cut:
            return self.cut(some)
        near = F.col("term").isin(*some)
        if self.buckets:
            near = F.col("bucket").isin(*[bucket_of(F.lit(t), self.buckets) for t in some]) & near
        return Index(self.postings.where(near), self.lengths, self.stats, self.terms.where(near), self.buckets)

    def tables(self, prefix: str = "") -> dict[str, DataFrame | Table]:
        """What is published: postings and terms in parts by bucket, sorted by term, so that files are pruned inside too.

        Parts follow from the corpus: a bucket has some BUCKET_TOKENS tokens, and each of its files SLICE_DOCS documents,
        whatever the corpus' size. Lengths come first, and terms are counted from the postings as they were written.
        """

        def postings(read: Read) -> DataFrame:
            buckets, slices = layout(read(f"{prefix}lengths"))
            kept = self.postings.drop("bucket").withColumn("bucket", bucket_of(F.col("term"), buckets))
            return kept.repartition(buckets * slices, "bucket", F.pmod(F.xxhash64("doc_id"), F.lit(slices))).sortWithinPartitions("bucket", "term", "doc_id")

        def terms(read: Read) -> DataFrame:
            counted = index_of(read(f"{prefix}postings"), self.lengths).terms
            buckets, _ = layout(read(f"{prefix}lengths"))
            return counted.withColumn("bucket", bucket_of(F.col("term"), buckets)).repartition(buckets, "bucket").sortWithinPartitions("bucket", "term")

        def stats(read: Read) -> DataFrame:
            return index_of(self.postings, read(f"{prefix}lengths")).stats.coalesce(1)

        return {f"{prefix}lengths": self.lengths, f"{prefix}postings": postings, f"{prefix}terms": terms, f"{prefix}stats": stats}


def layout(lengths: DataFrame) -> tuple[int, int]:
    """Buckets of an index, and files of a bucket."""
    size = lengths.agg(F.sum("length").alias("tokens"), F.countDistinct("field").alias("fields"), F.count(F.lit(1)).alias("n")).first()
    wanted = (size.tokens or 0) / BUCKET_TOKENS
    buckets = LEAST_BUCKETS
    while buckets < min(wanted, MOST_BUCKETS):
        buckets *= 2
    return buckets, 1 + size.n // max(1, size.fields) // SLICE_DOCS


def bucket_of(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def index_of(postings: DataFrame, lengths: DataFrame) -> Index:
    stats = lengths.groupBy("field").agg(F.avg("length").alias("average"), F.count(F.lit(1)).alias("docs"))
    terms = postings.groupBy("term", "field").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))
    return Index(postings, lengths, stats, terms)


def build_index(docs: DataFrame, key: str, *fields: str) -> Index:
    """Postings of the given text columns; a posting carries its field's length, so scores need no join with lengths.

    All tokens of a field are in its row, so postings are made there and nothing is shuffled before they are published. Only
    where rows share a key, which is looked up first, are their postings put together.
    """
    parts = None
    for name in fields:
        one = docs.select(F.col(key).alias("doc_id"), F.lit(name).alias("field"), tokens(F.col(name)).alias("tokens"))
        parts = one if parts is None else parts.unionByName(one)
    lengths = parts.select("doc_id", "field", F.coalesce(F.size("tokens"), F.lit(0)).alias("length"))
    kind = parts.schema["doc_id"].dataType.simpleString()
    postings = parts.mapInArrow(_postings, f"term string, doc_id {kind}, field string, tf int, length int, positions array<int>")
    if not docs.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        postings = postings.groupBy("term", "doc_id", "field").agg(F.sum("tf").cast("int").alias("tf"), F.first("length").alias("length"), F.array_sort(F.flatten(F.collect_list("positions"))).alias("positions"))
    return index_of(postings, lengths)


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each distinct token of each row (doc_id, field, tokens), by pieces of PIECE rows."""
    for batch in batches:
        for at in range(0, batch.num_rows, PIECE):
            ids, fields, lists = batch.slice(at, PIECE).columns
            sizes = pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            coded = lists.flatten().dictionary_encode()
            row = np.repeat(np.arange(len(sizes)), sizes)
            place = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            whose = row * len(coded.dictionary) + coded.indices.to_numpy()
            order = np.argsort(whose, kind="stable")
            starts = np.flatnonzero(np.diff(whose[order], prepend=-1))
            ends = np.append(starts, len(order))
            term, row = coded.dictionary.take(coded.indices.take(pa.array(order[starts]))), row[order[starts]]
            positions = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(place[order], pa.int32()))
            columns = [term, ids.take(pa.array(row)), fields.take(pa.array(row)), pa.array(np.diff(ends), pa.int32()), pa.array(sizes[row], pa.int32()), positions]
            yield pa.RecordBatch.from_arrays(columns, ["term", "doc_id", "field", "tf", "length", "positions"])


def leaving(rows: DataFrame, gone: DataFrame, n: int, *keys: str, how: str = "left_anti") -> DataFrame:
    """Rows without those of ``gone``, or those only (left_semi). So long as n keys can be broadcast, no postings are shuffled or sorted for it."""
    return rows.join(F.broadcast(gone) if n <= MOST_BROADCAST else gone.hint("shuffle_hash"), list(keys), how)


def changed_index(base: Index, gone: DataFrame, added: Index) -> Index:
    """The next generation: the base without the documents ``gone`` (doc_id), and the postings of those added."""
    left = gone.select("doc_id").distinct()
    n = left.count()
    kept = lambda t: leaving(t.drop("bucket"), left, n, "doc_id")
    return index_of(kept(base.postings).unionByName(added.postings.drop("bucket")), kept(base.lengths).unionByName(added.lengths))


@dataclass
class Queries:
    """Planned queries as small tables, at most 64 queries of 16 terms, so broadcast.

    terms: query_id, term, bits (of the parts that are this term alone), scored. phrases: query_id, bit, size, place, term.
    alternatives: for each query the bits that must be met, and those that must not.
    """

    terms: DataFrame
    phrases: DataFrame | None
    alternatives: dict[str, list[tuple[int, int]]]

    def accepts(self, query_id: Column, met: Column) -> Column:
        """Whether the bits that a document has met make one of its query's alternatives."""
        wanted = F.create_map(*[x for q, sides in self.alternatives.items() for x in (F.lit(q), F.array(*[F.array(F.lit(a).cast("long"), F.lit(b).cast("long")) for a, b in sides]))])
        return F.exists(F.element_at(wanted, query_id), lambda side: (met.bitwiseAND(side[0]) == side[0]) & (met.bitwiseAND(side[1]) == 0))


def query_table(spark: SparkSession, plans: dict[str, Plan]) -> Queries:
    """Parts are numbered in each query; a number is a bit. A query without alternatives has no terms and meets nothing."""
    terms: dict[tuple[str, str], list] = {}
    phrases: list[tuple[str, int, int, int, str]] = []
    alternatives: dict[str, list[tuple[int, int]]] = {}
    for q, plan in plans.items():
        numbers = {part: i for i, part in enumerate(dict.fromkeys(part for group in plan.groups for side in group for part in side))}
        bits = lambda side: sum(1 << numbers[part] for part in set(side))  # noqa: E731, B023
        alternatives[q] = [(bits(required), bits(excluded)) for required, excluded in plan.groups]
        asked = {part for required, _ in plan.groups for part in required}
        for part, number in numbers.items():
            for place, term in enumerate(part):
                row = terms.setdefault((q, term), [0, False])
                row[0] |= 1 << number if len(part) == 1 else 0
                row[1] |= part in asked
                if len(part) > 1:
                    phrases.append((q, 1 << number, len(part), place, term))
    columns = lambda rows, **kinds: spark.createDataFrame(pa.table({n: pa.array([r[i] for r in rows], t) for i, (n, t) in enumerate(kinds.items())}))
    told = [(q, t, bits, scored) for (q, t), (bits, scored) in terms.items()]
    return Queries(
        columns(told, query_id=pa.string(), term=pa.string(), bits=pa.int64(), scored=pa.bool_()),
        columns(phrases, query_id=pa.string(), bits=pa.int64(), size=pa.int32(), place=pa.int32(), term=pa.string()) if phrases else None,
        {q: sides for q, sides in alternatives.items() if sides} or {"": [(0, 0)]},
    )


def scan_postings(docs: DataFrame, key: str, terms: list[str], *fields: str) -> Index:
    """Postings of a few terms straight from the texts, for corpora without an index.

    The places of each query term are found inside the row, so nothing is shuffled, but every text is read. A corpus that
    is searched more than once should have its index published.
    """
    wanted = F.array(*[F.lit(t) for t in sorted(set(terms))])
    kept = None

    def hits(ts: Column) -> Column:
        places = lambda t: F.filter(F.transform(ts, lambda x, i: F.when(x == t, i)), lambda i: i.isNotNull())
        return F.transform(F.array_intersect(ts, wanted), lambda t: F.struct(t.alias("term"), places(t).alias("positions")))

    for name in fields:
        one = docs.select(F.col(key).alias("doc_id"), F.lit(name).alias("field"), let(tokens(F.col(name)), lambda ts: F.struct(F.size(ts).alias("length"), hits(ts).alias("hits"))).alias("t"))
        kept = one if kept is None else kept.unionByName(one)
    kept = kept.select("doc_id", "field", "t.length", "t.hits")
    postings = kept.where(F.size("hits") > 0).select("doc_id", "field", "length", F.inline("hits")).select("term", "doc_id", "field", F.size("positions").alias("tf"), "length", "positions")
    return index_of(postings, kept.select("doc_id", "field", "length"))


def phrase_bits(index: Index, queries: Queries, allowed: DataFrame | None = None) -> DataFrame:
    """query_id, doc_id, bits of the phrases met: the terms of a phrase stand one after another, so all have one start."""
    near = by_document(index.postings.select("term", "doc_id", "field", "positions").join(F.broadcast(queries.phrases.select("term").distinct()), "term", "left_semi"), allowed)
    placed = restricted(near.join(F.broadcast(queries.phrases), "term").select("query_id", "bits", "size", "place", "doc_id", "field", "positions"), by_query(allowed))
    starts = placed.select("query_id", "bits", "size", "doc_id", "field", "place", F.transform("positions", lambda p: p - F.col("place")).alias("starts"))
    met = starts.groupBy("query_id", "bits", "size", "doc_id", "field").agg(F.collect_list("starts").alias("starts")).where(F.size("starts") == F.col("size"))
    common = F.aggregate(F.slice("starts", 2, F.col("size")), F.get("starts", F.lit(0)), F.array_intersect)
    return met.where(F.size(common) > 0).select("query_id", "doc_id", "bits")


def by_document(postings: DataFrame, allowed: DataFrame | None = None) -> DataFrame:
    """Postings of the terms asked for, dealt by document: what is then gathered by query and document needs no further exchange.

    A posting crosses once, however many queries ask for its term, and positions cross as arrays. A selection of documents
    that all queries share cuts them before.
    """
    return (postings if by_query(allowed) is not None else restricted(postings, allowed)).repartition("doc_id")


def by_query(allowed: DataFrame | None) -> DataFrame | None:
    """The selection, if each query has its own."""
    return allowed if allowed is not None and "query_id" in allowed.columns else None


def restricted(hits: DataFrame, allowed: DataFrame | None) -> DataFrame:
    if allowed is None:
        return hits
    return hits.join(allowed, ["query_id", "doc_id"] if "query_id" in allowed.columns else "doc_id", "left_semi")


def matching(index: Index, queries: Queries) -> DataFrame:
    """query_id, doc_id of the documents that match. A part matches in either field; a phrase at consecutive places.

    Postings are read once for all queries; one aggregation by query and document gathers the parts met.
    """
    asked = queries.terms.where("bits <> 0")
    near = by_document(index.postings.select("term", "doc_id").join(F.broadcast(asked.select("term").distinct()), "term", "left_semi"))
    hits = near.join(F.broadcast(asked), "term").select("query_id", "doc_id", "bits")
    if queries.phrases is not None:
        hits = hits.unionByName(phrase_bits(index, queries))
    met = hits.groupBy("query_id", "doc_id").agg(F.bit_or("bits").alias("met"))
    return met.where(queries.accepts(F.col("query_id"), F.col("met"))).select("query_id", "doc_id")


def scores(index: Index, queries: Queries, allowed: DataFrame | None = None) -> DataFrame:
    """query_id, doc_id, score: BM25 over all matched terms and fields, with exact lengths.

    Statistics are of the whole corpus. ``allowed`` (doc_id, or query_id and doc_id) restricts postings before they are
    aggregated. Parts met and weights come from the same aggregation.
    """
    # At most a row per query term and field.
    rated = index.terms.join(F.broadcast(index.stats), "field").join(F.broadcast(queries.terms), "term")
    idf = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    rated = rated.select("query_id", "term", "field", "bits", F.when(F.col("scored"), idf).otherwise(0.0).alias("idf"), "average")
    weight = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("average")))
    near = by_document(index.postings.select("term", "doc_id", "field", "tf", "length").join(F.broadcast(queries.terms.select("term").distinct()), "term", "left_semi"), allowed)
    hits = restricted(near.join(F.broadcast(rated), ["term", "field"]).select("query_id", "doc_id", "bits", weight.alias("weight")), by_query(allowed))
    if queries.phrases is not None:
        hits = hits.unionByName(phrase_bits(index, queries, allowed).withColumn("weight", F.lit(0.0)))
    met = hits.groupBy("query_id", "doc_id").agg(F.bit_or("bits").alias("met"), F.sum("weight").alias("score"))
    return met.where(queries.accepts(F.col("query_id"), F.col("met"))).select("query_id", "doc_id", "score")


def top_k(scored: DataFrame, k: int, *tie: str) -> DataFrame:
    """Adds rank from 1 and keeps k rows per query. The limit runs in each task before the shuffle (window group limit)."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), *[F.col(t).asc() for t in tie])
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def terms_of(plans: dict[str, Plan]) -> list[str]:
    return [t for p in plans.values() for g in p.groups for side in g for part in side for t in part]


def search(index: Index, queries: Queries, k: int, allowed: DataFrame | None = None) -> DataFrame:
    return top_k(scores(index, queries, allowed).withColumn("score", F.round("score", 6)), k, "doc_id")


def repeated_hits(hits: DataFrame) -> DataFrame:
    """Documents that a result has twice; a sound index gives none."""
    return hits.groupBy("query_id", "doc_id").count().where("count > 1")


def without(docs: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    return docs.join(ids.select(key), key, "left_anti")
