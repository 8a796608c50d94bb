"""Search requests from text to hits, as one plan each, and the import of a folder."""

from __future__ import annotations

import contextlib
import threading
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions import ids, text
from lodestar.operators import classify, extract, filters, fulltext, fusion, segments, vectors
from lodestar.sources import files
from lodestar.sources.snapshots import Read, Store, Table, incremental

MODES = {"fulltext": "fulltext", "keyword": "fulltext", "semantic": "semantic", "hybrid": "hybrid"}
OVERFETCH, MOST, BATCH = 5, 100, 64


@dataclass
class Corpus:
    """What a search runs over: documents (doc_id, version_id, file_name, clean_text), an index, mentions, vectors."""

    documents: DataFrame
    index: fulltext.Index
    mentions: DataFrame | None = None
    contacts: DataFrame | None = None
    vectors: DataFrame | None = None  # doc_id, version_id, embedding
    candidates: DataFrame | None = None  # version_id, candidate_id
    embed: Callable[[str], list[float]] | None = None


#: The stages of a search, in their order.
STAGES = ("query_parse", "prefilter", "bm25", "ann", "fusion", "bulk_hydrate", "snippet")


class Stages:
    """Runs each stage of a search by itself: its rows stay with the executors, are counted, and the next stage reads them.

    So a stage's seconds are its own, at the price of an action a stage; a search that isn't timed is one plan. A stage
    that a search has no use for takes no time and has no rows. Lost rows are computed again.
    """

    def __init__(self) -> None:
        self.seconds, self.rows = dict.fromkeys(STAGES, 0.0), dict.fromkeys(STAGES[1:], 0)
        self.kept: list[DataFrame] = []

    def run(self, name: str, made: Callable[[], DataFrame]) -> DataFrame:
        began = time.perf_counter()
        out = made().persist()
        self.kept.append(out)
        self.rows[name] = out.count()
        self.seconds[name] = time.perf_counter() - began
        return out

    def release(self) -> None:
        while self.kept:
            self.kept.pop().unpersist()


@dataclass
class Answer:
    """Hits as a DataFrame, and how they were found."""

    hits: DataFrame
    partial: str | None = None
    timing: dict[str, float] = field(default_factory=dict)  # seconds
    rows: dict[str, int] = field(default_factory=dict)  # of each stage, if the search was timed
    stages: Stages | None = None

    def server_timing(self) -> str:
        """The stages in milliseconds, as an HTTP header gives them."""
        return ",".join(f"{name};dur={1000 * self.timing.get(name, 0.0):.3f}" for name in STAGES)

    def release(self) -> None:
        """Frees what a timed search keeps for its hits, which must be read before; answers of a batch share it."""
        if self.stages is not None:
            self.stages.release()


def parse_request(payload: dict) -> tuple[str, str, int, list[filters.Predicate]]:
    if unknown := set(payload) - {"query", "mode", "top_k", "filters"}:
        raise ValueError(f"unknown field: {sorted(unknown)[0]}")
    mode = MODES.get(payload.get("mode", "fulltext"))
    if mode is None:
        raise ValueError("unknown mode")
    top = payload.get("top_k", 10)
    if not isinstance(top, int) or isinstance(top, bool) or not 1 <= top <= MOST:
        raise ValueError("top_k is not between 1 and 100")
    return payload["query"], mode, top, filters.parse_filters(payload.get("filters") or {})


def search(spark: SparkSession, corpus: Corpus, query: str, mode: str = "fulltext", top_k: int = 10, wanted: dict | None = None, timed: bool = False) -> Answer:
    """One request. Structured filters restrict keyword hits before their cut-off and vector hits after it."""
    return search_batch(spark, corpus, {"0": {"query": query, "mode": mode, "top_k": top_k, "filters": wanted or {}}}, timed)["0"]


def search_batch(spark: SparkSession, corpus: Corpus, requests: dict[str, dict], timed: bool = False) -> dict[str, Answer]:
    """Up to 64 requests; those alike in mode and filters share one plan, which reads postings and vectors once.

    ``timed``: stage by stage, with seconds and rows of each; requests that share a plan share these.
    """
    if not 0 < len(requests) <= BATCH:
        raise ValueError("a batch has 1 to 64 queries")
    parsed = {name: parse_request(payload) for name, payload in requests.items()}
    answers = {}
    groups: dict[tuple, list[str]] = {}
    for name, (_, mode, top, predicates) in parsed.items():
        groups.setdefault((mode, top, repr(predicates)), []).append(name)
    for (mode, top, _), names in groups.items():
        began = time.perf_counter()
        plans = {n: fulltext.plan_query(parsed[n][0], top) for n in names}
        timing = {"query_parse": time.perf_counter() - began}
        stages = Stages() if timed else None
        hits, partial = run_group(spark, corpus, plans, {n: parsed[n][0] for n in names}, mode, top, parsed[names[0]][3], stages)
        timing = stages.seconds | timing if stages else timing | {"plan": time.perf_counter() - began - timing["query_parse"]}
        for n in names:
            answers[n] = Answer(hits.where(F.col("query_id") == n).drop("query_id"), partial, dict(timing), dict(stages.rows) if stages else {}, stages)
    return answers


def run_group(spark, corpus, plans, queries, mode, top, predicates, stages: Stages | None = None) -> tuple[DataFrame, str | None]:
    stage = stages.run if stages else lambda name, made: made()
    allowed = stage("prefilter", lambda: filters.select(corpus.documents.select("doc_id"), corpus.mentions, predicates, contacts=corpus.contacts)) if predicates else None
    fetch = min(MOST, max(top, OVERFETCH * top))
    as_text = lambda df: df.withColumn("doc_id", F.col("doc_id").cast("string"))
    lexical = semantic = partial = None
    if mode != "semantic":
        lexical = stage("bm25", lambda: as_text(fulltext.search(corpus.index.of(fulltext.terms_of(plans)), fulltext.query_table(spark, plans), fetch, allowed)))
    if mode != "fulltext":
        if corpus.vectors is None or corpus.embed is None:
            if mode == "semantic":
                raise RuntimeError("semantic search is disabled")
            partial = "embedding_runtime_unavailable"
        else:

            def by_vector() -> DataFrame:
                asked = spark.createDataFrame([(n, [float(x) for x in corpus.embed(q)]) for n, q in queries.items()], "query_id string, embedding array<float>")
                near = vectors.nearest(corpus.vectors, asked, fetch, "doc_id")
                return as_text(vectors.filtered_after(near, allowed, "doc_id") if allowed is not None else near)

            semantic = stage("ann", by_vector)
    both = lexical is not None and semantic is not None
    ranked = stage("fusion", lambda: (fusion.hybrid(lexical, semantic, fetch) if both else lexical if lexical is not None else semantic).select("query_id", "doc_id", "rank", "score"))

    def hydrated() -> DataFrame:
        # Hits are at most 100 a query: the text is joined, and snippets made, only for them.
        found = as_text(corpus.documents).join(F.broadcast(ranked), "doc_id")
        if corpus.candidates is not None:
            found = found.join(corpus.candidates.withColumnRenamed("candidate_id", "candidate_key"), "version_id", "left")
        else:
            found = found.withColumn("candidate_key", F.lit(None).cast("string"))
        return fusion.fold_and_number(found, top)

    folded = stage("bulk_hydrate", hydrated)

    def shown() -> DataFrame:
        terms = spark.createDataFrame([(n, [t for g in p.groups for part in g[0] for t in part]) for n, p in plans.items()], "query_id string, _terms array<string>")
        lexical_hit = F.exists("_terms", lambda t: F.instr(text.ascii_lower(F.col("clean_text")), t) > 0)
        snippet = F.when(lexical_hit, text.snippet(F.col("clean_text"), F.col("_terms"))).otherwise("semantic match")
        return folded.join(F.broadcast(terms), "query_id").select("query_id", "rank", "score", "doc_id", "version_id", text.file_name_shown(F.col("file_name")).alias("file_name"), snippet.alias("snippet"))

    return stage("snippet", shown), partial


def import_folder(spark: SparkSession, root: str, readers: dict | None = None, profile: str = "explicit") -> dict[str, DataFrame]:
    """documents, versions, classes, mentions and projection of a folder, as one lineage from files to tables."""
    found = files.scan(spark, root).where(files.wanted_directory(F.col("path"), profile) & files.wanted_name(F.col("path")) & files.wanted_extension(F.col("path")))
    documents = found.select(
        F.concat(F.lit("doc_"), F.substring(F.sha2("path", 256), 1, 32)).alias("doc_id"),
        F.col("path").alias("source_uri"),
        files.normalized_path(F.col("path")).alias("normalized_path"),
        F.regexp_extract("path", "([^/]*)$", 1).alias("file_name"),
        files.extension(F.col("path")).alias("extension"),
        F.col("length").alias("byte_size"),
        F.col("modificationTime").alias("mtime"),
        ids.content_digest(F.col("content")).alias("content_hash"),
    )
    parsed = files.parse(found.select("path", "content"), readers)
    # A text layer of bad quality is as good as none: the file needs character recognition.
    poor = F.lower(files.extension(F.col("path"))).eqNullSafe("pdf") & (F.col("outcome") == "text_extracted") & ~text.quality(F.col("text"))
    parsed = parsed.select("path", F.when(~poor, F.col("text")).alias("text"), F.when(poor, "ocr_required").otherwise(F.col("outcome")).alias("outcome"))
    clean = parsed.withColumn("clean_text", text.normalize_text(F.col("text")))
    joined = documents.join(clean.withColumnRenamed("path", "source_uri"), "source_uri")
    versions = joined.select("doc_id", "file_name", "content_hash", "byte_size", "outcome", "clean_text", text.language_set(F.coalesce("clean_text", F.lit(""))).alias("language_set"), ids.version_id(F.col("doc_id"), F.col("content_hash"), F.lit("parse-v1")).alias("version_id"))
    classes = classify.classify(versions, "clean_text", "outcome")
    active = classify.admitted(classes)
    mentions = extract.projected(extract.extract(active, "version_id", "clean_text"))
    projection = active.select("doc_id", "version_id", "file_name", "clean_text", "content_hash", "byte_size")
    return {"documents": documents, "versions": classes, "mentions": mentions, "projection": projection}


INDEX_TABLES = ("postings", "terms", "lengths", "stats")


def index_tables(index: fulltext.Index) -> dict[str, DataFrame | Table]:
    return index.tables("index_")


def index_facts(read: Read) -> dict:
    return {"buckets": fulltext.layout(read("index_lengths"))[0]}


def read_index(store: Store) -> fulltext.Index:
    """The current generation's index, from its tables alone."""
    head = store.head()
    if segments.listed(head) is not None:
        return segments.Segments(store, head).index()
    found = {name: store.current(f"index_{name}", head) for name in INDEX_TABLES}
    return fulltext.Index(found["postings"], found["lengths"], found["stats"], found["terms"], head.get("facts", {}).get("buckets") or fulltext.layout(found["lengths"])[0])


def projected_index(projection: DataFrame) -> fulltext.Index:
    """Contacts are redacted before anything is indexed."""
    safe = projection.withColumn("clean_text", text.redact(F.col("clean_text")))
    return fulltext.build_index(safe, "doc_id", "file_name", "clean_text")


def corpus_of(projection: DataFrame, mentions: DataFrame | None = None, index: fulltext.Index | None = None) -> Corpus:
    """A corpus over a published projection and its index; without one, the index is built for this search."""
    safe = projection.withColumn("clean_text", text.redact(F.col("clean_text")))
    by_doc = None if mentions is None else mentions.join(projection.select("version_id", "doc_id"), "version_id")
    return Corpus(safe, index or projected_index(projection), by_doc)


def next_generation(store: Store, new: dict[str, DataFrame], gone: DataFrame, generation: str, purge: bool = False) -> tuple[dict[str, DataFrame | Table], Callable[[Read], dict]]:
    """The tables and facts of the generation after the current one: without the documents ``gone`` (doc_id), with the ``new`` ones.

    The index grows by a segment of the new documents. Mentions and all else of documents that stay are taken over as they are.
    """
    head, added = store.head(), projected_index(new["projection"])
    if head is None:
        tables, facts = segments.change(store, None, generation, added)
        return {**new, **tables}, facts
    out = {name: incremental(store.current(name), gone, new[name]) for name in ("documents", "versions", "projection")}
    owned = store.current("versions").join(gone.select("doc_id"), "doc_id", "left_semi").select("version_id")
    out["mentions"] = store.current("mentions").join(owned.unionByName(new["versions"].select("version_id")).distinct(), "version_id", "left_anti").unionByName(new["mentions"])
    leaving = gone.select("doc_id").unionByName(new["documents"].select("doc_id")).distinct()
    base = None if segments.listed(head) is not None else read_index(store)
    tables, facts = segments.change(store, head, generation, added, leaving, purge, base)
    return {**out, **tables}, facts


#: Tables of an import that get a digest.
DIGESTS = ("documents", "versions", "mentions", "projection")


def changed_tables(store: Store) -> list[str]:
    """Tables of the current generation that are no longer what was published."""
    head, out = store.head(), []
    for name in (head or {}).get("digests", {}):
        try:
            store.checked(name, head)
        except ValueError as e:
            out.append(str(e))
    return out


def problems(store: Store) -> list[str]:
    """What is wrong with the current generation; nothing if it is sound."""
    head = store.head()
    if head is None:
        return ["nothing is published"]
    projection, versions = store.current("projection"), store.current("versions")
    indexed = read_index(store).lengths.select("doc_id").distinct()
    checks = {
        "a document is published twice": projection.groupBy("doc_id").count().where("count > 1"),
        "a published version is unknown": projection.join(versions, ["doc_id", "version_id"], "left_anti"),
        "a published version is not admitted": projection.join(classify.admitted(versions), ["doc_id", "version_id"], "left_anti"),
        "a mention is of an unknown version": store.current("mentions").join(versions, "version_id", "left_anti"),
        "a published document is not indexed": projection.join(indexed, "doc_id", "left_anti"),
        "an indexed document is not published": indexed.join(projection, "doc_id", "left_anti"),
    }
    return [name for name, rows in checks.items() if not rows.isEmpty()]


def with_deadline(spark: SparkSession, action: Callable[[], object], milliseconds: int) -> tuple[object, str | None]:
    """Runs an action under a tag and cancels its jobs at the deadline: (result, None) or (None, reason)."""
    if not 1 <= milliseconds <= 60_000:
        raise ValueError("a deadline is 1 to 60000 ms")
    tag, over, done = f"deadline-{uuid.uuid4().hex}", threading.Event(), threading.Event()

    def watch() -> None:
        # Jobs that a plan starts only after the deadline are cancelled too.
        if not done.wait(milliseconds / 1000):
            over.set()
            while not done.wait(0.1):
                spark.sparkContext.cancelJobsWithTag(tag)

    spark.sparkContext.addJobTag(tag)
    threading.Thread(target=watch, daemon=True).start()
    try:
        return action(), None
    except Exception:
        if over.is_set():
            return None, "deadline_exceeded"
        raise
    finally:
        done.set()
        spark.sparkContext.removeJobTag(tag)


#: Queries that each class of clients may have running; all together 16.
ADMISSION = {"interactive": 8, "background": 2, "batch": 8, "evaluation": 4}


class Admission:
    """Admits at most 16 requests, and of each class its share; each class is a pool of the fair scheduler."""

    def __init__(self, spark: SparkSession, most: int = 16):
        self.spark, self.most, self.running = spark, most, dict.fromkeys(ADMISSION, 0)
        self.lock = threading.Lock()

    @contextlib.contextmanager
    def admitted(self, client_class: str) -> Iterator[None]:
        with self.lock:
            if self.running[client_class] >= ADMISSION[client_class] or sum(self.running.values()) >= self.most:
                raise RuntimeError("overloaded")
            self.running[client_class] += 1
        self.spark.sparkContext.setLocalProperty("spark.scheduler.pool", client_class)
        try:
            yield
        finally:
            self.spark.sparkContext.setLocalProperty("spark.scheduler.pool", None)
            with self.lock:
                self.running[client_class] -= 1


def mean_pooled(model: Callable[[list[str]], np.ndarray], prefix: str) -> Callable[[list[str]], np.ndarray]:
    """A token-vector model as a text model: the prefix of its kind, mean over tokens, unit length."""

    def run(texts: list[str]) -> np.ndarray:
        out = np.stack([np.asarray(v, np.float32).mean(axis=0) for v in model([prefix + t for t in texts])])
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)

    return run
