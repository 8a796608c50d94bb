"""Queries of the metadata operators, over tables derived from the driver's by rules of their keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.operators import extract, store
from lodestar.plans.registry import query, table
from lodestar.plans.retrieval_queries import MENTIONS, mentions
from lodestar.sources import files, snapshots
from lodestar.streaming import ingest

K = "o_orderkey"


def orders(spark: SparkSession, sf: str, *columns) -> DataFrame:
    return table(spark, sf, "orders").select(*columns)


def occurrence(spark: SparkSession, sf: str, where: str, revision: str) -> DataFrame:
    """An occurrence per order: priority is the root, the key the path, the customer the document."""
    rows = table(spark, sf, "orders").where(where)
    return rows.select(F.col("o_orderpriority").alias("root_id"), F.col(K).cast("string").alias("relative_path"), F.col("o_custkey").alias("doc_id"), F.expr(revision).alias("revision_id"), F.when(F.col(K) % 13 == 0, "removed").otherwise("present").alias("state"))


@query("SELECT o_orderpriority AS root_id, CAST(o_orderkey AS VARCHAR) AS relative_path FROM orders WHERE o_orderkey % 5 = 0 AND o_orderkey % 13 <> 0")
def scan_diff_removed(spark: SparkSession, sf: str) -> DataFrame:
    present = occurrence(spark, sf, "true", "0").where("state = 'present'")
    return store.removed_occurrences(present, occurrence(spark, sf, f"{K} % 5 <> 0", "0"), 0).select("root_id", "relative_path")


@query("""
    WITH p AS (SELECT o_custkey AS doc_id, o_orderkey % 5 = 0 AS gone FROM orders WHERE o_orderkey % 13 <> 0)
    SELECT doc_id FROM p GROUP BY doc_id HAVING bool_and(gone)""")
def scan_diff_unreferenced(spark: SparkSession, sf: str) -> DataFrame:
    present = occurrence(spark, sf, "true", "0").where("state = 'present'")
    return store.unreferenced(store.removed_occurrences(present, occurrence(spark, sf, f"{K} % 5 <> 0", "0"), 0), present)


@query("""
    SELECT o_orderpriority AS root_id, CAST(o_orderkey AS VARCHAR) AS relative_path, o_custkey AS doc_id, o_orderkey % 2 AS revision_id,
           CASE WHEN o_orderkey % 7 = 0 THEN 'inserted' WHEN o_orderkey % 13 <> 0 AND o_orderkey % 2 = 0 THEN 'unchanged' ELSE 'replaced' END AS action,
           CASE WHEN o_orderkey % 7 <> 0 AND NOT (o_orderkey % 13 <> 0 AND o_orderkey % 2 = 0) THEN o_custkey END AS displaced_doc_id
    FROM orders WHERE o_orderkey % 3 <> 0""")
def occurrence_merge(spark: SparkSession, sf: str) -> DataFrame:
    return store.merge_occurrences(occurrence(spark, sf, f"{K} % 7 <> 0", "0"), occurrence(spark, sf, f"{K} % 3 <> 0", f"{K} % 2").drop("state"))


@query("""
    SELECT o_orderpriority AS root_id, count_if(o_orderkey % 13 <> 0 AND o_custkey % 4 = 0 AND o_orderkey % 2 = 0) AS n FROM orders GROUP BY 1""")
def active_per_root(spark: SparkSession, sf: str) -> DataFrame:
    active = table(spark, sf, "customer").where("c_custkey % 4 = 0").select(F.col("c_custkey").alias("doc_id"), F.lit(0).cast("bigint").alias("revision_id"))
    return store.active_per_root(occurrence(spark, sf, "true", f"{K} % 2"), active)


@query("""
    WITH o AS (SELECT o_custkey AS doc_id, o_orderpriority AS root_path, CAST(o_orderkey AS VARCHAR) AS relative_path FROM orders WHERE o_orderkey % 13 <> 0 AND o_orderkey % 2 = 0 AND o_orderpriority NOT IN ('5-LOW', '3-MEDIUM'))
    SELECT doc_id, root_path, relative_path FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY root_path, relative_path) AS n FROM o) WHERE n = 1""")
def source_file(spark: SparkSession, sf: str) -> DataFrame:
    roots = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("root_id")).distinct().select("root_id", F.col("root_id").alias("root_path"), (F.col("root_id") != "5-LOW").alias("active"))
    revisions = spark.createDataFrame([(0, "hash")], "revision_id long, content_hash string")
    deleted = spark.createDataFrame([("3-MEDIUM",)], "root_id string")
    return store.source_file(occurrence(spark, sf, "true", f"{K} % 2"), roots, revisions, deleted).select("doc_id", "root_path", "relative_path")


@query("""
    WITH b AS (SELECT o_custkey AS doc_id, min(o_orderkey) AS version_id FROM orders GROUP BY 1), r AS (SELECT doc_id, version_id + 1 AS version_id FROM b WHERE doc_id % 6 = 1)
    SELECT * FROM b WHERE doc_id % 5 <> 0 AND doc_id % 6 <> 1 UNION ALL SELECT * FROM r""")
def projection_delta(spark: SparkSession, sf: str) -> DataFrame:
    base = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("doc_id")).agg(F.min(K).alias("version_id"))
    return store.checked(store.project(base, base.where("doc_id % 5 = 0 AND doc_id % 6 <> 1"), base.where("doc_id % 6 = 1").withColumn("version_id", F.col("version_id") + 1)))


@query("""
    SELECT doc_id, CASE WHEN doc_id % 6 = 1 THEN 'new' ELSE text END AS text FROM documents WHERE doc_id % 5 <> 0 OR doc_id % 6 = 1""")
def publish_incremental(spark: SparkSession, sf: str) -> DataFrame:
    base = table(spark, sf, "documents").select("doc_id", "text")
    return snapshots.incremental(base, base.where("doc_id % 5 = 0"), base.where("doc_id % 6 = 1").withColumn("text", F.lit("new")))


@query("SELECT vec_id AS vector_id FROM embeddings WHERE (vec_id % 4 <> 0 AND vec_id % 5 <> 0) OR vec_id % 6 = 0")
def publish_vectors(spark: SparkSession, sf: str) -> DataFrame:
    base = table(spark, sf, "embeddings").select(F.col("vec_id").alias("vector_id"), F.col("vec_id").alias("doc_id"), F.lit(1).alias("version_id"))
    return snapshots.incremental_vectors(base, base.where("vector_id % 4 <> 0"), base.where("vector_id % 5 = 0"), base.where("vector_id % 6 = 0")).select("vector_id")


@query("SELECT count(*) AS vectors, count_if(vec_id % 4 = 0) AS outside, count_if(vec_id % 7 = 0) AS other_model, count_if(vec_id % 9 = 0) AS other_dimension FROM embeddings")
def publish_vector_check(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), F.lit(1).alias("version_id"), F.when(F.col("vec_id") % 7 == 0, "other").otherwise("m").alias("model_id"), F.when(F.col("vec_id") % 9 == 0, F.slice("embedding", 1, 32)).otherwise(F.col("embedding")).alias("values"))
    return snapshots.vector_violations(rows, rows.where("doc_id % 4 <> 0"), "m", 64)


@query("SELECT CAST(o_orderkey AS VARCHAR) AS generation FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders ORDER BY o_orderkey DESC LIMIT 100) AND o_orderkey % 10 <> 3")
def publish_retention(spark: SparkSession, sf: str) -> DataFrame:
    journal = orders(spark, sf, F.col(K).cast("string").alias("generation"), F.col(K).alias("epoch"))
    return snapshots.retention(journal, 100, journal.where("epoch % 10 = 3"))


@query("""
    SELECT o_custkey AS doc_id, o_orderkey AS version_id, CASE WHEN o_orderkey % 9 = 0 THEN 'not_found' WHEN o_orderkey = (SELECT max(x.o_orderkey) FROM orders x WHERE x.o_custkey = o.o_custkey) THEN 'current' ELSE 'stale' END AS state FROM orders o""")
def selection_resolution(spark: SparkSession, sf: str) -> DataFrame:
    asked = orders(spark, sf, F.col("o_custkey").alias("doc_id"), F.col(K).alias("version_id"))
    return store.resolve_selection(asked, asked.where("version_id % 9 <> 0"), asked.groupBy("doc_id").agg(F.max("version_id").alias("version_id")))


@query("SELECT row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS rank, o_custkey AS doc_id, o_orderkey AS version_id, o_totalprice FROM (SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 256)")
def hydration(spark: SparkSession, sf: str) -> DataFrame:
    active = orders(spark, sf, F.col("o_custkey").alias("doc_id"), F.col(K).alias("version_id"), "o_totalprice")
    from pyspark.sql import Window

    # As many hits as a search may return.
    best = active.orderBy(F.desc("o_totalprice"), "version_id").limit(256)
    keys = best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("o_totalprice"), "version_id"))).select("doc_id", "version_id", "rank")
    return store.hydrate(keys, active).select("rank", "doc_id", "version_id", "o_totalprice")


AUDIT = "o_orderkey AS version_id, o_custkey AS doc_id"


@query("""
    SELECT count(*) AS members, count_if(o_orderkey % 101 = 0) AS wrong_generation, count_if(o_orderkey % 17 = 0) AS unsealed, count_if(o_orderkey % 5 = 0) AS not_admitted, count_if(o_orderkey % 11 = 0) AS unlike_document FROM orders""")
def projection_audit(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col(K)
    projection = orders(spark, sf, k.alias("version_id"), k.alias("doc_id"), F.when(k % 101 == 0, "g0").otherwise("g1").alias("generation"), F.lit("h").alias("content_hash"), k.alias("byte_size"))
    seals = projection.where("version_id % 17 <> 0").select("version_id")
    classes = projection.select("version_id", F.when(F.col("version_id") % 5 == 0, "non_resume").otherwise("resume_candidate").alias("status"))
    documents = projection.select("doc_id", F.when(F.col("doc_id") % 11 == 0, "x").otherwise("h").alias("content_hash"), "byte_size")
    return store.audit_projection(projection, "g1", seals, classes, documents)


@query("""
    SELECT count(*) AS members, min(o_orderkey) = 0 AND max(o_orderkey) + 1 = count(*) AND count(DISTINCT o_orderkey) = count(*) AS gapless, count_if(o_custkey % 3 = 0) + count_if(o_orderkey % 4 = 0) AS violations FROM orders""")
def manifest_check(spark: SparkSession, sf: str) -> DataFrame:
    manifest = orders(spark, sf, F.col(K).alias("ordinal"), F.col("o_custkey").alias("doc_id"), F.col(K).alias("version_id"))
    return store.check_manifest(manifest, {"doc_id": manifest.where("doc_id % 3 <> 0").select("doc_id"), "version_id": manifest.where("version_id % 4 <> 0").select("version_id")})


@query("""
    WITH d AS (SELECT o_custkey AS root_id, o_orderkey AS task_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders WHERE o_orderstatus = 'F')
    SELECT root_id, task_id FROM d WHERE n = 1 AND root_id % 3 <> 0 AND root_id % 7 <> 0 AND root_id NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')""")
def latest_per_group_antijoin(spark: SparkSession, sf: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "P", "running").otherwise("failed")
    tasks = orders(spark, sf, F.col("o_custkey").alias("root_id"), F.col(K).alias("task_id"), status.alias("status"), F.col("o_orderdate").alias("completed_at"))
    roots = table(spark, sf, "customer").select(F.col("c_custkey").alias("root_id"), (F.col("c_custkey") % 3 != 0).alias("active"), (F.col("c_custkey") % 7 == 0).alias("paused"))
    return store.latest_completed(tasks, roots).select("root_id", "task_id")


JOB = "CASE o_orderkey % 5 WHEN 0 THEN 'queued' WHEN 1 THEN 'failed_retryable' WHEN 2 THEN 'running' WHEN 3 THEN 'interrupted' ELSE 'completed' END"


def jobs(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col(K)
    status = F.when(k % 5 == 0, "queued").when(k % 5 == 1, "failed_retryable").when(k % 5 == 2, "running").when(k % 5 == 3, "interrupted").otherwise("completed")
    return orders(spark, sf, k.alias("job_id"), status.alias("status"), (k % 4).alias("attempt_count"), F.lit(3).cast("bigint").alias("max_attempts"), (k * 37 % 1009).alias("queued_at"), (k % 2000).alias("started_at"), F.lit("update_index").alias("kind"))


@query(f"""
    SELECT o_orderkey AS job_id, {JOB} AS status FROM orders WHERE o_orderkey % 5 IN (0, 3) OR (o_orderkey % 5 = 1 AND o_orderkey % 4 < 3) ORDER BY o_orderkey * 37 % 1009, o_orderkey LIMIT 25""")
def job_claim(spark: SparkSession, sf: str) -> DataFrame:
    return store.claimable(jobs(spark, sf), 25).select("job_id", "status")


@query(f"""
    SELECT o_orderkey AS job_id, CASE WHEN o_orderkey % 5 = 2 AND o_orderkey % 2000 <= 1100 THEN CASE WHEN o_orderkey % 4 >= 3 THEN 'failed' ELSE 'interrupted' END ELSE {JOB} END AS status FROM orders""")
def job_recovery(spark: SparkSession, sf: str) -> DataFrame:
    return store.recover_stale(jobs(spark, sf), 2000).select("job_id", "status")


@query(f"""
    SELECT o_orderkey AS job_id, CASE WHEN o_orderkey % 5 = 4 AND o_orderkey % 3 = 0 THEN 'queued' ELSE {JOB} END AS status, CASE WHEN o_orderkey % 5 = 4 AND o_orderkey % 3 = 0 THEN 0 ELSE o_orderkey % 4 END AS attempt_count FROM orders""")
def job_requeue(spark: SparkSession, sf: str) -> DataFrame:
    specs = orders(spark, sf, F.col(K).alias("job_id"), F.when(F.col(K) % 3 == 0, "m").otherwise("n").alias("model_id"), F.lit(64).alias("dimension"))
    return store.requeue_for_model(jobs(spark, sf), specs, "m", 64).select("job_id", "status", "attempt_count")


@query("SELECT o_orderkey AS job_id FROM orders WHERE o_orderkey % 2000 <= 1700")
def job_due(spark: SparkSession, sf: str) -> DataFrame:
    return store.due(jobs(spark, sf), 2000, 300, "started_at").select("job_id")


@query("""
    SELECT o_orderkey AS path, CASE WHEN o_orderkey % 4 = 0 THEN 'new' WHEN o_orderkey % 3 = 0 THEN 'reparse' WHEN o_orderkey % 5 = 0 THEN 'metadata_only' ELSE 'unchanged' END AS decision FROM orders""")
def rerun_decision(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col(K)
    scanned = orders(spark, sf, k.alias("path"), k.cast("string").alias("normalized_path"), F.sha2(k.cast("string"), 256).alias("content_hash"))
    known = scanned.where("path % 4 <> 0").select("content_hash", F.when(F.col("path") % 5 == 0, F.concat(F.lit("old/"), "normalized_path")).otherwise(F.col("normalized_path")).alias("normalized_path"), F.when(F.col("path") % 3 == 0, "p0").otherwise("p1").alias("parse_version"), F.lit("e").alias("classifier_epoch"))
    return store.rerun_decision(scanned, known, "p1", "e").select("path", "decision")


@query("""
    WITH p AS (SELECT c_custkey AS d, c_mktsegment AS name, ['s' || c_nationkey] AS s, ['c' || c_custkey % 40, 'x' || c_custkey % 55] AS c, ['k' || c_custkey % 5, 'k' || c_custkey % 7, 'k' || c_custkey % 11] AS k FROM customer),
    q AS (SELECT a.d AS doc_left, b.d AS doc_right, round(least(0.95, 0.45 + CASE WHEN list_has_any(a.s, b.s) THEN 0.25 ELSE 0 END + CASE WHEN list_has_any(a.c, b.c) THEN 0.2 ELSE 0 END + 0.1 * least(len(list_distinct(list_intersect(a.k, b.k))), 3) / 3), 6) AS score
          FROM p a JOIN p b ON a.name = b.name AND a.d < b.d)
    SELECT * FROM q WHERE score > 0.7""")
def soft_dedupe_pairs(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col("c_custkey")
    named = lambda letter, n: F.concat(F.lit(letter), (c % n).cast("string"))
    profiles = table(spark, sf, "customer").select(c.alias("doc_id"), F.col("c_mktsegment").alias("name"), F.array(F.concat(F.lit("s"), F.col("c_nationkey").cast("string"))).alias("schools"), F.array(named("c", 40), named("x", 55)).alias("companies"), F.array(named("k", 5), named("k", 7), named("k", 11)).alias("skills"))
    return store.soft_duplicates(profiles)


@query("""
    WITH m AS (SELECT DISTINCT l_partkey AS c, l_linenumber AS n, l_orderkey AS version_id FROM lineitem),
    l AS (SELECT version_id, max(n * 10000000 + c) AS d, arg_max(c, n * 10000000 + c) AS c
          FROM m JOIN (SELECT c, n FROM m GROUP BY ALL HAVING count(*) > 1) USING (c, n) GROUP BY version_id),
    s AS (SELECT p_partkey AS c, (p_size % 7 + 1) * 10000000 + p_partkey AS split FROM part WHERE p_size < 25)
    SELECT o_orderkey AS version_id, CASE WHEN d IS NULL THEN 'c' || o_custkey WHEN split > d THEN NULL ELSE 'm' || c END AS candidate_id, d IS NOT NULL AND coalesce(split <= d, true) AS manual
    FROM orders LEFT JOIN l ON o_orderkey = version_id LEFT JOIN s USING (c)""")
def candidate_review(spark: SparkSession, sf: str) -> DataFrame:
    """Orders of a customer are versions of a candidate; the lines of a part are merged into it, small parts are split."""
    name = F.concat(F.lit("m"), F.col("l_partkey").cast("string"))
    merges = table(spark, sf, "lineitem").groupBy("l_partkey", "l_linenumber").agg(F.collect_set("l_orderkey").alias("versions"))
    merges = merges.select((F.col("l_linenumber").cast("long") * 10_000_000 + F.col("l_partkey")).alias("decision_id"), F.lit("merge").alias("kind"), "versions", name.alias("candidate_id"), F.lit(0.9).alias("confidence"))
    parts = table(spark, sf, "part").where("p_size < 25")
    splits = parts.select(((F.col("p_size") % 7 + 1).cast("long") * 10_000_000 + F.col("p_partkey")).alias("decision_id"), F.lit("split").alias("kind"), F.lit(None).cast("array<bigint>").alias("versions"), F.concat(F.lit("m"), F.col("p_partkey").cast("string")).alias("candidate_id"), F.lit(None).cast("double").alias("confidence"))
    versions = orders(spark, sf, F.col(K).alias("version_id"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("candidate_id"))
    return store.reviewed(versions, merges.unionByName(splits))


@query()
def candidate_assignment(spark: SparkSession, sf: str) -> DataFrame:
    """Sequential by contract: e-mails by customer, phones shared by few orders."""
    k = F.col(K)
    contacts = orders(spark, sf, k.cast("string").alias("version_id"), k.alias("committed"), F.when(k % 3 != 0, F.sha2(F.col("o_custkey").cast("string"), 256)).alias("email_hash"), F.when(k % 4 != 0, F.sha2(F.concat(F.lit("p"), (k % 5003).cast("string")), 256)).alias("phone_hash"))
    if spark.sparkContext.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", "") or ""
        if not shared and not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        spark.sparkContext.setCheckpointDir(shared or "file:///tmp/lodestar-checkpoints")
    return store.assign_candidates(contacts)


@query("""
    SELECT c_custkey AS candidate_id, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_orderkey % 3 = 0) AS version_count FROM customer""")
def version_counts(spark: SparkSession, sf: str) -> DataFrame:
    assigned = orders(spark, sf, F.col(K).alias("version_id"), F.col("o_custkey").alias("candidate_id"))
    candidates = table(spark, sf, "customer").select(F.col("c_custkey").alias("candidate_id"), F.lit(0).alias("version_count"))
    return store.version_counts(candidates, assigned, assigned.where("version_id % 3 = 0"))


@query("SELECT DISTINCT sha256(text) AS content_hash FROM documents WHERE source = 'src1' AND sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE source <> 'src1' AND lang <> 'fr')")
def orphaned_contents(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "source", F.sha2("text", 256).alias("content_hash"), (F.col("lang") == "fr").alias("is_deleted"))
    return store.orphaned_contents(docs.where("source = 'src1'"), docs)


@query("""
    SELECT DISTINCT o_custkey AS candidate_id FROM orders WHERE o_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 7 = 0 ORDER BY o_orderkey LIMIT 50)""")
def purge_candidates(spark: SparkSession, sf: str) -> DataFrame:
    docs = orders(spark, sf, F.col(K).alias("doc_id"), (F.col(K) % 7 == 0).alias("is_deleted"), F.col("o_custkey").alias("candidate_id"))
    return store.purge_batch(docs, docs.where("NOT is_deleted"), docs.select("doc_id", "candidate_id"), 50)


@query("SELECT o_orderkey AS doc_id, unnest(range(1, least(3, o_orderkey % 6) + 1)) AS page FROM orders WHERE o_orderstatus = 'O' AND o_orderkey % 6 > 0")
def ocr_pages(spark: SparkSession, sf: str) -> DataFrame:
    docs = orders(spark, sf, F.col(K).alias("doc_id"), F.when(F.col("o_orderstatus") == "O", "ocr_required").otherwise("searchable").alias("status"), (F.col(K) % 6).cast("int").alias("page_count"))
    return store.ocr_pages(docs, True, 3).withColumn("page", F.col("page").cast("long"))


@query("SELECT l_orderkey AS content_hash, l_linenumber AS page FROM lineitem WHERE l_linenumber % 2 = 1")
def ocr_uncached(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("content_hash"), F.col("l_linenumber").alias("page"), F.lit(300).alias("dpi"), F.lit("eng").alias("lang"), F.lit("p").alias("profile"))
    return store.uncached_pages(pages, pages.where("page % 2 = 0")).select("content_hash", "page")


@query("""
    SELECT conv_id AS doc_id, CASE WHEN count(*) <= 6 THEN string_agg(text, chr(10) ORDER BY turn) END AS text, CASE WHEN count(*) <= 6 THEN round(avg(length(text) / 1000.0), 6) END AS confidence FROM conversations GROUP BY conv_id""")
def ocr_combine(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page"), "text", (F.length("text") / 1000.0).alias("confidence"))
    return store.combine_pages(pages, 6)


@query("SELECT o_orderkey, 1000 + 21600 + CAST('0x' || right(sha256(CAST(o_orderkey AS VARCHAR)), 8) AS BIGINT) % 64800 AS due FROM orders")
def audit_jitter(spark: SparkSession, sf: str) -> DataFrame:
    return orders(spark, sf, K, store.audit_due_at(F.sha2(F.col(K).cast("string"), 256), F.lit(1000)).alias("due"))


@query("SELECT o_orderkey AS file_identity FROM orders WHERE o_orderkey % 8 = 0 OR o_orderkey % 5 = 1 OR o_orderkey % 500 <= 50")
def changed_files(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col(K)
    observed = orders(spark, sf, k.alias("file_identity"), (k % 100).alias("byte_size"), F.lit(1).cast("bigint").alias("mtime"), F.lit(1).alias("ctime"))
    last = observed.where("file_identity % 8 <> 0").withColumn("mtime", F.when(F.col("file_identity") % 5 == 1, F.lit(0).cast("bigint")).otherwise(F.col("mtime"))).withColumn("audit_due_at", F.col("file_identity") % 500)
    return store.changed_files(observed, last, 50).select("file_identity")


@query("SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 3 = 0 THEN 'superseded' ELSE 'completed' END AS state FROM orders")
def late_results(spark: SparkSession, sf: str) -> DataFrame:
    results = orders(spark, sf, F.col(K).alias("doc_id"), (F.col(K) % 3).alias("revision_id"))
    now = results.select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.lit(9).cast("bigint")).otherwise(F.col("revision_id")).alias("revision_id"))
    return ingest.current_results(results, now).select("doc_id", "state")


@query("SELECT o_orderkey AS n FROM orders WHERE o_orderkey IN (1, 100, 1000) OR o_orderkey % 1024 = 0")
def flush_points(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.flush_points(orders(spark, sf, F.col(K).alias("n"))).where("flush").select("n")


@query("""
    SELECT * FROM (SELECT url AS path, (SELECT count(*) FROM pages) AS observed, true AS limited FROM pages ORDER BY url LIMIT 20)""")
def scan_budget(spark: SparkSession, sf: str) -> DataFrame:
    return files.within_budget(table(spark, sf, "pages").select(F.col("url").alias("path")), 20)


# Mentions with made-up spans: repeated evidence of different confidence, and more than a document may keep.
EVIDENCE = f"""
    {MENTIONS}, r AS (SELECT doc_id % 12 AS doc_id, entity_type, v AS raw_value, CAST(doc_id % 40 AS INTEGER) AS span_start, CAST(doc_id % 40 + 5 AS INTEGER) AS span_end, round(confidence, 2) AS confidence FROM m)"""


@query(f"""
    WITH {EVIDENCE},
    d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, entity_type, raw_value, span_start, span_end ORDER BY confidence DESC) AS k FROM r) WHERE k = 1),
    t AS (SELECT *, row_number() OVER (PARTITION BY doc_id, entity_type ORDER BY confidence DESC, span_start, span_end, raw_value) AS turn,
          list_position(['name', 'email', 'phone', 'wechat', 'years_experience', 'school', 'school_tier', 'degree', 'major', 'company', 'title', 'location', 'skill', 'certificate', 'date_range'], entity_type) AS slot FROM d),
    k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY turn, slot) AS n FROM t WHERE turn <= 256) WHERE n <= 256)
    SELECT doc_id, entity_type, raw_value, span_start, confidence, row_number() OVER (PARTITION BY doc_id ORDER BY span_start, span_end, slot, raw_value) AS place FROM k""")
def mention_retention_round_robin(spark: SparkSession, sf: str) -> DataFrame:
    d = F.col("doc_id")
    evidence = mentions(spark, sf).select((d % 12).alias("doc_id"), "entity_type", "raw_value", "normalized_value", (d % 40).cast("int").alias("span_start"), (d % 40 + 5).cast("int").alias("span_end"), F.round("confidence", 2).alias("confidence"))
    return extract.retained(evidence).select("doc_id", "entity_type", "raw_value", "span_start", "confidence", "place")


@query(f"""
    WITH {EVIDENCE}, x AS (SELECT doc_id, CASE entity_type WHEN 'title' THEN 'email' WHEN 'location' THEN 'phone' END AS t, raw_value, span_start, confidence FROM r),
    b AS (SELECT *, row_number() OVER (PARTITION BY doc_id, t ORDER BY confidence DESC, span_start, raw_value) AS k FROM x WHERE t IS NOT NULL)
    SELECT doc_id, max(CASE WHEN t = 'email' THEN raw_value END) AS email, max(CASE WHEN t = 'phone' THEN raw_value END) AS phone FROM b WHERE k = 1 GROUP BY doc_id""")
def mention_best_contact(spark: SparkSession, sf: str) -> DataFrame:
    d = F.col("doc_id")
    kind = F.when(F.col("entity_type") == "title", "email").when(F.col("entity_type") == "location", "phone")
    evidence = mentions(spark, sf).select((d % 12).alias("doc_id"), kind.alias("entity_type"), "raw_value", "normalized_value", (d % 40).cast("int").alias("span_start"), F.round("confidence", 2).alias("confidence"))
    return extract.best_contact(evidence)
