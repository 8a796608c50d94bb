"""Queries of counts, percentiles, evaluation measures and load reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.operators import metrics
from lodestar.plans.registry import query, table
from lodestar.plans.retrieval_queries import MENTIONS, mentions

RANK = "ceil(n * {p} / 100)"


def nearest_sql(source: str, value: str, key: str, percents: tuple[int, ...]) -> str:
    """Ordered rows and their numbers, for the value at rank ceil(p * n / 100)."""
    picks = ", ".join(f"min(CASE WHEN i >= greatest(1, ceil(n * {p} / 100)) THEN v END) AS p{p}" for p in percents)
    return f"(SELECT {key}, {picks} FROM (SELECT {key}, {value} AS v, row_number() OVER (PARTITION BY {key} ORDER BY {value}) AS i, count(*) OVER (PARTITION BY {key}) AS n FROM {source} WHERE {value} IS NOT NULL) GROUP BY {key})"


@query(f"WITH {MENTIONS} SELECT doc_id, entity_type, count(*) AS n FROM m GROUP BY ALL")
def entity_type_counts(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.type_counts(mentions(spark, sf))


@query("""
    SELECT event_type AS kind, CAST(user_id % 3 AS VARCHAR) AS operation, count(*) AS n, CAST(coalesce(nullif(list_position(['purchase', 'click'], event_type), 0), 3) AS INTEGER) AS place
    FROM events GROUP BY ALL""")
def error_breakdown(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").select(F.col("event_type").alias("kind"), (F.col("user_id") % 3).cast("string").alias("operation"))
    return metrics.error_breakdown(rows, ["purchase", "click"])


@query("""
    SELECT count(*) AS total, count_if(o_orderstatus = 'F') AS n_f, count_if(o_orderstatus = 'O') AS n_o, count_if(o_orderstatus = 'P') AS n_p FROM orders""")
def status_summary(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.status_summary(table(spark, sf, "orders"), ["F", "O", "P"], "o_orderstatus")


@query("""
    SELECT count(DISTINCT o_orderkey) AS n FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')""")
def jobs_without_language(spark: SparkSession, sf: str) -> DataFrame:
    jobs = table(spark, sf, "orders").select(F.col("o_orderkey").alias("job_id"), F.col("o_orderkey").alias("content_hash"))
    cache = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("content_hash"), F.when(F.col("l_returnflag") == "R", "language_unavailable").alias("error"))
    return metrics.jobs_without_language(jobs, cache)


CLASS_OF = "CASE doc_id % 5 WHEN 0 THEN 'resume_candidate' WHEN 1 THEN 'non_resume' WHEN 2 THEN 'needs_review' ELSE 'failed' END"


def classes(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Versions, triage and documents by rules over the documents table; every ninth hash is an old one."""
    docs = table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("content_hash"))
    old = F.when(F.col("doc_id") % 9 == 0, F.lit("old")).otherwise(F.col("content_hash")).alias("content_hash")
    d = F.col("doc_id") % 5
    versions = docs.select("doc_id", old, F.lit("v4").alias("epoch"), F.when(d == 0, "resume_candidate").when(d == 1, "non_resume").when(d == 2, "needs_review").otherwise("failed").alias("status"))
    triage = docs.where("doc_id % 3 = 0").select("doc_id", old, F.lit("v4").alias("epoch"), F.when(F.col("doc_id") % 2 == 0, "ocr_backlog").otherwise("failed").alias("status"))
    return versions, triage, docs


@query(f"""
    WITH v AS (SELECT doc_id, {CLASS_OF} AS s FROM documents WHERE doc_id % 9 <> 0)
    SELECT count_if(s = 'resume_candidate') AS resume_candidate, count_if(s = 'non_resume') AS non_resume, count_if(s = 'needs_review') AS needs_review,
           count_if(doc_id % 3 = 0 AND doc_id % 2 = 0) AS ocr_backlog, count_if(s = 'failed') + count_if(doc_id % 3 = 0 AND doc_id % 2 = 1) AS failed FROM v""")
def class_counts(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.class_counts(*classes(spark, sf), "v4")


@query(f"""
    WITH v AS (SELECT doc_id, source, {CLASS_OF} AS s FROM documents)
    SELECT source AS root_id, count_if(s = 'resume_candidate') AS resume_candidate, count_if(s = 'non_resume') AS non_resume, count_if(s = 'needs_review') AS needs_review,
           count_if(doc_id % 3 = 0 AND doc_id % 2 = 0) AS ocr_backlog, count_if(s = 'failed' OR (doc_id % 3 = 0 AND doc_id % 2 = 1)) AS failed FROM v GROUP BY source""")
def class_counts_per_root(spark: SparkSession, sf: str) -> DataFrame:
    versions, triage, _ = classes(spark, sf)
    occurrences = table(spark, sf, "documents").select("doc_id", F.col("source").alias("root_id"), F.lit("present").alias("state"))
    return metrics.class_counts_per_root(occurrences, versions, triage)


@query("SELECT event_type, p50, p95, p99 FROM " + nearest_sql("events", "value", "event_type", (50, 95, 99)))
def latency_nearest_rank(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.nearest_rank(table(spark, sf, "events"), "value", [50, 95, 99], "event_type")


@query("""
    SELECT event_type, n, lo AS "min", mean, hi AS "max", p50, p95, p99 FROM (SELECT event_type, count(value) AS n, min(value) AS lo, round(avg(value), 6) AS mean, max(value) AS hi FROM events GROUP BY 1)
    JOIN """ + nearest_sql("events", "value", "event_type", (50, 95, 99)) + " USING (event_type)")
def latency_summary(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.latency_summary(table(spark, sf, "events"), "value", "event_type")


@query("""
    SELECT event_type, count_if(value <= 10) AS le_10, count_if(value <= 50) AS le_50, count_if(value <= 100) AS le_100, count_if(value > 100) AS "over" FROM events GROUP BY 1""")
def latency_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.cumulative_histogram(table(spark, sf, "events"), "value", (10, 50, 100), "event_type")


@query("""
    SELECT event_type, CASE WHEN value <= 10 THEN 10.0 WHEN value <= 50 THEN 50.0 WHEN value <= 100 THEN 100.0 END AS bound, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY ALL""")
def latency_first_bound(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.first_bound_histogram(table(spark, sf, "events"), "value", (10, 50, 100), "event_type")


F1 = """CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END, 6) AS f1"""
RATIOS = "CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END AS p, CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END AS r"


@query(f"""
    WITH e AS (SELECT l_orderkey AS doc_id, l_returnflag AS field, l_suppkey % 7 AS value, count(*) AS e FROM lineitem GROUP BY ALL),
    f AS (SELECT l_orderkey AS doc_id, l_returnflag AS field, l_suppkey % 5 AS value, count(*) AS f FROM lineitem WHERE l_linenumber <> 2 GROUP BY ALL),
    b AS (SELECT field, coalesce(e, 0) AS e, coalesce(f, 0) AS f FROM e FULL JOIN f USING (doc_id, field, value)),
    c AS (SELECT field, sum(least(e, f)) AS tp, sum(greatest(f - e, 0)) AS fp, sum(greatest(e - f, 0)) AS fn FROM b GROUP BY field),
    u AS (SELECT * FROM c UNION ALL SELECT 'overall', sum(tp), sum(fp), sum(fn) FROM c)
    SELECT field, {F1} FROM (SELECT *, {RATIOS} FROM u)""")
def eval_prf1(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem")
    of = lambda df, n: df.select(F.col("l_orderkey").alias("doc_id"), F.col("l_returnflag").alias("field"), (F.col("l_suppkey") % n).alias("value"))
    return metrics.field_scores(of(rows, 7), of(rows.where("l_linenumber <> 2"), 5))


@query(f"""
    WITH c AS (SELECT count_if(s AND d) AS tp, count_if(s AND NOT d) AS fp, count_if(NOT s AND d) AS fn, count_if(NOT s AND NOT d) AS tn FROM (SELECT coalesce(value / 100 >= 0.7, false) AS s, user_id % 3 = 0 AS d FROM events))
    SELECT {F1}, tn FROM (SELECT *, {RATIOS} FROM c)""")
def eval_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.duplicate_confusion(table(spark, sf, "events").select((F.col("value") / 100).alias("score"), (F.col("user_id") % 3 == 0).alias("duplicate")))


@query("""
    WITH r AS (SELECT user_id, event_type = 'purchase' AS rel, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS k FROM events),
    q AS (SELECT user_id, count_if(rel) AS n, count_if(rel AND k <= 5) AS h, min(CASE WHEN rel THEN k END) AS f, coalesce(sum(CASE WHEN rel AND k <= 5 THEN 1 / log2(k + 1) END), 0) AS dcg FROM r GROUP BY 1)
    SELECT count(*) AS queries, round(avg(CASE WHEN n = 0 THEN 0 ELSE h / n END), 6) AS recall, round(avg(coalesce(1 / f, 0)), 6) AS mrr,
           round(avg(CASE WHEN n = 0 THEN 0 ELSE dcg / (SELECT sum(1 / log2(i + 1)) FROM range(1, CAST(least(n, 5) AS BIGINT) + 1) t(i)) END), 6) AS ndcg, count_if(h = 0) AS zero_recall FROM q""")
def eval_rank_metrics(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").select(F.col("user_id").alias("query_id"), F.col("event_id").alias("position"), F.col("value").alias("score"), (F.col("event_type") == "purchase").alias("relevant"))
    return metrics.ranking_scores(rows, 5)


@query("""
    SELECT round(count_if(quality = 1 AND toxic = 0) / count_if(quality = 1), 6) AS precision, round(count_if(quality = 1 AND toxic = 0) / count_if(toxic = 0), 6) AS completeness FROM labels""")
def eval_index_quality(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.index_quality(table(spark, sf, "labels").select((F.col("quality") == 1).alias("indexed"), (F.col("toxic") == 0).alias("truth")))


LENGTHS = r"(SELECT 1 AS k, len(regexp_extract_all(text, '[^\s]+')) AS tokens FROM documents)"


@query(f"""
    SELECT 384 AS budget, texts, CAST(t AS BIGINT) AS tokens, p50, p95, CAST(b AS BIGINT) AS bounded, a AS above, round(1 - b / t, 6) AS saved
    FROM (SELECT 1 AS k, count(*) AS texts, sum(tokens) AS t, sum(least(tokens, 384)) AS b, count_if(tokens > 384) AS a FROM {LENGTHS}) JOIN {nearest_sql(LENGTHS, "tokens", "k", (50, 95))} USING (k)""")
def token_budget(spark: SparkSession, sf: str) -> DataFrame:
    lengths = table(spark, sf, "documents").select(F.regexp_count("text", F.lit(r"[^\s]+")).cast("long").alias("tokens"))
    return metrics.token_observation(lengths, 384)


@query(r"""
    WITH t AS (SELECT conv_id, turn, len(regexp_extract_all(text, '[^\s]+')) AS n FROM conversations),
    e AS (SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS e FROM t)
    SELECT CASE WHEN n = 0 THEN 'empty' WHEN e <= 256 THEN 'full' WHEN e - n < 256 THEN 'partial' ELSE 'none' END AS coverage, count(*) AS n FROM e GROUP BY 1""")
def token_section_coverage(spark: SparkSession, sf: str) -> DataFrame:
    sections = table(spark, sf, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("order_no"), F.regexp_count("text", F.lit(r"[^\s]+")).cast("long").alias("tokens"))
    return metrics.section_coverage(sections, 256)


LOAD = """
    l AS (SELECT 30 + 40 * (l_suppkey % 3) AS target, l_linenumber % 997 = 0 AS overload, l_orderkey * 10 AS scheduled, l_orderkey * 10 + l_linenumber AS started,
          l_orderkey * 10 + l_linenumber + l_partkey % 400 AS completed, l_partkey % 300 AS stages FROM lineitem),
    a AS (SELECT *, completed - scheduled AS arrival, completed - started AS service FROM l)"""


def load_samples(spark: SparkSession, sf: str) -> DataFrame:
    at = F.col("l_orderkey") * 10
    return table(spark, sf, "lineitem").select(
        (30 + 40 * (F.col("l_suppkey") % 3)).alias("target"), (F.col("l_linenumber") % 997 == 0).alias("overload"), at.alias("scheduled"), (at + F.col("l_linenumber")).alias("started"),
        (at + F.col("l_linenumber") + F.col("l_partkey") % 400).alias("completed"), (F.col("l_partkey") % 300).alias("stages"))


REPORT = f"""
    r AS (SELECT target, count(*) AS n, round(count(*) / ((max(completed) - min(scheduled)) / 1000), 6) AS achieved, count_if(overload) AS overloaded, CAST(sum(greatest(service - stages, 0)) AS BIGINT) AS unattributed FROM a GROUP BY 1),
    f AS (SELECT r.*, x.p95 AS arrival_p95, y.p95 AS service_p95 FROM r JOIN {nearest_sql("a", "arrival", "target", (95,))} x USING (target) JOIN {nearest_sql("a", "service", "target", (95,))} y USING (target))"""


@query(f"WITH {LOAD}, {REPORT} SELECT * FROM f")
def load_report(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.load_report(load_samples(spark, sf))


@query(f"WITH {LOAD}, {REPORT} SELECT max(CASE WHEN overloaded = 0 AND achieved >= 0.95 * target AND arrival_p95 <= 1500 THEN target END) AS capacity FROM f")
def load_capacity(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.stable_capacity(metrics.load_report(load_samples(spark, sf)))


@query(f"""
    WITH v AS (SELECT o_orderpriority AS run, o_totalprice AS x FROM orders WHERE o_orderstatus <> 'P')
    SELECT run, n, mean, cv_percent, range_percent, p50 AS median, worst FROM (
      SELECT run, count(*) AS n, round(avg(x), 6) AS mean, round(100 * stddev_pop(x) / avg(x), 6) AS cv_percent, round(100 * (max(x) - min(x)) / avg(x), 6) AS range_percent, max(x) AS worst FROM v GROUP BY 1)
    JOIN {nearest_sql("v", "x", "run", (50,))} USING (run)""")
def run_variance(spark: SparkSession, sf: str) -> DataFrame:
    runs = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("run"), F.col("o_totalprice").alias("x"), (F.col("o_orderstatus") != "P").alias("valid"))
    return metrics.run_variance(runs, "x", "run")


@query("""
    WITH p AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY sha256('key' || CAST(doc_id AS VARCHAR))) AS k, count(*) OVER (PARTITION BY source) AS n FROM documents)
    SELECT doc_id, source FROM p WHERE n > 1 AND k <= greatest(1, round_even(n * 15 / 100, 0))""")
def stratified_holdout(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "source")
    return metrics.stratified_holdout(docs, "source", F.sha2(F.concat(F.lit("key"), F.col("doc_id").cast("string")), 256), 15)


@query("""
    SELECT lang, round(count(*) / 7.5, 6) AS docs_per_second, round(sum(octet_length(encode(text))) / 1048576 / 7.5, 6) AS mib_per_second FROM documents GROUP BY lang""")
def throughput(spark: SparkSession, sf: str) -> DataFrame:
    docs, mib = metrics.throughput(F.count(F.lit(1)), F.sum(F.octet_length("text")), F.lit(7.5))
    return table(spark, sf, "documents").groupBy("lang").agg(F.round(docs, 6).alias("docs_per_second"), F.round(mib, 6).alias("mib_per_second"))
