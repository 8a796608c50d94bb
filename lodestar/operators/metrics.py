"""Aggregations: counts, summaries, exact percentiles, and evaluation measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Upper bounds of latency histograms, in ms.
BOUNDS = (1, 2, 5, 10, 20, 50, 100, 200, 500, 1000, 2000, 5000)
TOKEN_BUDGETS = (512, 384, 256)
DUPLICATE = 0.70
#: Rows of a task that compares fields.
TASK_ROWS = 500_000


def ratio(a: Column, b: Column) -> Column:
    """0 where there is nothing to divide by."""
    return F.when(b == 0, 0.0).otherwise(a / b)


def type_counts(mentions: DataFrame, key: str = "doc_id") -> DataFrame:
    return mentions.groupBy(key, "entity_type").agg(F.count(F.lit(1)).alias("n"))


def error_breakdown(errors: DataFrame, order: list[str]) -> DataFrame:
    """kind, operation, n, with place: kinds of ``order`` first, in that order, then the others by name."""
    place = F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(k) for k in order]), F.col("kind")), F.lit(0)), F.lit(len(order) + 1))
    return errors.groupBy("kind", "operation").agg(F.count(F.lit(1)).alias("n")).withColumn("place", place.cast("int")).orderBy("place", "kind", "operation")


def status_summary(documents: DataFrame, statuses: list[str], column: str = "status") -> DataFrame:
    """One row: total and the number of each status, in one pass."""
    return documents.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col(column) == s).alias(f"n_{s.lower()}") for s in statuses])


def jobs_without_language(jobs: DataFrame, cache: DataFrame) -> DataFrame:
    """One row: distinct jobs whose content has a page that failed for want of a language."""
    failed = cache.where("error = 'language_unavailable'").select("content_hash")
    return jobs.join(failed, "content_hash", "left_semi").agg(F.countDistinct("job_id").alias("n"))


def class_counts(versions: DataFrame, triage: DataFrame, documents: DataFrame, epoch: str) -> DataFrame:
    """One row of five counts of an epoch; only rows whose hash is their document's now. Failures of both add up."""
    current = documents.select("doc_id", "content_hash")
    v = versions.where(F.col("epoch") == epoch).join(current, ["doc_id", "content_hash"], "left_semi")
    t = triage.where(F.col("epoch") == epoch).join(current, ["doc_id", "content_hash"], "left_semi")
    one = v.agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("resume_candidate", "non_resume", "needs_review", "failed")])
    two = t.agg(F.count_if(F.col("status") == "ocr_backlog").alias("ocr_backlog"), F.count_if(F.col("status") == "failed").alias("_failed"))
    return one.crossJoin(F.broadcast(two)).select("resume_candidate", "non_resume", "needs_review", "ocr_backlog", (F.col("failed") + F.col("_failed")).alias("failed"))


def class_counts_per_root(occurrences: DataFrame, classes: DataFrame, triage: DataFrame) -> DataFrame:
    """root_id and counts of its present documents by class; a document failed if either table says so."""
    c = classes.groupBy("doc_id").agg(*[F.max(F.col("status") == s).alias(s) for s in ("resume_candidate", "non_resume", "needs_review", "failed")])
    t = triage.groupBy("doc_id").agg(F.max(F.col("status") == "ocr_backlog").alias("ocr_backlog"), F.max(F.col("status") == "failed").alias("_failed"))
    joined = occurrences.where("state = 'present'").join(c, "doc_id", "left").join(t, "doc_id", "left")
    failed = F.coalesce("failed", F.lit(False)) | F.coalesce("_failed", F.lit(False))
    return joined.groupBy("root_id").agg(*[F.count_if(F.col(s)).alias(s) for s in ("resume_candidate", "non_resume", "needs_review", "ocr_backlog")], F.count_if(failed).alias("failed"))


def nearest_rank(values: DataFrame, column: str, percents: list[int], *keys: str) -> DataFrame:
    """keys, p<percent>...: the value at rank ceil(p * n / 100), never interpolated.

    Values are counted first. They fall into buckets in order, by power of two and 4096 steps in it; running counts over
    buckets find the one that holds a rank, and running counts over its values the value. So no task orders all values of
    a group, however many are distinct. Infinities are below and above all numbers, and NaN is above these.
    """
    x = F.col(column).cast("double")
    special = F.isnan(x) | (F.abs(x) == float("inf"))
    power = F.when((x == 0) | special, 0).otherwise(F.floor(F.log2(F.abs(x))))
    end = F.when(F.isnan(x), 20_000).when(x > 0, 10_000).otherwise(-10_000)
    counted = values.where(F.col(column).isNotNull()).groupBy(*keys, column).agg(F.count(F.lit(1)).alias("_n"))
    counted = counted.withColumn("_power", F.when(special, end).when(x > 0, 5000 + power).when(x < 0, -5000 - power).otherwise(0)).withColumn("_step", F.when(special, 0).otherwise(F.floor(x / F.pow(F.lit(2.0), power) * 4096)))
    place = ["_power", "_step"]
    sums = counted.groupBy(*keys, *place).agg(F.sum("_n").alias("_n"))
    by = Window.partitionBy(*keys)
    upto = sums.withColumn("_upto", F.sum("_n").over(by.orderBy(*place).rowsBetween(Window.unboundedPreceding, 0))).withColumn("_total", F.sum("_n").over(by))
    ranked = upto.withColumn("_percent", F.explode(F.array(*[F.lit(p) for p in percents]))).withColumn("_rank", F.greatest(F.lit(1), F.ceil(F.col("_total") * F.col("_percent") / 100)))
    hit = ranked.where((F.col("_rank") <= F.col("_upto")) & (F.col("_rank") > F.col("_upto") - F.col("_n")))
    # Null keys are groups too.
    sought = hit.select(*[F.col(k).alias(f"_of_{k}") for k in keys], *[F.col(c).alias(f"_of{c}") for c in place], "_percent", (F.col("_rank") - (F.col("_upto") - F.col("_n"))).alias("_rank"))
    same = F.lit(True)
    for k in keys:
        same = same & counted[k].eqNullSafe(sought[f"_of_{k}"])
    found = counted.join(sought, same & (F.col("_power") == F.col("_of_power")) & (F.col("_step").eqNullSafe(F.col("_of_step"))))
    inside = Window.partitionBy(*keys, "_percent").orderBy(column).rowsBetween(Window.unboundedPreceding, 0)
    reached = found.withColumn("_upto", F.sum("_n").over(inside)).where(F.col("_upto") >= F.col("_rank"))
    return reached.groupBy(*keys).agg(*[F.min(F.when(F.col("_percent") == p, F.col(column))).alias(f"p{p}") for p in percents])


def latency_summary(samples: DataFrame, column: str, *keys: str) -> DataFrame:
    """n, min, mean, p50, p95, p99, max."""
    simple = samples.where(F.col(column).isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min(column).alias("min"), F.round(F.avg(column), 6).alias("mean"), F.max(column).alias("max"))
    ranks = nearest_rank(samples, column, [50, 95, 99], *keys)
    return simple.join(ranks, list(keys)) if keys else simple.crossJoin(F.broadcast(ranks))


def cumulative_histogram(samples: DataFrame, column: str, bounds: tuple[float, ...], *keys: str) -> DataFrame:
    """le_<bound>...: values up to each bound; over: values above all."""
    c = F.col(column)
    return samples.groupBy(*keys).agg(*[F.count_if(c <= b).alias(f"le_{b}") for b in bounds], F.count_if(c > bounds[-1]).alias("over"))


def first_bound_histogram(samples: DataFrame, column: str, bounds: tuple[float, ...], *keys: str) -> DataFrame:
    """keys, bound (null above all), n: each value counts at the first bound it does not exceed."""
    bound = F.coalesce(*[F.when(F.col(column) <= b, F.lit(float(b))) for b in bounds], F.lit(None).cast("double"))
    return samples.where(F.col(column).isNotNull()).groupBy(*keys, bound.alias("bound")).agg(F.count(F.lit(1)).alias("n"))


def field_scores(expected: DataFrame, found: DataFrame) -> DataFrame:
    """field, tp, fp, fn, precision, recall, f1, and a row ``overall``: multisets of (doc_id, field, value) compared.

    Both sides are counted in one aggregation, dealt over tasks of about TASK_ROWS rows: what a task holds doesn't grow with
    the tables. The rows are counted first.
    """
    keys = ["doc_id", "field", "value"]
    some_null = F.coalesce(*[F.when(F.col(k).isNull(), True) for k in keys])
    # Nulls equal nothing, so what has one is counted apart on each side.
    side = lambda df, e, f: df.select(*keys, F.when(some_null, e).alias("apart"), F.lit(e).alias("e"), F.lit(f).alias("f"))
    parts = max(expected.sparkSession.sparkContext.defaultParallelism, -(-(expected.count() + found.count()) // TASK_ROWS))
    dealt = side(expected, 1, 0).unionByName(side(found, 0, 1)).repartition(parts, *keys)
    both = dealt.groupBy(*keys, "apart").agg(F.sum("e").alias("e"), F.sum("f").alias("f"))
    tp, fp, fn = F.least("e", "f"), F.greatest(F.col("f") - F.col("e"), F.lit(0)), F.greatest(F.col("e") - F.col("f"), F.lit(0))
    sums = [F.sum(tp).alias("tp"), F.sum(fp).alias("fp"), F.sum(fn).alias("fn")]
    rows = both.groupBy("field").agg(*sums)
    whole = rows.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "fp", "fn")]).select(F.lit("overall").alias("field"), "tp", "fp", "fn")
    return with_f1(rows.unionByName(whole))


def with_f1(counts: DataFrame) -> DataFrame:
    tp, fp, fn = (F.col(c) for c in ("tp", "fp", "fn"))
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return counts.withColumns({"precision": F.round(p, 6), "recall": F.round(r, 6), "f1": F.round(ratio(2 * p * r, p + r), 6)})


def duplicate_confusion(pairs: DataFrame) -> DataFrame:
    """One row: tp, fp, fn, tn, precision, recall, f1 of pairs (score, duplicate)."""
    said, true = F.coalesce(F.col("score") >= DUPLICATE, F.lit(False)), F.col("duplicate")
    return with_f1(pairs.agg(F.count_if(said & true).alias("tp"), F.count_if(said & ~true).alias("fp"), F.count_if(~said & true).alias("fn"), F.count_if(~said & ~true).alias("tn")))


def ranking_scores(candidates: DataFrame, k: int) -> DataFrame:
    """One row: queries, recall, mrr, ndcg, zero_recall from (query_id, position, score, relevant).

    Candidates are ranked by score, then position. Recall and nDCG are at k, the reciprocal rank over the full list;
    means are over queries.
    """
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "position"))
    ranked = candidates.withColumn("rank", rank)
    near = F.col("relevant") & (F.col("rank") <= k)
    one = ranked.groupBy("query_id").agg(
        F.count_if("relevant").alias("relevant"),
        F.count_if(near).alias("hits"),
        F.min(F.when(F.col("relevant"), F.col("rank"))).alias("first"),
        F.coalesce(F.sum(F.when(near, 1 / F.log2(F.col("rank") + 1))), F.lit(0.0)).alias("dcg"),
    )
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.col("relevant").cast("int"), F.lit(k)))), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    mean = lambda c: F.round(F.coalesce(F.avg(c), F.lit(0.0)), 6)
    return one.agg(
        F.count(F.lit(1)).alias("queries"),
        mean(ratio(F.col("hits"), F.col("relevant"))).alias("recall"),
        mean(F.coalesce(1 / F.col("first"), F.lit(0.0))).alias("mrr"),
        mean(F.when(F.col("relevant") == 0, 0.0).otherwise(F.col("dcg") / ideal)).alias("ndcg"),
        F.count_if(F.col("hits") == 0).alias("zero_recall"),
    )


def index_quality(rows: DataFrame) -> DataFrame:
    """One row: precision and completeness of what is indexed, from (indexed, truth) flags."""
    true = F.col("indexed") & F.col("truth")
    return rows.agg(F.round(ratio(F.count_if(true), F.count_if("indexed")), 6).alias("precision"), F.round(ratio(F.count_if(true), F.count_if("truth")), 6).alias("completeness"))


def throughput(n: Column, bytes_: Column, seconds: Column) -> tuple[Column, Column]:
    """Documents and MiB per second."""
    return ratio(n, seconds), ratio(bytes_ / 1048576, seconds)


def token_observation(lengths: DataFrame, budget: int) -> DataFrame:
    """One row for a token budget: texts, tokens, p50, p95, bounded work, texts above, share of work saved."""
    t = F.col("tokens")
    sums = lengths.agg(F.count(F.lit(1)).alias("texts"), F.sum(t).alias("tokens"), F.sum(F.least(t, F.lit(budget))).alias("bounded"), F.count_if(t > budget).alias("above"))
    ranks = nearest_rank(lengths, "tokens", [50, 95])
    return sums.crossJoin(F.broadcast(ranks)).select(F.lit(budget).alias("budget"), "texts", "tokens", "p50", "p95", "bounded", "above", F.round(1 - ratio(F.col("bounded"), F.col("tokens")), 6).alias("saved"))


def section_coverage(sections: DataFrame, budget: int) -> DataFrame:
    """coverage, n: how much of each section (doc_id, order_no, tokens) lies within the first ``budget`` tokens."""
    end = F.sum("tokens").over(Window.partitionBy("doc_id").orderBy("order_no").rowsBetween(Window.unboundedPreceding, 0))
    placed = sections.withColumn("_end", end).withColumn("_start", end - F.col("tokens"))
    what = F.when(F.col("tokens") == 0, "empty").when(F.col("_end") <= budget, "full").when(F.col("_start") < budget, "partial").otherwise("none")
    return placed.groupBy(what.alias("coverage")).agg(F.count(F.lit(1)).alias("n"))


def load_report(samples: DataFrame) -> DataFrame:
    """target, n, achieved, overloaded, arrival_p95, service_p95, unattributed of each load point.

    samples: target, scheduled, started, completed (ms), stages (ms, summed), overload. Latency from arrival counts from
    the schedule, so waiting is in it; unattributed is service time that no stage explains.
    """
    arrival, service = F.col("completed") - F.col("scheduled"), F.col("completed") - F.col("started")
    rows = samples.select("target", "overload", "scheduled", "completed", arrival.alias("arrival"), service.alias("service"), F.greatest(service - F.col("stages"), F.lit(0)).alias("unattributed"))
    span = (F.max("completed") - F.min("scheduled")) / 1000
    sums = rows.groupBy("target").agg(F.count(F.lit(1)).alias("n"), F.round(F.count(F.lit(1)) / span, 6).alias("achieved"), F.count_if("overload").alias("overloaded"), F.sum("unattributed").alias("unattributed"))
    a = nearest_rank(rows, "arrival", [95], "target").withColumnRenamed("p95", "arrival_p95")
    s = nearest_rank(rows, "service", [95], "target").withColumnRenamed("p95", "service_p95")
    return sums.join(a, "target").join(s, "target")


def stable_capacity(report: DataFrame) -> DataFrame:
    """One row: the largest target that was met without overload and in time."""
    good = (F.col("overloaded") == 0) & (F.col("achieved") >= 0.95 * F.col("target")) & (F.col("arrival_p95") <= 1500)
    return report.agg(F.max(F.when(good, F.col("target"))).alias("capacity"))


def run_variance(runs: DataFrame, column: str, *keys: str) -> DataFrame:
    """keys, n, mean, cv_percent, range_percent, median (the lower one), worst over the valid runs."""
    valid = runs.where("valid")
    c = F.col(column)
    mean = F.avg(c)
    sums = valid.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.round(mean, 6).alias("mean"), F.round(100 * ratio(F.stddev_pop(c), mean), 6).alias("cv_percent"), F.round(100 * ratio(F.max(c) - F.min(c), mean), 6).alias("range_percent"), F.max(c).alias("worst"))
    return sums.join(nearest_rank(valid, column, [50], *keys).withColumnRenamed("p50", "median"), list(keys))


def stratified_holdout(rows: DataFrame, stratum: str, order: Column, percent: int) -> DataFrame:
    """Rows held out: of each stratum, in ``order`` (a keyed hash), the first max(1, round(n * percent / 100)).

    A stratum of one row gives none. Halves round to the even number. Rows are counted by the first four characters of
    the hash: all below the bucket in which a stratum's share ends are taken, and only within that one are rows ordered.
    """
    keyed = rows.withColumn("_order", order.cast("string")).withColumn("_bucket", F.substring("_order", 1, 4))
    counts = keyed.groupBy(stratum, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    by = Window.partitionBy(stratum)
    before = counts.withColumn("_before", F.sum("_n").over(by.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).withColumn("_total", F.sum("_n").over(by))
    most = F.greatest(F.lit(1), F.bround(F.col("_total") * percent / 100))
    left = before.where(F.col("_total") > 1).withColumn("_left", most - F.col("_before")).where("_left > 0").select(F.col(stratum).alias("_stratum"), F.col("_bucket").alias("_of"), "_n", "_left")
    near = keyed.join(left, keyed[stratum].eqNullSafe(left["_stratum"]) & (keyed["_bucket"] == left["_of"]))
    last = Window.partitionBy(stratum, "_bucket").orderBy("_order")
    partial = near.where(F.col("_left") < F.col("_n")).withColumn("_place", F.row_number().over(last)).where(F.col("_place") <= F.col("_left"))
    return near.where(F.col("_left") >= F.col("_n")).select(*rows.columns).unionByName(partial.select(*rows.columns))
