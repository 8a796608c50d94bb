"""Explainable classification of documents, and deterministic vectors for tests."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions.ids import fnv1a
from lodestar.functions.text import ascii_lower, let

MOST_REASONS = 8
# Headings and phrases of each signal.
PROFILE = ("profile", "summary", "professional summary", "个人简介")
EXPERIENCE = ("experience", "work experience", "professional experience", "工作经历")
EDUCATION = ("education", "education background", "教育经历", "教育背景")
SKILLS = ("skills", "technical skills", "技能", "专业技能")
INVOICE = ("invoice", "tax invoice", "发票", "账单")
MEETING = ("meeting notes", "meeting minutes", "会议纪要", "会议记录")
MANUAL = ("device manual", "user manual", "设备手册")
INVOICE_TERMS = ("subtotal", "payment terms", "amount due", "invoice number", "税额", "应付金额")
MEETING_TERMS = ("agenda", "action items", "meeting minutes", "decision to", "议程", "行动项")
MANUAL_TERMS = ("maintenance", "safety", "startup", "connect the cable", "installation steps", "troubleshooting", "维护", "安全指南")
ACTIONS = (
    "achieved", "analyzed", "architected", "automated", "built", "collaborated", "conducted", "coordinated", "created", "delivered", "deployed",
    "designed", "developed", "engineered", "established", "implemented", "improved", "increased", "launched", "led", "maintained", "managed",
    "operated", "optimized", "owned", "reduced", "resolved", "streamlined", "supported",
)
ACTIONS_ZH = (
    "主导", "参与", "协助", "完成", "搭建", "推动", "构建", "管理", "设计", "负责", "开发", "实现", "优化", "维护", "制定", "提升", "分析", "招聘", "建立", "编写", "测试", "运营", "组织", "销售",
    "监控", "执行", "担任", "获得", "降低", "协调", "培训",
)
POSITIVE = ("profile_heading", "experience_heading", "education_heading", "skills_heading", "career_history_detail")
NEGATIVE = ("invoice_heading", "invoice_terms", "meeting_heading", "meeting_workflow", "manual_heading", "manual_instructions")


def heading_text(line: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(F.trim(line), "[:：]+$", "")))


def at_least(text: Column, phrases: tuple[str, ...], least: int) -> Column:
    return sum((text.contains(p).cast("int") for p in phrases), F.lit(0)) >= least


def begins_with_action(line: Column) -> Column:
    bare = F.lower(F.regexp_replace(line, r"^[\p{Z}\s\-*•·]+", ""))
    return F.regexp_extract(bare, r"^[\p{L}\p{N}]+", 0).isin(*ACTIONS) | bare.rlike("^(?:" + "|".join(ACTIONS_ZH) + ")")


def history_detail(lines: Column) -> Column:
    """Whether a line of the experience section, before its boundary, begins with an action verb.

    One fold over the lines: 0 before the section, 1 inside, 2 after it, 3 found.
    """

    def step(state: Column, line: Column) -> Column:
        head = heading_text(line)
        boundary = head.isin(*PROFILE, *EDUCATION, *SKILLS) | ((F.length(head) <= 40) & line.rlike("[A-Za-z]") & ~line.rlike("[a-z]"))
        inside = F.when(boundary, 2).when(begins_with_action(line), 3).otherwise(1)
        return F.when(state >= 2, state).when(head.isin(*EXPERIENCE), 1).when(state == 1, inside).otherwise(state)

    return F.aggregate(lines, F.lit(0), step) == 3


def signals(text: Column) -> Column:
    """A struct of all signals. Lines, their heading forms and the lower-cased text are computed once each."""

    def of(lines: Column, heads: Column, low: Column) -> Column:
        has = lambda words: F.exists(heads, lambda h: h.isin(*words))
        return F.struct(
            has(PROFILE).alias("profile_heading"),
            has(EXPERIENCE).alias("experience_heading"),
            has(EDUCATION).alias("education_heading"),
            has(SKILLS).alias("skills_heading"),
            # The fold over lines is needed only where there is an experience section.
            F.when(has(EXPERIENCE), history_detail(lines)).otherwise(False).alias("career_history_detail"),
            has(INVOICE).alias("invoice_heading"),
            at_least(low, INVOICE_TERMS, 2).alias("invoice_terms"),
            has(MEETING).alias("meeting_heading"),
            at_least(low, MEETING_TERMS, 2).alias("meeting_workflow"),
            has(MANUAL).alias("manual_heading"),
            at_least(low, MANUAL_TERMS, 2).alias("manual_instructions"),
        )

    return let(F.split(text, r"\r?\n", -1), lambda lines: let(F.transform(lines, heading_text), lambda heads: let(F.lower(text), lambda low: of(lines, heads, low))))


def classify(texts: DataFrame, text: str = "text", outcome: str | None = None) -> DataFrame:
    """Adds status, reasons and the numbers of positive and negative signals.

    ``outcome`` names a column with the parser's outcome: ``ocr_required`` and ``failed`` decide by themselves. A null
    or blank text fails.
    """
    c = F.col
    flagged = texts.select("*", signals(c(text)).alias("_s"))
    s = {k: F.coalesce(c("_s")[k], F.lit(False)) for k in (*POSITIVE, *NEGATIVE)}
    number = lambda names: sum((s[n].cast("int") for n in names), F.lit(0))
    resume = (number(POSITIVE[:4]) >= 2) & s["experience_heading"] & s["career_history_detail"]
    other = (s["invoice_heading"] & s["invoice_terms"]) | (s["meeting_heading"] & s["meeting_workflow"]) | (s["manual_heading"] & s["manual_instructions"])
    matched = lambda names: F.array_compact(F.array(*[F.when(s[n], n) for n in names]))
    with_primary = lambda primary, names: F.slice(F.concat(F.array(F.lit(primary)), matched(names)), 1, MOST_REASONS)
    blank = c(text).isNull() | (F.regexp_replace(c(text), r"[\p{Z}\s]+", "") == "")
    given = c(outcome) if outcome else F.lit("text_extracted")
    status = F.when(given == "ocr_required", "ocr_backlog").when((given == "failed") | blank, "failed").when(resume & other, "needs_review").when(resume, "resume_candidate").when(other, "non_resume").otherwise("needs_review")
    reasons = (
        F.when(given == "ocr_required", F.array(F.lit("ocr_required")))
        .when(given == "failed", F.array(F.lit("parser_failed")))
        .when(blank, F.array(F.lit("empty_normalized_text")))
        .when(resume & other, with_primary("conflicting_signal_families", (*POSITIVE, *NEGATIVE)))
        .when(resume, with_primary("corroborated_resume_signals", POSITIVE))
        .when(other, with_primary("corroborated_non_resume_signals", NEGATIVE))
        .otherwise(with_primary("insufficient_signal_families", (*POSITIVE, *NEGATIVE)))
    )
    silent = (given != "text_extracted") | blank
    counts = [F.when(silent, 0).otherwise(number(n)) for n in (POSITIVE, NEGATIVE)]
    return flagged.select(*texts.columns, status.alias("status"), reasons.alias("reasons"), counts[0].alias("positive"), counts[1].alias("negative"))


def admitted(classified: DataFrame) -> DataFrame:
    """Only resume candidates reach an index."""
    return classified.where("status = 'resume_candidate'")


#: Some 60 bytes a row.
MODEL_ROWS = 500_000
#: Grams that are each looked for in a text; more are met by a join.
FEW_GRAMS = 64


def squeezed(text: Column) -> Column:
    return F.lower(F.regexp_replace(text, r"\s+", " "))


def few_grams(weights: DataFrame) -> list | None:
    """The rows of a small model whose grams do not repeat; None for another."""
    rows = weights.select("gram", "idf", "weight").limit(FEW_GRAMS + 1).collect()
    return rows if len(rows) <= FEW_GRAMS and len({r.gram for r in rows}) == len(rows) else None


def probability(text: Column, grams: list, bias: float) -> Column:
    """The same model as an expression over one text: occurrences of each gram, overlapping ones too, by a look ahead."""
    known = [r for r in grams if r.gram is not None and 3 <= len(r.gram) <= 5]
    if not known:
        return F.lit(1 / (1 + math.exp(-bias)))
    counted = lambda low: F.array(*[F.coalesce(F.regexp_count(low, F.lit(f"(?={re.escape(r.gram)})")), F.lit(0)) for r in known])
    valued = lambda ns: F.array(*[F.when(ns[i] > 0, (1 + F.log(ns[i])) * r.idf).otherwise(F.lit(0.0)) for i, r in enumerate(known)])

    def scored(vs: Column) -> Column:
        norm = F.sqrt(sum((vs[i] * vs[i] for i in range(len(known))), F.lit(0.0)))
        z = F.when(norm > 0, sum((vs[i] * r.weight for i, r in enumerate(known)), F.lit(0.0)) / norm).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-(z + bias)))

    return let(squeezed(text), lambda low: let(counted(low), lambda ns: let(valued(ns), scored)))


def promotion_scores(texts: DataFrame, weights: DataFrame, bias: float, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, probability: a logistic model over character 3- to 5-grams of the whole text, 1 + ln(count) times idf, unit length.

    weights: gram, idf, weight. A model of up to FEW_GRAMS is looked up gram by gram in its row, without a join; keys are unique. For
    others characters are split once, so grams take linear time; grams without a weight end at the join, before anything is
    counted or shuffled. A model of up to MODEL_ROWS rows is broadcast to it.
    """
    if (few := few_grams(weights)) is not None:
        return texts.select(key, probability(F.col(text), few, bias).alias("probability"))
    low = squeezed(F.col(text))
    of = lambda cs: F.flatten(F.transform(F.array(F.lit(3), F.lit(4), F.lit(5)), lambda n: F.when(F.size(cs) >= n, F.transform(F.sequence(F.lit(1), F.size(cs) - n + 1), lambda i: F.array_join(F.slice(cs, i, n), ""))).otherwise(F.array().cast("array<string>"))))
    grams = let(F.filter(F.split(low, ""), lambda c: c != ""), of)
    model = F.broadcast(weights) if weights.limit(MODEL_ROWS + 1).count() <= MODEL_ROWS else weights
    known = texts.select(key, F.explode(grams).alias("gram")).join(model, "gram")
    scored = known.groupBy(key, "gram", "idf", "weight").agg(F.count(F.lit(1)).alias("n")).withColumn("v", (1 + F.log(F.col("n"))) * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("v") * F.col("v")))
    linear = scored.groupBy(key).agg((F.sum(F.col("v") * F.col("weight")) / norm).alias("z"))
    return texts.select(key).join(linear, key, "left").select(key, (1 / (1 + F.exp(-(F.coalesce("z", F.lit(0.0)) + bias)))).alias("probability"))


def promote(classified: DataFrame, probabilities: DataFrame, threshold: float, key: str = "doc_id") -> DataFrame:
    """Conflict-free texts under review become candidates from ``threshold`` on."""
    return lifted(classified.join(probabilities, key, "left"), threshold)


def lifted(joined: DataFrame, threshold: float) -> DataFrame:
    """The same over classified texts that have their probability beside them."""
    up = (F.col("status") == "needs_review") & (F.get("reasons", 0) == "insufficient_signal_families") & (F.col("probability") >= threshold)
    reasons = F.when(up, F.slice(F.concat(F.array(F.lit("corroborated_resume_signals")), F.col("reasons")), 1, MOST_REASONS)).otherwise(F.col("reasons"))
    return joined.withColumns({"reasons": reasons, "status": F.when(up, "resume_candidate").otherwise(F.col("status"))})


def hash_embedding(dimension: int):
    """Unit vectors of token counts by hash, for tests and examples: a vectorised UDF text -> array<float>."""

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def one(text: str | None) -> list[float]:
            counts = [0.0] * dimension
            for token in (text or "").split():
                counts[fnv1a(token.translate(_LOWER).encode()) % dimension] += 1.0
            norm = math.sqrt(sum(x * x for x in counts))
            return [x / norm for x in counts] if norm else counts

        for texts in parts:
            yield texts.map(one)

    return run


_LOWER = {c: c + 32 for c in range(65, 91)}


def hash_embedding_column(text: Column, dimension: int) -> Column:
    """The same idea inside the JVM, by xxhash64: for plans that must run no Python."""
    tokens = F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda t: t != "")
    slots = F.transform(tokens, lambda t: F.pmod(F.xxhash64(t), F.lit(dimension)))
    counts = let(slots, lambda held: F.transform(F.sequence(F.lit(0), F.lit(dimension - 1)), lambda d: F.size(F.filter(held, lambda s: s == d)).cast("double")))
    norm = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda a, x: a + x * x))
    return let(counts, lambda c: let(norm(c), lambda n: F.transform(c, lambda x: F.when(n > 0, x / n).otherwise(F.lit(0.0)).cast("float"))))
