"""Sections of a text: by headings, or packed chunks where there are none."""

from __future__ import annotations

import string
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions.text import ascii_lower, let
from lodestar.functions.vectorised import vectorised

HEADING_BYTES, CHUNK_CHARS = 40, 1200
#: What is left out at the ends of a heading: punctuation and white space.
EDGES = string.punctuation + " \t\n\x0b\f\r：，。、；"
HEADING_CONFIDENCE, CHUNK_CONFIDENCE = 0.92, 0.45
# What makes a line a heading of a family; the first family that fits holds.
HEADINGS = (
    ("contact", ("contact", "联系方式", "联系")),
    ("profile", ("profile", "summary", "self", "自我评价", "个人简介", "求职意向")),
    ("education", ("education", "教育", "学校", "学历")),
    ("project", ("project", "项目")),
    ("experience", ("experience", "工作经历", "工作经验", "经历")),
    ("skill", ("skill", "skills", "技能", "技术栈")),
    ("certificate", ("certificate", "certification", "证书", "认证", "资格")),
)


def heading_family(line: Column) -> Column:
    """The family of a heading line, or null. Most lines are too long, which is seen before anything else is looked at."""

    def of(bare: Column) -> Column:
        found = F.coalesce(*[F.when(F.greatest(*[bare.contains(w) for w in words]) if len(words) > 1 else bare.contains(words[0]), F.lit(family)) for family, words in HEADINGS])
        return F.when((bare != "") & ~line.contains("|"), found)

    # Bound: inside a lambda each use would be computed again.
    return let(F.btrim(line, F.lit(EDGES)), lambda cut: F.when(F.octet_length(cut) <= HEADING_BYTES, let(ascii_lower(cut), of)))


def heading_sections(texts: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, order_no, section_type, text, confidence: a heading and all lines up to the next one.

    What precedes the first heading belongs to no section; blank lines at the end of a section are left out. Each text
    is one row in and stays in its task: lines are folded to sections inside the row, without a shuffle.
    """
    lines = F.split(F.col(text), "\n", -1)
    indexed = texts.select(key, lines.alias("_lines")).select(key, "_lines", F.transform("_lines", heading_family).alias("_kinds"))
    starts = F.filter(F.transform("_kinds", lambda k, i: F.when(k.isNotNull(), i)), lambda i: i.isNotNull())
    placed = indexed.select(key, "_lines", "_kinds", starts.alias("_starts")).select(key, "_lines", "_kinds", "_starts", F.posexplode("_starts").alias("order_no", "_from"))
    end = F.coalesce(F.get("_starts", F.col("order_no") + 1), F.size("_lines"))
    body = F.array_join(F.slice("_lines", F.col("_from") + 1, end - F.col("_from")), "\n")
    return placed.select(key, "order_no", F.get("_kinds", F.col("_from")).alias("section_type"), F.regexp_replace(body, r"[\s]+$", "").alias("text"), F.lit(HEADING_CONFIDENCE).alias("confidence"))


def packed(text: str | None) -> list[str]:
    """Paragraphs put together up to CHUNK_CHARS; a longer paragraph is cut."""
    out: list[str] = []
    held = ""
    for paragraph in (p.strip() for p in (text or "").split("\n\n")):
        if not paragraph:
            continue
        if held and (len(paragraph) > CHUNK_CHARS or len(held) + 2 + len(paragraph) > CHUNK_CHARS):
            out.append(held)
            held = ""
        if len(paragraph) > CHUNK_CHARS:
            out += [paragraph[i : i + CHUNK_CHARS] for i in range(0, len(paragraph), CHUNK_CHARS)]
        else:
            held = f"{held}\n\n{paragraph}" if held else paragraph
    return [*out, held] if held else out


@vectorised("array<string>")
def packed_chunks(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in parts:
        yield texts.map(packed)


def sections(texts: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Sections by headings; texts without a heading get packed chunks."""
    has = F.exists(F.split(F.col(text), "\n", -1), lambda x: heading_family(x).isNotNull())
    chunks = texts.where(~F.coalesce(has, F.lit(False))).select(key, F.posexplode(packed_chunks(F.col(text))).alias("order_no", "text"))
    return heading_sections(texts.where(has), key, text).unionByName(chunks.select(key, "order_no", F.lit("chunk").alias("section_type"), "text", F.lit(CHUNK_CONFIDENCE).alias("confidence")))


def heading_runs(lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """The same sections from exploded rows (key, line_no, line), for texts too long for one row."""
    kind = heading_family(F.col("line"))
    order = Window.partitionBy(key).orderBy("line_no")
    numbered = lines.withColumn("_kind", kind).withColumn("_run", F.sum(F.col("_kind").isNotNull().cast("int")).over(order))
    parts = F.array_sort(F.collect_list(F.struct("line_no", "line", "_kind")))
    grouped = numbered.where("_run > 0").groupBy(key, "_run").agg(parts.alias("_parts"))
    body = F.regexp_replace(F.array_join(F.transform("_parts", lambda p: p["line"]), "\n"), r"[\s]+$", "")
    return grouped.select(key, (F.col("_run") - 1).alias("order_no"), F.get("_parts", 0)["_kind"].alias("section_type"), body.alias("text"), F.lit(HEADING_CONFIDENCE).alias("confidence"))
