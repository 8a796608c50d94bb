"""Queries of the text, value and date functions, sections, classification and extraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions import ids, months, text, values
from lodestar.operators import classify, extract, promotion, sections
from lodestar.plans.registry import ORACLE_SQL, literal, query, table, values_sql
from lodestar.sources import files

ASCII = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
TIDY = r"trim(regexp_replace(x, '[\p{Z}\x00-\x09\x0b\x0e-\x1f\x7f-\x9f]+', ' ', 'g'))"
LINES = rf"list_transform(list_transform(string_split_regex(text, '\r\n|[\r\n\f]'), lambda x: {TIDY}), lambda x: CASE WHEN regexp_full_match(x, '[A-Za-z]( [A-Za-z]){{3,}}') THEN replace(x, ' ', '') ELSE x END)"
PAGE_LINE = f"({ASCII.format('x')} LIKE 'page %' AND {ASCII.format('x')} LIKE '% of %' AND regexp_matches(x, '[0-9]'))"


@query(rf"""
    WITH l AS (SELECT doc_id, {LINES} AS ls FROM documents),
    c AS (SELECT doc_id, x, count(*) AS n FROM (SELECT doc_id, unnest(ls) AS x FROM l) WHERE x <> '' AND octet_length(encode(x)) <= 80 GROUP BY doc_id, x HAVING count(*) > 1),
    t AS (SELECT doc_id, list(x) AS twice FROM c GROUP BY doc_id),
    k AS (SELECT l.doc_id, array_to_string(list_transform(ls, lambda x: CASE WHEN {PAGE_LINE} OR list_contains(coalesce(twice, []), x) THEN '' ELSE x END), chr(10)) AS j FROM l LEFT JOIN t ON l.doc_id = t.doc_id)
    SELECT doc_id, regexp_replace(regexp_replace(j, '\n{{3,}}', chr(10) || chr(10), 'g'), '^\n+|\n+$', '', 'g') AS clean FROM k""")
def txt_normalize(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", text.normalize_text(F.col("text")).alias("clean"))


@query(rf"""
    SELECT doc_id, x AS line, count(*) AS n FROM (SELECT doc_id, unnest({LINES}) AS x FROM documents)
    WHERE x <> '' AND octet_length(encode(x)) <= 80 GROUP BY doc_id, x HAVING count(*) > 1""")
def txt_repeat_lines(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "documents").select("doc_id", F.explode(F.transform(text.text_lines(F.col("text")), text.tidy_line)).alias("line"))
    return lines.where((F.col("line") != "") & (F.octet_length("line") <= text.SHORT_LINE_BYTES)).groupBy("doc_id", "line").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@query(r"""
    SELECT doc_id, CASE WHEN en AND zh THEN ['en', 'zh'] WHEN en THEN ['en'] WHEN zh THEN ['zh'] ELSE ['unknown'] END AS languages
    FROM (SELECT doc_id, regexp_matches(text, '[A-Za-z]') AS en, regexp_matches(text, '[\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}]') AS zh FROM documents)""")
def txt_language_set(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", text.language_set(F.col("text")).alias("languages"))


REDACT = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({0},
        '\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b', '<redacted-email>', 'g'),
        '(?:\+\d{1,3}[\s.-]*)?(?:\(\d{3}\)[\s.-]*|\d{3,4}[\s.-]+)\d{3,4}[\s.-]*\d{4}', '<redacted-phone>', 'g'),
        '\+?(?:1)?\d{10}\b', '<redacted-phone>', 'g'),
        '(?i)\b(?:wechat|weixin|wx|微信|微信号)\s*[:：]\s*[A-Za-z][A-Za-z0-9_.-]{5,31}\b', '<redacted-wechat>', 'g'),
        '(?i)(?:file://\S+|(?:~|/Users|/home|/private|/var|/tmp|[A-Z]:[\\/])\S*|\b[A-Z]:\\\S+|\S*(?:/Users/|/home/|/private|\\Users\\)\S*)', '<redacted-path>', 'g')"""


@query("SELECT doc_id, " + REDACT.replace("{0}", "text") + " AS safe FROM documents")
def txt_redact(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", text.redact(F.col("text")).alias("safe"))


SNIPPET = REDACT.replace("{0}", "trim(substr(text, b, p + 80 - b), ' ')")


@query(f"""
    WITH d AS (SELECT doc_id, text, list_filter([strpos({ASCII.format('text')}, 'idiot'), strpos({ASCII.format('text')}, 'und'), strpos({ASCII.format('text')}, 'the')], lambda p: p > 0)[1] AS p FROM documents),
    s AS (SELECT doc_id, text, coalesce(p, 1) AS p, greatest(1, coalesce(p, 1) - 40) AS b FROM d)
    SELECT doc_id, {SNIPPET} AS snippet FROM s""")
def txt_snippet(spark: SparkSession, sf: str) -> DataFrame:
    terms = F.array(F.lit("Idiot"), F.lit("und"), F.lit("the"))
    return table(spark, sf, "documents").select("doc_id", text.snippet(F.col("text"), terms).alias("snippet"))


@query("""
    SELECT doc_id, substr(text, 101, 50) AS part, CAST(length(text) AS INTEGER) AS total, CASE WHEN length(text) > 150 THEN 150 END AS next_cursor
    FROM documents WHERE length(text) >= 100""")
def txt_page(spark: SparkSession, sf: str) -> DataFrame:
    page = table(spark, sf, "documents").select("doc_id", text.page_of_text(F.col("text"), 100, 50).alias("p")).where("p IS NOT NULL")
    return page.select("doc_id", F.col("p.text").alias("part"), "p.total", "p.next_cursor")


@query("""
    SELECT doc_id, text AS joined, true AS fit FROM documents""")
def txt_page_bytes(spark: SparkSession, sf: str) -> DataFrame:
    """Walks all pages of 997 bytes of each text: joined they are the text, and none is larger or splits a character."""
    pages = table(spark, sf, "documents").select("doc_id", text.pages_of_bytes(F.col("text"), 997).alias("pages"))
    fit = F.forall("pages", lambda p: (F.octet_length(p) <= 997) & ~p.contains("\ufffd"))
    return pages.select("doc_id", F.array_join("pages", "").alias("joined"), fit.alias("fit"))


@query("SELECT page_id, CASE WHEN octet_length(encode(u)) <= 160 THEN u ELSE substr(u, 1, 157) || '...' END AS shown FROM (SELECT page_id, " + REDACT.replace("{0}", "url") + " AS u FROM pages)")
def txt_file_name(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", text.file_name_shown(F.col("url")).alias("shown"))


@query("""
    SELECT l_orderkey, l_linenumber, n, c FROM (
        SELECT l_orderkey, l_linenumber, length(CASE WHEN length(v) > 120 THEN substr(v, 1, 120) || '...' ELSE v END) AS n, greatest(0.0, least(1.0, l_quantity / 40)) AS c
        FROM (SELECT l_orderkey, l_linenumber, l_quantity, trim(repeat(l_returnflag || ' ' || l_linestatus || ' ', CAST(l_quantity AS INTEGER)), ' ') AS v FROM lineitem))""")
def txt_detail(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem")
    raw = F.repeat(F.concat_ws(" ", "l_returnflag", "l_linestatus", F.lit("")), F.col("l_quantity").cast("int"))
    shown, confidence = text.detail_value(raw, F.lit(" "), F.col("l_quantity") / 40)
    return rows.select("l_orderkey", "l_linenumber", F.length(shown).cast("long").alias("n"), confidence.alias("c"))


@query(ORACLE_SQL["txt_normalize"])
def txt_origins(spark: SparkSession, sf: str) -> DataFrame:
    """The clean text put together from the source by its origins alone: runs as they stand, or a blank, between line ends."""
    rows = table(spark, sf, "documents").select("doc_id", "text", text.normalize_with_origins("text").alias("o"))
    size = lambda r, side: r[f"{side}_end"] - r[f"{side}_start"]

    def joined(source: Column, runs: Column) -> Column:
        cut = lambda r: F.decode(F.substring(source, r["source_start"] + 1, size(r, "source")), "UTF-8")
        run = lambda r: F.when(size(r, "clean") == size(r, "source"), F.regexp_replace(cut(r), r"^[\x00-\x20\x7F]", " ")).otherwise(F.lit(" "))
        before = lambda i: F.when(i == 0, 0).otherwise(F.get(runs, i - 1)["clean_end"])
        return F.array_join(F.transform(runs, lambda r, i: F.concat(F.repeat(F.lit("\n"), r["clean_start"] - before(i)), run(r))), "")

    # Both are bound: a text would otherwise be encoded again for each of its runs.
    whole = text.let(F.encode("text", "UTF-8"), lambda source: text.let(F.col("o.origins"), lambda runs: joined(source, runs)))
    return rows.select("doc_id", whole.alias("clean"))


@query()
def txt_quality_gate(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", text.quality(F.col("text")).alias("good"))


@query("""
    SELECT doc_id, 'sha256:' || sha256(text) AS content_hash FROM documents""")
def id_content_digest(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", ids.content_digest(F.col("text")).alias("content_hash"))


@query("""
    WITH d AS (SELECT doc_id, CAST(doc_id AS VARCHAR) AS a, source AS b FROM documents)
    SELECT doc_id, 'ver_' || substr(sha256(length(a) || ':' || a || length(b) || ':' || b), 1, 32) AS version_id FROM d""")
def id_version(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", ids.version_id(F.col("doc_id").cast("string"), F.col("source")).alias("version_id"))


@query(f"""
    WITH r AS (SELECT CAST(doc_id AS VARCHAR) AS a, sha256(text) AS b FROM documents),
    h AS (SELECT sha256(octet_length(encode(a)) || ':' || a || octet_length(encode(b)) || ':' || b) AS h FROM r),
    l AS (SELECT i, sum(CAST('0x' || substr(h, 4 * i + 1, 4) AS BIGINT)) AS lane FROM h, range(16) t(i) GROUP BY i)
    SELECT (SELECT count(*) FROM documents) AS members, (SELECT count(*) FROM (SELECT doc_id FROM documents GROUP BY doc_id HAVING count(*) > 1)) AS repeated,
           sha256(string_agg(CAST(lane AS VARCHAR), ',' ORDER BY i)) AS digest FROM l""")
def id_projection_digest(spark: SparkSession, sf: str) -> DataFrame:
    return ids.projection_digest(table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("version_id")))


#: The key, filled up to a block, with the two pads of the standard.
PADS = ["".join(f"{b ^ pad:02x}" for b in b"key of an example".ljust(64, b"\0")) for pad in (0x36, 0x5C)]


@query(f"""
    SELECT c_custkey, sha256(from_hex('{PADS[1]}') || from_hex(sha256(from_hex('{PADS[0]}') || encode('email') || from_hex('00') || encode(lower(c_name))))) AS email_hash FROM customer""")
def id_contact_hash(spark: SparkSession, sf: str) -> DataFrame:
    hashed = ids.contact_hash(b"key of an example", "email")
    return table(spark, sf, "customer").select("c_custkey", hashed(F.lower("c_name")).alias("email_hash"))


#: Tables of each kind of value. Two parts in three get an alias of their kind, in capitals or between blanks, the others their own name.
KINDS = {"degree": values.DEGREES, "school_tier": values.SCHOOL_TIERS, "skill": values.SKILLS, "major": values.MAJORS, "title": values.TITLES, "location": values.LOCATIONS, "certificate": values.CERTIFICATES, "company": {}}
ALIASES = {kind: sorted(values.aliases(known)) or ["acme  co., ltd.", "foo inc", "company", "星辰 有限公司", "north gmbh 公司"] for kind, known in KINDS.items()}


def value_sql() -> str:
    known = {kind: values.aliases(t) for kind, t in KINDS.items() if t}
    find = lambda kind, key: f"MAP({literal(list(known[kind]))}, {literal(list(known[kind].values()))})[{key}]"
    joined = r"trim(regexp_replace(lower(trim(raw)), '[^\p{L}\p{N}]+', '_', 'g'), '_')"
    folded = r"lower(trim(regexp_replace(raw, '\s+', ' ', 'g')))"
    bare = r"regexp_replace(lower(trim(raw)), '[ \-_]', '', 'g')"
    primary = r"trim(regexp_extract(lower(trim(raw)), '^[^,，;；|/\\、]*'))"
    strip = lambda x, suffixes: f"trim(left({x}, length({x}) - coalesce(length(list_filter({literal(list(suffixes))}, lambda e: ends_with({x}, e))[1]), 0)))"
    cases = {
        "degree": f"CASE WHEN replace(lower(trim(raw)), ' ', '') = 'b.e.' THEN 'bachelor' ELSE {find('degree', REG.format('[ .\\-_]'))} END",
        "school_tier": find("school_tier", REG.format(r"[^\p{L}\p{N}]")),
        "skill": f"coalesce({find('skill', REG.format(r'[^\p{L}\p{N}]'))}, {folded})",
        "major": f"coalesce({find('major', bare)}, {joined})",
        "title": f"coalesce({find('title', joined)}, {joined})",
        "location": f"coalesce({find('location', REG2.format(primary))}, {primary})",
        "certificate": f"coalesce({find('certificate', joined)}, {joined})",
        "company": strip(strip(folded, values.COMPANY_SUFFIXES_EN), values.COMPANY_SUFFIXES_ZH),
    }
    names = " ".join(f"WHEN {i} THEN {literal(ALIASES[k])}" for i, k in enumerate(KINDS))
    rows = f"SELECT p_partkey, p_partkey % 8 AS k, p_name, p_partkey // 8 AS i, CASE p_partkey % 8 {names} END AS a FROM part"
    raws = f"SELECT p_partkey, k, CASE WHEN p_partkey % 3 = 0 THEN p_name WHEN p_partkey % 3 = 1 THEN upper(a[i % len(a) + 1]) ELSE '  ' || a[i % len(a) + 1] || ' ' END AS raw FROM r"
    return f"WITH r AS ({rows}), d AS ({raws}) SELECT p_partkey, CASE k {' '.join(f'WHEN {i} THEN {cases[kind]}' for i, kind in enumerate(KINDS))} END AS value FROM d"


REG = "regexp_replace(lower(trim(raw)), '{0}', '', 'g')"
REG2 = "regexp_replace({0}, '[ \\-_]', '', 'g')"


@query(value_sql())
def val_normalize(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("p_partkey")
    alias = F.coalesce(*[F.when(key % 8 == i, F.get(F.array(*[F.lit(a) for a in ALIASES[kind]]), (F.floor(key / 8) % len(ALIASES[kind])).cast("int"))) for i, kind in enumerate(KINDS)])
    raw = F.when(key % 3 == 0, F.col("p_name")).when(key % 3 == 1, F.upper(alias)).otherwise(F.concat(F.lit("  "), alias, F.lit(" ")))
    rows = table(spark, sf, "part").select("p_partkey", raw.alias("raw"))
    return rows.select("p_partkey", F.coalesce(*[F.when(key % 8 == i, getattr(values, kind)(F.col("raw"))) for i, kind in enumerate(KINDS)]).alias("value"))


@query("""
    SELECT p_partkey, CASE WHEN n LIKE '%_inc' THEN n ELSE n END AS title FROM (SELECT p_partkey, trim(regexp_replace(lower(p_type), '[^a-z0-9]+', '_', 'g'), '_') AS n FROM part)""")
def val_tokens_joined(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", values.title(F.col("p_type")).alias("title"))


# Ranges are written in eight ways, from an order's month and one some months later; the last three are malformed, but for ends that are the start.
@query("""
    WITH o AS (SELECT o_orderkey, o_orderkey % 8 AS way, date_trunc('month', CAST(o_orderdate AS DATE)) AS s, CAST(date_trunc('month', CAST(o_orderdate AS DATE)) + to_months(CAST(o_orderkey % 29 AS INTEGER)) AS DATE) AS e FROM orders)
    SELECT o_orderkey, CASE WHEN way IN (0, 1, 2) THEN strftime(s, '%Y-%m') || '/' || strftime(e, '%Y-%m') WHEN way IN (3, 4) THEN strftime(s, '%Y-%m') || '/PRESENT'
                            WHEN way = 5 AND s = e THEN strftime(s, '%Y-%m') || '/' || strftime(e, '%Y-%m') END AS canonical FROM o""")
def date_canonical(spark: SparkSession, sf: str) -> DataFrame:
    start = F.trunc(F.col("o_orderdate").cast("date"), "month")
    end = F.add_months(start, (F.col("o_orderkey") % 29).cast("int"))
    said = lambda d, form: F.date_format(d, form)
    ways = [
        F.concat(said(start, "yyyy-MM"), F.lit("/"), said(end, "yyyy-MM")), F.concat(said(start, "yyyy-M"), F.lit(".."), said(end, "yyyy-M")), F.concat(F.lit(" "), said(start, "yyyy年MM月"), F.lit(" / "), said(end, "yyyy年M月")),
        F.concat(said(start, "yyyy年MM月"), F.lit("/至今")), F.concat(said(start, "yyyy-MM"), F.lit(" / NOW ")),
        F.concat(said(end, "yyyy-MM"), F.lit("/"), said(start, "yyyy-MM")), F.concat(said(start, "yyyy"), F.lit("-13/"), said(end, "yyyy-MM")), said(start, "yyyy-MM"),
    ]
    raw = F.coalesce(*[F.when(F.col("o_orderkey") % 8 == i, w) for i, w in enumerate(ways)])
    return table(spark, sf, "orders").select("o_orderkey", text.let(raw, lambda r: text.let(months.month_range(r), months.range_text)).alias("canonical"))


@query("""
    WITH r AS (SELECT o_custkey, min(year(o_orderdate) * 12 + month(o_orderdate)) AS s, max(year(o_orderdate) * 12 + month(o_orderdate)) AS e FROM orders GROUP BY 1)
    SELECT o_custkey, s <= 1994 * 12 + 6 AND 1993 * 12 + 1 <= e AS meets FROM r""")
def date_overlap(spark: SparkSession, sf: str) -> DataFrame:
    month = F.year("o_orderdate") * 12 + F.month("o_orderdate")
    ranges = table(spark, sf, "orders").groupBy("o_custkey").agg(F.min(month).alias("s"), F.max(month).alias("e"))
    return ranges.select("o_custkey", months.overlaps(F.col("s"), F.col("e"), F.lit(1993 * 12 + 1), F.lit(1994 * 12 + 6)).alias("meets"))


@query("""
    WITH r AS (SELECT o_custkey, year(o_orderdate) * 12 + month(o_orderdate) AS s, year(o_orderdate) * 12 + month(o_orderdate) + o_orderkey % 9 AS e FROM orders WHERE o_orderkey % 11 <> 0),
    x AS (SELECT o_custkey, s, greatest(e, s + 1) AS e FROM r),
    m AS (SELECT *, max(e) OVER (PARTITION BY o_custkey ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM x),
    i AS (SELECT *, sum(CASE WHEN b IS NULL OR s > b THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM m),
    t AS (SELECT o_custkey, g, max(e) - min(s) AS n FROM i GROUP BY 1, 2)
    SELECT o_custkey, round_even(sum(n) / 12.0, 1) AS years_experience FROM t GROUP BY 1""")
def interval_union_years(spark: SparkSession, sf: str) -> DataFrame:
    month = F.year("o_orderdate") * 12 + F.month("o_orderdate")
    # Every eleventh range is open, and left out.
    end = F.when(F.col("o_orderkey") % 11 != 0, month + F.col("o_orderkey") % 9)
    return months.experience_years(table(spark, sf, "orders").select("o_custkey", month.alias("start_month"), end.alias("end_month")), "o_custkey")


#: What stands before and after a heading word; with the last it is too long to be a heading.
AROUND = [("", ":"), ("## ", " ##"), ("My ", " so far"), ("", " | more"), (" ", " " + "and so on " * 5)]
HEADING_WORDS = [w for _, words in sections.HEADINGS for w in words] + ["hobbies", "...", "work"]


def family_sql(line: str) -> str:
    """The family of a line: the first in order with a word in it, punctuation at the ends left out."""
    bare = rf"lower(regexp_replace({line}, '^[[:punct:]\s：，。、；]+|[[:punct:]\s：，。、；]+$', '', 'g'))"
    cases = " ".join(f"WHEN {' OR '.join(f'contains({bare}, {literal(w)})' for w in words)} THEN {literal(family)}" for family, words in sections.HEADINGS)
    return f"CASE WHEN contains({line}, '|') OR {bare} = '' OR octet_length(encode({bare})) > 40 THEN NULL {cases} END"


def heading_line(spark: SparkSession, sf: str) -> DataFrame:
    pick = lambda options, n: F.get(F.array(*[F.lit(o) for o in options]), (n % len(options)).cast("int"))
    key = F.col("doc_id")
    line = F.concat(pick([a for a, _ in AROUND], key), F.when(F.floor(key / 5) % 2 == 0, F.upper(pick(HEADING_WORDS, F.floor(key / 10)))).otherwise(pick(HEADING_WORDS, F.floor(key / 10))), pick([b for _, b in AROUND], key))
    return table(spark, sf, "documents").select("doc_id", "text", line.alias("line"))


LINE = f"{literal([a for a, _ in AROUND])}[doc_id % 5 + 1] || CASE WHEN doc_id // 5 % 2 = 0 THEN upper(w) ELSE w END || {literal([b for _, b in AROUND])}[doc_id % 5 + 1]"
LINES = f"r AS (SELECT doc_id, text, {literal(HEADING_WORDS)}[doc_id // 10 % {len(HEADING_WORDS)} + 1] AS w FROM documents), h AS (SELECT doc_id, text, {LINE} AS line FROM r)"


@query(f"WITH {LINES} SELECT doc_id, {family_sql('line')} AS family FROM h")
def section_headings(spark: SparkSession, sf: str) -> DataFrame:
    return heading_line(spark, sf).select("doc_id", sections.heading_family(F.col("line")).alias("family"))


@query(rf"""
    WITH {LINES}, l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line, unnest(range(len(string_split(t, chr(10))))) AS p FROM (SELECT doc_id, line || chr(10) || text || chr(10) || 'Education' || chr(10) || line || chr(10) || ' ' AS t FROM h)),
    f AS (SELECT *, {family_sql('line')} AS family FROM l),
    s AS (SELECT *, count(family) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM f)
    SELECT doc_id, CAST(k - 1 AS INTEGER) AS order_no, arg_min(family, p) AS section_type, regexp_replace(string_agg(line, chr(10) ORDER BY p), '\s+$', '') AS text FROM s WHERE k > 0 GROUP BY doc_id, k""")
def section_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Whole documents between headings of their own."""
    texts = heading_line(spark, sf).select("doc_id", F.concat("line", F.lit("\n"), "text", F.lit("\nEducation\n"), "line", F.lit("\n ")).alias("text"))
    return sections.heading_sections(texts).select("doc_id", "order_no", "section_type", "text")


RESUME = "Jane Doe\nEmail: jane.doe@example.test\nPhone: +86 138-0013-8000\nSummary\nEngineer.\nExperience\nAcme Technologies\nSenior Backend Engineer\n2018.01 - 2020.06\n- Built a search engine\n2020.06 - 2021.01\nEducation\nExample University\nBachelor of Science in Computer Science\n\nSkills: Rust, K8s, PostgreSQL\nLocation: Shanghai, China\nCertificates: CKA\n"


@query()
def section_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return sections.sections(table(spark, sf, "documents").select("doc_id", "text"))


CLASS_CASES = [
    (RESUME, "text_extracted", "resume_candidate", ["corroborated_resume_signals", "profile_heading", "experience_heading", "education_heading", "career_history_detail"]),
    ("Invoice\nSubtotal 5\nAmount due 5", "text_extracted", "non_resume", ["corroborated_non_resume_signals", "invoice_heading", "invoice_terms"]),
    ("Meeting notes:\nAgenda\nAction items", "text_extracted", "non_resume", ["corroborated_non_resume_signals", "meeting_heading", "meeting_workflow"]),
    ("Summary\nExperience\nBuilt x\nInvoice\nsubtotal, amount due", "text_extracted", "needs_review", ["conflicting_signal_families", "profile_heading", "experience_heading", "career_history_detail", "invoice_heading", "invoice_terms"]),
    ("Experience\nEDUCATION\nBuilt x", "text_extracted", "needs_review", ["insufficient_signal_families", "experience_heading", "education_heading"]),
    ("技能\n工作经历\n负责搜索", "text_extracted", "resume_candidate", ["corroborated_resume_signals", "experience_heading", "skills_heading", "career_history_detail"]),
    ("Nothing here", "text_extracted", "needs_review", ["insufficient_signal_families"]),
    (" \n", "text_extracted", "failed", ["empty_normalized_text"]),
    (None, "failed", "failed", ["parser_failed"]),
    (None, "ocr_required", "ocr_backlog", ["ocr_required"]),
]


@query(f"SELECT p_partkey, v.status, v.reasons FROM part JOIN ({values_sql('k INTEGER, status VARCHAR, reasons VARCHAR[]', [(i, s, r) for i, (_, _, s, r) in enumerate(CLASS_CASES)])}) v ON p_partkey % {len(CLASS_CASES)} = k")
def class_rules(spark: SparkSession, sf: str) -> DataFrame:
    """A case for each part, by its key, with the part's own name on a line at the end of texts that have words."""
    pick = lambda options: F.get(F.array(*[F.lit(o) for o in options]), (F.col("p_partkey") % len(CLASS_CASES)).cast("int"))
    words = pick([t and t.strip() and t for t, *_ in CLASS_CASES])
    rows = table(spark, sf, "part").select("p_partkey", F.coalesce(F.when(words != "", F.concat(words, F.lit("\n"), "p_name")), pick([t for t, *_ in CLASS_CASES])).alias("text"), pick([o for _, o, *_ in CLASS_CASES]).alias("outcome"))
    return classify.classify(rows, "text", "outcome").select("p_partkey", "status", "reasons")


#: What is appended to a document by its id, and what it is then.
CLASS_ENDS = [
    ("\nSummary\nEducation\nExperience\nBuilt x", "resume_candidate", ["corroborated_resume_signals", "profile_heading", "experience_heading", "education_heading", "career_history_detail"]),
    ("\nInvoice\nSubtotal 5\nAmount due 5", "non_resume", ["corroborated_non_resume_signals", "invoice_heading", "invoice_terms"]),
    ("\nSummary\nExperience\nBuilt x\nInvoice\nsubtotal, amount due", "needs_review", ["conflicting_signal_families", "profile_heading", "experience_heading", "career_history_detail", "invoice_heading", "invoice_terms"]),
    ("\nMeeting notes:\nAgenda\nAction items", "non_resume", ["corroborated_non_resume_signals", "meeting_heading", "meeting_workflow"]),
    ("", "needs_review", ["insufficient_signal_families"]),
]


@query(f"SELECT doc_id, v.status, v.reasons FROM documents JOIN ({values_sql('k INTEGER, status VARCHAR, reasons VARCHAR[]', [(k, s, r) for k, (_, s, r) in enumerate(CLASS_ENDS)])}) v ON doc_id % 5 = k")
def class_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Whole documents, most with a few lines of a kind at their end; the rules must find these and nothing else."""
    ends = F.array(*[F.lit(t) for t, *_ in CLASS_ENDS])
    docs = table(spark, sf, "documents").select("doc_id", F.concat("text", F.get(ends, (F.col("doc_id") % 5).cast("int"))).alias("text"))
    return classify.classify(docs).select("doc_id", "status", "reasons")


@query("""
    WITH g AS (SELECT doc_id, unnest(range(1, length(t) - 1)) AS p, t FROM (SELECT doc_id, lower(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM documents)),
    c AS (SELECT doc_id, substr(t, p, 3) AS gram, count(*) AS n FROM g GROUP BY 1, 2),
    v AS (SELECT doc_id, (1 + ln(n)) * w.idf AS v, w.weight FROM c JOIN (VALUES ('the', 1.5, 0.8), ('und', 2.0, -0.7), ('que', 1.2, 0.3), ('ion', 1.1, 0.2)) w(gram, idf, weight) ON c.gram = w.gram),
    z AS (SELECT doc_id, sum(v * weight) / sqrt(sum(v * v)) AS z FROM v GROUP BY 1)
    SELECT d.doc_id, round(1 / (1 + exp(-(coalesce(z, 0.0) - 0.1))), 9) AS probability FROM documents d LEFT JOIN z ON d.doc_id = z.doc_id""")
def class_promotion(spark: SparkSession, sf: str) -> DataFrame:
    """A small model over the whole texts."""
    weights = spark.createDataFrame([("the", 1.5, 0.8), ("und", 2.0, -0.7), ("que", 1.2, 0.3), ("ion", 1.1, 0.2)], "gram string, idf double, weight double")
    scored = classify.promotion_scores(table(spark, sf, "documents").select("doc_id", "text"), weights, -0.1)
    return scored.select("doc_id", F.round("probability", 9).alias("probability"))


#: Characters that the model of the next query reads; the bound is its feature.
WINDOW = 400
SIGNALS = [[r for r in reasons if r in (*classify.POSITIVE, *classify.NEGATIVE)] for *_, reasons in CLASS_ENDS]


MODEL_INPUT = rf"""
    WITH d AS (SELECT doc_id, text || {literal([t for t, *_ in CLASS_ENDS])}[doc_id % 5 + 1] AS t, [{', '.join('CAST(' + literal(s) + ' AS VARCHAR[])' for s in SIGNALS)}][doc_id % 5 + 1] AS signals FROM documents),
    l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line, unnest(range(len(string_split(t, chr(10))))) AS p FROM d),
    f AS (SELECT doc_id, p, {family_sql('line')} AS family FROM l),
    k AS (SELECT doc_id, list('__section_' || family || '__' ORDER BY p) AS kinds FROM f WHERE family IS NOT NULL GROUP BY doc_id),
    s AS (SELECT d.doc_id, t, substr(array_to_string(list_concat(coalesce(kinds, [])[:64], list_transform(signals, lambda r: '__reason_' || replace(r, '_', '') || '__')), ' '), 1, {WINDOW // 4}) AS s FROM d LEFT JOIN k ON d.doc_id = k.doc_id),
    r AS (SELECT *, {WINDOW} - length(s) - 1 AS room FROM s),
    b AS (SELECT doc_id, s, CASE WHEN length(t) <= room THEN t ELSE substr(t, 1, room * 3 // 5) || right(t, room - room * 3 // 5) END AS b FROM r)
    SELECT doc_id, trim(regexp_replace(lower(substr(CASE WHEN s = '' THEN b ELSE b || chr(10) || s END, 1, {WINDOW})), '[\p{{Z}}\s]+', ' ', 'g')) AS input FROM b"""


@query(MODEL_INPUT)
def class_model_input(spark: SparkSession, sf: str) -> DataFrame:
    """What a model with a window reads of each document and its signals."""
    ends = F.array(*[F.lit(t) for t, *_ in CLASS_ENDS])
    docs = table(spark, sf, "documents").select("doc_id", F.concat("text", F.get(ends, (F.col("doc_id") % 5).cast("int"))).alias("text"))
    text_ = F.col("text")
    return classify.classify(docs).select("doc_id", promotion.model_input(text_, promotion.section_types(text_), F.col("reasons"), WINDOW).alias("input"))


#: gram, idf, weight of a small model, and its intercept and threshold.
GRAMS, INTERCEPT, THRESHOLD = [("the", 1.5, 0.8), ("und", 2.0, -0.7), ("que", 1.2, 0.3), ("ion", 1.1, 0.2)], -0.1, 0.55


@query(f"""
    WITH i AS ({MODEL_INPUT}), g AS (SELECT doc_id, unnest(range(1, length(input) - 1)) AS p, input AS t FROM i),
    c AS (SELECT doc_id, substr(t, p, 3) AS gram, count(*) AS n FROM g GROUP BY 1, 2),
    v AS (SELECT doc_id, (1 + ln(n)) * w.idf AS v, w.weight FROM c JOIN ({values_sql('gram VARCHAR, idf DOUBLE, weight DOUBLE', GRAMS)}) w ON c.gram = w.gram),
    z AS (SELECT doc_id, sum(v * weight) / sqrt(sum(v * v)) AS z FROM v GROUP BY 1),
    d AS (SELECT doc_id, s.status, s.reasons, s.reasons[1] = 'insufficient_signal_families' AND 1 / (1 + exp(-(coalesce(z, 0.0) + {INTERCEPT}))) >= {THRESHOLD} AS up
          FROM documents JOIN ({values_sql('k INTEGER, status VARCHAR, reasons VARCHAR[]', [(k, st, r) for k, (_, st, r) in enumerate(CLASS_ENDS)])}) s ON doc_id % 5 = k LEFT JOIN z USING (doc_id))
    SELECT doc_id, CASE WHEN up THEN 'resume_candidate' ELSE status END AS status, CASE WHEN up THEN list_prepend('corroborated_resume_signals', reasons) ELSE reasons END AS reasons FROM d""")
def class_promoted(spark: SparkSession, sf: str) -> DataFrame:
    """Classified documents after a model with a window has lifted some of those under review."""
    ends = F.array(*[F.lit(t) for t, *_ in CLASS_ENDS])
    docs = table(spark, sf, "documents").select("doc_id", F.concat("text", F.get(ends, (F.col("doc_id") % 5).cast("int"))).alias("text"))
    model = promotion.Model("e1", WINDOW, THRESHOLD, INTERCEPT, spark.createDataFrame(GRAMS, "gram string, idf double, weight double"))
    return promotion.promoted(classify.classify(docs), model).select("doc_id", "status", "reasons")


#: FNV-1a of a list of bytes, in whole numbers of 128 bits.
FNV = "list_reduce(list_concat([14695981039346656037::UBIGINT], {0}), lambda x, y: CAST((CAST(xor(x, y) AS HUGEINT) * 1099511628211) % 18446744073709551616 AS UBIGINT))"
BYTES = "list_transform(regexp_extract_all({0}, '..'), lambda h: CAST('0x' || h AS UBIGINT))"


@query(f"""
    WITH t AS (SELECT conv_id, turn, unnest(list_filter(regexp_split_to_array(coalesce(text, ''), '[\\s\\x{{0b}}\\x{{1c}}-\\x{{1f}}\\x{{85}}\\x{{a0}}]+'), lambda w: w <> '')) AS w FROM conversations),
    u AS (SELECT w, {FNV.format(BYTES.format("hex(encode(" + ASCII.format("w") + "))"))} % 16 AS slot FROM (SELECT DISTINCT w FROM t)),
    c AS (SELECT conv_id, turn, slot, count(*) AS n FROM t JOIN u USING (w) GROUP BY ALL),
    v AS (SELECT conv_id, turn, list(slot) AS slots, list(n) AS ns, sqrt(sum(n * n)) AS norm FROM c GROUP BY ALL)
    SELECT conv_id, turn, list_transform(range(16), lambda d: CAST(coalesce(ns[list_position(slots, d)], 0) / coalesce(norm, 1) AS FLOAT)) AS embedding FROM conversations LEFT JOIN v USING (conv_id, turn)""")
def embed_hash(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select("conv_id", "turn", classify.hash_embedding(16)(F.col("text")).alias("embedding"))


MENTION_ROWS = [
    ("name", "Jane Doe", "jane doe", 0, 8, 0.84), ("email", "jane.doe@example.test", "jane.doe@example.test", 16, 37, 0.99), ("phone", "+86 138-0013-8000", "+8613800138000", 45, 62, 0.98),
    ("company", "Acme Technologies", "acme", 92, 109, 0.78), ("title", "Senior Backend Engineer", "backend_engineer", 110, 133, 0.84),
    ("years_experience", "2018.01 - 2020.06", "3.0", 134, 151, 0.82), ("date_range", "2018.01 - 2020.06", "2018-01/2020-06", 134, 151, 0.92), ("date_range", "2020.06 - 2021.01", "2020-06/2021-01", 176, 193, 0.92),
    ("school", "Example University", "example university", 204, 222, 0.84), ("degree", "Bachelor of Science in Computer Science", "bachelor", 223, 262, 0.95), ("major", "Computer Science", "computer_science", 246, 262, 0.94),
    ("skill", "Rust", "Rust", 272, 276, 0.91), ("skill", "K8s", "Kubernetes", 278, 281, 0.91), ("skill", "PostgreSQL", "PostgreSQL", 283, 293, 0.91),
    ("location", "Shanghai, China", "shanghai", 304, 319, 0.86), ("certificate", "CKA", "cka", 334, 337, 0.90),
]


@query(f"""
    WITH v AS ({values_sql("entity_type VARCHAR, raw_value VARCHAR, normalized_value VARCHAR, span_start INTEGER, span_end INTEGER, confidence DOUBLE", MENTION_ROWS)}),
    k AS (SELECT p_partkey, CAST(p_partkey AS VARCHAR) AS k FROM part)
    SELECT p_partkey, entity_type, CASE entity_type WHEN 'email' THEN replace(raw_value, '@', k || '@') ELSE raw_value END AS raw_value, CASE entity_type WHEN 'email' THEN replace(raw_value, '@', k || '@') ELSE normalized_value END AS normalized_value,
           CAST(span_start + CASE WHEN span_start > 16 THEN length(k) ELSE 0 END AS INTEGER) AS span_start, CAST(span_end + CASE WHEN span_end > 16 THEN length(k) ELSE 0 END AS INTEGER) AS span_end, confidence FROM v, k""")
def extract_resume(spark: SparkSession, sf: str) -> DataFrame:
    """A resume for each part, with the part's key in its address, so that all that follows lies further on."""
    before, after = RESUME.split("@", 1)
    texts = extract.spread(table(spark, sf, "part").select("p_partkey")).select("p_partkey", F.concat(F.lit(before), F.col("p_partkey").cast("string"), F.lit("@" + after)).alias("text"))
    return extract.extract(texts, "p_partkey").select("p_partkey", "entity_type", "raw_value", "normalized_value", "span_start", "span_end", "confidence")


@query(r"""
    WITH m AS (SELECT doc_id, unnest(regexp_extract_all(text, '\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b')) AS v FROM documents)
    SELECT doc_id, lower(v) AS email, count(*) AS n FROM m GROUP BY 1, 2""")
def extract_emails(spark: SparkSession, sf: str) -> DataFrame:
    texts = table(spark, sf, "documents").where(F.contains("text", F.lit("@")))
    found = extract.all_mentions(texts, rules=(extract.find_contacts,)).where("entity_type = 'email'")
    return found.groupBy("doc_id", F.col("normalized_value").alias("email")).agg(F.count(F.lit(1)).alias("n"))


@query()
def extract_documents(spark: SparkSession, sf: str) -> DataFrame:
    return extract.projected(extract.extract(table(spark, sf, "documents").select("doc_id", "text")))


#: Paths of a page: what stands around its number, before and after folding.
PATH_CASES = [
    ("C:\\Users\\x\\..\\y\\.\\", "\\a.txt", "c:/Users/y/", "/a.txt"), ("/a/b/../", "//c", "/a/", "/c"), ("\\\\server\\share\\", "\\f", "//server/share/", "/f"), ("a/../../", "/b", "../", "/b"), ("/../", "/x/", "/", "/x"), ("./", "/..", "", ""), ("C:\\..\\", "/x/../y", "c:/", "/y"),
]


@query(f"""
    SELECT page_id, CASE page_id % {len(PATH_CASES)} {' '.join(f"WHEN {i} THEN {literal(a)} || " + ("'' " if not a and not b else "page_id ") + f"|| {literal(b)}" for i, (_, _, a, b) in enumerate(PATH_CASES))} END AS normalized FROM pages""")
def scan_paths(spark: SparkSession, sf: str) -> DataFrame:
    pick = lambda at: F.get(F.array(*[F.lit(c[at]) for c in PATH_CASES]), (F.col("page_id") % len(PATH_CASES)).cast("int"))
    path = F.concat(pick(0), F.col("page_id").cast("string"), pick(1))
    return table(spark, sf, "pages").select("page_id", files.normalized_path(path).alias("normalized"))


#: Folders and names around a page's number, and whether a scan for discovery goes there and takes them.
FOLDERS = [("/d/", True), ("/x/node_modules/", False), ("/usr/share/", False), ("/Users/me/Library/", False), ("/Users/me/cv/", True), ("c:/Windows/", False), ("c:/me/", True), ("/d/.git/", False)]
NAMES = [("", ".txt", True), (".hidden", ".txt", False), ("~$", ".docx", False), ("", ".txt~", False), ("", ".PDF", True), ("", ".part", False), ("", ".exe", False), ("b", ".docx", True), ("", "", False)]


@query(f"""
    SELECT page_id, {literal([w for _, w in FOLDERS])}[page_id % {len(FOLDERS)} + 1] AS entered, {literal([w for *_, w in NAMES])}[page_id // {len(FOLDERS)} % {len(NAMES)} + 1] AS taken FROM pages""")
def scan_filters(spark: SparkSession, sf: str) -> DataFrame:
    """A file for each page in one of the folders; ``taken`` looks at the name alone."""
    pick = lambda options, n: F.get(F.array(*[F.lit(o) for o in options]), (n % len(options)).cast("int"))
    number, other = F.col("page_id").cast("string"), F.floor(F.col("page_id") / len(FOLDERS))
    name = F.concat(pick([a for a, *_ in NAMES], other), number, pick([b for _, b, _ in NAMES], other))
    path, plain = F.concat(pick([f for f, _ in FOLDERS], F.col("page_id")), name), F.concat(F.lit("/d/"), name)
    inside = files.wanted_directory(path) & files.wanted_name(F.concat(pick([f for f, _ in FOLDERS], F.col("page_id")), F.lit("a.txt")))
    return table(spark, sf, "pages").select("page_id", inside.alias("entered"), (files.wanted_name(plain) & files.wanted_extension(plain)).alias("taken"))


@query("""
    SELECT to_json({'lang': lang, 'n': n}) AS json FROM (SELECT lang, count(*) AS n FROM documents GROUP BY lang)""")
def report_sink(spark: SparkSession, sf: str) -> DataFrame:
    return files.report_json(table(spark, sf, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n")))


@query(f"""
    WITH h AS (SELECT doc_id, hex(encode(text)) AS x, octet_length(encode(text)) AS n FROM documents),
    b AS (SELECT doc_id, hex(encode('quick')) || array_to_string(list_transform(range(8), lambda k: printf('%02X', (n >> (8 * k)) & 255)), '') || repeat('00', 8) || CASE WHEN n <= 8192 THEN x ELSE substr(x, 1, 8192) || right(x, 8192) END AS x FROM h)
    SELECT doc_id, lpad(lower(hex({FNV.format(BYTES.format("x"))})), 16, '0') AS fingerprint FROM b""")
def id_quick_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").withColumn("bytes", F.encode("text", "UTF-8"))
    return docs.select("doc_id", ids.quick_fingerprint(F.octet_length("bytes"), F.lit(0), "bytes").alias("fingerprint"))
