"""The queries of this subpackage and, where SQL can express one, its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm import decontaminate, jaccard, maintext, media, mixing, repetition, sequenced, sharding, spelling, tokencount, toxicity, urlfilter, warc
from lodestar.llm.shared import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.page_records(spark, table(spark, sf_dir, "pages"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge_urls(table(spark, sf_dir, "pages"), urlfilter.publish(spark, urlfilter.RULES))


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_features(table(spark, sf_dir, "documents"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.assign_shards(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_report(spark, table(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.with_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_plan(table(spark, sf_dir, "documents"))


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintext.extract(table(spark, sf_dir, "pages"), maintext.train())


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_sequenced_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequenced.apply_changes(spark, table(spark, sf_dir, "client_changes"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op13_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.repetition(table(spark, sf_dir, "documents"), "doc_id")


QUERIES: dict[str, Query] = {
    "op1_warc": op1_warc,
    "op2_url_filter": op2_url_filter,
    "op3_media": op3_media,
    "op4_sharding": op4_sharding,
    "op5_token_counts": op5_token_counts,
    "op6_decontamination": op6_decontamination,
    "op7_jaccard": op7_jaccard,
    "op8_mixing": op8_mixing,
    "op9_main_text": op9_main_text,
    "op10_toxicity": op10_toxicity,
    "op11_sequenced_changes": op11_sequenced_changes,
    "op12_spelling": op12_spelling,
    "op13_repetition": op13_repetition,
}

ORACLE_SQL: dict[str, str] = {
    "op1_warc": """
        WITH p AS (SELECT page_id, url, coalesce(html, '') AS h FROM pages),
        d AS (SELECT page_id, url, octet_length(encode(h)) AS n, sha256(h) AS s FROM p),
        m AS (SELECT s, min(page_id) AS head, count(*) AS k FROM d WHERE n >= 100 GROUP BY s)
        SELECT d.page_id, CAST(n AS BIGINT) AS payload_bytes, d.s AS payload_digest,
               CASE WHEN head IS NOT NULL AND d.page_id IS DISTINCT FROM head THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN head IS NOT NULL AND d.page_id IS DISTINCT FROM head THEN head END AS refers_to,
               replace(replace(coalesce(url, ''), chr(13), '%0D'), chr(10), '%0A') AS target_uri
        FROM d LEFT JOIN m ON d.s = m.s""",
    "op2_url_filter": """
        WITH p AS (SELECT page_id, translate(regexp_extract(url, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                          regexp_extract(url, '://[^/?#]*([^?#]*)', 1) AS path FROM pages),
        r(h, q, verdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
        x AS (SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path,
                     (SELECT arg_max({'rule': h || q, 'verdict': verdict}, length(h || q)) FROM r
                      WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q)) AS best FROM p)
        SELECT page_id, host, path, best.rule AS rule, coalesce(best.verdict, 'allow') AS verdict FROM x""",
    # CRC-32 from its table of 256 remainders; the rest are sums over windows.
    "op4_sharding": r"""
        WITH c(t) AS (SELECT list(list_reduce(list_concat([CAST(i AS BIGINT)], CAST([0, 0, 0, 0, 0, 0, 0, 0] AS BIGINT[])), lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) ORDER BY i) FROM range(256) r(i)),
        b AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 8 AS size, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: CAST('0x' || h AS BIGINT)) AS bytes FROM documents),
        d AS (SELECT doc_id, CAST(size AS BIGINT) AS size, xor(4294967295, list_reduce(list_concat([4294967295], bytes), lambda x, y: xor(x >> 8, t[1 + (xor(x, y) & 255)]))) AS text_crc32 FROM b, c),
        p AS (SELECT *, sum(size) OVER (ORDER BY doc_id NULLS LAST, text_crc32, size ROWS UNBOUNDED PRECEDING) - size AS before, sum(size) OVER () AS total FROM d),
        s AS (SELECT *, CAST(least((2 * before + size) * 24 // (2 * total), 23) AS INTEGER) AS shard FROM p)
        SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS LAST, text_crc32, size) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM s""",
    "op6_decontamination": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        i AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
        s AS (SELECT item, w, least(10, len(w)) AS n FROM i WHERE len(w) > 0),
        iw AS (SELECT DISTINCT item, n, array_to_string(list_slice(w, p, p + n - 1), ' ') AS g FROM (SELECT item, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM s)),
        dw AS (SELECT doc_id, n, p, array_to_string(list_slice(w, p, p + n - 1), ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM s))),
        h AS (SELECT dw.doc_id, dw.n, dw.p, iw.item FROM dw JOIN iw ON dw.n = iw.n AND dw.g = iw.g),
        c AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM h) GROUP BY doc_id),
        k AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256 FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
        SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
               coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN c ON d.doc_id = c.doc_id LEFT JOIN k ON d.doc_id = k.doc_id""",
    "op7_jaccard": r"""
        WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, p, p + 4), ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS p FROM d WHERE len(w) > 0)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
        l AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
        r(doc_id, reached) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.doc_id, l.b FROM r JOIN l ON r.reached = l.a)
        SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, (SELECT min(reached) FROM r WHERE r.doc_id = d.doc_id) AS component_id
        FROM d LEFT JOIN n ON n.doc_id = d.doc_id""",
    # These pages keep their main text in one <article>, without anything else in it.
    "op9_main_text": r"""
        WITH a AS (SELECT page_id, url, regexp_extract(html, '<article>(.*)</article>', 1, 's') AS h FROM pages),
        t AS (SELECT page_id, url, regexp_replace(regexp_replace(h, '</?(p|h1|br)>', ' ', 'g'), '<[^>]*>', '', 'g') AS h FROM a),
        e AS (SELECT page_id, url, replace(replace(replace(replace(replace(h, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', chr(39)), '&amp;', '&') AS h FROM t),
        w AS (SELECT page_id, url, trim(regexp_replace(h, '[\s\x{0b}\x{a0}\x{2009}]+', ' ', 'g')) AS text FROM e)
        SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM w""",
    # Two words are near if one has a letter taken out where the other has it, or both have the same letters around one place.
    "op12_spelling": r"""
        WITH RECURSIVE c(t) AS (SELECT list(list_reduce(list_concat([CAST(i AS BIGINT)], CAST([0, 0, 0, 0, 0, 0, 0, 0] AS BIGINT[])), lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) ORDER BY i) FROM range(256) r(i)),
        r AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents),
        o AS (SELECT run, doc_id || ':' || run AS k, count(*) AS n FROM r WHERE length(run) >= 6 GROUP BY ALL),
        h AS (SELECT run, n, xor(4294967295, list_reduce(list_concat([4294967295], list_transform(regexp_extract_all(hex(encode(k)), '..'), lambda b: CAST('0x' || b AS BIGINT))), lambda x, y: xor(x >> 8, t[1 + (xor(x, y) & 255)]))) AS h FROM o, c),
        g AS (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word, n FROM h),
        v AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM g WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
        p AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS d FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)),
        e AS (SELECT DISTINCT a.word, a.n, b.word AS other, b.n AS m FROM p a JOIN p b ON a.i = b.i AND a.d = b.d AND a.word <> b.word),
        f AS (SELECT DISTINCT p.word, p.n, v.word AS other, v.n AS m FROM p JOIN v ON p.d = v.word),
        u AS (SELECT * FROM e UNION ALL SELECT * FROM f UNION ALL SELECT other, m, word, n FROM f),
        b AS (SELECT word, n, count(*) AS n_near, (list({'m': m, 'other': other} ORDER BY m DESC, other))[1] AS best FROM u GROUP BY word, n),
        k AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN best.m >= 5 * v.n THEN best.other END AS form, CASE WHEN best.m >= 5 * v.n THEN best.m END AS form_n FROM v LEFT JOIN b ON b.word = v.word),
        w(word, root, form) AS (SELECT word, word, form FROM k UNION ALL SELECT w.word, k.word, k.form FROM w JOIN k ON k.word = w.form)
        SELECT k.word, k.form, w.root, k.n, CAST(k.n_near AS BIGINT) AS n_near, k.form_n FROM k JOIN w ON w.word = k.word AND w.form IS NULL""",
    "op13_repetition": r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
        w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM d),
        e AS (SELECT doc_id, p, list_element(w, p) AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM w)),
        g AS (SELECT doc_id, n, p, array_to_string(list_slice(w, p, p + n - 1), ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM w, (VALUES (3), (5), (6), (7), (8), (9), (10)) AS v(n))),
        h AS (SELECT doc_id, n, p FROM (SELECT doc_id, n, p, count(*) OVER (PARTITION BY doc_id, n, g) AS k FROM g) WHERE k > 1),
        c AS (SELECT DISTINCT doc_id, n, unnest(range(p, p + n)) AS p FROM h),
        m AS (SELECT c.doc_id, count(*) FILTER (n = 3) AS n3, sum(length(x)) FILTER (n = 5) AS c5, sum(length(x)) FILTER (n = 6) AS c6, sum(length(x)) FILTER (n = 7) AS c7,
                     sum(length(x)) FILTER (n = 8) AS c8, sum(length(x)) FILTER (n = 9) AS c9, sum(length(x)) FILTER (n = 10) AS c10 FROM c JOIN e ON e.doc_id = c.doc_id AND e.p = c.p GROUP BY c.doc_id),
        l AS (SELECT doc_id, x, count(*) AS k FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM d) WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY doc_id, x),
        s AS (SELECT doc_id, sum(k) AS n_lines, sum(k * length(x)) AS line_chars, sum(k - 1) AS n_dup_lines, sum((k - 1) * length(x)) AS dup_line_chars FROM l GROUP BY doc_id),
        t AS (SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars, CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
                     CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(line_chars, 0) AS BIGINT) AS line_chars, CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(dup_line_chars, 0) AS BIGINT) AS dup_line_chars,
                     CAST(coalesce(n3, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(c5, 0) AS BIGINT) AS dup_chars_5, CAST(coalesce(c6, 0) AS BIGINT) AS dup_chars_6, CAST(coalesce(c7, 0) AS BIGINT) AS dup_chars_7,
                     CAST(coalesce(c8, 0) AS BIGINT) AS dup_chars_8, CAST(coalesce(c9, 0) AS BIGINT) AS dup_chars_9, CAST(coalesce(c10, 0) AS BIGINT) AS dup_chars_10
              FROM w LEFT JOIN s ON s.doc_id = w.doc_id LEFT JOIN m ON m.doc_id = w.doc_id),
        b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM t)
        SELECT *, NOT base_failed AND 100 * dup_line_chars <= 30 * line_chars AND 100 * dup_chars_5 <= 40 * word_chars AND 100 * dup_chars_6 <= 38 * word_chars AND 100 * dup_chars_7 <= 36 * word_chars
                  AND 100 * dup_chars_8 <= 34 * word_chars AND 100 * dup_chars_9 <= 32 * word_chars AND 100 * dup_chars_10 <= 30 * word_chars AS kept FROM b""",
}
