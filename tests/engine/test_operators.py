"""Behaviour that single cases show best: literal inputs and what must come out."""

import io
import math
import random
import unicodedata
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.functions import ids, months, text, values
from lodestar.operators import ann, classify, extract, filters, fulltext, fusion, metrics, sections, store, vectors
from lodestar.operators.filters import Predicate
from lodestar.plans import engine
from lodestar.queries import QUERIES
from lodestar.sources import files, snapshots
from lodestar.streaming import ingest


def one(spark, column, **cells):
    names = list(cells)
    schema = ", ".join(f"{n} {'string' if v is None or isinstance(v, str) else 'int'}" for n, v in cells.items())
    return spark.createDataFrame([tuple(cells[n] for n in names)], schema).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("source", "want"),
    [
        ("a\r\nb\tc \x0c d", "a\nb c\nd"),
        ("H e l l o\nx y z", "Hello\nx y z"),
        ("head\nbody\nhead\n\n\nend", "body\n\nend"),
        ("Page 2 of 9\ntext\n\npage of pages", "text\n\npage of pages"),
        ("简历　标题\n\n\n正文", "简历 标题\n\n正文"),
        ("\n\n", ""),
    ],
)
def test_normalize(spark, source, want):
    assert one(spark, text.normalize_text(F.col("t")), t=source) == want


def test_redaction(spark):
    source = "mail a.b@x.co, call +1 (415) 555-2671 or 13800138000; 微信: abcdef1, see /Users/me/cv.pdf"
    want = "mail <redacted-email>, call <redacted-phone> or <redacted-phone>; <redacted-wechat>, see <redacted-path>"
    assert one(spark, text.redact(F.col("t")), t=source) == want
    assert one(spark, text.redact(F.col("t")), t="nothing here") == "nothing here"


def test_byte_limits(spark):
    shown = one(spark, text.file_name_shown(F.col("t")), t="名" * 100)
    assert shown == "名" * 52 + "..." and len(shown.encode()) <= 160
    page = one(spark, text.page_of_bytes(F.col("t"), F.lit(0), F.lit(4)), t="名名")
    assert (page.text, page.total, page.next_cursor) == ("名", 6, 3)
    assert one(spark, text.page_of_bytes(F.col("t"), F.lit(1), F.lit(4)), t="名名").text is None
    assert one(spark, text.page_of_text(F.col("t"), 3, 1), t="ab") is None


def test_snippet(spark):
    found = one(spark, text.snippet(F.col("t"), F.array(F.lit("zzz"), F.lit("needle"))), t="x" * 100 + " Needle " + "y" * 200)
    assert found.startswith("x" * 39) and "Needle" in found and len(found) <= 121


@pytest.mark.parametrize(("raw", "want"), [("2020-01/2024-03", (24241, 24291)), ("2020年1月..now", (24241, None)), ("2021-02/2021-01", None), ("junk", None)])
def test_month_range(spark, raw, want):
    got = one(spark, months.month_range(F.col("t")), t=raw)
    assert (got and (got.start_month, got.end_month)) == want


def test_degree_order():
    assert values.degrees_from("master") == ["master", "doctor"]


def test_projection_digest_ignores_order(spark):
    rows = [(i, f"v{i}") for i in range(50)]
    a, b = (ids.projection_digest(spark.createDataFrame(r, "doc_id long, version_id string").repartition(n)).first() for r, n in ((rows, 1), (rows[::-1], 3)))
    assert a == b and a.members == 50 and a.repeated == 0
    other = ids.projection_digest(spark.createDataFrame([*rows[1:], (0, "w")], "doc_id long, version_id string")).first()
    assert other.digest != a.digest
    assert ids.fnv1a(b"a") == 0xAF63DC4C8601EC8C


def test_chunks():
    assert sections.packed("a\n\n b \n\n\n\n") == ["a\n\nb"]
    long = sections.packed("x" * 700 + "\n\n" + "y" * 600 + "\n\n" + "z" * 2500)
    assert [len(c) for c in long] == [700, 600, 1200, 1200, 100]
    assert sections.packed(None) == []


def test_sections_from_rows_and_texts_agree(spark):
    body = "intro\nSkills\nRust\n\nEducation\nSchool\n"
    whole = sections.heading_sections(spark.createDataFrame([(1, body)], "doc_id long, text string")).orderBy("order_no").collect()
    lines = spark.createDataFrame([(1, i, x) for i, x in enumerate(body.split("\n"))], "doc_id long, line_no int, line string")
    assert sorted(map(tuple, sections.heading_runs(lines).collect())) == sorted(map(tuple, whole))
    assert [r.text for r in whole] == ["Skills\nRust", "Education\nSchool"]


def test_promotion(spark):
    rows = classify.classify(spark.createDataFrame([(1, "just text"), (2, "Invoice\nsubtotal amount due")], "doc_id long, text string"))
    likely = spark.createDataFrame([(1, 0.9), (2, 0.99)], "doc_id long, probability double")
    got = {r.doc_id: (r.status, r.reasons[0]) for r in classify.promote(rows, likely, 0.8).collect()}
    assert got == {1: ("resume_candidate", "corroborated_resume_signals"), 2: ("non_resume", "corroborated_non_resume_signals")}


def test_embeddings(spark):
    rows = spark.createDataFrame([("Rust rust  GO",), ("",)], "t string")
    for made in (classify.hash_embedding(32)(F.col("t")), classify.hash_embedding_column(F.col("t"), 32)):
        a, b = (r.x for r in rows.select(made.alias("x")).collect())
        assert abs(sum(v * v for v in a) - 1) < 1e-5 and sum(b) == 0


BOOLEAN = [("a", "rust backend platform"), ("b", "rust frontend platform"), ("c", "python backend platform"), ("d", "backend rust platform")]


@pytest.mark.parametrize(("query", "want"), [("rust backend", "ad"), ("rust AND backend", "ad"), ("rust OR backend", "abcd"), ('"rust backend"', "a"), ("platform NOT rust", "c"), ("nothing", ""), ("RUST", "abd"), ('python OR "backend rust"', "cd"), ("platform AND (rust OR python)", "abcd"), ("rust AND (frontend OR backend)", "abd"), ("rust NOT (frontend OR backend)", ""), ("NOT (frontend OR python) rust", "ad"), ("platform -(rust backend)", "bc"), ("rust AND (frontend OR (backend NOT platform", "b"), ("rust) frontend", "b"), ("(rust OR python) AND (frontend OR \"python backend\")", "bc"), ("NOT rust", "")])
def test_boolean_queries(spark, query, want):
    docs = spark.createDataFrame(BOOLEAN, "doc_id string, text string")
    index = fulltext.build_index(docs, "doc_id", "text")
    queries = fulltext.query_table(spark, {"q": fulltext.plan_query(query)})
    assert sorted(r.doc_id for r in fulltext.matching(index, queries).collect()) == sorted(want)


def test_terms_match_in_either_field(spark):
    docs = spark.createDataFrame([("a", "alpha", "beta"), ("b", "alpha", "gamma")], "doc_id string, file_name string, clean_text string")
    index = fulltext.build_index(docs, "doc_id", "file_name", "clean_text")
    queries = fulltext.query_table(spark, {"q": fulltext.plan_query("alpha beta")})
    hits = fulltext.search(index, queries, 5)
    assert [(r.doc_id, r.rank) for r in hits.collect()] == [("a", 1)]
    assert fulltext.repeated_hits(hits).isEmpty()


def test_query_planning():
    plan = fulltext.plan_query('  ｒｕｓｔ rust "a  b" "a b" c ', 500)
    assert plan.text == 'rust "a b" c' and plan.limit == 100 and "rust" not in repr(plan)
    assert fulltext.plan_query("a AND a").text == "a AND a"
    for bad in ("", "   ", "AND", " ".join(f"t{i}" for i in range(17)), "x" * 257):
        with pytest.raises(ValueError):
            fulltext.plan_query(bad)
    assert unicodedata.normalize("NFKC", "ｒ") == "r"


def test_query_shapes(spark):
    cases = {"rust": "single_term", "a b": "and_2", "a b c": "and_3_5", "a b c d e f": "and_6_16", "rust 上海": "field_filter", '"a b"': "semantic", "a OR b": "hybrid", "go 5 years": "field_filter"}
    rows = spark.createDataFrame([(q,) for q in cases], "q string")
    assert {r.q: r.b for r in rows.select("q", fulltext.query_shape(F.col("q"))["bucket"].alias("b")).collect()} == cases


def test_vectors(spark):
    r = np.random.default_rng(1)
    data = r.normal(size=(300, 8)).astype(np.float32)
    vecs = spark.createDataFrame([(i, data[i].tolist()) for i in range(300)] + [(999, [0.0] * 8)], "vec_id long, embedding array<float>").repartition(7)
    asked = spark.createDataFrame([("q", data[5].tolist())], "query_id string, embedding array<float>")
    got = [x.vec_id for x in vectors.nearest(vecs, asked, 5).orderBy("rank").collect()]
    norm = data / np.linalg.norm(data, axis=1, keepdims=True)
    assert got == np.argsort(-(norm @ norm[5]), kind="stable")[:5].tolist()
    assert vectors.check_contract("m", 2, "n", [1.0, 2.0]) is False
    with pytest.raises(ValueError):
        vectors.check_contract("m", 3, "m", [1.0, 2.0])
    made = vectors.embed(spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string"), lambda ts: np.ones((len(ts), 4)), 4)
    assert made.count() == 2


def test_vectors_in_blocks(spark, monkeypatch, tmp_path):
    """More queries than a block holds, and a table whose ids go beyond 1280."""
    r = np.random.default_rng(2)
    data = r.normal(size=(1400, 8)).astype(np.float32)
    vecs = spark.createDataFrame([(i, data[i].tolist(), i % 3) for i in range(1400)], "vec_id long, embedding array<float>, label int")
    vecs.repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    monkeypatch.setattr(vectors, "MOST_QUERIES", 32)
    got = {}
    for x in QUERIES["vec_knn_topk"](spark, str(tmp_path)).collect():
        got.setdefault(int(x.query_id), []).append((x.rank, x.vec_id))
    unit = data.astype(np.float64) / np.linalg.norm(data.astype(np.float64), axis=1, keepdims=True)
    for q in range(0, 1400, 20):
        similar = np.round(unit @ unit[q], 6)
        assert [v for _, v in sorted(got.pop(q))] == sorted(range(1400), key=lambda i: (-similar[i], i))[:10]
    assert not got
    allowed = {x.query_id for x in QUERIES["vec_knn_postfilter"](spark, str(tmp_path)).collect()}
    assert {str(q) for q in range(0, 1400, 20) if q % 3 != 1} <= allowed


def test_fusion(spark):
    rows = [("q", 0, 1, "a"), ("q", 0, 2, "b"), ("q", 1, 1, "b"), ("q", 1, 2, "c")]
    fused = fusion.reciprocal_rank_fusion(spark.createDataFrame(rows, "query_id string, channel int, rank int, doc_id string"))
    assert [r.doc_id for r in fused.orderBy("rank").collect()] == ["b", "a", "c"]
    hits = spark.createDataFrame([("q", "old", "v1", 1, "c1"), ("q", "new", "v2", 2, "c1"), ("q", "other", "v3", 3, None)], "query_id string, doc_id string, version_id string, rank int, candidate_key string")
    assert [r.doc_id for r in fusion.fold(hits).orderBy("rank").collect()] == ["old", "other"]
    assert [(r.doc_id, r.rank) for r in fusion.fold_and_number(hits, 5).orderBy("rank").collect()] == [("old", 1), ("other", 2)]


def test_filters(spark):
    mentions = spark.createDataFrame([(1, "skill", "Rust", None, 0.9), (1, "years_experience", "3.5", "3.5x", 0.9), (2, "skill", "rust", None, 0.5), (3, "date_range", "x", "2020-01/PRESENT", 0.9)], "doc_id long, entity_type string, raw_value string, normalized_value string, confidence double")
    docs = spark.createDataFrame([(i,) for i in (1, 2, 3, 4)], "doc_id long")
    pick = lambda *p: sorted(r.doc_id for r in filters.select(docs, mentions, list(p)).collect())
    assert pick(Predicate("any", "skill", ["RUST"])) == [1]
    assert pick(Predicate("any", "skill", ["RUST"], exact=True)) == []
    assert pick(Predicate("any_or_missing", "skill", ["go"])) == [2, 3, 4]
    assert pick(Predicate("missing", "skill")) == [2, 3, 4]
    assert pick(Predicate("minimum", "years_experience", minimum=3.5)) == [1]
    assert pick(Predicate("overlap", "date_range", start=24300, end=None)) == [3]
    assert pick(filters.school_tiers(["unknown"])) == [1, 2, 3, 4]
    assert pick(filters.degree_minimum("master")) == []
    for bad in ({"unknown": 1}, {"skills_any": ["x" * 100]}, {"skills_any": []}, {"degree_min": "x"}, {"contact_hashes_any": ["zz"]}, {"date_range_overlaps": {"start_month": 9, "end_month": 3}}):
        with pytest.raises(ValueError):
            filters.parse_filters(bad)
    with pytest.raises(ValueError):
        filters.bounded(docs, 3)
    assert filters.bounded(docs, 4).count() == 4


def candidates_in_order(rows):
    emails, phones, out = {}, {}, {}
    for v, _, e, p in sorted(rows, key=lambda r: (r[1], r[0])):
        a, b = emails.get(e), phones.get(p)
        if a and b and a != b:
            out[v] = None
            continue
        c = a or b
        if not c and (e or p):
            c = v
            if e:
                emails[e] = c
            if p:
                phones[p] = c
        out[v] = c
    return out


@pytest.mark.parametrize("seed", [0, 1])
def test_candidates_follow_commit_order(spark, tmp_path, seed):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    r = random.Random(seed)
    rows = [(f"v{i:03d}", r.randint(0, 60), r.choice([None, *"abcdefgh"]), r.choice([None, *"stuvwxyz"])) for i in range(80)]
    rows += [("A", -3, "e1", "p1"), ("B", -2, "e1", "p2"), ("C", -1, None, "p2")]
    got = store.assign_candidates(spark.createDataFrame(rows, "version_id string, committed int, email_hash string, phone_hash string")).collect()
    want = candidates_in_order(rows)
    same = lambda d: sorted(sorted(v for v in d if d[v] == c) for c in set(d.values()) - {None})
    found = {x.version_id: x.candidate_id for x in got}
    assert same(found) == same(want) and {v for v in found if found[v] is None} == {v for v in want if want[v] is None}
    assert found["C"] != found["A"] == found["B"]


def test_soft_duplicates(spark):
    rows = [(1, "ann", ["u"], [], ["k"]), (2, "ann", ["u"], [], ["k"]), (3, "ann", ["u"], [], []), (4, "ann", [], ["c"], ["k", "l", "m"]), (5, "ann", [], ["c"], ["k", "l", "m"]), (6, "bob", ["u"], [], ["k"])]
    got = store.soft_duplicates(spark.createDataFrame(rows, "doc_id int, name string, schools array<string>, companies array<string>, skills array<string>"))
    assert sorted((r.doc_left, r.doc_right) for r in got.collect()) == [(1, 2), (4, 5)]


def test_hydration_never_falls_back(spark):
    active = spark.createDataFrame([("a", "v2", "t")], "doc_id string, version_id string, body string")
    hits = spark.createDataFrame([("a", "v1", 1)], "doc_id string, version_id string, rank int")
    with pytest.raises(Exception, match="stale"):
        store.hydrate(hits, active).collect()
    assert store.hydrate(hits.withColumn("version_id", F.lit("v2")), active).count() == 1


def test_contract_delta():
    old = {"primary": "1", "ocr": "1", "derived": "1", "classifier": "1"}
    assert store.contract_delta(old, old) == ("none", "reuse")
    assert store.contract_delta(old, {**old, "ocr": "2"})[0] == "ocr"
    assert store.contract_delta(old, {**old, "ocr": "2", "derived": "2"})[0] == "multiple"
    assert store.contract_delta(None, old)[0] == "unknown"


def test_scores_and_percentiles(spark):
    samples = spark.createDataFrame([(float(v),) for v in (5, 1, 9, 7, 3)], "v double")
    row = metrics.nearest_rank(samples, "v", [50, 95, 1]).first()
    assert (row.p50, row.p95, row.p1) == (5, 9, 1)
    e = spark.createDataFrame([(1, "skill", "a"), (1, "skill", "a"), (1, "name", "x")], "doc_id int, field string, value string")
    f = spark.createDataFrame([(1, "skill", "a"), (1, "skill", "b")], "doc_id int, field string, value string")
    got = {r.field: (r.tp, r.fp, r.fn) for r in metrics.field_scores(e, f).collect()}
    assert got == {"skill": (1, 1, 1), "name": (0, 0, 1), "overall": (1, 1, 2)}
    pairs = spark.createDataFrame([(0.75, True), (0.5, True), (0.8, False), (None, False)], "score double, duplicate boolean")
    assert metrics.duplicate_confusion(pairs).first().asDict() | {"tp": 1} == {"tp": 1, "fp": 1, "fn": 1, "tn": 1, "precision": 0.5, "recall": 0.5, "f1": 0.5}


def values_of(source, kind):
    return [m.value for m in extract.mentions_of(source) if m.type == kind]


@pytest.mark.parametrize(
    ("source", "kind", "want"),
    [
        ("姓名：张三\nx", "name", ["张三"]),
        ("first line of a letter\nJane Q. Doe\n", "name", []),
        ("a@b.io\nJane Q. Doe\n", "name", ["jane q. doe"]),
        ("电话 +86 138 0013 8000 或 (415) 555-2671", "phone", ["+8613800138000", "+14155552671"]),
        ("微信: Abc_def1\n", "wechat", ["abc_def1"]),
        ("2019.3 - 2020.11, Jan 2021 to Present, 2018年1月至2019年2月", "date_range", ["2019-03/2020-11", "2018-01/2019-02", "2021-01/PRESENT"]),
        ("2020-01 - 2020-01", "years_experience", ["0.1"]),
        ("2020-01 - present", "years_experience", []),
        ("学校：北京大学（985）", "school_tier", ["985"]),
        ("Tier: 19850", "school_tier", []),
        ("Education\nB.E. in Software Engineering", "degree", ["bachelor"]),
        ("Bachelor party planner", "degree", []),
        ("专业：海洋学", "major", ["海洋学"]),
        ("Employer: Acme Holdings", "company", []),
        ("Employer: Acme Labs", "company", ["acme"]),
        ("Title: Senior Front-end Developer", "title", ["frontend_engineer"]),
        ("AWS Certified Solutions Architect", "title", []),
        ("Address: 12 Main St., Suzhou, China", "location", ["suzhou"]),
        ("地址：上海市浦东新区1号", "location", ["shanghai"]),
        ("Skills: Spring Cloud, Java, JS", "skill", ["Spring Cloud", "JavaScript", "Java"]),
        ("证书\nCFA Level 1\n杂项", "certificate", ["cfa_level_1"]),
        ("Some Certified Person", "certificate", ["some certified person"]),
    ],
)
def test_extraction(source, kind, want):
    assert values_of(source, kind) == want


def test_spans_are_bytes():
    source = "姓名：张三\nmail x@y.io"
    for m in extract.mentions_of(source):
        assert source.encode()[m.start : m.end].decode() == m.raw


def docx(*paragraphs):
    out = io.BytesIO()
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    body = "".join(f"<w:p><w:r><w:t>{p}</w:t></w:r></w:p>" for p in paragraphs)
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def test_readers():
    assert files.read_text(b"\xef\xbb\xbfa\r\nb\rc") == "a\nb\nc"
    assert files.read_text("é".encode("utf-16")) == "é"
    with pytest.raises(UnicodeDecodeError):
        files.read_text(b"\xff\xfa")
    assert files.read_docx(docx("one", " ", "two")) == "one\ntwo"


RESUME = "{name}\nEmail: {mail}\nSummary\nx\nExperience\nAcme Labs\n- Built {what}\nEducation\nExample University\nSkills: {skills}\n"


@pytest.fixture
def folder(tmp_path):
    root = tmp_path / "cvs"
    root.mkdir()
    people = [("Jane Doe", "jane@x.io", "search engines", "Rust"), ("Rich Roe", "rich@x.io", "search portals", "Python"), ("Ann Poe", "ann@x.io", "bridges", "Rust")]
    for i, (n, m, w, s) in enumerate(people):
        (root / f"cv{i}.txt").write_text(RESUME.format(name=n, mail=m, what=w, skills=s))
    (root / "invoice.txt").write_text("Invoice\nsubtotal\namount due\n")
    (root / "empty.txt").write_text(" ")
    (root / "scan.pdf").write_bytes(b"%PDF")
    (root / "cv.docx").write_bytes(docx("Experience", "Led search teams", "Skills", "Rust"))
    (root / ".hidden.txt").write_text("Experience")
    return root


def test_import_publish_search(spark, folder, tmp_path):
    tables = engine.import_folder(spark, str(folder))
    status = {r.file_name: r.status for r in tables["versions"].collect()}
    assert status == {"cv0.txt": "resume_candidate", "cv1.txt": "resume_candidate", "cv2.txt": "resume_candidate", "cv.docx": "resume_candidate", "invoice.txt": "non_resume", "empty.txt": "failed", "scan.pdf": "ocr_backlog"}
    shop = snapshots.Store(spark, str(tmp_path / "store"))
    assert shop.publish(tables, "g1", None)["epoch"] == 1
    with pytest.raises(RuntimeError):
        shop.publish({"projection": tables["projection"]}, "g2", None)
    corpus = engine.corpus_of(shop.current("projection"), shop.current("mentions"))
    found = lambda q, **k: [r.file_name for r in engine.search(spark, corpus, q, **k).hits.orderBy("rank").collect()]
    assert sorted(found("search")) == ["cv.docx", "cv0.txt", "cv1.txt"]
    assert sorted(found("search", wanted={"skills_any": ["rust"]})) == ["cv.docx", "cv0.txt"]
    assert found("search", wanted={"names_any": ["rich roe"]}, top_k=1) == ["cv1.txt"]
    answer = engine.search(spark, corpus, "search", mode="hybrid")
    assert answer.partial == "embedding_runtime_unavailable" and answer.hits.count() == 3
    assert "search" in answer.hits.first().snippet and "@" not in answer.hits.first().snippet
    with pytest.raises(RuntimeError):
        engine.search(spark, corpus, "search", mode="semantic")
    for bad in ({"query": "x", "extra": 1}, {"query": "x", "mode": "no"}, {"query": "x", "top_k": 0}):
        with pytest.raises(ValueError):
            engine.parse_request(bad)
    gone = spark.createDataFrame([(shop.current("projection").where("file_name = 'cv0.txt'").first().doc_id,)], "doc_id string")
    projection = shop.current("projection")
    shop.publish({"projection": snapshots.incremental(projection, gone, projection.limit(0))}, "g3", "g1")
    assert shop.current("projection").count() == 3
    assert "g1" in shop.collect_garbage(1) and shop.head()["generation"] == "g3"


def test_semantic_search(spark):
    docs = spark.createDataFrame([("a", "v1", "a.txt", "red apples"), ("b", "v2", "b.txt", "green pears"), ("c", "v3", "c.txt", "red cars")], "doc_id string, version_id string, file_name string, clean_text string")
    vecs = docs.select("doc_id", "version_id", classify.hash_embedding(64)(F.col("clean_text")).alias("embedding"))
    local = lambda q: [float(x) for x in one(spark, classify.hash_embedding(64)(F.col("t")), t=q)]
    corpus = engine.Corpus(docs, fulltext.build_index(docs, "doc_id", "file_name", "clean_text"), vectors=vecs, embed=local)
    assert engine.search(spark, corpus, "green pears", "semantic").hits.orderBy("rank").first().doc_id == "b"
    hybrid = engine.search(spark, corpus, "red", "hybrid").hits.orderBy("rank").collect()
    assert {hybrid[0].doc_id, hybrid[1].doc_id} == {"a", "c"} and any(r.snippet == "semantic match" for r in hybrid)
    batch = engine.search_batch(spark, corpus, {"x": {"query": "red"}, "y": {"query": "pears"}})
    assert {n: a.hits.count() for n, a in batch.items()} == {"x": 2, "y": 1}
    timed = engine.search(spark, corpus, "red", "hybrid", timed=True)
    assert timed.hits.orderBy("rank").collect() == hybrid
    assert timed.rows == {"prefilter": 0, "bm25": 2, "ann": 3, "fusion": 3, "bulk_hydrate": 3, "snippet": 3}
    assert tuple(timed.timing) == engine.STAGES and timed.timing["prefilter"] == 0 < min(timed.timing[s] for s in engine.STAGES[2:])
    assert timed.server_timing().startswith("query_parse;dur=") and timed.server_timing().count(";dur=") == 7
    timed.release()
    assert timed.stages.kept == []


def test_deadline(spark):
    assert engine.with_deadline(spark, lambda: 5, 60_000) == (5, None)
    slow = lambda: spark.range(2 * 10**10).selectExpr("sum(sqrt(id))").collect()
    assert engine.with_deadline(spark, slow, 1500) == (None, "deadline_exceeded")


def test_file_stream(spark, folder, tmp_path):
    seen = []

    def publish(batch, number):
        seen.extend(r.path for r in files.parse(batch.where(files.wanted_extension(F.col("path"))).select("path", "content")).where("outcome = 'text_extracted'").collect())

    for _ in range(2):  # the second run finds nothing new
        ingest.run(ingest.watch(spark, str(folder)), str(tmp_path / "checkpoint"), publish).awaitTermination()
    assert len(seen) == len(set(seen)) == 5
    (folder / "late.txt").write_text("late")
    ingest.run(ingest.watch(spark, str(folder)), str(tmp_path / "checkpoint"), publish).awaitTermination()
    assert len(seen) == 6


def test_debounce(spark, tmp_path):
    """Bursts that cross slots, a burst that never pauses, a retry, and one that a burst comes before: against a replay."""
    r = random.Random(1)
    events = [("a", ms, False) for ms in (0, 400, 900, 1700, 2500)] + [("b", 1900 + 300 * k, False) for k in range(12)] + [("c", 100, True), ("d", 100, True), ("d", 20_000, False)]
    events += [("e", r.randrange(20_000), r.random() < 0.1) for _ in range(60)]
    base = 1_700_000_000_000  # nothing may lie at the epoch, where watermarks begin
    events = [(root, base + ms, failed) for root, ms, failed in events]
    want = []
    for root in "abcde":
        open_ = []
        retry = None
        for ms, failed in sorted((ms, failed) for x, ms, failed in events if x == root) + [(base + 3_600_000, False)]:
            while open_ or retry is not None:
                due = min(([min(open_[-1] + 750, open_[0] + 2000)] if open_ else []) + ([retry] if retry is not None else []))
                if due > ms:
                    break
                want.append((root, due, open_[0] if open_ else None, len(open_), "changes" if open_ else "retry"))
                open_, retry = [], None
            if failed:
                retry = ms + 30_000
            else:
                open_.append(ms)
    events.sort(key=lambda e: e[1])
    cuts = [0, 11, 12, 40, len(events)]
    for i, (low, high) in enumerate(zip(cuts, cuts[1:], strict=False)):
        rows = events[low:high] + ([(x, base + 3_600_000, False) for x in "abcde"] if high == len(events) else [])
        spark.createDataFrame(rows, "root string, ms long, failed boolean").selectExpr("root", "timestamp_millis(ms) AS ts", "failed").coalesce(1).write.parquet(str(tmp_path / "in" / str(i)))
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
        try:
            source = spark.readStream.schema("root string, ts timestamp, failed boolean").parquet(str(tmp_path / "in" / "*"))
            ingest.debounced(source).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
        finally:
            spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = [tuple(x) for x in spark.read.parquet(str(tmp_path / "out")).collect() if x.since != base + 3_600_000]
    assert sorted(got, key=str) == sorted(want, key=str) and any(w[4] == "retry" for w in want)


def test_publication_follows_the_rule(spark, tmp_path):
    shop = snapshots.Store(spark, str(tmp_path / "s"))
    sink = ingest.Publication(shop, "rows")
    seen, total = [], 0
    for number, n in enumerate([1, 50, 48, 1, 850, 60, 14, 500, 2000, 3]):
        batch = spark.range(total, total + n).withColumnRenamed("id", "doc_id")
        sink(batch, number)
        if number == 3:
            sink(batch, number)  # again, as after a failure
        total += n
        seen.append(shop.current("rows").count())
    assert seen == [1, 1, 1, 100, 100, 1010, 1024, 1024, 3524, 3524]
    assert shop.current("rows").distinct().count() == 3524


def test_scan_reports_errors_and_limits(spark, folder):
    found, errors = files.scan_with_errors(spark, [str(folder), "/no/such/folder"])
    assert found.count() >= 7 and [r.root for r in errors.collect()] == ["/no/such/folder"]
    limited = files.within_budget(found, 2).collect()
    assert len(limited) == 2 and limited[0].limited


def test_jsonl(spark, tmp_path):
    path = tmp_path / "x.jsonl"
    path.write_text('{"a": 1}\n\n  {"a": 2}\n')
    assert sorted(r.a for r in files.read_jsonl(spark, str(path), "a int").collect()) == [1, 2]


def test_origins(spark):
    source = "  Füller\r\nA  \tB\n\n\nPage 1 of 2\nH e l l o\n"
    clean, runs = text.normalized_with_origins(source)
    assert clean == one(spark, text.normalize_text(F.col("t")), t=source) == "Füller\nA B\n\nHello"
    data = source.encode()
    at = lambda a, b: data[slice(*text.source_span(runs, a, b))].decode()
    assert at(0, 7) == "Füller" and at(8, 11) == "A  \tB" and at(13, 18) == "H e l l o"
    assert text.source_span(runs, 7, 8) is None and text.source_span(runs, 3, 3) is None


@pytest.mark.parametrize(
    ("source", "good"),
    [
        ("A fair text of some forty and more signal characters, in a line.", True),
        ("short", False),
        ("x" * 50 + "\x01" * 5, False),
        ("\ue000" * 10 + "x" * 60, False),
        ("repeated line\n" * 4 + "another line of text\n", False),
        (("tokenoftwentylettersx " * 4) + "and a few others", False),
        ("ï»¿ A fair text of some forty and more signal characters, in a line.", False),
        ("A fair text with a run " + "".join(chr(97 + i % 26) + chr(65 + i * 7 % 26) for i in range(60)), False),
    ],
)
def test_quality_gate(spark, source, good):
    assert one(spark, text.quality(F.col("t")), t=source) is good


def test_admission(spark):
    gate = engine.Admission(spark)
    with gate.admitted("background"), gate.admitted("background"):
        with pytest.raises(RuntimeError, match="overloaded"), gate.admitted("background"):
            pass
        with gate.admitted("batch"):
            assert spark.range(3).count() == 3
    assert not any(gate.running.values())


def test_command_line(spark, folder, tmp_path, capsys):
    from lodestar.__main__ import main

    shop = str(tmp_path / "shop")
    assert main(["import", str(folder), shop]) == 0
    assert main(["search", shop, "search portals"]) == 0
    assert main(["status", shop]) == 0
    out = capsys.readouterr().out
    assert '"file_name": "cv1.txt"' in out and '"status": "resume_candidate", "count": 4' in out
    doc = snapshots.Store(spark, shop).current("projection").where("file_name = 'cv1.txt'").first().doc_id
    assert main(["detail", shop, doc]) == 0 and "<redacted-email>" in capsys.readouterr().out
    assert main(["delete", shop, doc]) == 0 and main(["gc", shop]) == 0
    assert doc not in {r.doc_id for r in snapshots.Store(spark, shop).current("projection").collect()}


def test_nearest_rank_against_sorting(spark):
    """Negative, tiny, huge, equal and missing values, null keys, one value alone."""
    import math
    import random

    r = random.Random(3)
    rows = [(r.choice(["a", "b", None]), r.choice([None, 0.0, -1.5, 2.0, r.gauss(0, 1), r.gauss(0, 1) * 10 ** r.randint(-9, 9), float(r.randint(-50, 50))])) for _ in range(3000)] + [("one", 7.25)]
    found = {x.k: x for x in metrics.nearest_rank(spark.createDataFrame(rows, "k string, v double"), "v", [0, 1, 50, 95, 100], "k").collect()}
    assert set(found) == {"a", "b", None, "one"}
    for k, x in found.items():
        held = sorted(v for key, v in rows if key == k and v is not None)
        assert [x[f"p{p}"] for p in (0, 1, 50, 95, 100)] == [held[max(1, math.ceil(p * len(held) / 100)) - 1] for p in (0, 1, 50, 95, 100)]


def test_holdout_of_a_large_stratum(spark):
    rows = spark.createDataFrame([(i, "big" if i < 2000 else "pair" if i < 2002 else None if i < 2010 else "alone") for i in range(2011)], "i long, s string")
    found = metrics.stratified_holdout(rows, "s", F.sha2(F.col("i").cast("string"), 256), 15).collect()
    import hashlib

    order = lambda ids: sorted(ids, key=lambda i: hashlib.sha256(str(i).encode()).hexdigest())
    want = order(range(2000))[:300] + order(range(2000, 2002))[:1] + order(range(2002, 2010))[:1]
    assert sorted(r.i for r in found) == sorted(want)


def test_soft_duplicates_against_all_pairs(spark, monkeypatch):
    import itertools
    import random

    r = random.Random(5)
    some = lambda letter, n: [f"{letter}{r.randrange(n)}" for _ in range(r.randint(0, 3))]
    rows = [(i, r.choice(["x", "y"]), some("s", 4), some("c", 4), some("k", 5)) for i in range(120)]
    want = set()
    for a, b in itertools.combinations(rows, 2):
        skills = min(3, len(set(a[4]) & set(b[4])))
        score = min(0.95, 0.45 + 0.25 * bool(set(a[2]) & set(b[2])) + 0.2 * bool(set(a[3]) & set(b[3])) + 0.1 * skills / 3)
        if a[1] == b[1] and round(score, 6) > 0.7:
            want.add((a[0], b[0], round(score, 6)))
    for most in (2000, 3):
        monkeypatch.setattr(store, "LONG", most)
        found = store.soft_duplicates(spark.createDataFrame(rows, "doc_id long, name string, schools array<string>, companies array<string>, skills array<string>")).collect()
        assert len(found) == len(want) and {tuple(x) for x in found} == want


def test_pages_of_bytes_join_to_the_text(spark):
    texts = ["", "abc", "é" * 9, "a名b😀c" * 7, "😀😀😀", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for limit in (4, 5, 7, 64):
        for x in docs.select("i", text.pages_of_bytes(F.col("t"), limit).alias("p")).collect():
            assert "".join(x.p) == (texts[x.i] or "") and all(len(p.encode()) <= limit for p in x.p)


def test_projection_digest_of_large_sums(spark):
    """No lane overflows: the sums of 16 bits stay far below what a long holds."""
    rows = spark.range(3000).selectExpr("id AS doc_id", "CAST(id AS string) AS version_id")
    a, b = (ids.projection_digest(x).first() for x in (rows, rows.repartition(7)))
    assert a == b and a.repeated == 0
    assert ids.projection_digest(rows.unionByName(rows.limit(2))).first().repeated == 2


def test_second_import_adds_and_searches_read_the_index(spark, folder, tmp_path, capsys):
    import json

    from lodestar.__main__ import main

    shop = str(tmp_path / "shop")
    assert main(["import", str(folder), shop]) == 0
    more = tmp_path / "more"
    more.mkdir()
    (more / "new.txt").write_text("Summary\nEducation\nExperience\nBuilt quaint search portals")
    (more / "second.txt").write_text("Invoice\nSubtotal 5\nAmount due 5")
    assert main(["import", str(more), shop]) == 0 and main(["import", str(more), shop]) == 0 and main(["doctor", shop]) == 0
    capsys.readouterr()
    assert main(["search", shop, "quaint"]) == 0 and "new.txt" in capsys.readouterr().out
    assert main(["search", shop, "search"]) == 0
    assert {json.loads(x)["file_name"] for x in capsys.readouterr().out.splitlines()} >= {"cv0.txt", "new.txt"}
    store_ = snapshots.Store(spark, shop)
    doc = store_.current("projection").where("file_name = 'new.txt'").first().doc_id
    assert main(["purge", shop, doc]) == 0 and main(["doctor", shop]) == 0
    assert store_.current("mentions").join(store_.current("versions"), "version_id", "left_anti").isEmpty()
    capsys.readouterr()
    assert main(["search", shop, "quaint"]) == 0 and not capsys.readouterr().out
    assert main(["export", shop, str(tmp_path / "out")]) == 0
    assert spark.read.json(str(tmp_path / "out")).count() == store_.current("projection").count()


def test_published_index_prunes_and_scores_as_built(spark, tmp_path):
    docs = spark.createDataFrame([(i, " ".join(f"w{(i * k) % 23}" for k in range(1, 9)), f"f{i % 3}") for i in range(200)], "doc_id long, body string, name string")
    built = fulltext.build_index(docs, "doc_id", "body", "name")
    shop = snapshots.Store(spark, str(tmp_path / "s"))
    shop.publish(engine.index_tables(built), "g1", None)
    plans = {"a": fulltext.plan_query("w3 w5"), "b": fulltext.plan_query('"w1 w2"'), "c": fulltext.plan_query("w4 NOT f1")}
    read = engine.read_index(shop).of(fulltext.terms_of(plans))
    asked = fulltext.query_table(spark, plans)
    rows = lambda index: sorted(map(str, fulltext.search(index, asked, 7).collect()))
    assert rows(read) == rows(built) == rows(fulltext.scan_postings(docs, "doc_id", fulltext.terms_of(plans), "body", "name"))
    plan = read.postings._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan.replace("isnotnull(bucket#", "bucket#") or "bucket" in plan.split("PartitionFilters:")[1][:200]
    # The next generation is what would be built anew.
    gone, changed = docs.where("doc_id % 4 = 0"), docs.where("doc_id % 4 = 1").withColumn("body", F.lit("w3 w5 zz"))
    after = fulltext.changed_index(engine.read_index(shop), gone.unionByName(changed), fulltext.build_index(changed, "doc_id", "body", "name"))
    anew = fulltext.build_index(docs.where("doc_id % 4 > 1").unionByName(changed), "doc_id", "body", "name")
    assert rows(after) == rows(anew) and sorted(map(str, after.stats.collect())) == sorted(map(str, anew.stats.collect()))


def pdf(*pages, cmap=None, packed=True):
    """A file with a page for each content stream and one font, with a map to Unicode if given."""
    import zlib

    objects = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 3: b"<< /Type /Font /Subtype /Type1 " + (b"/ToUnicode 4 0 R " if cmap else b"") + b">>"}
    stream = lambda data: b"<< /Length %d /Filter /FlateDecode >>\nstream\n%s\nendstream" % (len(zlib.compress(data)), zlib.compress(data)) if packed else b"<< /Length %d >>\nstream\n%s\nendstream" % (len(data), data)
    if cmap:
        objects[4] = stream(cmap)
    kids = []
    for k, content in enumerate(pages):
        kids.append(b"%d 0 R" % (10 + 2 * k))
        objects[10 + 2 * k] = b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R >>" % (11 + 2 * k)
        objects[11 + 2 * k] = stream(content)
    objects[2] = b"<< /Type /Pages /Kids [" + b" ".join(kids) + b"] /Count %d /Resources << /Font << /F1 3 0 R >> >> >>" % len(pages)
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % x for x in sorted(objects.items())) + b"trailer << /Root 1 0 R >>"


def test_pdf_text():
    from lodestar.sources.pdf import read_pdf

    first = rb"BT /F1 12 Tf 72 720 Td (Experience) Tj 0 -14 Td [(Led ) -20 (search) -300 (teams)] TJ T* (a \(b\) \101\\) Tj ET"
    assert read_pdf(pdf(first, rb"BT /F1 9 Tf 1 0 0 1 10 10 Tm (left) Tj 1 0 0 1 90 10 Tm (right) Tj (x) ' ET")) == "Experience\nLed search teams\na (b) A\\\fleft right\nx"
    assert read_pdf(pdf(first, packed=False)).startswith("Experience\nLed")
    cmap = b"1 begincodespacerange <0000> <FFFF> endcodespacerange 1 beginbfchar <0001> <6280> endbfchar 1 beginbfrange <0002> <0004> <0041> endbfrange"
    assert read_pdf(pdf(b"BT /F1 12 Tf <0001000200030004> Tj ET", cmap=cmap)) == "技ABC"
    assert read_pdf(pdf(b"q 1 0 0 1 0 0 cm /Im1 Do Q")) == "" and read_pdf(b"%PDF") == ""
    with pytest.raises(ValueError):
        read_pdf(b"%PDF-1.4 trailer << /Encrypt 5 0 R >>")


def test_pdf_import_and_its_quality_gate(spark, tmp_path):
    lines = ["Summary", "Education", "Experience", "Built search portals for many customers and teams", "Skills", "Rust"]
    show = lambda xs: b"BT /F1 12 Tf " + b" ".join(b"(%s) Tj T*" % x.encode() for x in xs) + b" ET"
    (tmp_path / "cv.pdf").write_bytes(pdf(show(lines)))
    (tmp_path / "poor.pdf").write_bytes(pdf(show(["Summary", "Experience"])))
    (tmp_path / "image.pdf").write_bytes(pdf(b"/Im1 Do"))
    (tmp_path / "locked.pdf").write_bytes(pdf(show(lines)) + b" /Encrypt 5 0 R")
    found = {r.file_name: r.status for r in engine.import_folder(spark, str(tmp_path))["versions"].collect()}
    assert found == {"cv.pdf": "resume_candidate", "poor.pdf": "ocr_backlog", "image.pdf": "ocr_backlog", "locked.pdf": "failed"}


def test_store_recovers_from_a_stop_at_each_step(spark, tmp_path, monkeypatch):
    one = spark.createDataFrame([("a",)], "doc_id string")
    stops = {"journal": lambda name: "/journal/" in name, "void": lambda name: False, "head": lambda name: name.endswith("HEAD.json")}
    for step, stop in stops.items():
        shop = snapshots.Store(spark, str(tmp_path / step))
        shop.publish({"projection": one}, "g1", None)
        create = snapshots.Store._create

        def broken(self, name, value, overwrite, stop=stop, create=create):
            if stop(name):
                self._fs.create(self._path(name), overwrite).close()
                raise OSError("stopped")
            create(self, name, value, overwrite)

        monkeypatch.setattr(snapshots.Store, "_create", broken)
        if step != "void":
            with pytest.raises(OSError):
                shop.publish({"projection": one}, "g2", "g1")
        monkeypatch.setattr(snapshots.Store, "_create", create)
        # Before the entry is whole nothing has changed; after it the generation is published, whatever became of HEAD.
        base = {"journal": "g1", "void": "g1", "head": "g2"}[step]
        assert shop.head()["generation"] == base and shop.current("projection").count() == 1
        assert shop.publish({"projection": one.limit(0)}, "g3", base)["generation"] == "g3"
        shop._fs.delete(shop._path(f"{shop.root}/HEAD.json"), False)
        assert shop.head()["generation"] == "g3" and shop.current("projection").count() == 0
        with pytest.raises(RuntimeError):
            shop.publish({"projection": one}, "g4", base)
        assert "g3" not in shop.collect_garbage(1)


def test_index_follows_its_table(spark, tmp_path):
    from lodestar.plans import retrieval_queries

    write = lambda rows: spark.createDataFrame(rows, "doc_id long, text string, source string").write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
    terms = lambda: {r.term for r in retrieval_queries.ft_index_statistics(spark, str(tmp_path)).where("field = 'text'").collect()}
    write([(1, "alpha beta", "s"), (2, "beta", "s")])
    assert terms() == {"alpha", "beta"}
    write([(3, "gamma", "s")])
    assert terms() == {"gamma"}


def test_nearest_rank_of_infinities_and_nan(spark):
    inf, nan = float("inf"), float("nan")
    rank = lambda values, *ps: spark_rank(spark, values, ps)
    assert rank([1.0, 2.0, inf], 50, 100) == [2.0, inf]
    assert rank([-inf, 1.0, inf, -inf], 25, 50, 75, 100) == [-inf, -inf, 1.0, inf]
    got = rank([1.0, 2.0, nan], 50, 100)
    assert got[0] == 2.0 and math.isnan(got[1])
    assert rank([-0.0, 0.0, 5e-324, -1.0], 25, 50, 100) == [-1.0, 0.0, 5e-324]


def spark_rank(spark, values, percents):
    row = metrics.nearest_rank(spark.createDataFrame([(v,) for v in values], "x double"), "x", list(percents)).first()
    return [row[f"p{p}"] for p in percents]


def test_pdf_of_many_pages():
    from lodestar.sources.pdf import read_pdf

    text = read_pdf(pdf(*(b"BT /F1 12 Tf (page%d) Tj ET" % k for k in range(2500))))
    assert "page0" in text and "page2499" in text


def test_contact_hash_is_the_standard_one(spark):
    import hashlib
    import hmac

    for key in (b"k", b"long " * 30):
        rows = spark.createDataFrame([("a@b.test",), ("é",), (None,)], "v string").select("v", ids.contact_hash(key, "email")(F.col("v")).alias("h")).collect()
        assert [r.h for r in rows] == [v and hmac.new(key, f"email\0{v}".encode(), hashlib.sha256).hexdigest() for v in ("a@b.test", "é", None)]


def clustered(n, dimension=16):
    """Vectors around a few directions, one of them a third of all, the first of these repeated many times."""
    r = np.random.default_rng(4)
    centres = r.normal(size=(12, dimension))
    of = np.where(r.random(n) < 0.34, 0, r.integers(0, 12, n))
    rows = centres[of] + r.normal(size=(n, dimension)) * 0.4
    rows[100:150] = rows[100]
    return rows.astype(np.float32)


def test_approximate_search(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ann, "PAGE", 100)
    monkeypatch.setattr(ann, "QUERY_PAGE", 16)
    rows = clustered(1500)
    vecs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)] + [(9999, None)], "vec_id long, embedding array<float>")
    shop = snapshots.Store(spark, str(tmp_path / "v"))
    ann.publish(shop, "g1", None, vecs)
    pages, model = shop.current("ann_codes"), ann.read_model(shop.current("ann_model"))
    # Every vector has one code, four values a byte; hot lists lie in several pages.
    assert pages.select(F.explode("rows.key")).distinct().count() == 1500 and pages.selectExpr("max(size(rows))").first()[0] < 250
    assert pages.select(F.explode("rows.code").alias("c")).selectExpr("max(octet_length(c))").first()[0] == 4
    asked = vecs.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    exact = {(r.query_id, r.vec_id) for r in vectors.nearest(vecs, asked, 10).collect()}
    found = ann.search(pages, model, vecs, asked, 10).collect()
    assert len(found) == 750 and len({(r.query_id, r.vec_id) for r in found} & exact) >= 0.9 * 750
    # Allowed vectors that candidates lack are found exactly; a query is never answered with fewer than there are.
    few = vecs.where("vec_id % 100 = 7").select("vec_id")
    want = sorted(map(tuple, vectors.nearest(vecs.join(few, "vec_id"), asked, 12).collect()))
    assert sorted(map(tuple, ann.search(pages, model, vecs, asked, 12, few).select("query_id", "vec_id", "score", "rank").collect())) == sorted((a, b, c, d) for a, b, c, d in want)


def test_approximate_search_of_nothing(spark, tmp_path):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    shop = snapshots.Store(spark, str(tmp_path / "v"))
    ann.publish(shop, "g1", None, none)
    found = ann.search(shop.current("ann_codes"), ann.read_model(shop.current("ann_model")), none, none.select(F.col("vec_id").alias("query_id"), "embedding"), 3)
    assert found.collect() == []


def test_int8_codes(spark):
    row = spark.createDataFrame([([0.5, -1.0, 0.25],), ([0.0, 0.0, 0.0],)], "v array<float>").select(ann.int8_codes(F.col("v")).alias("c"), ann.int8_dot(F.col("v"), ann.int8_codes(F.col("v"))).alias("d")).collect()
    assert row[0].c.codes == [64, -127, 32] and abs(row[0].d - 1.3125) < 0.01 and row[1].c.codes == [0, 0, 0] and row[1].d == 0
