"""Findings of the third review: each test failed before its change."""

import math
import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lodestar.functions import text
from lodestar.operators import classify, extract, filters, fulltext, sections, store, vectors
from lodestar.plans import retrieval_queries, text_queries


def test_short_rows_that_become_long_work_are_dealt_over_tasks(spark, tmp_path):
    spark.range(12_000).selectExpr("id AS p_partkey").coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    assert extract.spread(spark.range(12_000).coalesce(1), 5000).rdd.getNumPartitions() == 3
    found = text_queries.extract_resume(spark, str(tmp_path)).where("p_partkey IN (7, 11999) AND entity_type IN ('email', 'skill')")
    assert {r.raw_value for r in found.collect()} == {"jane.doe7@example.test", "jane.doe11999@example.test", "Rust", "K8s", "PostgreSQL"}


def test_mentions_come_by_pieces_of_texts(spark, monkeypatch):
    monkeypatch.setattr(extract, "PIECE", 2)
    rows = spark.createDataFrame([(str(i), None if i == 3 else f"é {i}@example.test") for i in range(7)], "doc_id string, text string").coalesce(1)
    found = extract.all_mentions(rows, rules=(extract.find_contacts,)).select("doc_id", "raw_value", "span_start").collect()
    assert sorted(tuple(r) for r in found) == [(str(i), f"{i}@example.test", 3) for i in range(7) if i != 3]


def test_origins_are_whole_numbers_by_pieces(monkeypatch):
    texts = pa.array(["w " * 2000, None, "é  b"] * 20)
    tracemalloc.start()
    found = text.origin_array(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 4_000_000  # 40,000 runs; as dictionaries they took over 10 MB
    assert found[2].as_py() == {"clean": "é b", "origins": [dict(zip(text.RUN.names, r, strict=True)) for r in ((0, 2, 0, 2), (2, 3, 2, 4), (3, 4, 4, 5))]}
    monkeypatch.setattr(text, "PIECE", 7)
    assert [len(p) for p in text._origins(iter([texts]))] == [7] * 8 + [4]


def test_an_address_that_begins_with_a_mark_keeps_the_mark(spark):
    """A window may cut an address before a mark: a word boundary stands before the next word."""
    rows = spark.createDataFrame([(".last@example.test",), ("(.last@example.test)",), ("first.last@example.test",)], "t string").select(text.redact(F.col("t")))
    assert [r[0] for r in rows.collect()] == [".<redacted-email>", "(.<redacted-email>)", "<redacted-email>"]


def test_ties_of_rounded_scores_at_the_cut_go_to_the_key(spark):
    """The vector of key 1 is a little less like the query than those after it; to six digits all are alike."""
    turned = lambda a: [math.cos(a), math.sin(a)]
    rows = [(1, turned(0.50000005)), *[(i, turned(0.5)) for i in range(2, 6)]]
    vecs = spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1)
    found = vectors.nearest(vecs, spark.createDataFrame([("q", [1.0, 0.0])], "query_id string, embedding array<double>"), 2)
    assert sorted((r.vec_id, r.rank) for r in found.collect()) == [(1, 1), (2, 2)]


def test_a_block_of_scores_is_bounded_and_its_best_are_kept(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 7)
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 3)
    r = np.random.default_rng(3)
    m = r.integers(-2, 3, (60, 4)).astype(float)
    m[5] = 0
    unit = np.divide(m, np.linalg.norm(m, axis=1, keepdims=True), out=np.zeros_like(m), where=m.any(1)[:, None])
    seen = []
    monkeypatch.setattr(vectors, "_rounded", lambda similar, whole=vectors._rounded: seen.append(similar.shape) or whole(similar))
    want = {(str(q), int(v), n + 1) for q in range(8) for n, v in enumerate(sorted(range(60), key=lambda v: (-round(float(unit[q] @ unit[v]), 6), v))[:9])}
    best = vectors._nothing(pa.int64())
    for at in range(0, 60, 7):
        best = vectors._better(best, vectors._rounded(unit[:8] @ unit[at : at + 7].T), pa.array(range(at, min(60, at + 7)), pa.int64()), 9)
    assert max(a * b for a, b in seen) <= 8 * 7
    assert {(str(q), v) for q, v, _ in zip(*best.to_pydict().values(), strict=True)} == {w[:2] for w in want}
    vecs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "vec_id long, embedding array<double>").repartition(3)
    found = vectors.nearest(vecs, vecs.where("vec_id < 8").selectExpr("vec_id AS query_id", "embedding"), 9)
    assert {(r.query_id, r.vec_id, r.rank) for r in found.collect()} == want


def test_selection_of_a_job_has_no_bound(spark, tmp_path):
    n = filters.MOST_SELECTED * 13 // 10
    customers = spark.range(n).selectExpr("id AS c_custkey", "CAST(0 AS int) AS c_nationkey", "1.0D AS c_acctbal", "'BUILDING' AS c_mktsegment")
    customers.write.parquet(str(tmp_path / "customer.parquet"))
    spark.createDataFrame([(0, "ALGERIA")], "n_nationkey int, n_name string").write.parquet(str(tmp_path / "nation.parquet"))
    for name, columns in {"orders": "o_orderkey long, o_custkey long, o_orderdate timestamp", "lineitem": "l_orderkey long, l_partkey long", "part": "p_partkey long, p_brand string"}.items():
        spark.createDataFrame([], columns).write.parquet(str(tmp_path / f"{name}.parquet"))
    # A place of every fifth is not sure enough.
    assert retrieval_queries.flt_bounded(spark, str(tmp_path)).count() == n - n // 5 > filters.MOST_SELECTED
    found = filters.whole(customers.select(F.col("c_custkey").alias("doc_id")))
    assert found.count() == n and [r[0] for r in found.limit(3).collect()] == [0, 1, 2]


def test_small_models_need_no_join_and_give_the_same(spark, monkeypatch):
    grams = [("aaa", 1.5, 0.8), ("a.b", 2.0, -0.7), ("b c", 1.2, 0.3), ("é😀é", 1.1, 0.2), ("xy", 1.0, 9.0)]
    weights = spark.createDataFrame(grams, "gram string, idf double, weight double")
    rows = ["aaaaa a.b", "AXB a.b a.b", "b \n c", "é😀é😀é", "", None, "xy xy", "aaa b c a.b"]
    texts = spark.createDataFrame(list(enumerate(rows)), "doc_id int, text string")
    few = classify.promotion_scores(texts, weights, -0.1)
    assert "Join" not in few._jdf.queryExecution().executedPlan().toString()
    found = {r.doc_id: r.probability for r in few.collect()}
    monkeypatch.setattr(classify, "FEW_GRAMS", 2)
    want = {r.doc_id: r.probability for r in classify.promotion_scores(texts, weights, -0.1).collect()}
    assert found.keys() == want.keys() and all(abs(found[k] - want[k]) < 1e-12 for k in want)


def test_ends_of_headings_are_left_out_once(spark):
    lines = ["** Education: **", "Education" + "。" * 60, "x" * 41, " \t", "Skills | more", "My EXPERIENCE so far", "联系方式：", "—Education—"]
    rows = spark.createDataFrame(list(enumerate(lines)), "i int, line string").select("i", sections.heading_family(F.col("line")).alias("family"))
    assert [r.family for r in sorted(rows.collect())] == ["education", "education", None, None, None, "experience", "contact", "education"]
    assert sections.heading_family(F.col("line"))._jc.toString().count("btrim") == 1


def test_profiles_of_a_fact_are_compared_as_bits_by_pieces(monkeypatch):
    """Pairs of a large group leave in bounded pieces, with over 64 values of a kind, null skills and facts met earlier."""
    monkeypatch.setattr(store, "PAIRS", 40)
    r = np.random.default_rng(7)
    some = lambda letter, n, k: [f"{letter}{v}" for v in r.integers(0, n, k)]
    rows = [(i, i % 2, ["s5", *some("s", 9, 1)], some("c", 90, 2), [None, *some("k", 150, 20)]) for i in range(60)]
    table = pa.table(dict(zip(["doc_id", "part", "schools", "companies", "skills"], map(list, zip(*rows, strict=True)), strict=True)))
    got = []
    for low, high in ((0, 0), (0, 1), (1, 1)):
        mine = table.filter(pa.array([p in (low, high) for p in table["part"].to_pylist()]))
        pieces = list(store._compared(tuple(pa.scalar(k) for k in ("n", 0, "s5", low, high)), iter(mine.to_batches(max_chunksize=7))))
        assert max(len(p) for p in pieces) <= 40
        got += [tuple(x.values()) for p in pieces for x in p.to_pylist()]
    want = set()
    for i, a in enumerate(rows):
        for b in rows[i + 1 :]:
            score = round(min(0.95, 0.7 + 0.2 * bool(set(a[3]) & set(b[3])) + 0.1 * min(3, len(set(a[4]) & set(b[4]))) / 3), 6)
            if score > 0.7 and min(set(a[2]) & set(b[2])) == "s5":
                want.add((a[0], b[0], score))
    assert len(got) == len(want) and set(got) == want


def test_postings_are_made_in_their_row(spark, monkeypatch):
    monkeypatch.setattr(fulltext, "PIECE", 2)
    rows = [(1, "the Cat the", "a"), (2, None, "b"), (3, "", "a b"), (4, "cat é cat cat", None), (5, "x", "the")]
    docs = spark.createDataFrame(rows, "doc_id long, body string, name string").coalesce(1)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    index = fulltext.build_index(docs, "doc_id", "body", "name")
    assert "Exchange" not in plan(index.postings)
    told = lambda t: {(r.term, r.doc_id, r.field, r.tf, r.length, tuple(r.positions)) for r in t.collect()}
    want = {("the", 1, "body", 2, 3, (0, 2)), ("cat", 1, "body", 1, 3, (1,)), ("cat", 4, "body", 3, 4, (0, 2, 3)), ("é", 4, "body", 1, 4, (1,)), ("x", 5, "body", 1, 1, (0,)), ("a", 1, "name", 1, 1, (0,)), ("b", 2, "name", 1, 1, (0,)), ("a", 3, "name", 1, 2, (0,)), ("b", 3, "name", 1, 2, (1,)), ("the", 5, "name", 1, 1, (0,))}
    assert told(index.postings) == want and index.postings.count() == len(want)
    # Rows of one key are one document still.
    twice = fulltext.build_index(docs.unionByName(docs.where("doc_id = 5")), "doc_id", "body").postings
    assert [(r.tf, r.positions) for r in twice.where("term = 'x'").collect()] == [(2, [0, 0])]


def test_documents_leave_an_index_without_a_shuffle_of_postings(spark, monkeypatch):
    docs = spark.range(40).selectExpr("id AS doc_id", "concat('w', id % 3, ' the') AS body")
    gone, none = docs.where("doc_id % 5 = 0"), fulltext.build_index(docs.limit(0), "doc_id", "body")
    base = fulltext.build_index(docs, "doc_id", "body")
    base.postings, base.lengths = (t.withColumn("bucket", F.lit(0)) for t in (base.postings, base.lengths))
    kept = []
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        for most in (8, 7):
            monkeypatch.setattr(fulltext, "MOST_BROADCAST", most)
            after = fulltext.changed_index(base, gone, none)
            assert ("BroadcastHashJoin" in after.postings._jdf.queryExecution().executedPlan().toString()) == (most == 8)
            kept.append({(r.term, r.df) for r in after.terms.collect()})
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert kept[0] == kept[1] and ("the", 32) in kept[0]


def test_postings_cross_once_for_all_queries(spark):
    rows = [(1, "of the cat of"), (2, "the of"), (3, "of of the the end"), (4, "the cat"), (5, None)]
    docs = spark.createDataFrame(rows, "doc_id long, body string")
    index = fulltext.build_index(docs, "doc_id", "body")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    queries = fulltext.query_table(spark, {q: fulltext.plan_query(t) for q, t in {"a": '"of the"', "b": '"of of the the"', "c": '"the cat of"'}.items()})
    phrases = fulltext.phrase_bits(index, queries)
    assert "explode(positions" not in plan(phrases) and plan(phrases).count("Exchange hashpartitioning(doc_id") == 1 and "hashpartitioning(query_id" not in plan(phrases)
    assert sorted((r.query_id, r.doc_id) for r in phrases.collect()) == [("a", 1), ("a", 3), ("b", 3), ("c", 1)]
    words = fulltext.query_table(spark, {f"q{i}": fulltext.plan_query("the") for i in range(8)})
    # By query and document nothing is dealt again.
    assert "hashpartitioning(query_id" not in plan(fulltext.scores(index, words)) and "hashpartitioning(query_id" not in plan(fulltext.matching(index, words))
    some = fulltext.scores(index, words, docs.where("doc_id < 3").select("doc_id"))
    assert sorted((r.query_id, r.doc_id) for r in some.collect()) == [(f"q{i}", d) for i in range(8) for d in (1, 2)]
    mine = spark.createDataFrame([("q1", 4), ("q2", 1)], "query_id string, doc_id long")
    assert sorted((r.query_id, r.doc_id) for r in fulltext.scores(index, words, mine).collect()) == [("q1", 4), ("q2", 1)]
