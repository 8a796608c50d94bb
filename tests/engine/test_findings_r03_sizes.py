"""Findings of round 3 on growth: what a task or a worker holds, and what crosses between tasks."""

import re

from pyspark.sql import functions as F

from lodestar.operators import metrics, store
from lodestar.plans import text_queries


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_field_scores_in_one_aggregation(spark, monkeypatch):
    monkeypatch.setattr(metrics, "TASK_ROWS", 4)
    kinds = "doc_id long, field string, value long"
    expected = spark.createDataFrame([(1, "a", 1), (1, "a", 1), (1, "b", None), (None, "a", 2), (2, "a", 3), *[(i, "c", 0) for i in range(20)]], kinds)
    found = spark.createDataFrame([(1, "a", 1), (1, "b", None), (None, "a", 2), (2, "a", 4), *[(i, "c", 0) for i in range(20)]], kinds)
    got = metrics.field_scores(expected, found)
    assert "Join" not in plan(got) and "REPARTITION_BY_NUM" in plan(got)
    rows = {r.field: (r.tp, r.fp, r.fn) for r in got.collect()}
    # A null equals nothing.
    assert rows == {"a": (1, 2, 3), "b": (0, 1, 1), "c": (20, 0, 0), "overall": (21, 3, 4)}


def test_contacts_cross_as_bits(spark, monkeypatch):
    rows = [(str(i), i, f"e{i % 7}" if i % 3 else None, f"p{i % 5}" if i % 4 else None) for i in range(60)]
    contacts = spark.createDataFrame(rows, "version_id string, committed long, email_hash string, phone_hash string")
    spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
    owner, want = {}, {}
    for version, _, email, phone in rows:
        mine = [c for c in (email, phone) if c]
        known = [owner[c] if c in owner else None for c in (email, phone)]
        chosen = next((k for k in known if k), None)
        if mine and chosen is None:
            chosen = version
            owner |= dict.fromkeys(mine, version)
        want[version] = (None if known[0] and known[1] and known[0] != known[1] else chosen, *known)
    for few in (100, 0):
        monkeypatch.setattr(store, "FEW_CONTACTS", few)
        got = store.assign_candidates(contacts)
        assert not re.search(r"Exchange[^\n]*_hash|hashpartitioning\(_(email|phone)", plan(got))
        name = {f"cand_{r.h}": r.version_id for r in contacts.select("version_id", F.substring(F.sha2("version_id", 256), 1, 32).alias("h")).collect()}
        assert {r.version_id: tuple(name.get(r[c]) for c in ("candidate_id", "email_candidate", "phone_candidate")) for r in got.collect()} == want


def test_emails_cross_to_python_from_texts_with_an_at_only(spark, tmp_path):
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "64m")
    spark.createDataFrame([(1, "A@b.org a@B.org"), (2, "no address"), (3, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = text_queries.extract_emails(spark, str(tmp_path))
    assert "Contains(text" in plan(got)
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= 8 << 20
    assert [tuple(r) for r in got.collect()] == [(1, "a@b.org", 2)]
