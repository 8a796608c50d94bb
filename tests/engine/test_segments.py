"""The keyword index in segments, held against one that is built anew."""

import pytest
from pyspark.sql import functions as F

from lodestar.operators import fulltext, segments
from lodestar.sources.snapshots import Store


def build(docs):
    return fulltext.build_index(docs, "doc_id", "body", "name")


def rows(table):
    return sorted(map(str, table.collect()))


@pytest.fixture
def shop(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(segments, "FANOUT", 3)
    monkeypatch.setattr(segments, "TIER_TOKENS", 60)
    return Store(spark, str(tmp_path / "s"))


def publish(shop, generation, docs, leaving=None, **more):
    head = shop.head()
    tables, facts = segments.change(shop, head, generation, build(docs), leaving, **more)
    return shop.publish(tables, generation, head and head["generation"], facts)


def test_segments_answer_like_an_index_built_anew(spark, shop):
    text = lambda i, k: " ".join(f"w{(i * k) % 11}" for k in range(1, 2 + k))
    alive: dict[int, tuple] = {}
    plans = {"a": fulltext.plan_query("w3 OR w5"), "b": fulltext.plan_query('"w1 w2" OR w7'), "c": fulltext.plan_query("w4 NOT f1")}
    asked = fulltext.query_table(spark, plans)
    seen = set()
    for step in range(5):
        new = {i: (i, text(i + step, i % 6), f"f{i % 3}") for i in range(step * 6, step * 6 + 8)}  # two replace earlier ones
        left = [i for i in alive if i % 4 == step % 4]
        entry = publish(shop, f"g{step}", spark.createDataFrame(list(new.values()), "doc_id long, body string, name string"), spark.createDataFrame([(i,) for i in {*left, *new}], "doc_id long"))
        alive = {**{i: d for i, d in alive.items() if i not in left}, **new}
        seen.add(len(entry["facts"]["segments"]))
        if step in (1, 4):
            shop.collect_garbage(1)
            anew = build(spark.createDataFrame(list(alive.values()), "doc_id long, body string, name string"))
            whole = segments.Segments(shop, shop.head()).index()
            assert rows(whole.terms.select("term", "field", "df", "cf")) == rows(anew.terms.select("term", "field", "df", "cf"))
            assert rows(whole.stats.select("field", "average", "docs")) == rows(anew.stats.select("field", "average", "docs"))
            assert rows(whole.lengths.select("doc_id", "field", "length")) == rows(anew.lengths.select("doc_id", "field", "length"))
            assert rows(fulltext.search(whole.of(fulltext.terms_of(plans)), asked, 5)) == rows(fulltext.search(anew, asked, 5))
    assert len(seen) > 1 and max(seen) < 5  # segments came and were merged


def test_a_publication_writes_its_own_segment_only(spark, shop):
    docs = lambda *ids: spark.createDataFrame([(i, "alpha beta", "n") for i in ids], "doc_id long, body string, name string")
    publish(shop, "g1", docs(*range(40)))
    entry = publish(shop, "g2", docs(100), docs(3))
    assert [s["generation"] for s in entry["facts"]["segments"]] == ["g1", "g2"]
    assert shop.read("g2", "index_lengths").select("doc_id").distinct().count() == 1 and shop.read("g2", "index_gone").where("segment = 1").count() == 2
    assert "g1" not in shop.collect_garbage(1)
    # A scan of a term opens its bucket only.
    plan = segments.Segments(shop, shop.head()).index(["alpha"]).postings._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1][:120]


def test_purge_leaves_no_postings_of_the_dead(spark, shop):
    docs = lambda *ids: spark.createDataFrame([(i, f"word{i}", "n") for i in ids], "doc_id long, body string, name string")
    publish(shop, "g1", docs(*range(40)))
    publish(shop, "g2", docs(100), docs(3))
    publish(shop, "g3", docs().limit(0), docs(5), purge=True)
    assert set(shop.collect_garbage(1)) == {"g1"}  # g2's document is alive and was not touched
    held = [r.term for g in ("g2", "g3") for r in shop.read(g, "index_postings").select("term").collect()]
    assert "word4" in held and not {"word3", "word5"} & set(held)


def test_segments_of_nothing_and_of_the_dead(spark, shop):
    docs = lambda *ids: spark.createDataFrame([(i, None if i == 1 else "alpha", "") for i in ids], "doc_id long, body string, name string")
    assert publish(shop, "g1", docs().limit(0))["facts"]["segments"] == []
    assert segments.Segments(shop, shop.head()).index(["alpha"]).postings.isEmpty()
    publish(shop, "g2", docs(1, 2))
    entry = publish(shop, "g3", docs().limit(0), docs(1, 2, 9))
    assert entry["facts"]["segments"] == [] and entry["facts"]["uses"] == []
    found = segments.Segments(shop, shop.head()).index()
    assert found.terms.isEmpty() and found.stats.isEmpty() and found.lengths.isEmpty()


def test_an_index_in_one_piece_becomes_a_segment(spark, shop):
    docs = spark.createDataFrame([(i, f"alpha w{i % 3}", "n") for i in range(9)], "doc_id long, body string, name string")
    tables, facts = segments.change(shop, None, "g1", build(docs.where("doc_id > 6")), docs.where("doc_id < 2"), base=build(docs.where("doc_id <= 6")))
    shop.publish(tables, "g1", None, facts)
    anew = build(docs.where("doc_id >= 2"))
    assert rows(segments.Segments(shop, shop.head()).index().terms.select("term", "field", F.col("df"))) == rows(anew.terms.select("term", "field", "df"))
