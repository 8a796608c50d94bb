"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for every operator."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lodestar.llm import decontaminate, jaccard, maintext, media, mixing, sharding, tokencount, toxicity, urlfilter, warc

LONG = "word " * 40_000 + "x" * 70_000
DOCS = [(1, "a b c d e f g", "s"), (1, "a b c d e f g", "s"), (2, None, None), (None, "a b c", "s"), (3, "", "t"), (4, LONG, "t"), (5, "  \n ", None), (6, "a b c d e f g", "u"), (None, None, None)]
PAGES = [(1, "http://A.com/x", "<p>hi</p>"), (1, "http://A.com/x", "<p>hi</p>"), (2, None, None), (None, "b", ""), (3, "no scheme", "<p>" + "long text. " * 50_000), (4, "x://h\r\n/p", "<p>unclosed <b>bold & <!-- c")]
CLASH = "size block shard part before place n_words n_hit score text_crc32 class label media payload _row _text verdict host".split()
DOC_OPERATORS = {
    "media": lambda spark, d: media.media_features(d),
    "sharding": lambda spark, d: sharding.assign_shards(d),
    "tokens": lambda spark, d: tokencount.count_tokens(d, tokencount.load_ranks()),
    "decontaminate": lambda spark, d: decontaminate.overlaps(d, spark.createDataFrame([(1, "a b c d e f g"), (None, None), (2, ""), (2, "zz")], "item_id long, text string")),
    "jaccard": lambda spark, d: jaccard.with_components(d),
    "mixing": lambda spark, d: mixing.mix_plan(d),
    "toxicity": lambda spark, d: toxicity.score_documents(d, labels(spark)),
}
PAGE_OPERATORS = {
    "warc": lambda spark, p: warc.page_records(spark, p),
    "urls": lambda spark, p: urlfilter.judge_urls(p, urlfilter.publish(spark, urlfilter.RULES)),
    "maintext": lambda spark, p: maintext.extract(p, maintext.train()),
}


def labels(spark):
    return spark.createDataFrame([(1, 0, 1), (4, 0, None), (6, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")


def documents(spark, rows=DOCS):
    return spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("lang", F.lit(None).cast("string")).withColumn("n_chars", F.length("text").cast("long"))


def pages(spark, rows=PAGES):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def clashing(df):
    return df.select("*", *[F.lit("x").alias(c) for c in CLASH if c not in df.columns])


def rows(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("name", DOC_OPERATORS)
def test_documents(spark, name):
    operator = DOC_OPERATORS[name]
    found = rows(operator(spark, documents(spark)))
    assert len(found) == len(DOCS)
    assert rows(operator(spark, clashing(documents(spark)))) == found
    assert rows(operator(spark, documents(spark).repartition(3, "source"))) == found
    assert operator(spark, documents(spark, [])).count() == 0


@pytest.mark.parametrize("name", PAGE_OPERATORS)
def test_pages(spark, name):
    operator = PAGE_OPERATORS[name]
    found = rows(operator(spark, pages(spark)))
    assert len(found) == len(PAGES)
    assert rows(operator(spark, clashing(pages(spark)))) == found
    assert operator(spark, pages(spark, [])).count() == 0


def test_decontamination_by_shuffle(spark, monkeypatch):
    """Nulls, repeats, empty tables and clashing names on the other way of joining."""
    by_broadcast = DOC_OPERATORS["decontaminate"]
    wide = clashing(documents(spark)).withColumn("mark", F.lit("m")).withColumn("prints", F.lit("p"))
    none = spark.createDataFrame([], "item_id long, text string")
    want = rows(by_broadcast(spark, documents(spark))), rows(decontaminate.overlaps(documents(spark), none))
    kept = rows(decontaminate.with_overlap(wide, labels(spark).select(F.col("doc_id").alias("item_id"), F.lit("a b c d").alias("text")), "doc_id", "text", "_text", "mark", "prints"))
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", -1)
    assert (rows(by_broadcast(spark, wide)), rows(decontaminate.overlaps(documents(spark), none))) == want
    assert rows(decontaminate.with_overlap(wide, labels(spark).select(F.col("doc_id").alias("item_id"), F.lit("a b c d").alias("text")), "doc_id", "text", "_text", "mark", "prints")) == kept
    assert by_broadcast(spark, documents(spark, [])).count() == 0


def pipeline_folder(spark, tmp_path, item="q w e r t y"):
    labels(spark).write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def plain(df):
    return sorted(((r.doc_id, r.text, r.source) for r in df.collect()), key=str)


STAGES = dict(corpus_pipeline.STAGES)


def test_near_duplicates_of_repeated_ids(spark, tmp_path):
    """A row goes for its own text only; of repeated rows the first by all columns stays; rows without doc_id all stay."""
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    given = [(3, a, "s"), (5, a, "s"), (5, b, "t"), (5, b, "r"), (6, None, "s"), (6, None, "s"), (7, "", "s"), (7, " ", "s"), (None, a, "s"), (None, a, "s"), (None, None, "s")]
    found = plain(STAGES["jaccard"](spark, documents(spark, given), pipeline_folder(spark, tmp_path)))
    assert found == sorted([(3, a, "s"), (5, b, "r"), (6, None, "s"), (7, "", "s"), (7, " ", "s"), (None, a, "s"), (None, a, "s"), (None, None, "s")], key=str)


def test_contaminated_nulls_and_repeats(spark, tmp_path):
    given = [(1, "Q w, e r t y!", "s"), (1, "q w e r t", "s"), (2, None, "s"), (2, "", None), (None, "x q w e r t y z", "s"), (4, "fine", "s"), (4, "fine", "s"), (5, "... --", "s")]
    found = plain(STAGES["decontaminate"](spark, documents(spark, given), pipeline_folder(spark, tmp_path)))
    assert found == sorted([(1, "q w e r t", "s"), (2, None, "s"), (2, "", None), (4, "fine", "s"), (4, "fine", "s"), (5, "... --", "s")], key=str)


def test_toxicity_stage_without_labels_keeps_all(spark, tmp_path):
    given = [(i, t, "s") for i, t, _ in DOCS]
    assert plain(STAGES["toxicity"](spark, documents(spark, given), pipeline_folder(spark, tmp_path))) == sorted(given, key=str)


def test_mix_stage_shares_fates(spark, tmp_path):
    """Repeats share a fate, no row is taken more than three times, a source without words gives nothing."""
    given = [(i, f"word{i} and more", "abc"[i % 3]) for i in range(90)] + [(5, "word5 and more", "c")] * 2 + [(200, None, None), (201, "", None)]
    folder = pipeline_folder(spark, tmp_path)
    times = {}
    for row in plain(STAGES["mix"](spark, documents(spark, given), folder)):
        times[row] = times.get(row, 0) + 1
    assert set(times) <= set(given) and all(n <= 3 * given.count(row) and n % given.count(row) == 0 for row, n in times.items())
    assert not any(row[2] is None for row in times)
    assert plain(STAGES["mix"](spark, documents(spark, given).repartition(5), folder)) == plain(STAGES["mix"](spark, documents(spark, given), folder))


def test_shard_stage_is_in_stored_order(spark, tmp_path):
    """Nulls count 8 bytes, repeats are rows of their own, each shard's slots follow the files."""
    given = [(None, None, "s"), (1, "x" * 92, "s"), (1, "x" * 92, "s"), (2, "", "s"), (3, "é" * 400, "s")]
    documents(spark, given).coalesce(1).write.parquet(f"{tmp_path}/stored")
    found = STAGES["shard"](spark, spark.read.parquet(f"{tmp_path}/stored"), str(tmp_path)).collect()
    total, before, slots = 8 + 100 + 100 + 8 + 808, 0, {}
    for i, t, _ in given:
        size = 8 + len((t or "").encode())
        k = min(23, (2 * before + size) * 24 // (2 * total))
        slots[k] = slots.get(k, -1) + 1
        assert sum((r.doc_id, r.text, r.size, r.shard, r.slot) == (i, t, size, k, slots[k]) for r in found) == 1
        before += size
    assert len(found) == len(given)


def test_pipeline_keeps_columns(spark, tmp_path):
    for rows_ in (DOCS, []):
        folder = str(tmp_path / f"t{len(rows_)}")
        docs = clashing(documents(spark, rows_))
        docs.write.parquet(f"{folder}/documents.parquet")
        labels(spark).write.parquet(f"{folder}/labels.parquet")
        spark.createDataFrame([(1, "q w e r t y")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, docs, folder).columns == docs.columns
        out = corpus_pipeline.run(spark, folder)
        assert {"doc_id", "text", "source", "lang", "n_chars", "shard", "slot"} <= set(out.columns)
        assert (out.count() > 0) == bool(rows_)
