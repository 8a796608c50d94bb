"""Queries of keyword, vector and hybrid retrieval and of structured filters."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions.months import month_text
from lodestar.operators import ann, filters, fulltext, fusion, segments, vectors
from lodestar.operators.filters import Predicate
from lodestar.plans import engine
from lodestar.plans.registry import query, table
from lodestar.sources.snapshots import Store, state_of

TOKENS = r"list_filter(regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}]+'), lambda t: octet_length(encode(t)) <= 40)"
POSTINGS = f"""
    f AS (SELECT doc_id, 'text' AS field, {TOKENS.format('text')} AS ts FROM documents UNION ALL SELECT doc_id, 'source', {TOKENS.format('source')} FROM documents),
    p AS (SELECT doc_id, field, unnest(ts) AS term, unnest(range(len(ts))) AS pos FROM f)"""


_published: dict[tuple[str, str, str], Store] = {}


def new_folder(spark: SparkSession, purpose: str) -> str:
    """A path below the folder that all machines share; only a local session may do without one."""
    root = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        root = "file://" + tempfile.gettempdir()
    return f"{root.rstrip('/')}/lodestar-{purpose}-{uuid.uuid4().hex}"


def published(spark: SparkSession, sf: str) -> fulltext.Index:
    """The published index of a corpus; the first query of a session on it publishes it, the others read what they need.

    A corpus whose files have changed is another one, and is published anew.
    """
    key = spark.sparkContext.applicationId, sf, state_of(spark, f"{sf}/documents.parquet")
    if key not in _published:
        _published[key] = publish_index(spark, sf, new_folder(spark, "index"))
    return engine.read_index(_published[key])


def publish_index(spark: SparkSession, sf: str, root: str) -> Store:
    store = Store(spark, root)
    index = fulltext.build_index(table(spark, sf, "documents"), "doc_id", "text", "source")
    store.publish(engine.index_tables(index), "g1", None, engine.index_facts)
    return store


def postings_of(spark: SparkSession, sf: str, plans: dict[str, fulltext.Plan]) -> tuple[fulltext.Index, fulltext.Queries]:
    return published(spark, sf).of(fulltext.terms_of(plans)), fulltext.query_table(spark, plans)


def matches(spark: SparkSession, sf: str, text: str) -> DataFrame:
    return fulltext.matching(*postings_of(spark, sf, {"q": fulltext.plan_query(text)})).select("doc_id")


@query(f"WITH {POSTINGS} SELECT doc_id FROM p WHERE term IN ('the', 'and', 'src3') GROUP BY doc_id HAVING count(DISTINCT term) = 3")
def ft_required_all(spark: SparkSession, sf: str) -> DataFrame:
    return matches(spark, sf, "the and src3")


@query(f"WITH {POSTINGS} SELECT DISTINCT doc_id FROM p WHERE term IN ('der', 'que')")
def ft_or(spark: SparkSession, sf: str) -> DataFrame:
    return matches(spark, sf, "der OR que")


@query(f"WITH {POSTINGS} SELECT doc_id FROM p GROUP BY doc_id HAVING count_if(term = 'the') > 0 AND count_if(term = 'with') = 0")
def ft_not(spark: SparkSession, sf: str) -> DataFrame:
    return matches(spark, sf, "the NOT with")


@query(f"WITH {POSTINGS} SELECT DISTINCT a.doc_id FROM p a JOIN p b ON a.doc_id = b.doc_id AND a.field = b.field AND b.pos = a.pos + 1 WHERE a.term = 'of' AND b.term = 'the'")
def ft_phrase(spark: SparkSession, sf: str) -> DataFrame:
    return matches(spark, sf, '"of the"')


@query(f"WITH {POSTINGS} SELECT term, field, count(DISTINCT doc_id) AS df, count(*) AS cf FROM p GROUP BY term, field")
def ft_index_statistics(spark: SparkSession, sf: str) -> DataFrame:
    return published(spark, sf).terms.select("term", "field", "df", "cf")


@query(f"WITH {POSTINGS} SELECT term, field, count(DISTINCT doc_id) AS df, count(*) AS cf FROM p GROUP BY term, field")
def ft_index_build(spark: SparkSession, sf: str) -> DataFrame:
    """Publishes the corpus' index afresh at every call."""
    return engine.read_index(publish_index(spark, sf, new_folder(spark, "index"))).terms.select("term", "field", "df", "cf")


@query(f"""
    WITH {POSTINGS}, a AS (SELECT doc_id FROM documents WHERE lang IN ('en', 'de')),
    m AS (SELECT doc_id FROM p WHERE term IN ('the', 'and') AND doc_id IN (SELECT doc_id FROM a) GROUP BY doc_id HAVING count(DISTINCT term) = 2),
    n AS (SELECT least(50, count(*)) AS n FROM m)
    SELECT s.stage, CAST(CASE s.stage WHEN 'prefilter' THEN (SELECT count(*) FROM a) WHEN 'ann' THEN 0 WHEN 'bm25' THEN n WHEN 'fusion' THEN n ELSE least(10, n) END AS BIGINT) AS rows
    FROM n, (VALUES ('prefilter'), ('bm25'), ('ann'), ('fusion'), ('bulk_hydrate'), ('snippet')) s(stage)""")
def search_stages(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of each stage of a filtered keyword search over all documents; a document's language stands as a skill of its own."""
    docs = table(spark, sf, "documents")
    skills = docs.select("doc_id", F.lit("skill").alias("entity_type"), F.col("lang").alias("raw_value"), F.col("lang").alias("normalized_value"), F.lit(0.9).alias("confidence"))
    whole = docs.select("doc_id", F.col("doc_id").cast("string").alias("version_id"), F.col("source").alias("file_name"), F.col("text").alias("clean_text"))
    answer = engine.search(spark, engine.Corpus(whole, published(spark, sf), skills), "the and", wanted={"skills_any": ["en", "de"]}, timed=True)
    answer.release()
    return spark.createDataFrame(list(answer.rows.items()), "stage string, rows long")


#: The generation after the first: every fifth document gone, every seventh with another text.
NEXT = "SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'new words the' ELSE text END AS text, source FROM documents WHERE doc_id % 5 <> 0 OR doc_id % 7 = 0"


@query(f"WITH documents AS ({NEXT}), {POSTINGS} SELECT term, field, count(DISTINCT doc_id) AS df, count(*) AS cf FROM p GROUP BY term, field")
def ft_index_incremental(spark: SparkSession, sf: str) -> DataFrame:
    """Documents leave and change; postings of the others are taken over as they are."""
    docs = table(spark, sf, "documents")
    changed = docs.where("doc_id % 7 = 0").withColumn("text", F.lit("new words the"))
    gone = docs.where("doc_id % 5 = 0 OR doc_id % 7 = 0")
    index = fulltext.changed_index(published(spark, sf), gone, fulltext.build_index(changed, "doc_id", "text", "source"))
    return index.terms.select("term", "field", "df", "cf")


def bm25_sql(terms: dict[str, list[str]], k: int, where: str = "TRUE") -> str:
    rows = ", ".join(f"('{q}', '{t}')" for q, ts in terms.items() for t in ts)
    return f"""
    WITH {POSTINGS}, q(query_id, term) AS (VALUES {rows}),
    l AS (SELECT doc_id, field, len(ts) AS n FROM f), s AS (SELECT field, avg(n) AS avg_n, count(*) AS docs FROM l GROUP BY field),
    tf AS (SELECT term, doc_id, field, count(*) AS tf FROM p WHERE term IN (SELECT term FROM q) GROUP BY ALL),
    df AS (SELECT term, field, count(*) AS df FROM tf GROUP BY ALL),
    w AS (SELECT tf.doc_id, tf.term, sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / avg_n))) AS w
          FROM tf JOIN df USING (term, field) JOIN l USING (doc_id, field) JOIN s USING (field) GROUP BY ALL),
    m AS (SELECT query_id, doc_id, sum(w) AS score FROM w JOIN q USING (term) JOIN (SELECT query_id, count(*) AS need FROM q GROUP BY query_id) USING (query_id) GROUP BY query_id, doc_id, need HAVING count(*) = need),
    r AS (SELECT query_id, doc_id, round(score, 6) AS score FROM m JOIN documents USING (doc_id) WHERE {where})
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM r) WHERE rank <= {k}"""


BATCH = {"a": ["the", "and"], "b": ["der"], "c": ["que", "la"], "d": ["thing", "the", "of"]}


@query(bm25_sql(BATCH, 10))
def ft_bm25_topk(spark: SparkSession, sf: str) -> DataFrame:
    plans = {q: fulltext.plan_query(" ".join(ts)) for q, ts in BATCH.items()}
    return fulltext.search(*postings_of(spark, sf, plans), 10).select("query_id", "doc_id", "score", "rank")


def segmented(spark: SparkSession, sf: str) -> segments.Segments:
    """The corpus as three imports and a change of it: documents leave, others come with another text."""
    docs, store = table(spark, sf, "documents"), Store(spark, new_folder(spark, "segments"))
    build = lambda rows: fulltext.build_index(rows, "doc_id", "text", "source")
    base = None
    for n in range(3):
        generation = f"g{n}"
        tables, facts = segments.change(store, store.head(), generation, build(docs.where(F.pmod("doc_id", F.lit(3)) == n)))
        base = store.publish(tables, generation, base, facts)["generation"]
    changed = docs.where("doc_id % 7 = 0").withColumn("text", F.lit("new words the"))
    tables, facts = segments.change(store, store.head(), "g3", build(changed), docs.where("doc_id % 5 = 0 OR doc_id % 7 = 0"))
    store.publish(tables, "g3", base, facts)
    return segments.Segments(store, store.head())


@query(f"WITH documents AS ({NEXT}), {POSTINGS} SELECT term, field, count(DISTINCT doc_id) AS df, count(*) AS cf FROM p GROUP BY term, field")
def ft_segments_statistics(spark: SparkSession, sf: str) -> DataFrame:
    return segmented(spark, sf).index().terms.select("term", "field", "df", "cf")


@query(bm25_sql(BATCH, 10).replace("WITH", f"WITH documents AS ({NEXT}),", 1))
def ft_segments_topk(spark: SparkSession, sf: str) -> DataFrame:
    """Scores over segments with dead documents are those of an index of what is alive."""
    plans = {q: fulltext.plan_query(" ".join(ts)) for q, ts in BATCH.items()}
    index = segmented(spark, sf).index(fulltext.terms_of(plans))
    return fulltext.search(index, fulltext.query_table(spark, plans), 10).select("query_id", "doc_id", "score", "rank")


WORDS = "the and of to in is on with der die und que la les de en".split()
#: A batch of 64 queries of one to four terms, the shares of a mixed workload.
WORKLOAD = {f"q{i:02d}": [WORDS[(i * 5 + j * (1 + i % 3)) % len(WORDS)] for j in range((1, 2, 2, 3, 3, 3, 4, 1)[i % 8])] for i in range(64)}


@query(bm25_sql(WORKLOAD, 10))
def ft_batch64(spark: SparkSession, sf: str) -> DataFrame:
    """A full batch in one job: the texts are read once for all 64 queries."""
    plans = {q: fulltext.plan_query(" ".join(ts)) for q, ts in WORKLOAD.items()}
    return fulltext.search(*postings_of(spark, sf, plans), 10).select("query_id", "doc_id", "score", "rank")


@query(bm25_sql(BATCH, 10, "source IN ('src1', 'src2') AND lang <> 'fr'"))
def ft_prefiltered_topk(spark: SparkSession, sf: str) -> DataFrame:
    """The structured filter is a semi join below the cut-off."""
    allowed = table(spark, sf, "documents").where("source IN ('src1', 'src2') AND lang <> 'fr'").select("doc_id")
    plans = {q: fulltext.plan_query(" ".join(ts)) for q, ts in BATCH.items()}
    return fulltext.search(*postings_of(spark, sf, plans), 10, allowed).select("query_id", "doc_id", "score", "rank")


@query("SELECT d.doc_id FROM documents d WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def ft_minus_set(spark: SparkSession, sf: str) -> DataFrame:
    return fulltext.without(table(spark, sf, "documents"), table(spark, sf, "labels").where("toxic = 1")).select("doc_id")


SHAPE_WORDS = "lower(text) LIKE '%beijing%'"


@query(r"""
    WITH q AS (SELECT conv_id, turn, text, list_filter(regexp_extract_all(text, '["“”][^"“”]*(?:["“”]|$)|[^\s\x{a0}]+'), lambda p: regexp_replace(p, '["“”\s]+', '', 'g') <> '') AS ps FROM conversations),
    f AS (SELECT conv_id, turn, len(ps) AS n, len(list_filter(ps, lambda p: NOT regexp_matches(p, '^["“”]') AND regexp_matches(p, '^[^\p{L}\p{N}]*(?:AND|OR|NOT)[^\p{L}\p{N}]*$'))) > 0 AS b,
          len(list_filter(ps, lambda p: regexp_matches(p, '^["“”]'))) > 0 AS ph,
          regexp_matches(lower(text), 'beijing|shanghai|shenzhen|guangzhou|hangzhou|chengdu|wuhan') OR regexp_matches(text, '[0-9]') OR regexp_matches(lower(text), 'bachelor|master|phd|doctor|degree') AS fl FROM q)
    SELECT CASE WHEN b THEN 'hybrid' WHEN ph THEN 'semantic' WHEN n >= 2 AND fl THEN 'field_filter' WHEN n <= 1 THEN 'single_term' WHEN n = 2 THEN 'and_2' WHEN n <= 5 THEN 'and_3_5' ELSE 'and_6_16' END AS bucket, count(*) AS n
    FROM f GROUP BY 1""")
def query_shape_bucket(spark: SparkSession, sf: str) -> DataFrame:
    shape = fulltext.query_shape(F.col("text"))
    return table(spark, sf, "conversations").select(shape["bucket"].alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


KNN = """
    WITH q AS (SELECT CAST(vec_id AS VARCHAR) AS query_id, embedding AS a FROM embeddings WHERE vec_id % 20 = 0),
    s AS (SELECT query_id, vec_id, round(list_cosine_similarity(CAST(a AS DOUBLE[]), CAST(embedding AS DOUBLE[])), 6) AS score FROM q, embeddings),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)"""


def near(spark: SparkSession, sf: str, k: int) -> DataFrame:
    """Every 20th vector as a query against all vectors."""
    vecs = table(spark, sf, "embeddings")
    return vectors.nearest(vecs, vecs.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), k)


@query(f"{KNN} SELECT query_id, vec_id, score, rank FROM r WHERE rank <= 10")
def vec_knn_topk(spark: SparkSession, sf: str) -> DataFrame:
    return near(spark, sf, 10)


@query(f"{KNN} SELECT query_id, vec_id, score, rank FROM r WHERE rank <= 10 AND vec_id IN (SELECT vec_id FROM embeddings WHERE label % 2 = 0)")
def vec_knn_postfilter(spark: SparkSession, sf: str) -> DataFrame:
    return vectors.filtered_after(near(spark, sf, 10), table(spark, sf, "embeddings").where("label % 2 = 0"))


_coded: dict[tuple[str, str, str], Store] = {}


def coded(spark: SparkSession, sf: str) -> tuple[DataFrame, ann.Model]:
    """The published codes and model of a corpus' vectors."""
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", "") or new_folder(spark, "checkpoints"))
    key = spark.sparkContext.applicationId, sf, state_of(spark, f"{sf}/embeddings.parquet")
    if key not in _coded:
        store = Store(spark, new_folder(spark, "vectors"))
        ann.publish(store, "g1", None, table(spark, sf, "embeddings"))
        _coded[key] = store
    return _coded[key].current("ann_codes"), ann.read_model(_coded[key].current("ann_model"))


def approximate(spark: SparkSession, sf: str, k: int, allowed: DataFrame | None = None) -> DataFrame:
    vecs = table(spark, sf, "embeddings")
    return ann.search(*coded(spark, sf), vecs, vecs.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), k, allowed)


@query(None)
def vec_ann_topk(spark: SparkSession, sf: str) -> DataFrame:
    """Every 20th vector against all by inverted lists of codes; tests and ``vec_ann_recall`` hold it against the exact ranking."""
    return approximate(spark, sf, 10)


@query(None)
def vec_ann_recall(spark: SparkSession, sf: str) -> DataFrame:
    """query_id and how many of its ten nearest vectors the approximate search has found."""
    found = approximate(spark, sf, 10).select("query_id", "vec_id", F.lit(1).alias("hit"))
    return near(spark, sf, 10).join(found, ["query_id", "vec_id"], "left").groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.count("hit").alias("n_found"))


@query(f"{KNN.replace('FROM q, embeddings)', 'FROM q, embeddings WHERE vec_id % 97 = 3)')} SELECT query_id, vec_id, score, rank FROM r WHERE rank <= 400")
def vec_ann_backfill(spark: SparkSession, sf: str) -> DataFrame:
    """More is asked for than candidates have: every list is filled exactly."""
    return approximate(spark, sf, 400, table(spark, sf, "embeddings").where("vec_id % 97 = 3"))


@query("""
    WITH m AS (SELECT vec_id, embedding, list_max(list_transform(embedding, lambda x: abs(CAST(x AS DOUBLE)))) / 127 AS s FROM embeddings),
    c AS (SELECT vec_id, embedding, CASE WHEN s > 0 THEN s ELSE 1.0 END AS s FROM m),
    e AS (SELECT vec_id, embedding, s, list_transform(embedding, lambda x: CAST(round(CAST(x AS DOUBLE) / s) AS INTEGER)) AS codes FROM c)
    SELECT a.vec_id, round(a.s, 9) AS scale, CAST(list_sum(list_transform(a.codes, lambda x: abs(x))) AS BIGINT) AS weight,
           round(list_dot_product(CAST(b.embedding AS DOUBLE[]), CAST(a.codes AS DOUBLE[])) * a.s, 6) AS dot
    FROM e a JOIN e b ON b.vec_id = a.vec_id + 1""")
def vec_int8(spark: SparkSession, sf: str) -> DataFrame:
    """Bytes instead of floats: scale, magnitude of the codes, and the following vector's own values against them."""
    vecs = table(spark, sf, "embeddings")
    following = vecs.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    both = vecs.join(following, "vec_id").withColumn("code", ann.int8_codes(F.col("embedding")))
    weight = F.aggregate("code.codes", F.lit(0).cast("long"), lambda s, c: s + F.abs(c.cast("long")))
    return both.select("vec_id", F.round("code.scale", 9).alias("scale"), weight.alias("weight"), F.round(ann.int8_dot(F.col("other"), F.col("code")), 6).alias("dot"))


@query("""
    SELECT a.vec_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS score
    FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def vec_cosine(spark: SparkSession, sf: str) -> DataFrame:
    vecs = table(spark, sf, "embeddings")
    following = vecs.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return vecs.join(following, "vec_id").select("vec_id", F.round(vectors.cosine(F.col("embedding"), F.col("other")), 6).alias("score"))


@query("SELECT doc_id, sha256(text) AS version_id FROM documents WHERE doc_id % 3 = 0 OR doc_id % 7 = 0 AND doc_id % 2 = 1")
def vec_changed_projection(spark: SparkSession, sf: str) -> DataFrame:
    target = table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("version_id"))
    other = F.when((F.col("doc_id") % 7 == 0) & (F.col("doc_id") % 2 == 1), "old").otherwise(F.col("version_id"))
    return vectors.changed(target, target.where("doc_id % 3 <> 0").withColumn("version_id", other))


CHANNELS = """
    c AS (SELECT CAST(o_custkey % 50 AS VARCHAR) AS query_id, 0 AS channel, CAST(o_orderkey % 97 AS VARCHAR) AS doc_id, row_number() OVER (PARTITION BY o_custkey % 50 ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders
          UNION ALL SELECT CAST(l_partkey % 50 AS VARCHAR), 1, CAST(l_orderkey % 97 AS VARCHAR), row_number() OVER (PARTITION BY l_partkey % 50 ORDER BY l_extendedprice, l_orderkey, l_linenumber) FROM lineitem)"""


def channels(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    def ranked(name: str, key: str, doc: str, channel: int, *order) -> DataFrame:
        rows = table(spark, sf, name).withColumn("query_id", (F.col(key) % 50).cast("string"))
        return rows.select("query_id", F.lit(channel).alias("channel"), (F.col(doc) % 97).cast("string").alias("doc_id"), F.row_number().over(Window.partitionBy("query_id").orderBy(*order)).alias("rank"))

    return ranked("orders", "o_custkey", "o_orderkey", 0, F.desc("o_totalprice"), "o_orderkey").unionByName(ranked("lineitem", "l_partkey", "l_orderkey", 1, "l_extendedprice", "l_orderkey", "l_linenumber"))


@query(f"""
    WITH {CHANNELS}, s AS (SELECT query_id, doc_id, round(sum(1.0 / (60 + rank)), 6) AS score, round(sum(1.0 / (60 + rank)), 12) AS exact FROM c GROUP BY ALL)
    SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY exact DESC, doc_id) AS rank FROM s""")
def hybrid_rrf(spark: SparkSession, sf: str) -> DataFrame:
    return fusion.reciprocal_rank_fusion(channels(spark, sf)).withColumn("score", F.round("score", 6))


@query(f"""
    WITH {CHANNELS}, h AS (SELECT query_id, doc_id, rank, CASE WHEN CAST(doc_id AS INTEGER) % 4 <> 0 THEN 'c' || CAST(doc_id AS INTEGER) % 10 END AS candidate_key FROM c WHERE channel = 0),
    n AS (SELECT *, row_number() OVER (PARTITION BY query_id, coalesce('candidate:' || candidate_key, 'doc:' || doc_id) ORDER BY rank) AS k FROM h)
    SELECT query_id, doc_id, rank, candidate_key FROM n WHERE k = 1""")
def candidate_fold(spark: SparkSession, sf: str) -> DataFrame:
    number = F.col("doc_id").cast("int")
    hits = channels(spark, sf).where("channel = 0").select("query_id", "doc_id", "rank", F.when(number % 4 != 0, F.concat(F.lit("c"), (number % 10).cast("string"))).alias("candidate_key"))
    return fusion.fold(hits)


@query(f"""
    WITH {CHANNELS}, h AS (SELECT query_id, doc_id AS version_id, rank, CASE WHEN CAST(doc_id AS INTEGER) % 4 <> 0 THEN 'c' || CAST(doc_id AS INTEGER) % 10 END AS k FROM c WHERE channel = 0),
    n AS (SELECT *, row_number() OVER (PARTITION BY query_id, coalesce('candidate:' || k, 'version:' || version_id) ORDER BY rank) AS i FROM h),
    r AS (SELECT query_id, version_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM n WHERE i = 1)
    SELECT * FROM r WHERE rank <= 10""")
def candidate_fold_numbered(spark: SparkSession, sf: str) -> DataFrame:
    number = F.col("doc_id").cast("int")
    hits = channels(spark, sf).where("channel = 0").select("query_id", F.col("doc_id").alias("version_id"), "doc_id", "rank", F.when(number % 4 != 0, F.concat(F.lit("c"), (number % 10).cast("string"))).alias("candidate_key"))
    return fusion.fold_and_number(hits, 10).select("query_id", "version_id", "rank")


# Customers stand for documents: segment is a title, nation a place, ordered brands are skills, order months a range.
MENTIONS = """
    span AS (SELECT o_custkey AS doc_id, min(year(o_orderdate) * 12 + month(o_orderdate)) AS s, max(year(o_orderdate) * 12 + month(o_orderdate)) AS e FROM orders GROUP BY 1),
    m AS (SELECT c_custkey AS doc_id, 'title' AS entity_type, c_mktsegment AS v, 0.5 + (c_custkey % 6) / 10.0 AS confidence FROM customer
      UNION ALL SELECT c_custkey, 'location', n_name, CASE WHEN c_custkey % 5 <> 0 THEN 0.9 ELSE 0.6 END FROM customer JOIN nation ON n_nationkey = c_nationkey
      UNION ALL SELECT DISTINCT o_custkey, 'skill', p_brand, 0.6 + (o_custkey * 7 % 5) / 10.0 FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey
      UNION ALL SELECT doc_id, 'date_range', printf('%04d-%02d/', (s - 1) // 12, (s - 1) % 12 + 1) || CASE WHEN doc_id % 7 = 0 THEN 'PRESENT' ELSE printf('%04d-%02d', (e - 1) // 12, (e - 1) % 12 + 1) END, 0.92 FROM span
      UNION ALL SELECT doc_id, 'years_experience', CAST(round((e - s) / 12.0, 1) AS VARCHAR), 0.82 FROM span)"""


def mentions(spark: SparkSession, sf: str) -> DataFrame:
    t = lambda n: table(spark, sf, n)
    month = F.year("o_orderdate") * 12 + F.month("o_orderdate")
    span = t("orders").groupBy(F.col("o_custkey").alias("doc_id")).agg(F.min(month).alias("s"), F.max(month).alias("e"))
    row = lambda df, doc, kind, value, confidence: df.select(F.col(doc).alias("doc_id"), F.lit(kind).alias("entity_type"), value.alias("normalized_value"), confidence.alias("confidence"))
    skills = t("orders").join(t("lineitem"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("part"), F.col("p_partkey") == F.col("l_partkey")).select("o_custkey", "p_brand").distinct()
    until = F.when(F.col("doc_id") % 7 == 0, "PRESENT").otherwise(month_text(F.col("e")))
    parts = [
        row(t("customer"), "c_custkey", "title", F.col("c_mktsegment"), 0.5 + (F.col("c_custkey") % 6) / 10.0),
        row(t("customer").join(t("nation"), F.col("n_nationkey") == F.col("c_nationkey")), "c_custkey", "location", F.col("n_name"), F.when(F.col("c_custkey") % 5 != 0, 0.9).otherwise(0.6)),
        row(skills, "o_custkey", "skill", F.col("p_brand"), 0.6 + (F.col("o_custkey") * 7 % 5) / 10.0),
        row(span, "doc_id", "date_range", F.concat(month_text(F.col("s")), F.lit("/"), until), F.lit(0.92)),
        row(span, "doc_id", "years_experience", F.round((F.col("e") - F.col("s")) / 12.0, 1).cast("string"), F.lit(0.82)),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("raw_value", F.col("normalized_value"))


def filtered(spark: SparkSession, sf: str, *predicates: Predicate) -> DataFrame:
    docs = table(spark, sf, "customer").select(F.col("c_custkey").alias("doc_id"))
    return filters.select(docs, mentions(spark, sf), list(predicates))


def exists(condition: str) -> str:
    return f"EXISTS (SELECT 1 FROM m WHERE m.doc_id = c.c_custkey AND confidence >= 0.75 AND {condition})"


def filter_sql(condition: str) -> str:
    return f"WITH {MENTIONS} SELECT c.c_custkey AS doc_id FROM customer c WHERE {condition}"


TITLE = "entity_type = 'title' AND lower(v) IN ('building', 'machinery')"
SKILL = "entity_type = 'skill' AND v IN ('Brand#11', 'Brand#23')"
YEARS = "entity_type = 'years_experience' AND CAST(v AS DOUBLE) >= 4.5"
RANGE = "entity_type = 'date_range' AND left(v, 7) <= '1993-06' AND (right(v, 7) = 'PRESENT' OR right(v, 7) >= '1996-01')"
TITLE_P = Predicate("any", "title", ["Building", "machinery"])
SKILL_P = Predicate("any", "skill", ["Brand#11", "Brand#23"], exact=True)
YEARS_P = Predicate("minimum", "years_experience", minimum=4.5)
RANGE_P = Predicate("overlap", "date_range", start=1996 * 12 + 1, end=1993 * 12 + 6)


@query(filter_sql(exists(TITLE)))
def flt_value_any(spark: SparkSession, sf: str) -> DataFrame:
    return filtered(spark, sf, TITLE_P)


@query(filter_sql(f"{exists(TITLE)} OR NOT {exists(chr(39).join(['entity_type = ', 'title', '']))}"))
def flt_any_or_missing(spark: SparkSession, sf: str) -> DataFrame:
    return filtered(spark, sf, Predicate("any_or_missing", "title", ["building", "machinery"]))


@query(filter_sql("NOT " + exists("entity_type = 'skill'")))
def flt_missing(spark: SparkSession, sf: str) -> DataFrame:
    return filtered(spark, sf, Predicate("missing", "skill"))


@query(filter_sql(exists(YEARS)))
def flt_numeric_min(spark: SparkSession, sf: str) -> DataFrame:
    return filtered(spark, sf, YEARS_P)


@query(filter_sql(exists("entity_type = 'date_range' AND left(v, 7) <= '1995-06' AND (right(v, 7) = 'PRESENT' OR right(v, 7) >= '1994-01')")))
def flt_interval_overlap(spark: SparkSession, sf: str) -> DataFrame:
    return filtered(spark, sf, Predicate("overlap", "date_range", start=1994 * 12 + 1, end=1995 * 12 + 6))


@query("SELECT c_custkey AS doc_id FROM customer WHERE sha256(c_name) IN (SELECT sha256(c_name) FROM customer WHERE c_custkey IN (3, 5, 99))")
def flt_contact_any(spark: SparkSession, sf: str) -> DataFrame:
    import hashlib

    customers = table(spark, sf, "customer")
    contacts = customers.select(F.col("c_custkey").alias("doc_id"), F.sha2("c_name", 256).alias("contact_hash"))
    wanted = [hashlib.sha256(r.c_name.encode()).hexdigest() for r in customers.where("c_custkey IN (3, 5, 99)").select("c_name").collect()]
    return filters.select(contacts.select("doc_id"), mentions(spark, sf), [Predicate("contact", values=wanted)], contacts=contacts)


@query(filter_sql(f"{exists(TITLE)} AND {exists(SKILL)} AND {exists(YEARS)}"))
def flt_and_all(spark: SparkSession, sf: str) -> DataFrame:
    return filtered(spark, sf, TITLE_P, SKILL_P, YEARS_P)


@query(filter_sql(exists("entity_type = 'location' AND v LIKE '%'") + " AND c.c_acctbal > 0"))
def flt_bounded(spark: SparkSession, sf: str) -> DataFrame:
    """All that is selected, however many: ``filters.bounded``, which refuses large selections, is for single requests."""
    docs = table(spark, sf, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("doc_id"))
    places = [r.n_name for r in table(spark, sf, "nation").select("n_name").collect()]
    return filters.whole(filters.select(docs, mentions(spark, sf), [Predicate("any", "location", places)]))


@query("SELECT doc_id FROM documents WHERE lang <> 'fr' AND source <> 'src0'")
def flt_visible(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", (F.col("lang") == "fr").alias("is_deleted"), F.when(F.col("source") == "src0", "deleted").otherwise("searchable").alias("status"))
    return filters.visible(docs).select("doc_id")


@query("""
    SELECT c_custkey AS doc_id, c_custkey % 5 >= 2 AND (c_custkey % 4 = 0 OR c_custkey % 4 = 3) AND c_custkey % 10 >= 3 AS matches FROM customer""")
def flt_profile(spark: SparkSession, sf: str) -> DataFrame:
    from lodestar.functions.values import DEGREE_ORDER

    pick = lambda options, n: F.get(F.array(*[F.lit(o) for o in options]), (F.col("c_custkey") % n).cast("int"))
    wanted = {"degree_min": "bachelor", "school_tiers_any": ["985", "unknown"], "years_experience_min": 3.0}
    matched = filters.profile_matches(pick(DEGREE_ORDER, 5), pick(["985", "211", "regular", None], 4), (F.col("c_custkey") % 10).cast("double"), F.array(F.lit("go")), wanted)
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("doc_id"), matched.alias("matches"))
