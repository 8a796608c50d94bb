"""Every registered query of the engine, against its SQL where it has one."""

import datetime
import decimal
import math

import duckdb
import pytest

from lodestar.queries import ORACLE_SQL, QUERIES, flagship

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return connection


def plain(value):
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 5)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return [plain(v) for v in value] if isinstance(value, (list, tuple)) else value


@pytest.mark.parametrize("name", [n for n in QUERIES])
def test_query(spark, db, name):
    df = QUERIES[name](spark, SMALL)
    got = [r.asDict() for r in df.collect()]
    if name not in ORACLE_SQL:
        return
    result = db.execute(ORACLE_SQL[name])
    columns = [d[0] for d in result.description]
    want = [dict(zip(columns, r, strict=True)) for r in result.fetchall()]
    assert sorted(columns) == sorted(df.columns)
    key = lambda rows: sorted(str([(c, plain(r[c])) for c in sorted(columns)]) for r in rows)
    assert [s.replace(".0)", ")").replace(".0]", "]") for s in key(got)] == [s.replace(".0)", ")").replace(".0]", "]") for s in key(want)]


def test_flagship(spark):
    assert flagship(spark, SMALL).columns == ["query_id", "doc_id", "score", "rank"]


def test_prefilter_is_below_the_cut(spark):
    plan = QUERIES["ft_prefiltered_topk"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("WindowGroupLimit") < plan.index("LeftSemi") if "WindowGroupLimit" in plan else "LeftSemi" in plan


def test_scans_read_only_what_they_need(spark):
    plan = QUERIES["interval_union_years"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    schema = plan[plan.index("ReadSchema") :].split("\n")[0]
    assert "o_custkey" in schema and "o_comment" not in schema and "o_totalprice" not in schema
