"""Manual decisions over candidates, and tables whose files were changed after publication."""

import random

import pytest

from lodestar.operators import store
from lodestar.plans import engine
from lodestar.sources.snapshots import Store

LEDGER = "decision_id long, kind string, versions array<string>, candidate_id string, confidence double"


def replay(base, ledger):
    """One decision after the other."""
    now, manual = dict(base), set()
    for _, kind, versions, candidate, confidence in sorted(set((d, k, tuple(v or ()), c, x) for d, k, v, c, x in ledger), key=lambda r: r[0]):
        if kind == "merge" and len(set(versions)) > 1 and confidence is not None and 0 <= confidence <= 1 and candidate is not None:
            for v in versions:
                if v in now:
                    now[v] = candidate
                    manual.add(v)
        elif kind == "split":
            for v in [v for v in manual if now[v] == candidate]:
                now[v] = None
    return {v: (c, v in manual and c is not None) for v, c in now.items()}


def test_review_is_a_replay_of_the_ledger(spark):
    r = random.Random(5)
    base = [(f"v{i}", None if i % 5 == 0 else f"c{i % 4}") for i in range(40)]
    ledger = []
    for d in range(60):
        versions = [f"v{r.randrange(45)}" for _ in range(r.randrange(5))]
        if r.random() < 0.6:
            ledger.append((d, "merge", versions, f"m{r.randrange(6)}", r.choice([0.0, 0.9, 1.0, 1.5, None])))
        else:
            ledger.append((d, "split", None, r.choice([f"m{r.randrange(6)}", "c1", None]), None))
    ledger += ledger[10:20]
    got = store.reviewed(spark.createDataFrame(base, "version_id string, candidate_id string"), spark.createDataFrame(ledger, LEDGER)).collect()
    assert {x.version_id: (x.candidate_id, x.manual) for x in got} == replay(base, ledger) and len(got) == 40
    none = spark.createDataFrame([], LEDGER)
    same = store.reviewed(spark.createDataFrame(base, "version_id string, candidate_id string"), none).collect()
    assert {x.version_id: x.candidate_id for x in same} == dict(base)


def test_changed_files_are_refused(spark, tmp_path):
    shop = Store(spark, str(tmp_path / "s"))
    rows = lambda *vs: spark.createDataFrame([(i, float(i), [float(v)], None if i else "x") for i, v in enumerate(vs)], "vector_id long, w double, values array<double>, note string")
    entry = shop.publish({"vectors": rows(1, 2, 3).repartition(3), "empty": rows().limit(0), "plain": rows(1)}, "g1", None, digests=("vectors", "empty"))
    assert entry["digests"]["vectors"]["rows"] == 3 and entry["digests"]["empty"] == {"rows": 0, "digest": "0"}
    assert shop.checked("vectors").count() == 3 and shop.checked("empty").isEmpty() and engine.changed_tables(shop) == []
    with pytest.raises(ValueError):
        shop.checked("plain")
    # Other files with the same rows are the same table; another row is not.
    path = str(tmp_path / "s/generations/g1/vectors")
    rows(1, 2, 3).coalesce(1).write.mode("overwrite").parquet(path)
    assert shop.checked("vectors").count() == 3
    rows(1, 2, 4).write.mode("overwrite").parquet(path)
    with pytest.raises(ValueError):
        shop.checked("vectors")
    assert engine.changed_tables(shop) == ["vectors is not what was published"]
