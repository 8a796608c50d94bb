"""Findings of the fourth review: each test failed before its change."""

from lodestar.operators import store

KINDS = "doc_id long, name string, schools array<string>, companies array<string>, skills array<string>"


def crossed(df):
    """Bytes that the shuffles of an executed plan have been given."""
    total, seen, nodes = 0, set(), [df._jdf.queryExecution().executedPlan()]
    while nodes:
        node = nodes.pop()
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            nodes.append(node.executedPlan())
        elif kind.endswith("QueryStageExec"):
            nodes.append(node.plan())
        else:
            if kind == "ShuffleExchangeExec" and node.id() not in seen:
                seen.add(node.id())
                total += node.metrics().apply("dataSize").value()
            children = node.children()
            nodes += [children.apply(i) for i in range(children.size())]
    return total


def test_what_crosses_for_soft_duplicates_grows_with_the_profiles(spark, monkeypatch):
    """Four times the profiles of one fact make sixteen times the pairs, but four times the bytes, though blocks are small."""
    monkeypatch.setattr(store, "LONG", 5)
    monkeypatch.setattr(store, "CELLS", 1, raising=False)
    size = {}
    for n in (150, 600):
        found = store.soft_duplicates(spark.createDataFrame([(i, "ann", ["u"], [f"c{i % 50}"], []) for i in range(n)], KINDS))
        pairs = {tuple(r) for r in found.collect()}
        assert pairs == {(i, j, 0.9) for i in range(n) for j in range(i + 50, n, 50)}
        size[n] = crossed(found)
    assert size[600] < 6 * size[150]


def test_a_profile_without_an_id_pairs_with_nothing(spark):
    rows = [(i, "ann", ["u"], ["c"], []) for i in (1, None, 2, 2, None)]
    found = store.soft_duplicates(spark.createDataFrame(rows, KINDS)).collect()
    assert sorted(tuple(r) for r in found) == [(1, 2, 0.9), (1, 2, 0.9)]


def test_a_cell_holds_few_blocks(spark, monkeypatch):
    """The join holds a cell's blocks, so a fact of many has more stripes than the threads ask for, and all pairs still meet once."""
    monkeypatch.setattr(store, "LONG", 5)
    monkeypatch.setattr(store, "CELLS", 1)
    monkeypatch.setattr(store, "STRIPE", 2)
    found = store.soft_duplicates(spark.createDataFrame([(i, "ann", ["u"], [f"c{i % 20}"], []) for i in range(120)], KINDS))
    pairs = [tuple(r) for r in found.collect()]
    assert len(pairs) == len(set(pairs)) and set(pairs) == {(i, j, 0.9) for i in range(120) for j in range(i + 20, 120, 20)}
    assert found._jdf.queryExecution().executedPlan().toString().count("SortMergeJoin") > 0
