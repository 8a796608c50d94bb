"""The model that promotes texts under review: its window, its file, its decisions."""

import pytest
from pyspark.sql import functions as F

from lodestar.operators import classify, promotion


def plain(text, kinds, reasons, cap):
    """The window by slices of a Python string."""
    tokens = [f"__section_{'other_chunk' if k == 'chunk' else k}__" for k in (kinds or [])[:64]]
    tokens += [f"__reason_{r.replace('_', '')}__" for r in (reasons or []) if r in classify.POSITIVE + classify.NEGATIVE]
    structure, text = " ".join(tokens)[: min(1024, cap // 4)], text or ""
    room = max(1, cap - len(structure) - 1)
    head = room * 3 // 5
    body = text if len(text) <= room else text[:head] + text[len(text) - (room - head) :]
    return " ".join((f"{body}\n{structure}" if structure else body)[:cap].lower().split())


LISTS = [([], []), (None, None), (["skill", "chunk"], ["insufficient_signal_families", "skills_heading"]), (["profile"] * 70, ["career_history_detail"])]
TEXTS = [None, "", "Ab", "Größe 1\n\n２ " * 40, "a𝔘b " * 300]


@pytest.mark.parametrize("cap", [1, 2, 5, 8, 40, 200, 5000])
def test_window(spark, cap):
    given = [(t, s, r) for t in TEXTS for s, r in LISTS]
    rows = spark.createDataFrame([(i, *g) for i, g in enumerate(given)], "i int, t string, s array<string>, r array<string>")
    got = rows.select("i", promotion.model_input(F.col("t"), F.col("s"), F.col("r"), cap)).orderBy("i").collect()
    assert [r[1] for r in got] == [plain(*g, cap) for g in given]


def test_model_file(spark, tmp_path):
    weights = spark.createDataFrame([("zeb", 1.0, 4.0), ("__sec", 1.0, -1.0)], "gram string, idf double, weight double")
    promotion.write_model(promotion.Model("e1", 200, 0.9, 0.0, weights), str(tmp_path / "m"))
    model = promotion.read_model(spark, str(tmp_path / "m"), "e1")
    assert (model.max_input_chars, model.threshold, sorted(map(tuple, model.weights.collect()))) == (200, 0.9, sorted(map(tuple, weights.collect())))
    with pytest.raises(ValueError, match="epoch"):
        promotion.read_model(spark, str(tmp_path / "m"), "e2")
    texts = [(1, "zebra"), (2, "Skills\nzebra"), (3, "horse"), (4, "Invoice\nsubtotal amount due zebra"), (5, None), (6, "x " * 300 + "zebra" + " y" * 300)]
    rows = classify.classify(spark.createDataFrame(texts, "doc_id long, text string"))
    got = {r.doc_id: r.status for r in promotion.promoted(rows, model).collect()}
    # The second is held back by its section, the last one's word lies outside the window.
    assert got == {1: "resume_candidate", 2: "needs_review", 3: "needs_review", 4: "non_resume", 5: "failed", 6: "needs_review"}


@pytest.mark.parametrize(("change", "reason"), [({"max_input_chars": 0}, "window"), ({"max_input_chars": 40_000}, "window"), ({"threshold": 1.5}, "threshold"), ({"grams": [("ab", 1.0, 1.0)]}, "features"), ({"grams": [("abc", 0.0, 1.0)]}, "features"), ({"grams": [("abc", 1.0, 1.0)] * 2}, "features"), ({"grams": []}, "number of features")])
def test_models_that_are_refused(spark, tmp_path, change, reason):
    weights = spark.createDataFrame(change.pop("grams", [("abc", 1.0, 1.0)]), "gram string, idf double, weight double")
    given = {"epoch": "e", "max_input_chars": 100, "threshold": 0.5, "intercept": 0.0} | change
    promotion.write_model(promotion.Model(**given, weights=weights), str(tmp_path / "m"))
    with pytest.raises(ValueError, match=reason):
        promotion.read_model(spark, str(tmp_path / "m"), "e")
