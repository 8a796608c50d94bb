"""Promotion of texts under review by a linear model: its bounded input, its file, and its decisions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions.text import let
from lodestar.operators import classify, sections

#: The form of a model file; a file of another form is refused.
FORM = "linear-promotion-1"
MOST_CHARS, MOST_FEATURES = 32_768, 250_000
MOST_SECTIONS, STRUCTURE_CHARS = 64, 1024
MODEL = "form string, epoch string, max_input_chars int, threshold double, intercept double, features array<struct<ngram: string, idf: double, coefficient: double>>"


def section_types(text: Column) -> Column:
    """The families of a text's heading lines, in order; a text without headings has none."""
    return F.filter(F.transform(F.split(text, "\n", -1), sections.heading_family), lambda f: f.isNotNull())


def model_input(text: Column, section_list: Column, reasons: Column, cap: int) -> Column:
    """What a model reads of a text, at most ``cap`` characters: head and tail, then words for sections and signals.

    A text that does not fit gives the first three fifths and the last two fifths of the room left by the structure.
    Reasons that sum up others are no input. Lower case, white space collapsed; a null text is empty, null lists too.
    """
    given = F.coalesce(text, F.lit(""))
    none = F.array().cast("array<string>")
    kinds = F.transform(F.slice(F.coalesce(section_list, none), 1, MOST_SECTIONS), lambda s: F.concat(F.lit("__section_"), F.when(s == "chunk", F.lit("other_chunk")).otherwise(s), F.lit("__")))
    signals = F.filter(F.slice(F.coalesce(reasons, none), 1, classify.MOST_REASONS), lambda r: r.isin(*classify.POSITIVE, *classify.NEGATIVE))
    named = F.transform(signals, lambda r: F.concat(F.lit("__reason_"), F.replace(r, F.lit("_"), F.lit("")), F.lit("__")))
    structure = F.substring(F.array_join(F.concat(kinds, named), " "), 1, min(STRUCTURE_CHARS, cap // 4))

    def whole(s: Column) -> Column:
        room = F.greatest(F.lit(cap) - F.length(s) - 1, F.lit(1))
        head = F.floor(room * 3 / 5).cast("int")
        body = F.when(F.length(given) <= room, given).otherwise(F.concat(F.substr(given, F.lit(1), head), F.right(given, room - head)))
        return F.substring(F.when(s == "", body).otherwise(F.concat(body, F.lit("\n"), s)), 1, cap)

    return F.trim(F.regexp_replace(F.lower(let(structure, whole)), r"[\p{Z}\s]+", " "))


@dataclass
class Model:
    """A linear model over character n-grams; ``weights`` is gram, idf, weight."""

    epoch: str
    max_input_chars: int
    threshold: float
    intercept: float
    weights: DataFrame


def write_model(model: Model, path: str) -> None:
    """The model as one JSON file of one row in a new folder ``path``; ``read_model`` judges it."""
    features = model.weights.agg(F.sort_array(F.collect_list(F.struct(F.col("gram").alias("ngram"), "idf", F.col("weight").alias("coefficient")))).alias("features"))
    head = {"form": FORM, "epoch": model.epoch, "max_input_chars": model.max_input_chars, "threshold": model.threshold, "intercept": model.intercept}
    features.select(*[F.lit(v).alias(k) for k, v in head.items()], "features").coalesce(1).write.json(path)


def read_model(spark: SparkSession, path: str, epoch: str) -> Model:
    """The model of a file; ValueError says why one is refused.

    Refused are another form or epoch, a window of 0 or more than MOST_CHARS characters, a threshold outside (0, 1], no or more
    than MOST_FEATURES features, n-grams that repeat or have not 3 to 5 characters, and numbers that are not finite.
    """
    rows = spark.read.schema(MODEL).json(path)
    heads = rows.select("form", "epoch", "max_input_chars", "threshold", "intercept").limit(2).collect()
    if len(heads) != 1:
        raise ValueError("a model file has one row")
    head = heads[0]
    finite = lambda c: ~F.isnan(c) & (F.abs(c) < float("inf"))
    features = rows.select(F.explode("features").alias("f")).select(F.col("f.ngram").alias("gram"), F.col("f.idf").alias("idf"), F.col("f.coefficient").alias("weight"))
    sound = F.length("gram").between(3, 5) & finite(F.col("idf")) & (F.col("idf") > 0) & finite(F.col("weight"))
    n, kinds, good = features.agg(F.count(F.lit(1)), F.count_distinct("gram"), F.count_if(F.coalesce(sound, F.lit(False)))).first()
    wrong = {
        "form": head.form != FORM,
        "epoch": head.epoch != epoch,
        "window": not 0 < (head.max_input_chars or 0) <= MOST_CHARS,
        "threshold": head.threshold is None or not 0 < head.threshold <= 1,
        "intercept": head.intercept is None or not abs(head.intercept) < float("inf"),
        "number of features": not 0 < n <= MOST_FEATURES,
        "features": not n == kinds == good,
    }
    if any(wrong.values()):
        raise ValueError("model refused: " + ", ".join(k for k, v in wrong.items() if v))
    return Model(head.epoch, head.max_input_chars, head.threshold, head.intercept, features)


def promoted(classified: DataFrame, model: Model, key: str = "doc_id", text: str = "text", section_list: Column | None = None) -> DataFrame:
    """Classified texts with those that the model lifts as candidates. Only texts that it may lift are scored; keys are unique."""
    listed = section_types(F.col(text)) if section_list is None else section_list
    may = "status = 'needs_review' AND reasons[0] = 'insufficient_signal_families'"
    if (few := classify.few_grams(model.weights)) is not None:  # in one pass, without a join
        scored = F.when(F.expr(may), classify.probability(model_input(F.col(text), listed, F.col("reasons"), model.max_input_chars), few, model.intercept))
        return classify.lifted(classified.withColumn("probability", scored), model.threshold)
    open_ = classified.where(may)
    read = open_.select(key, model_input(F.col(text), listed, F.col("reasons"), model.max_input_chars).alias("_input"))
    return classify.promote(classified, classify.promotion_scores(read, model.weights, model.intercept, key, "_input"), model.threshold, key)
