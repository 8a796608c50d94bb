"""Structured predicates over mentions. Predicates are ANDed, values inside one are ORed.

A predicate is a semi or anti join of documents with the mentions that satisfy it. All predicates of a filter read the
mention table once: each mention is flagged per predicate, flags are aggregated per document (map-side first), and one
join keeps the documents that have them all.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions import values
from lodestar.functions.months import FAR, month_range
from lodestar.functions.text import ascii_lower

CONFIDENCE = 0.75
MOST_PREDICATES, MOST_VALUES, VALUE_BYTES, MOST_SELECTED = 32, 64, 512, 100_000


@dataclass
class Predicate:
    """One condition. ``kind``: any, any_or_missing, missing, minimum, overlap or contact."""

    kind: str
    entity_type: str = ""
    values: list[str] = field(default_factory=list)
    exact: bool = False
    minimum: float = 0.0
    start: int = 0
    end: int | None = None

    def flag(self, confidence: float) -> Column:
        """Whether a mention row satisfies the condition, or for ``missing``: speaks against it."""
        value = F.coalesce(F.col("normalized_value"), F.col("raw_value"))
        of_type = (F.col("entity_type") == self.entity_type) & (F.col("confidence") >= confidence)
        if self.kind in ("any", "any_or_missing"):
            same = value.isin(*self.values) if self.exact else ascii_lower(value).isin(*[lowered(v) for v in self.values])
            return of_type & same
        if self.kind == "minimum":
            # The leading number of a value; a value without one counts as 0.
            return of_type & (F.coalesce(F.regexp_extract(value, r"^\s*([+-]?[0-9]+(?:\.[0-9]*)?)", 1).try_cast("double"), F.lit(0.0)) >= self.minimum)
        if self.kind == "overlap":
            r = month_range(value)
            return of_type & F.coalesce((r["start_month"] <= F.lit(FAR if self.end is None else self.end)) & (F.coalesce(r["end_month"], F.lit(FAR)) >= self.start), F.lit(False))
        return of_type


def lowered(text: str) -> str:
    return text.translate({c: c + 32 for c in range(65, 91)})


def validate(predicates: list[Predicate], confidence: float) -> None:
    if len(predicates) > MOST_PREDICATES:
        raise ValueError("too many predicates")
    if not 0 <= confidence <= 1:
        raise ValueError("confidence is not between 0 and 1")
    for p in predicates:
        if p.kind in ("any", "any_or_missing", "contact") and not 0 < len(p.values) <= MOST_VALUES:
            raise ValueError("a predicate needs 1 to 64 values")
        if any(not v.strip() or len(v.encode()) > VALUE_BYTES for v in p.values):
            raise ValueError("a value is empty or too large")
        if p.kind == "overlap" and p.end is not None and p.end < p.start:
            raise ValueError("a range ends before it starts")
        if p.kind == "minimum" and not p.minimum >= 0:
            raise ValueError("a minimum is negative")


def select(docs: DataFrame, mentions: DataFrame, predicates: list[Predicate], confidence: float = CONFIDENCE, contacts: DataFrame | None = None, key: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that satisfy all predicates. contacts: key and contact_hash, for ``contact`` predicates."""
    validate(predicates, confidence)
    out = docs
    for p in (p for p in predicates if p.kind == "contact"):
        wanted = [v.strip().lower() for v in p.values]
        out = out.join(contacts.where(F.lower("contact_hash").isin(*wanted)).select(key), key, "left_semi")
    rest = [p for p in predicates if p.kind != "contact"]
    if not rest:
        return out
    types = sorted({p.entity_type for p in rest})
    flags = [F.max(p.flag(confidence)).alias(f"_f{i}") for i, p in enumerate(rest)]
    present = [F.max(Predicate("", p.entity_type).flag(confidence)).alias(f"_p{i}") for i, p in enumerate(rest)]
    found = mentions.where(F.col("entity_type").isin(*types)).groupBy(key).agg(*flags, *present)
    joined = out.join(found, key, "left")
    conditions = []
    for i, p in enumerate(rest):
        has, any_ = F.coalesce(F.col(f"_f{i}"), F.lit(False)), F.coalesce(F.col(f"_p{i}"), F.lit(False))
        conditions.append(~any_ if p.kind == "missing" else has | ~any_ if p.kind == "any_or_missing" else has)
    for c in conditions:
        joined = joined.where(c)
    return joined.select(*[F.col(c) for c in docs.columns])


def bounded(selection: DataFrame, most: int = MOST_SELECTED, key: str = "doc_id") -> DataFrame:
    """The selection in order of key; more than ``most`` rows are an error and never a silent cut."""
    if selection.select(key).limit(most + 1).count() > most:
        raise ValueError("selection is too large")
    return selection.orderBy(key)


def whole(selection: DataFrame, key: str = "doc_id") -> DataFrame:
    """A selection of any size in order of key, for jobs: sorted by ranges, nothing left out, nothing on the driver."""
    return selection.orderBy(key)


def degree_minimum(least: str) -> Predicate:
    return Predicate("any", "degree", values.degrees_from(least), exact=True)


def school_tiers(tiers: list[str]) -> Predicate:
    """``unknown`` alone: no tier is known; with others: one of them or none known."""
    known = [t for t in tiers if t != "unknown"]
    if not known:
        return Predicate("missing", "school_tier")
    return Predicate("any_or_missing" if len(known) < len(tiers) else "any", "school_tier", known, exact=True)


def years_minimum(years: float) -> Predicate:
    return Predicate("minimum", "years_experience", minimum=years)


def visible(documents: DataFrame) -> DataFrame:
    return documents.where("NOT is_deleted AND status <> 'deleted'")


#: Request keys of lists, their entity type, and the most bytes of a value.
LISTS = {"names_any": ("name", 80), "schools_any": ("school", 200), "majors_any": ("major", 80), "certificates_any": ("certificate", 120), "companies_any": ("company", 200), "titles_any": ("title", 120), "locations_any": ("location", 80), "skills_any": ("skill", 80)}
KEYS = {*LISTS, "degree_min", "school_tiers_any", "years_experience_min", "date_range_overlaps", "contact_hashes_any"}


def parse_filters(request: dict) -> list[Predicate]:
    """Predicates of a request; an unknown key, a wrong type or an oversized value is an error."""
    if unknown := set(request) - KEYS:
        raise ValueError(f"unknown filter: {sorted(unknown)[0]}")
    out = []
    for key, value in request.items():
        if key in LISTS:
            kind, most = LISTS[key]
            if not isinstance(value, list) or any(not isinstance(v, str) or len(v.encode()) > most for v in value):
                raise ValueError(f"{key} must be a list of short texts")
            out.append(Predicate("any", kind, [lowered(" ".join(v.split())) for v in value]))
        elif key == "degree_min":
            if value not in values.DEGREE_ORDER:
                raise ValueError("unknown degree")
            out.append(degree_minimum(value))
        elif key == "school_tiers_any":
            if not isinstance(value, list) or set(value) - set(values.SCHOOL_TIERS):
                raise ValueError("unknown school tier")
            out.append(school_tiers(value))
        elif key == "years_experience_min":
            out.append(years_minimum(float(value)))
        elif key == "date_range_overlaps":
            out.append(Predicate("overlap", "date_range", start=int(value["start_month"]), end=value.get("end_month")))
        else:
            if any(len(v) != 64 or set(v.lower()) - set("0123456789abcdef") for v in value):
                raise ValueError("a contact hash has 64 hexadecimal digits")
            out.append(Predicate("contact", values=[v.lower() for v in value]))
    validate(out, CONFIDENCE)
    return out


def profile_matches(degree: Column, tier: Column, years: Column, skills: Column, wanted: dict) -> Column:
    """The filter over one profile row with array columns; contact hashes play no part here."""
    out = F.lit(True)
    if "degree_min" in wanted:
        out &= F.coalesce(values.degree_rank(degree) >= values.DEGREE_ORDER.index(wanted["degree_min"]), F.lit(False))
    if "school_tiers_any" in wanted:
        tiers = wanted["school_tiers_any"]
        out &= F.coalesce(tier.isin(*tiers), F.lit("unknown" in tiers))
    if "years_experience_min" in wanted:
        out &= F.coalesce(years >= wanted["years_experience_min"], F.lit(False))
    if "skills_any" in wanted:
        out &= F.coalesce(F.arrays_overlap(F.transform(skills, values.skill), F.array(*[values.skill(F.lit(s)) for s in wanted["skills_any"]])), F.lit(False))
    return out


def matching_documents(documents: DataFrame, mentions: DataFrame, predicate: Predicate, confidence: float = CONFIDENCE) -> DataFrame:
    """A predicate as a query of its own: visible documents, by file name where the type is missing, else by id."""
    found = select(visible(documents), mentions, [predicate], confidence)
    return found.orderBy("file_name", "doc_id") if predicate.kind == "missing" else found.orderBy("doc_id")
