"""Month intervals. A month is ``year * 12 + month`` with month from 1; an open end is null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Words for an open end.
OPEN_ENDS = ("present", "current", "now", "ongoing", "至今", "现在", "当前", "目前", "进行中")
FAR = 2**31 - 1


def month_index(c: Column) -> Column:
    """``YYYY-MM`` or ``YYYY年MM月`` of the years 1900 to 2100, else null."""
    pattern = r"^\s*([+-]?[0-9]+)\s*(?:-\s*([+]?[0-9]+)|年\s*([+]?[0-9]+)\s*月)\s*$"
    year = F.regexp_extract(c, pattern, 1).try_cast("int")
    month = F.coalesce(F.regexp_extract(c, pattern, 2).try_cast("int"), F.regexp_extract(c, pattern, 3).try_cast("int"))
    return F.when(year.between(1900, 2100) & month.between(1, 12), year * 12 + month)


def month_range(c: Column) -> Column:
    """struct(start_month, end_month) of ``start/end`` or ``start..end``; null if malformed or ending before it starts."""
    at = F.when(c.contains("/"), F.instr(c, "/")).when(c.contains(".."), F.instr(c, ".."))
    wide = F.when(c.contains("/"), 1).otherwise(2)
    start = month_index(F.substring(c, F.lit(1), at - 1))
    end_text = F.trim(F.substring(c, at + wide, F.length(c)))
    open_ = F.lower(end_text).isin(*OPEN_ENDS)
    end = month_index(end_text)
    good = at.isNotNull() & start.isNotNull() & (open_ | (end >= start))
    return F.when(good, F.struct(start.alias("start_month"), F.when(~open_, end).alias("end_month")))


def month_text(index: Column) -> Column:
    zero = index - 1
    return F.concat(F.lpad(F.floor(zero / 12).cast("string"), 4, "0"), F.lit("-"), F.lpad((F.pmod(zero, F.lit(12)) + 1).cast("string"), 2, "0"))


def range_text(r: Column) -> Column:
    return F.concat(month_text(r["start_month"]), F.lit("/"), F.coalesce(month_text(r["end_month"]), F.lit("PRESENT")))


def overlaps(start: Column, end: Column, other_start: Column, other_end: Column) -> Column:
    """Closed intervals; a null end never ends."""
    return (start <= F.coalesce(other_end, F.lit(FAR))) & (other_start <= F.coalesce(end, F.lit(FAR)))


def experience_years(ranges: DataFrame, *keys: str) -> DataFrame:
    """years_experience per ``keys`` from rows (start_month, end_month): months of the union, over 12, to one decimal.

    Open ranges are left out; a range of one month counts one. Ranges that touch or overlap join into islands, found
    with one window over each key's ranges. Ties of rounding go to the even digit.
    """
    order = Window.partitionBy(*keys).orderBy("start_month", "end_month")
    closed = ranges.where("start_month IS NOT NULL AND end_month >= start_month").withColumn("end_month", F.greatest(F.col("end_month"), F.col("start_month") + 1))
    before = F.max("end_month").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = closed.withColumn("_new", (before.isNull() | (F.col("start_month") > before)).cast("int")).withColumn("_island", F.sum("_new").over(order))
    islands = marked.groupBy(*keys, "_island").agg((F.max("end_month") - F.min("start_month")).alias("months"))
    return islands.groupBy(*keys).agg(F.bround(F.sum("months") / 12.0, 1).alias("years_experience"))
