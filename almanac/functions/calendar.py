"""Date parsing, calendar columns and calendar spines (DT1-DT5, STR1, FRQ5)."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULT_DATE_FORMATS = ("yyyy-MM-dd", "M/d/yyyy", "yyyy/MM/dd", "d.M.yyyy", "yyyy-MM")


def parse_date(c: Column | str, formats: Sequence[str] = DEFAULT_DATE_FORMATS) -> Column:
    """First format that parses wins; unparsable text gives NULL (DT1)."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(*[F.try_to_date(c, f) for f in formats])


def quarter_end(d: Column) -> Column:
    return F.last_day(F.add_months(F.trunc(d, "quarter"), 2))


def add_time_variables(df: DataFrame, date_col: str = "date") -> DataFrame:
    """Add year, month, month_name, month_end, quarter, quarter_end, Q1..Q4, period if
    missing (DT2). Q1..Q4 are rewritten together unless all four exist."""
    d = F.col(date_col)
    have = set(df.columns)
    new: dict[str, Column] = {}
    if "year" not in have:
        new["year"] = F.year(d)
    if "month" not in have:
        new["month"] = F.month(d)
    if "month_name" not in have:
        new["month_name"] = F.date_format(d, "MMM")
    if "month_end" not in have:
        new["month_end"] = F.last_day(d)
    if "quarter" not in have:
        new["quarter"] = F.quarter(d)
    if "quarter_end" not in have:
        new["quarter_end"] = quarter_end(d)
    out = df.withColumns(new) if new else df
    if not all(f"Q{q}" in have for q in range(1, 5)):
        out = out.withColumns({f"Q{q}": (F.col("quarter") == q).cast("int") for q in range(1, 5)})
    if "period" not in have:
        out = out.withColumn("period", F.date_format(d, "MMM yyyy"))
    return out


def create_date_features(df: DataFrame, date_col: str = "date") -> DataFrame:
    """year, month, quarter, day_of_year, day_of_month and the cyclic month/quarter codes,
    each only if missing (DT3, DT4)."""
    d = F.col(date_col)
    have = set(df.columns)
    steps = [
        ("year", lambda: F.year(d)),
        ("month", lambda: F.month(d)),
        ("quarter", lambda: F.quarter(d)),
        ("day_of_year", lambda: F.dayofyear(d)),
        ("day_of_month", lambda: F.dayofmonth(d)),
    ]
    out = df.withColumns({n: f() for n, f in steps if n not in have})
    cyc = {
        "month_sin": F.sin(F.lit(2 * math.pi) * F.col("month") / F.lit(12)),
        "month_cos": F.cos(F.lit(2 * math.pi) * F.col("month") / F.lit(12)),
        "quarter_sin": F.sin(F.lit(2 * math.pi) * F.col("quarter") / F.lit(4)),
        "quarter_cos": F.cos(F.lit(2 * math.pi) * F.col("quarter") / F.lit(4)),
    }
    return out.withColumns({n: e for n, e in cyc.items() if n not in have})


def spine(spark: SparkSession, start, end, freq: str = "MS", name: str = "date") -> DataFrame:
    """Calendar of period starts from the first start on/after ``start`` to ``end`` (FRQ5).

    Generated with ``sequence`` + ``explode`` from a one-row frame; the row count is the
    number of periods, not the data size."""
    months = {"MS": 1, "QS": 3, "YS": 12}[freq]
    s = F.to_date(F.lit(str(start)))
    first = F.when(F.trunc(s, "month") == s, s).otherwise(F.add_months(F.trunc(s, "month"), 1))
    if freq == "QS":
        first = F.when(F.trunc(first, "quarter") == first, first).otherwise(F.add_months(F.trunc(first, "quarter"), 3))
    if freq == "YS":
        first = F.when(F.trunc(first, "year") == first, first).otherwise(F.add_months(F.trunc(first, "year"), 12))
    e = F.to_date(F.lit(str(end)))
    seq = F.sequence(first, e, F.expr(f"interval {months} month"))
    return spark.range(1).select(F.explode(F.when(first <= e, seq).otherwise(F.array().cast("array<date>"))).alias(name))
