"""Column selection by type and by name; NaN -> NULL normalisation."""

from __future__ import annotations

import logging
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

log = logging.getLogger(__name__)

# ---------------------------------------------------------------------------------------
# Fixed values that must equal the reference's name rules (kept verbatim, natural order).
# Calendar columns that are never treated as measures.
CALENDAR_COLUMNS = (
    "year", "month", "quarter", "month_end", "quarter_end",
    "Q1", "Q2", "Q3", "Q4", "day_of_year", "day_of_month", "week_of_year",
)
# Calendar columns the trimming step ignores (no week_of_year there).
TRIM_CALENDAR_COLUMNS = (
    "year", "month", "quarter", "month_end", "quarter_end",
    "Q1", "Q2", "Q3", "Q4", "day_of_year", "day_of_month",
)
# Calendar columns the merge step treats as generated (not dataset values).
MERGE_CALENDAR_COLUMNS = (
    "year", "month", "quarter", "month_name", "period",
    "month_end", "quarter_end", "Q1", "Q2", "Q3", "Q4",
)
# Substrings that mark a "key indicator" (gets lags and rolling means).
KEY_INDICATOR_WORDS = ("sales", "rate", "price", "index", "gdp", "orders", "production")
# Substrings that mark a log-transform candidate.
LOG_CANDIDATE_WORDS = ("sales", "price", "production", "consumption", "orders", "gdp", "value")
# ---------------------------------------------------------------------------------------


def numeric_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    """Numeric columns in schema order, minus ``exclude`` (PRJ1)."""
    skip = set(exclude)
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in skip]


def name_matches(columns: Iterable[str], words: Sequence[str]) -> list[str]:
    """Columns whose name contains any of ``words`` (PRJ2)."""
    return [c for c in columns if any(w in c for w in words)]


def existing(df: DataFrame, columns: Iterable[str]) -> list[str]:
    """Keep the columns that exist, warn about the rest (PRJ3)."""
    have = set(df.columns)
    out = []
    for c in columns:
        if c in have:
            out.append(c)
        else:
            log.warning("column %r not found", c)
    return out


def nan_to_null(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """Map NaN to NULL in floating columns, so that aggregates skip it as pandas does."""
    floats = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    cols = floats if columns is None else floats & set(columns)
    if not cols:
        return df
    return df.select(*[
        F.nanvl(F.col(c), F.lit(None).cast(df.schema[c].dataType)).alias(c) if c in cols else F.col(c)
        for c in df.columns
    ])
