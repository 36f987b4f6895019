"""Frequency detection, alignment, merging, trimming and imputation (FRQ*, JN1, FLT*, IMP*, AGG3).

All operators take ``keys`` (series identifiers, possibly empty). Per-series statistics go
through a group aggregate (partial + final hash aggregate) and are joined back; with no
keys they are one row and inlined as literals. Order-based fills go through
:class:`~almanac.plans.ordered.SeriesPlan`, so a single global series or a hot key never
lands in one task."""

from __future__ import annotations

import logging
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from almanac.functions.calendar import add_time_variables, spine
from almanac.functions.schema import MERGE_CALENDAR_COLUMNS, TRIM_CALENDAR_COLUMNS, numeric_columns
from almanac.operators.stats import value_ranks
from almanac.plans.fitted import Fitted
from almanac.plans.ordered import IDX, join_on_keys, series_plan
from almanac.plans.staged import staged

log = logging.getLogger(__name__)


# ------------------------------------------------------------------ helpers
def _day_number(df: DataFrame, c: str) -> Column:
    """Whole days since the epoch, floored (timedelta ``.days``)."""
    dt = df.schema[c].dataType
    if isinstance(dt, T.DateType):
        return F.unix_date(F.col(c)).cast("long")
    return F.floor(F.unix_micros(F.col(c).cast("timestamp")) / F.lit(86_400_000_000)).cast("long")


# ------------------------------------------------------------------ FRQ1
def detect_frequency(df: DataFrame, date_col: str = "date", keys: Sequence[str] = (),
                     block_rows: int | None = None) -> DataFrame:
    """One row per series: ``n``, ``median_days`` and ``frequency`` (monthly, quarterly,
    annual or unknown) from the median gap between consecutive dates, with the
    month-pattern fallback for irregular gaps."""
    keys = list(keys)
    d = df.select(*keys, date_col).where(F.col(date_col).isNotNull())
    d = d.withColumn("__day", _day_number(d, date_col)).withColumn("__m", F.month(date_col))
    plan = series_plan(d, keys, ["__day"], block_rows)
    if plan.blocked:
        d = plan.index(d)
    d = plan.bounded(d, lambda w: {
        "__gap": F.col("__day") - F.lag("__day", 1).over(w),
        "__mstep": F.col("__m") - F.lag("__m", 1).over(w),
    }, back=1)
    stats = d.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.bool_and(F.col("__mstep").isin(3, -9)), F.lit(True)).alias("__q"),
        F.count_distinct("__m").alias("__nm"),
    )
    med_t = exact_median(d, keys, ["__gap"], block_rows).withColumnRenamed("__gap", "median_days")
    stats = join_on_keys(stats, med_t, keys, "left")
    med = F.col("median_days")
    freq = (
        F.when(F.col("n") < 2, "unknown")
        .when(med.between(25, 32), "monthly")
        .when(med.between(85, 95), "quarterly")
        .when(med.between(350, 380), "annual")
        .when((F.col("n") >= 4) & F.col("__q"), "quarterly")
        .when((F.col("n") >= 4) & (F.col("__nm") == 1), "annual")
        .otherwise("unknown")
    )
    return stats.select(*keys, F.col("n").cast("long").alias("n"), med.cast("double").alias("median_days"),
                        freq.alias("frequency"))


def frequency_of(df: DataFrame, date_col: str = "date", keys: Sequence[str] = ()) -> str:
    """The frequency; with keys the one that most series have."""
    found = detect_frequency(df, date_col, keys).groupBy("frequency").count().orderBy(F.desc("count"), "frequency").first()
    return found["frequency"] if found else "unknown"


#: Period starts by detected frequency, and other steps by the greatest median gap in days they stand for.
STEPS = {"monthly": "MS", "quarterly": "QS", "annual": "YS"}
GAPS = ((3.0, "D"), (24.0, "W"), (60.0, "MS"), (200.0, "QS"))


def step_of(df: DataFrame, date_col: str = "date", keys: Sequence[str] = ()) -> str:
    """The step of :func:`future_frame` that continues the dates: of the frequency, else of the median spacing (of the most common
    frequency, where series differ); hours for time stamps less than a day apart."""
    found = (detect_frequency(df, date_col, keys).groupBy("frequency").agg(F.count(F.lit(1)).alias("m"), F.avg("median_days").alias("days"))
             .orderBy(F.desc("m"), "frequency").first())
    if found is None or found["days"] is None:
        return STEPS.get(found["frequency"], "MS") if found else "MS"
    if found["days"] < 0.5 and isinstance(df.schema[date_col].dataType, (T.TimestampType, T.TimestampNTZType)):
        return "h"
    near = next((step for most, step in GAPS if found["days"] <= most), "YS")
    return near if near in ("D", "W") else STEPS.get(found["frequency"], near)  # days of one month count as annual there


# ------------------------------------------------------------------ FRQ2-FRQ4
def align_to_monthly(df: DataFrame, frequency: str, date_col: str = "date", check_empty: bool = True) -> DataFrame:
    """Repeat quarterly / annual values over the months they stand for (values are not
    divided). Quarterly dates must fall in Jan/Apr/Jul/Oct and stand for the previous
    quarter; other rows are dropped with a warning."""
    if frequency == "monthly":
        return df
    dt = df.schema[date_col].dataType
    d = F.to_date(F.col(date_col))
    if frequency == "quarterly":
        start = F.add_months(F.trunc(d, "month"), -3)
        months = F.sequence(start, F.add_months(F.trunc(d, "month"), -1), F.expr("interval 1 month"))
        src = df.where(F.month(d).isin(1, 4, 7, 10))
    elif frequency == "annual":
        months = F.sequence(F.trunc(d, "year"), F.add_months(F.trunc(d, "year"), 11), F.expr("interval 1 month"))
        src = df
    else:
        log.warning("unsupported frequency %r for alignment", frequency)
        return df
    cols = [F.explode(months.cast(T.ArrayType(dt))).alias(date_col) if c == date_col else F.col(c) for c in df.columns]
    out = src.select(*cols)
    if check_empty and out.isEmpty():
        log.warning("no rows produced by %s alignment; input returned", frequency)
        return df
    return out


# ------------------------------------------------------------------ JN1
def merge_datasets(datasets: dict[str, DataFrame], date_col: str = "date", align_frequency: str = "monthly",
                   prefix: bool = True) -> DataFrame:
    """Align every dataset to months, build the month-start (or quarter-start) spine over the
    overall date range, add calendar columns and left-join each dataset on the date.
    Value columns are named ``{dataset}_{column}``. Every dataset is computed once and written; frequencies, date range
    and join read the written tables."""
    aligned: dict[str, DataFrame] = {}
    dated = {}
    for name, df in datasets.items():
        if date_col not in df.columns:
            log.warning("dataset %r has no date column, skipped", name)
            continue
        dated[name] = staged(df, f"merge-{name}")
    # frequency of every dataset in one keyed job over the union of (dataset, date)
    freqs: dict[str, str] = {}
    if dated:
        dates = reduce(lambda a, b: a.unionByName(b), [
            df.select(F.lit(name).alias("__ds"), F.to_date(date_col).alias(date_col)) for name, df in dated.items()])
        freqs = {r["__ds"]: r["frequency"] for r in detect_frequency(dates, date_col, keys=["__ds"]).collect()}
    for name, df in dated.items():
        if name not in freqs:  # no dated rows at all
            log.warning("dataset %r is empty, skipped", name)
            continue
        freq = freqs[name]
        if freq not in (align_frequency, "unknown"):
            aligned[name] = align_to_monthly(df, freq, date_col, check_empty=False) \
                if align_frequency == "monthly" else df
        else:
            aligned[name] = df
    if not aligned:
        raise ValueError("no dataset with dates")
    bounds = [df.agg(F.min(date_col).alias("lo"), F.max(date_col).alias("hi")) for df in aligned.values()]
    b = reduce(lambda a, c: a.unionByName(c), bounds).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).first()
    spark = next(iter(aligned.values())).sparkSession
    freq = "QS" if align_frequency == "quarterly" else "MS"
    base = spine(spark, b["lo"].date() if hasattr(b["lo"], "date") else b["lo"],
                 b["hi"].date() if hasattr(b["hi"], "date") else b["hi"], freq, date_col)
    base = add_time_variables(base, date_col)
    for name, df in aligned.items():
        values = [c for c in df.columns if c != date_col and c not in MERGE_CALENDAR_COLUMNS]
        right = df.select(F.to_date(date_col).alias(date_col),
                          *[F.col(c).alias(f"{name}_{c}" if prefix else c) for c in values])
        base = base.join(right, date_col, "left")
    return base


# ------------------------------------------------------------------ FRQ6
FUTURE_FREQS = ("MS", "QS", "YS", "M", "W", "D", "h")


def future_frame(df: DataFrame, date_col: str, periods: int, keys: Sequence[str] = (), freq: str = "MS",
                 include_history: bool = True) -> DataFrame:
    """History dates plus ``periods`` periods after the last date of each series: starts of months (MS),
    quarters (QS) or years (YS), ends of months (M), days (D), weeks (W, Sundays) or hours (h, timestamps)."""
    keys = list(keys)
    if freq not in FUTURE_FREQS:
        raise ValueError(f"unknown frequency {freq!r}; one of {', '.join(FUTURE_FREQS)}")
    when = F.col(date_col).cast("timestamp") if freq == "h" else F.to_date(date_col)
    last = df.groupBy(*keys).agg(F.max(when).alias("__last"))
    fut = last.select(*keys, F.explode(F.sequence(F.lit(1), F.lit(periods))).alias("__i"), "__last")
    i, end = F.col("__i"), F.col("__last")
    if freq == "h":
        at = F.timestamp_micros((F.floor(F.unix_micros(end) / 3_600_000_000) + i) * 3_600_000_000)
    elif freq == "D":
        at = F.date_add(end, i)
    elif freq == "W":
        at = F.date_add(F.next_day(end, "Sun"), (i - 1) * 7)
    elif freq == "M":  # a last date inside a month has that month's end ahead of it
        at = F.last_day(F.add_months(F.trunc(end, "month"), i - F.when(end < F.last_day(end), 1).otherwise(0)))
    else:
        unit, months = {"MS": ("month", 1), "QS": ("quarter", 3), "YS": ("year", 12)}[freq]
        at = F.add_months(F.trunc(end, unit), i * months)
    fut = fut.select(*keys, at.alias(date_col))
    if not include_history:
        return fut
    hist = df.select(*keys, when.alias(date_col)).distinct()
    return hist.unionByName(fut)


# ------------------------------------------------------------------ FLT1
def trim_to_common_date_range(df: DataFrame, date_col: str = "date", keys: Sequence[str] = (),
                              columns: Sequence[str] | None = None) -> DataFrame:
    """Keep rows between the latest first valid date and the earliest last valid date over
    the measure columns (per series). All-null columns are ignored; an empty or inverted
    range leaves the series unchanged."""
    keys = list(keys)
    cols = list(columns) if columns is not None else numeric_columns(df, [date_col, *keys, *TRIM_CALENDAR_COLUMNS])
    if not cols:
        return df
    d = F.col(date_col)
    firsts = [F.min(F.when(F.col(c).isNotNull(), d)) for c in cols]
    lasts = [F.max(F.when(F.col(c).isNotNull(), d)) for c in cols]
    lo = firsts[0] if len(cols) == 1 else F.greatest(*firsts)
    hi = lasts[0] if len(cols) == 1 else F.least(*lasts)
    fit = Fitted.fit(df, keys, {"lo": lo, "hi": hi})
    based, p, drop = fit.attach(df)
    keep = p["lo"].isNull() | p["hi"].isNull() | (p["lo"] > p["hi"]) | d.between(p["lo"], p["hi"])
    return based.where(keep).drop(*drop)


# ------------------------------------------------------------------ AGG3
def missing_counts(df: DataFrame, columns: Sequence[str] | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """Long table (keys..., column, missing)."""
    keys = list(keys)
    cols = list(columns) if columns is not None else [c for c in df.columns if c not in keys]
    wide = df.groupBy(*keys).agg(*[F.count(F.when(F.col(c).isNull(), 1)).alias(c) for c in cols])
    stack = ", ".join(f"'{c}', `{c}`" for c in cols)
    return wide.select(*keys, F.expr(f"stack({len(cols)}, {stack}) as (column, missing)")).withColumn(
        "missing", F.col("missing").cast("long"))


# ------------------------------------------------------------------ exact median
def exact_median(df: DataFrame, group: Sequence[str], cols: Sequence[str], block_rows: int | None = None) -> DataFrame:
    """Exact (interpolated) median per group without holding a group in memory: the columns
    are unpivoted, the distinct values of each (group, column) are counted and ranked (one
    sort for all columns) and the values at the one or two middle ranks are averaged. A NULL
    group key is a group like any other. Returns (group..., {c})."""
    group = list(group)
    body = ", ".join(f"'{c}', CAST(`{c}` AS DOUBLE)" for c in cols)
    long = df.select(*group, F.expr(f"stack({len(cols)}, {body}) as (__col, __v)"))
    r = value_ranks(long, [*group, "__col"], "__v", block_rows=block_rows)
    lo = F.floor((F.col("__n") - 1) / 2)
    hi = F.ceil((F.col("__n") - 1) / 2)
    first, end = F.col("__r0"), F.col("__r0") + F.col("__c")
    m = r.where((first <= hi) & (lo < end)).groupBy(*group, "__col").agg(F.avg("__v").alias("__med"))
    return m.groupBy(*group).agg(*[F.max(F.when(F.col("__col") == c, F.col("__med"))).alias(c) for c in cols])


def _group_stats(df: DataFrame, group: Sequence[str], cols: Sequence[str], stat: str) -> DataFrame:
    if stat == "mean":
        return df.groupBy(*group).agg(*[F.avg(c).alias(c) for c in cols])
    return exact_median(df, group, cols)


# ------------------------------------------------------------------ IMP1-IMP8
def handle_missing_values(df: DataFrame, method: str = "mean", fill_groups: Sequence[str] | None = None,
                          date_col: str = "date", keys: Sequence[str] = (), order: Sequence[str] | None = None,
                          columns: Sequence[str] | None = None, block_rows: int | None = None) -> DataFrame:
    """Fill or drop missing values of the numeric columns.

    ``mean``/``median``: with ``fill_groups`` (all present) first the statistic of the
    group, then the statistic of the group-filled column over the whole series; without
    groups the statistic of the series. ``forward``/``backward``: carry in order, the
    remaining edge filled from the other side. ``drop``: remove rows with any missing."""
    keys = list(keys)
    cols = list(columns) if columns is not None else numeric_columns(df, [date_col, *keys])
    if not cols:
        return df
    if method == "drop":
        return df.na.drop(subset=cols)
    if method in ("mean", "median"):
        groups = list(fill_groups or [])
        if groups and not all(g in df.columns for g in groups):
            groups = []
        out = df
        if groups:
            cols = [c for c in cols if c not in groups]
            stage1 = _group_stats(df, keys + groups, cols, method)
            stage1 = stage1.where(reduce(lambda a, b: a & b, [F.col(g).isNotNull() for g in groups]))
            s1 = stage1.select(*keys, *groups, *[F.col(c).alias(f"__g_{c}") for c in cols])
            out = join_on_keys(out, s1, keys + groups, "left")
            out = out.withColumns({c: F.coalesce(F.col(c), F.col(f"__g_{c}")) for c in cols})
            out = out.drop(*[f"__g_{c}" for c in cols])
        if method == "mean":
            fit = Fitted.fit(out, keys, {f"__o_{c}": F.avg(c) for c in cols})
        else:
            fit = Fitted.from_table(keys, _group_stats(out, keys, cols, "median").select(
                *keys, *[F.col(c).alias(f"__o_{c}") for c in cols]))
        based, p, drop = fit.attach(out)
        return based.withColumns({c: F.coalesce(F.col(c), p[f"__o_{c}"]) for c in cols}).drop(*drop)
    if method in ("forward", "backward"):
        if not order:
            order = [date_col]
        plan = series_plan(df, keys, order, block_rows)
        had = IDX in df.columns
        d = df if (had or not plan.blocked) else plan.index(df)
        items = []
        for c in cols:
            items.append((f"__f_{c}", "last", F.col(c)))
            items.append((f"__b_{c}", "first", F.col(c)))
        d = plan.scan(d, items)
        if method == "forward":
            new = {c: F.coalesce(F.col(c), F.col(f"__f_{c}"), F.col(f"__b_{c}")) for c in cols}
        else:
            new = {c: F.coalesce(F.col(c), F.col(f"__b_{c}"), F.col(f"__f_{c}")) for c in cols}
        out = d.withColumns(new).drop(*[n for n, _, _ in items])
        if plan.blocked and not had:
            out = out.drop(IDX)
        return out
    raise ValueError(f"unknown missing-value method {method!r}")


# ------------------------------------------------------------------ IMP9
def interpolate_linear(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = (),
                       order: Sequence[str] = ("date",), block_rows: int | None = None) -> DataFrame:
    """Linear interpolation by row position: gaps between two values are filled on the
    straight line; a leading gap stays missing, a trailing gap takes the last value."""
    keys = list(keys)
    plan = series_plan(df, keys, list(order), block_rows)
    had = IDX in df.columns
    d = df if had else plan.index(df)
    items = []
    for c in columns:
        has = F.col(c).isNotNull()
        items += [
            (f"__pv_{c}", "last", F.col(c)), (f"__pi_{c}", "last", F.when(has, F.col(IDX))),
            (f"__nv_{c}", "first", F.col(c)), (f"__ni_{c}", "first", F.when(has, F.col(IDX))),
        ]
    d = plan.scan(d, items)
    new = {}
    for c in columns:
        pv, pi, nv, ni = (F.col(f"__{t}_{c}") for t in ("pv", "pi", "nv", "ni"))
        line = pv + (nv - pv) * (F.col(IDX) - pi).cast("double") / (ni - pi).cast("double")
        new[c] = (F.when(F.col(c).isNotNull(), F.col(c)).when(pv.isNull(), F.lit(None))
                  .when(nv.isNull(), pv).otherwise(line))
    out = d.withColumns(new).drop(*[n for n, _, _ in items])
    return out if had else out.drop(IDX)
