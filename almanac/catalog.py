"""

Every query reads the benchmark tables (or series Spark derives from them, see
:mod:`almanac.sources.series`) in full. Doubles are rounded the same way on both sides,
``floor(x * 10^d + 0.5001) / 10^d``, which is the same IEEE arithmetic in Spark and DuckDB; the
small bias settles values that lie exactly on a rounding tie (means of decimal data) the same
way in both engines even when their summation orders differ in the last bit."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from almanac.functions.calendar import add_time_variables, create_date_features
from almanac.operators import features as fe
from almanac.operators import prepare as pr
from almanac import oracle_sql as osql
from almanac.functions import formulas as fx
from almanac.operators.transforms import SeriesTransformer
from almanac.sources import io
from almanac.plans.ordered import join_on_keys
from almanac.sources import series as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return deco


def R(c, d: int = 4):
    c = F.col(c) if isinstance(c, str) else c
    return F.floor(c * (10 ** d) + 0.5001) / (10 ** d)


def r(e: str, d: int = 4) -> str:
    return f"(floor(({e}) * {10 ** d} + 0.5001::DOUBLE) / {10 ** d})"


def rounded(df: DataFrame, digits: dict[str, int] | int = 4) -> DataFrame:
    """Round every double column (``digits`` may give a per-column number of decimals)."""
    out = []
    for f in df.schema.fields:
        if f.dataType.simpleString() in ("double", "float"):
            d = digits.get(f.name, 4) if isinstance(digits, dict) else digits
            out.append(R(F.nanvl(F.col(f.name).cast("double"), F.lit(None).cast("double")), d).alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


def f1(spark, sf):
    return S.monthly_orders(spark, sf).withColumnRenamed("month", "date")


F1_SQL = f"SELECT month AS date, revenue, n, avg_price FROM ({S.MONTHLY_ORDERS_SQL})"
F2_SQL = f"SELECT o_orderpriority, month AS date, revenue, n, avg_price FROM ({S.MONTHLY_PANEL_SQL})"
F6_SQL = S.EVENTS_GAPS_SQL


def f2(spark, sf):
    return S.monthly_orders_panel(spark, sf).withColumnRenamed("month", "date")


# =============================================================== sources (SRC1, SRC2)
@query("q_date_range_filter", f"""
SELECT o_orderkey, CAST(o_orderdate AS DATE) AS date, {r('o_totalprice', 2)} AS o_totalprice
FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1996-01-01' AND DATE '1997-12-31'
""")
def q_date_range_filter(spark, sf):
    df = io.load_data(spark, f"{sf}/orders.parquet", date_col="o_orderdate", start_date="1996-01-01",
                      end_date="1997-12-31", fmt="parquet", to_date=True)
    return rounded(df.select("o_orderkey", F.col("o_orderdate").alias("date"), "o_totalprice"), 2)


# =============================================================== calendar (DT2-DT4, STR1)
@query("q_time_variables", f"""
SELECT date, {r('revenue', 2)} AS revenue, n, {r('avg_price')} AS avg_price,
  CAST(year(date) AS INTEGER) AS year, CAST(month(date) AS INTEGER) AS month, strftime(date, '%b') AS month_name,
  CAST(last_day(date) AS DATE) AS month_end, CAST(quarter(date) AS INTEGER) AS quarter,
  CAST(last_day(date_trunc('quarter', date) + INTERVAL 2 MONTH) AS DATE) AS quarter_end,
  CAST(quarter(date) = 1 AS INTEGER) AS Q1, CAST(quarter(date) = 2 AS INTEGER) AS Q2,
  CAST(quarter(date) = 3 AS INTEGER) AS Q3, CAST(quarter(date) = 4 AS INTEGER) AS Q4,
  strftime(date, '%b %Y') AS period
FROM ({F1_SQL})
""")
def q_time_variables(spark, sf):
    return rounded(add_time_variables(f1(spark, sf), "date"), {"revenue": 2})


_TWO_PI = repr(2 * math.pi)


@query("q_date_features", f"""
SELECT date, {r('revenue', 2)} AS revenue, n, {r('avg_price')} AS avg_price,
  CAST(year(date) AS INTEGER) AS year, CAST(month(date) AS INTEGER) AS month, CAST(quarter(date) AS INTEGER) AS quarter,
  CAST(dayofyear(date) AS INTEGER) AS day_of_year, CAST(dayofmonth(date) AS INTEGER) AS day_of_month,
  {r(f'sin({_TWO_PI} * month(date) / 12)', 6)} AS month_sin, {r(f'cos({_TWO_PI} * month(date) / 12)', 6)} AS month_cos,
  {r(f'sin({_TWO_PI} * quarter(date) / 4)', 6)} AS quarter_sin, {r(f'cos({_TWO_PI} * quarter(date) / 4)', 6)} AS quarter_cos
FROM ({F1_SQL})
""")
def q_date_features(spark, sf):
    out = create_date_features(f1(spark, sf), "date")
    return rounded(out, {"revenue": 2, "month_sin": 6, "month_cos": 6, "quarter_sin": 6, "quarter_cos": 6})


# =============================================================== frequency (FRQ1)
def _freq_sql(src: str, date: str, keys: list[str]) -> str:
    part = f"PARTITION BY {', '.join(keys)} " if keys else ""
    kc = "".join(f"{k}, " for k in keys)
    grp = f"GROUP BY {', '.join(keys)}" if keys else ""
    return f"""
WITH s AS ({src}),
g AS (SELECT {kc}{date},
        datediff('day', lag({date}) OVER ({part}ORDER BY {date}), {date}) AS gap,
        month({date}) - lag(month({date})) OVER ({part}ORDER BY {date}) AS ms
      FROM s WHERE {date} IS NOT NULL),
a AS (SELECT {kc}COUNT(*) AS n, median(gap) AS med, COALESCE(bool_and(ms IN (3, -9)), TRUE) AS q,
        COUNT(DISTINCT month({date})) AS nm FROM g {grp})
SELECT {kc}CAST(n AS BIGINT) AS n, CAST(med AS DOUBLE) AS median_days,
  CASE WHEN n < 2 THEN 'unknown' WHEN med BETWEEN 25 AND 32 THEN 'monthly'
       WHEN med BETWEEN 85 AND 95 THEN 'quarterly' WHEN med BETWEEN 350 AND 380 THEN 'annual'
       WHEN n >= 4 AND q THEN 'quarterly' WHEN n >= 4 AND nm = 1 THEN 'annual' ELSE 'unknown' END AS frequency
FROM a
"""


@query("q_frequency_detect", _freq_sql(F1_SQL, "date", []))
def q_frequency_detect(spark, sf):
    return pr.detect_frequency(f1(spark, sf), "date")


@query("q_frequency_detect_panel", _freq_sql(F2_SQL, "date", ["o_orderpriority"]))
def q_frequency_detect_panel(spark, sf):
    return pr.detect_frequency(f2(spark, sf), "date", keys=["o_orderpriority"])


@query("q_frequency_detect_quarterly", _freq_sql(S.shipments_sql("quarter"), "d", []))
def q_frequency_detect_quarterly(spark, sf):
    return pr.detect_frequency(S.shipments(spark, sf, "quarter"), "d")


@query("q_frequency_detect_annual", _freq_sql(S.shipments_sql("year"), "d", []))
def q_frequency_detect_annual(spark, sf):
    return pr.detect_frequency(S.shipments(spark, sf, "year"), "d")


@query("q_frequency_detect_events", _freq_sql(
    "SELECT user_id, CAST(ts AS DATE) AS d FROM events", "d", ["user_id"]))
def q_frequency_detect_events(spark, sf):
    ev = S.table(spark, sf, "events").select("user_id", F.to_date("ts").alias("d"))
    return pr.detect_frequency(ev, "d", keys=["user_id"])


# =============================================================== alignment (FRQ2, FRQ3)
@query("q_align_quarterly", f"""
SELECT CAST(unnest(generate_series(d - INTERVAL 3 MONTH, d - INTERVAL 1 MONTH, INTERVAL 1 MONTH)) AS DATE) AS d,
       {r('qty', 2)} AS qty, {r('price', 2)} AS price
FROM ({S.shipments_sql('quarter')}) WHERE month(d) IN (1, 4, 7, 10)
""")
def q_align_quarterly(spark, sf):
    return rounded(pr.align_to_monthly(S.shipments(spark, sf, "quarter"), "quarterly", "d"), 2)


@query("q_align_annual", f"""
SELECT CAST(unnest(generate_series(date_trunc('year', d), date_trunc('year', d) + INTERVAL 11 MONTH,
       INTERVAL 1 MONTH)) AS DATE) AS d, {r('qty', 2)} AS qty, {r('price', 2)} AS price
FROM ({S.shipments_sql('year')})
""")
def q_align_annual(spark, sf):
    return rounded(pr.align_to_monthly(S.shipments(spark, sf, "year"), "annual", "d"), 2)


# =============================================================== merge (JN1, AGG4, FRQ5)
@query("q_merge_datasets", f"""
WITH o AS ({F1_SQL}),
q AS (SELECT CAST(unnest(generate_series(d - INTERVAL 3 MONTH, d - INTERVAL 1 MONTH, INTERVAL 1 MONTH)) AS DATE) AS date,
        qty, price FROM ({S.shipments_sql('quarter')}) WHERE month(d) IN (1, 4, 7, 10)),
y AS (SELECT CAST(unnest(generate_series(date_trunc('year', d), date_trunc('year', d) + INTERVAL 11 MONTH,
        INTERVAL 1 MONTH)) AS DATE) AS date, qty, price FROM ({S.shipments_sql('year')})),
b AS (SELECT MIN(lo) AS lo, MAX(hi) AS hi FROM (
        SELECT MIN(date) lo, MAX(date) hi FROM o UNION ALL SELECT MIN(date), MAX(date) FROM q
        UNION ALL SELECT MIN(date), MAX(date) FROM y)),
sp AS (SELECT CAST(unnest(generate_series(
         CASE WHEN date_trunc('month', lo) = lo THEN lo ELSE date_trunc('month', lo) + INTERVAL 1 MONTH END,
         hi, INTERVAL 1 MONTH)) AS DATE) AS date FROM b)
SELECT sp.date, CAST(year(sp.date) AS INTEGER) AS year, CAST(month(sp.date) AS INTEGER) AS month,
  strftime(sp.date, '%b') AS month_name, CAST(last_day(sp.date) AS DATE) AS month_end,
  CAST(quarter(sp.date) AS INTEGER) AS quarter,
  CAST(last_day(date_trunc('quarter', sp.date) + INTERVAL 2 MONTH) AS DATE) AS quarter_end,
  CAST(quarter(sp.date) = 1 AS INTEGER) AS Q1, CAST(quarter(sp.date) = 2 AS INTEGER) AS Q2,
  CAST(quarter(sp.date) = 3 AS INTEGER) AS Q3, CAST(quarter(sp.date) = 4 AS INTEGER) AS Q4,
  strftime(sp.date, '%b %Y') AS period,
  {r('o.revenue', 2)} AS orders_revenue, o.n AS orders_n, {r('o.avg_price')} AS orders_avg_price,
  {r('q.qty', 2)} AS shipments_qty, {r('q.price', 2)} AS shipments_price,
  {r('y.qty', 2)} AS shipments_y_qty, {r('y.price', 2)} AS shipments_y_price
FROM sp LEFT JOIN o ON sp.date = o.date LEFT JOIN q ON sp.date = q.date LEFT JOIN y ON sp.date = y.date
""")
def q_merge_datasets(spark, sf):
    ds = {
        "orders": f1(spark, sf),
        "shipments": S.shipments(spark, sf, "quarter").withColumnRenamed("d", "date"),
        "shipments_y": S.shipments(spark, sf, "year").withColumnRenamed("d", "date"),
    }
    out = pr.merge_datasets(ds, "date")
    return rounded(out, {"orders_revenue": 2, "shipments_qty": 2, "shipments_price": 2, "shipments_y_qty": 2,
                         "shipments_y_price": 2})


# =============================================================== future frame (FRQ6)
@query("q_future_frame", f"""
WITH s AS ({F1_SQL})
SELECT DISTINCT date FROM s
UNION ALL
SELECT CAST(unnest(generate_series(date_trunc('month', MAX(date)) + INTERVAL 1 MONTH,
       date_trunc('month', MAX(date)) + INTERVAL 12 MONTH, INTERVAL 1 MONTH)) AS DATE) FROM s
""")
def q_future_frame(spark, sf):
    return pr.future_frame(f1(spark, sf), "date", 12)


@query("q_future_frame_panel", f"""
WITH s AS ({F2_SQL})
SELECT DISTINCT o_orderpriority, date FROM s
UNION ALL
SELECT o_orderpriority, CAST(unnest(generate_series(date_trunc('month', MAX(date)) + INTERVAL 1 MONTH,
       date_trunc('month', MAX(date)) + INTERVAL 6 MONTH, INTERVAL 1 MONTH)) AS DATE) FROM s GROUP BY o_orderpriority
""")
def q_future_frame_panel(spark, sf):
    return pr.future_frame(f2(spark, sf), "date", 6, keys=["o_orderpriority"])


# =============================================================== trim, drop, missing (FLT1, FLT2, AGG3)
_P = ["p1", "p2", "p3", "p4", "p5"]
_P_ROUND = ", ".join(f"{r(p, 2)} AS {p}" for p in _P)


@query("q_trim_common_range", f"""
WITH s AS ({S.STAGGERED_SQL}),
b AS (SELECT greatest({', '.join(f'MIN(CASE WHEN {p} IS NOT NULL THEN month END)' for p in _P)}) AS lo,
             least({', '.join(f'MAX(CASE WHEN {p} IS NOT NULL THEN month END)' for p in _P)}) AS hi FROM s)
SELECT month, {_P_ROUND} FROM s, b WHERE lo > hi OR month BETWEEN lo AND hi
""")
def q_trim_common_range(spark, sf):
    return rounded(pr.trim_to_common_date_range(S.staggered(spark, sf), "month"), 2)


@query("q_trim_common_range_panel", f"""
WITH s AS (SELECT user_id, CAST(ts AS DATE) AS d, CASE WHEN event_id % 5 = 0 THEN NULL ELSE value END AS a,
             CASE WHEN event_id % 3 = 0 THEN NULL ELSE value END AS b, event_id FROM events),
bd AS (SELECT user_id, greatest(MIN(CASE WHEN a IS NOT NULL THEN d END), MIN(CASE WHEN b IS NOT NULL THEN d END)) AS lo,
              least(MAX(CASE WHEN a IS NOT NULL THEN d END), MAX(CASE WHEN b IS NOT NULL THEN d END)) AS hi
       FROM s GROUP BY user_id)
SELECT s.event_id, s.user_id, s.d FROM s JOIN bd ON s.user_id = bd.user_id
WHERE bd.lo IS NULL OR bd.hi IS NULL OR bd.lo > bd.hi OR s.d BETWEEN bd.lo AND bd.hi
""")
def q_trim_common_range_panel(spark, sf):
    ev = S.table(spark, sf, "events").select(
        "event_id", "user_id", F.to_date("ts").alias("d"),
        F.when(F.col("event_id") % 5 == 0, None).otherwise(F.col("value")).alias("a"),
        F.when(F.col("event_id") % 3 == 0, None).otherwise(F.col("value")).alias("b"))
    return pr.trim_to_common_date_range(ev, "d", keys=["user_id"], columns=["a", "b"]).select("event_id", "user_id", "d")


@query("q_dropna", f"SELECT month, {_P_ROUND} FROM ({S.STAGGERED_SQL}) WHERE " +
       " AND ".join(f"{p} IS NOT NULL" for p in _P))
def q_dropna(spark, sf):
    return rounded(pr.handle_missing_values(S.staggered(spark, sf), "drop", date_col="month"), 2)


@query("q_missing_counts", f"""
WITH s AS ({S.STAGGERED_SQL})
""" + " UNION ALL ".join(
    f"SELECT '{c}' AS column, CAST(COUNT(*) - COUNT({c}) AS BIGINT) AS missing FROM s" for c in ["month", *_P]))
def q_missing_counts(spark, sf):
    return pr.missing_counts(S.staggered(spark, sf))


# =============================================================== imputation (IMP1-IMP5, IMP9)
@query("q_fill_mean", f"""
WITH s AS ({S.STAGGERED_SQL}), m AS (SELECT {', '.join(f'AVG({p}) AS m{p}' for p in _P)} FROM s)
SELECT month, {', '.join(f"{r(f'COALESCE({p}, m{p})', 2)} AS {p}" for p in _P)} FROM s, m
""")
def q_fill_mean(spark, sf):
    return rounded(pr.handle_missing_values(S.staggered(spark, sf), "mean", date_col="month"), 2)


@query("q_fill_median", f"""
WITH s AS ({S.STAGGERED_SQL}), m AS (SELECT {', '.join(f'median({p}) AS m{p}' for p in _P)} FROM s)
SELECT month, {', '.join(f"{r(f'COALESCE({p}, m{p})', 2)} AS {p}" for p in _P)} FROM s, m
""")
def q_fill_median(spark, sf):
    return rounded(pr.handle_missing_values(S.staggered(spark, sf), "median", date_col="month"), 2)


def _group_fill_sql(stat: str) -> str:
    return f"""
WITH e AS ({F6_SQL}),
g AS (SELECT user_id, event_type, {stat}(value) AS gm FROM e WHERE event_type IS NOT NULL GROUP BY 1, 2),
s1 AS (SELECT e.event_id, e.user_id, COALESCE(e.value, g.gm) AS v1 FROM e LEFT JOIN g
       ON e.user_id IS NOT DISTINCT FROM g.user_id AND e.event_type = g.event_type),
o AS (SELECT user_id, {stat}(v1) AS om FROM s1 GROUP BY 1)
SELECT s1.event_id, {r('COALESCE(v1, om)')} AS value FROM s1 LEFT JOIN o ON s1.user_id IS NOT DISTINCT FROM o.user_id
"""


@query("q_fill_group_mean", _group_fill_sql("AVG"))
def q_fill_group_mean(spark, sf):
    out = pr.handle_missing_values(S.events_with_gaps(spark, sf), "mean", fill_groups=["event_type"],
                                   keys=["user_id"], columns=["value"])
    return rounded(out.select("event_id", "value"))


@query("q_fill_group_median", _group_fill_sql("median"))
def q_fill_group_median(spark, sf):
    out = pr.handle_missing_values(S.events_with_gaps(spark, sf), "median", fill_groups=["event_type"],
                                   keys=["user_id"], columns=["value"])
    return rounded(out.select("event_id", "value"))


def _fill_sql(direction: str, keys: bool) -> str:
    part = "PARTITION BY user_id " if keys else ""
    fw = f"last_value(value IGNORE NULLS) OVER ({part}ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    bw = f"first_value(value IGNORE NULLS) OVER ({part}ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
    first, second = (fw, bw) if direction == "forward" else (bw, fw)
    return f"SELECT event_id, {r(f'COALESCE(value, {first}, {second})')} AS value FROM ({F6_SQL})"


def _fill(spark, sf, method, keys):
    out = pr.handle_missing_values(S.events_with_gaps(spark, sf), method, keys=keys, order=["ts", "event_id"],
                                   columns=["value"])
    return rounded(out.select("event_id", "value"))


@query("q_ffill", _fill_sql("forward", True))
def q_ffill(spark, sf):
    return _fill(spark, sf, "forward", ["user_id"])


@query("q_bfill", _fill_sql("backward", True))
def q_bfill(spark, sf):
    return _fill(spark, sf, "backward", ["user_id"])


@query("q_ffill_global", _fill_sql("forward", False))
def q_ffill_global(spark, sf):
    return _fill(spark, sf, "forward", [])


@query("q_bfill_global", _fill_sql("backward", False))
def q_bfill_global(spark, sf):
    return _fill(spark, sf, "backward", [])


def _interp_sql(keys: bool) -> str:
    part = "PARTITION BY user_id " if keys else ""
    w = f"OVER ({part}ORDER BY ts, event_id"
    return f"""
WITH e AS (SELECT *, row_number() {w}) - 1 AS idx FROM ({F6_SQL})),
p AS (SELECT event_id, value, idx,
  last_value(value IGNORE NULLS) {w} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pv,
  last_value(CASE WHEN value IS NOT NULL THEN idx END IGNORE NULLS) {w} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pi,
  first_value(value IGNORE NULLS) {w} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nv,
  first_value(CASE WHEN value IS NOT NULL THEN idx END IGNORE NULLS) {w} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ni
  FROM e)
SELECT event_id, {r("CASE WHEN value IS NOT NULL THEN value WHEN pv IS NULL THEN NULL WHEN nv IS NULL THEN pv "
                    "ELSE pv + (nv - pv) * CAST(idx - pi AS DOUBLE) / CAST(ni - pi AS DOUBLE) END")} AS value FROM p
"""


@query("q_interpolate", _interp_sql(True))
def q_interpolate(spark, sf):
    out = pr.interpolate_linear(S.events_with_gaps(spark, sf), ["value"], keys=["user_id"], order=["ts", "event_id"])
    return rounded(out.select("event_id", "value"))


@query("q_interpolate_global", _interp_sql(False))
def q_interpolate_global(spark, sf):
    out = pr.interpolate_linear(S.events_with_gaps(spark, sf), ["value"], order=["ts", "event_id"])
    return rounded(out.select("event_id", "value"))


# =============================================================== features (WIN1, WIN2, WIN7, MTH1-3, TRF5)
def _lag_sql(keys: bool) -> str:
    part = "PARTITION BY user_id " if keys else ""
    w = f"OVER ({part}ORDER BY ts, event_id)"
    lags = ", ".join(f"{r(f'lag(value, {k}) {w}')} AS value_lag_{k}" for k in (1, 2, 3))
    return f"SELECT event_id, {r('value')} AS value, {lags}, {r(f'lead(value, 1) {w}')} AS value_lag_-1 FROM ({F6_SQL})".replace(
        "AS value_lag_-1", 'AS "value_lag_-1"')


def _lags(spark, sf, keys):
    out = fe.create_lagged_features(S.events_with_gaps(spark, sf), ["value"], [1, 2, 3, -1], keys=keys,
                                    order=["ts", "event_id"])
    return rounded(out.select("event_id", "value", "value_lag_1", "value_lag_2", "value_lag_3", "value_lag_-1"))


@query("q_lags", _lag_sql(True))
def q_lags(spark, sf):
    return _lags(spark, sf, ["user_id"])


@query("q_lags_global", _lag_sql(False))
def q_lags_global(spark, sf):
    return _lags(spark, sf, [])


_ROLL_FN = {"mean": "AVG", "std": "stddev_samp", "min": "MIN", "max": "MAX"}


def _roll_sql(keys: bool) -> str:
    part = "PARTITION BY user_id " if keys else ""
    cols = []
    for w in (3, 6):
        for f, sqlf in _ROLL_FN.items():
            cols.append(f"{r(f'{sqlf}(value) OVER ({part}ORDER BY ts, event_id ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)')}"
                        f" AS value_roll_{w}_{f}")
    return f"SELECT event_id, {', '.join(cols)} FROM ({F6_SQL})"


def _rolling(spark, sf, keys):
    out = fe.create_rolling_features(S.events_with_gaps(spark, sf), ["value"], [3, 6], keys=keys,
                                     order=["ts", "event_id"])
    return rounded(out.select("event_id", *[f"value_roll_{w}_{f}" for w in (3, 6) for f in _ROLL_FN]))


@query("q_rolling", _roll_sql(True))
def q_rolling(spark, sf):
    return _rolling(spark, sf, ["user_id"])


@query("q_rolling_global", _roll_sql(False))
def q_rolling_global(spark, sf):
    return _rolling(spark, sf, [])


def _fourier_sql_cols(idx: str, periods, harmonics) -> list[str]:
    cols = []
    for p in periods:
        for h in range(1, harmonics + 1):
            ang = f"{repr(2 * math.pi / p)} * CAST(({idx} * {h}) % {p} AS DOUBLE)"
            cols.append(f"{r(f'sin({ang})', 6)} AS sin_{p}_{h}")
            cols.append(f"{r(f'cos({ang})', 6)} AS cos_{p}_{h}")
    return cols


@query("q_fourier", f"""
WITH s AS (SELECT *, row_number() OVER (ORDER BY date) - 1 AS idx FROM ({F1_SQL}))
SELECT date, {', '.join(_fourier_sql_cols('idx', (4, 12), 2))} FROM s
""")
def q_fourier(spark, sf):
    out = fe.create_fourier_terms(f1(spark, sf), [4, 12], 2, order=["date"])
    return rounded(out.select("date", *[f"{t}_{p}_{h}" for p in (4, 12) for h in (1, 2) for t in ("sin", "cos")]), 6)


@query("q_fourier_panel", f"""
WITH s AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY date) - 1 AS idx FROM ({F2_SQL}))
SELECT o_orderpriority, date, {', '.join(_fourier_sql_cols('idx', (12,), 3))} FROM s
""")
def q_fourier_panel(spark, sf):
    out = fe.create_fourier_terms(f2(spark, sf), [12], 3, keys=["o_orderpriority"], order=["date"])
    return rounded(out.select("o_orderpriority", "date", *[f"{t}_12_{h}" for h in (1, 2, 3) for t in ("sin", "cos")]), 6)


@query("q_row_index", """
SELECT event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS idx FROM events
""")
def q_row_index(spark, sf):
    ev = S.table(spark, sf, "events")
    return fe.row_index(ev, ["user_id"], ["ts", "event_id"]).select("event_id", "idx")


@query("q_row_index_global", """
SELECT event_id, CAST(row_number() OVER (ORDER BY ts, event_id) - 1 AS BIGINT) AS idx FROM events
""")
def q_row_index_global(spark, sf):
    ev = S.table(spark, sf, "events")
    return fe.row_index(ev, [], ["ts", "event_id"]).select("event_id", "idx")


@query("q_safe_log", f"""
WITH c AS (SELECT c_custkey, c_acctbal FROM customer), m AS (SELECT MIN(c_acctbal) AS mn FROM c)
SELECT c_custkey, {r('ln(c_acctbal + CASE WHEN mn <= 0 THEN abs(mn) + 1.0 ELSE 1.0 END)', 6)} AS c_acctbal_log FROM c, m
""")
def q_safe_log(spark, sf):
    out = fe.safe_log_transform(S.balances(spark, sf), ["c_acctbal"], offset=1.0)
    return rounded(out.select("c_custkey", "c_acctbal_log"), 6)


@query("q_safe_log_panel", f"""
WITH c AS (SELECT c_custkey, c_mktsegment, c_acctbal FROM customer),
m AS (SELECT c_mktsegment, MIN(c_acctbal) AS mn FROM c GROUP BY 1)
SELECT c_custkey, {r('ln(c_acctbal + CASE WHEN mn <= 0 THEN abs(mn) + 1.0 ELSE 1.0 END)', 6)} AS c_acctbal_log
FROM c JOIN m USING (c_mktsegment)
""")
def q_safe_log_panel(spark, sf):
    out = fe.safe_log_transform(S.balances(spark, sf), ["c_acctbal"], offset=1.0, keys=["c_mktsegment"])
    return rounded(out.select("c_custkey", "c_acctbal_log"), 6)


@query("q_interaction", f"""
SELECT l_orderkey, l_linenumber, l_partkey, {r('l_quantity * l_discount')} AS l_quantity_l_discount_interaction,
       {r('l_extendedprice * l_tax')} AS l_extendedprice_l_tax_interaction FROM lineitem
""")
def q_interaction(spark, sf):
    li = S.table(spark, sf, "lineitem")
    out = fe.create_interaction_features(li, [("l_quantity", "l_discount"), ("l_extendedprice", "l_tax"),
                                              ("l_quantity", "missing_col")])
    return rounded(out.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity_l_discount_interaction",
                              "l_extendedprice_l_tax_interaction"))


def _engineer_sql() -> str:
    w = "OVER (ORDER BY date)"
    cols = ["date", r("revenue", 2) + " AS revenue", "n", r("avg_price") + " AS avg_price",
            "CAST(year(date) AS INTEGER) AS year", "CAST(month(date) AS INTEGER) AS month",
            "CAST(quarter(date) AS INTEGER) AS quarter", "CAST(dayofyear(date) AS INTEGER) AS day_of_year",
            "CAST(dayofmonth(date) AS INTEGER) AS day_of_month",
            f"{r(f'sin({_TWO_PI} * month(date) / 12)', 6)} AS month_sin",
            f"{r(f'cos({_TWO_PI} * month(date) / 12)', 6)} AS month_cos",
            f"{r(f'sin({_TWO_PI} * quarter(date) / 4)', 6)} AS quarter_sin",
            f"{r(f'cos({_TWO_PI} * quarter(date) / 4)', 6)} AS quarter_cos"]
    cols += _fourier_sql_cols("idx", (4, 12), 2)
    for k in range(1, 4):
        cols.append(f"{r(f'lag(revenue, {k}) {w}', 2)} AS revenue_lag_{k}")
    for k in range(1, 4):
        cols.append(f"{r(f'lag(avg_price, {k}) {w}')} AS avg_price_lag_{k}")
    for s in (3, 6, 12):
        cols.append(f"{r(f'AVG(avg_price) OVER (ORDER BY date ROWS BETWEEN {s - 1} PRECEDING AND CURRENT ROW)')}"
                    f" AS avg_price_roll_{s}_mean")
    cols.append(f"{r('ln(avg_price + CASE WHEN mn <= 0 THEN abs(mn) + 1.0 ELSE 1.0 END)', 6)} AS avg_price_log")
    return f"""
WITH s AS (SELECT *, row_number() OVER (ORDER BY date) - 1 AS idx FROM ({F1_SQL})),
m AS (SELECT MIN(avg_price) AS mn FROM s)
SELECT {', '.join(cols)} FROM s, m
"""


@query("q_engineer_features", _engineer_sql())
def q_engineer_features(spark, sf):
    out = fe.engineer_features(f1(spark, sf), "revenue", "date", max_lag=3)
    digits = {c: 6 for c in out.columns if c.startswith(("sin_", "cos_", "month_s", "month_c", "quarter_s", "quarter_c"))}
    digits.update({"avg_price_log": 6, "revenue": 2, **{f"revenue_lag_{k}": 2 for k in range(1, 4)}})
    return rounded(out, digits)


# =============================================================== transformations (MTH4-MTH15, WIN3-WIN6, TRF1-TRF4)
_BAL = "SELECT c_custkey, c_mktsegment, c_acctbal AS x FROM customer"


def _trf(spark, sf, kinds, params=None, keys=(), inverse=False, digits=6):
    df = S.balances(spark, sf).select("c_custkey", "c_mktsegment", F.col("c_acctbal").alias("x"))
    t = SeriesTransformer(keys=keys)
    out = t.fit_transform(df, ["x"], kinds, params)
    if inverse:
        out = t.inverse_transform(out)
    return rounded(out.select("c_custkey", "x"), digits)


def _trf_sql(expr: str, stats: str, keys: bool = False, digits: int = 6) -> str:
    if keys:
        return f"""WITH c AS ({_BAL}), m AS (SELECT c_mktsegment, {stats} FROM c GROUP BY 1)
SELECT c_custkey, {r(expr, digits)} AS x FROM c JOIN m USING (c_mktsegment)"""
    return f"WITH c AS ({_BAL}), m AS (SELECT {stats} FROM c) SELECT c_custkey, {r(expr, digits)} AS x FROM c, m"


_LOG_OFF = "CASE WHEN mn <= 0 THEN abs(mn) + 1 ELSE 0.0 END"
_SQRT_OFF = "CASE WHEN mn < 0 THEN abs(mn) + 0.01 ELSE 0.0 END"
_BC_OFF = "CASE WHEN mn <= 0 THEN abs(mn) + 1 ELSE 0.0 END"
_SD = "CASE WHEN sd = 0 THEN 1.0 ELSE sd END"
_RNG = "CASE WHEN mx = mn THEN 1.0 ELSE mx - mn END"


@query("q_log", _trf_sql(f"ln(x + {_LOG_OFF})", "MIN(x) AS mn"))
def q_log(spark, sf):
    return _trf(spark, sf, ["log"])


@query("q_sqrt", _trf_sql(f"sqrt(x + {_SQRT_OFF})", "MIN(x) AS mn"))
def q_sqrt(spark, sf):
    return _trf(spark, sf, ["sqrt"])


@query("q_standardize", _trf_sql(f"(x - mu) / {_SD}", "AVG(x) AS mu, stddev_pop(x) AS sd"))
def q_standardize(spark, sf):
    return _trf(spark, sf, ["standardize"])


@query("q_standardize_panel", _trf_sql(f"(x - mu) / {_SD}", "AVG(x) AS mu, stddev_pop(x) AS sd", keys=True))
def q_standardize_panel(spark, sf):
    return _trf(spark, sf, ["standardize"], keys=["c_mktsegment"])


@query("q_normalize", _trf_sql(f"(x - mn) / {_RNG}", "MIN(x) AS mn, MAX(x) AS mx"))
def q_normalize(spark, sf):
    return _trf(spark, sf, ["normalize"])


@query("q_normalize_panel", _trf_sql(f"(x - mn) / {_RNG}", "MIN(x) AS mn, MAX(x) AS mx", keys=True))
def q_normalize_panel(spark, sf):
    return _trf(spark, sf, ["normalize"], keys=["c_mktsegment"])


@query("q_box_cox", _trf_sql(f"(pow(x + {_BC_OFF}, 0.5) - 1) / 0.5", "MIN(x) AS mn"))
def q_box_cox(spark, sf):
    return _trf(spark, sf, ["box_cox"], {"box_cox_lambda": 0.5})


@query("q_yeo_johnson", _trf_sql(
    "CASE WHEN x >= 0 THEN (pow(x + 1, 0.5) - 1) / 0.5 ELSE -(pow(1 - x, 1.5) - 1) / 1.5 END", "COUNT(*) AS n"))
def q_yeo_johnson(spark, sf):
    return _trf(spark, sf, ["yeo_johnson"], {"yeo_johnson_lambda": 0.5})


_ROUND_TRIP = f"WITH c AS ({_BAL}) SELECT c_custkey, {r('x', 4)} AS x FROM c"


@query("q_inverse_log", _ROUND_TRIP)
def q_inverse_log(spark, sf):
    return _trf(spark, sf, ["log"], inverse=True, digits=4)


@query("q_inverse_sqrt", _ROUND_TRIP)
def q_inverse_sqrt(spark, sf):
    return _trf(spark, sf, ["sqrt"], inverse=True, digits=4)


@query("q_inverse_standardize", _ROUND_TRIP)
def q_inverse_standardize(spark, sf):
    return _trf(spark, sf, ["standardize"], inverse=True, digits=4)


@query("q_inverse_normalize", _ROUND_TRIP)
def q_inverse_normalize(spark, sf):
    return _trf(spark, sf, ["normalize"], inverse=True, digits=4)


@query("q_inverse_box_cox", _ROUND_TRIP)
def q_inverse_box_cox(spark, sf):
    return _trf(spark, sf, ["box_cox"], {"box_cox_lambda": 0.5}, inverse=True, digits=4)


@query("q_inverse_yeo_johnson", _ROUND_TRIP)
def q_inverse_yeo_johnson(spark, sf):
    return _trf(spark, sf, ["yeo_johnson"], {"yeo_johnson_lambda": 0.5}, inverse=True, digits=4)


@query("q_inverse_chain", _ROUND_TRIP)
def q_inverse_chain(spark, sf):
    return _trf(spark, sf, ["yeo_johnson", "standardize", "normalize"], {"yeo_johnson_lambda": 1.3},
                inverse=True, digits=4)


def _diff_df(spark, sf, keys):
    return (f2(spark, sf) if keys else f1(spark, sf)).select(*(["o_orderpriority"] if keys else []), "date", "revenue")


def _diff_sql(k: int, keys: bool) -> str:
    src = F2_SQL if keys else F1_SQL
    part = "PARTITION BY o_orderpriority " if keys else ""
    kc = "o_orderpriority, " if keys else ""
    return f"SELECT {kc}date, {r(f'revenue - lag(revenue, {k}) OVER ({part}ORDER BY date)', 2)} AS revenue FROM ({src})"


@query("q_diff", _diff_sql(1, False))
def q_diff(spark, sf):
    t = SeriesTransformer(order=["date"])
    return rounded(t.fit_transform(_diff_df(spark, sf, False), ["revenue"], ["diff"]), 2)


@query("q_seasonal_diff", _diff_sql(12, False))
def q_seasonal_diff(spark, sf):
    t = SeriesTransformer(order=["date"])
    return rounded(t.fit_transform(_diff_df(spark, sf, False), ["revenue"], ["seasonal_diff"]), 2)


@query("q_seasonal_diff_panel", _diff_sql(12, True))
def q_seasonal_diff_panel(spark, sf):
    t = SeriesTransformer(keys=["o_orderpriority"], order=["date"])
    return rounded(t.fit_transform(_diff_df(spark, sf, True), ["revenue"], ["seasonal_diff"]), 2)


@query("q_inverse_diff", f"SELECT date, {r('revenue', 2)} AS revenue FROM ({F1_SQL})")
def q_inverse_diff(spark, sf):
    t = SeriesTransformer(order=["date"])
    d = t.fit_transform(_diff_df(spark, sf, False), ["revenue"], ["diff"], {"diff_lag": 3})
    return rounded(t.inverse_transform(d), 2)


@query("q_inverse_seasonal_diff_panel", f"SELECT o_orderpriority, date, {r('revenue', 2)} AS revenue FROM ({F2_SQL})")
def q_inverse_seasonal_diff_panel(spark, sf):
    t = SeriesTransformer(keys=["o_orderpriority"], order=["date"])
    d = t.fit_transform(_diff_df(spark, sf, True), ["revenue"], ["log", "seasonal_diff"])
    return rounded(t.inverse_transform(d), 2)


# =============================================================== statistics, correlation, reduction (AGG6-7, DIM*)
from almanac.operators import diagnostics as dg  # noqa: E402
from almanac.operators import forecast as fc  # noqa: E402
from almanac.operators import model as md  # noqa: E402
from almanac.operators import reduce as rd  # noqa: E402
from almanac.operators import split as sp  # noqa: E402
from almanac.operators import stats as st  # noqa: E402

F7_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "dup", "net", "const", "target"]
F7_FEATS = F7_COLS[:-1]
F7_SQL = S.LINEITEM_WIDE_SQL


def _nn(e: str) -> str:
    return f"(CASE WHEN isnan({e}) THEN NULL ELSE {e} END)"


@query("q_corr_matrix", f"WITH d AS ({F7_SQL}) " + " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, {r(_nn(f'corr({a}, {b})'), 6)} AS r FROM d"
    for i, a in enumerate(F7_COLS) for b in F7_COLS[i + 1:]))
def q_corr_matrix(spark, sf):
    return rounded(st.corr_pairs(S.lineitem_wide(spark, sf), F7_COLS), 6)


@query("q_corr_matrix_panel", f"WITH d AS ({F7_SQL}) " + " UNION ALL ".join(
    f"SELECT l_returnflag, '{a}' AS a, '{b}' AS b, {r(_nn(f'corr({a}, {b})'), 6)} AS r FROM d JOIN "
    f"(SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag FROM lineitem) USING "
    f"(l_orderkey, l_linenumber, l_partkey, l_suppkey) GROUP BY l_returnflag"
    for i, a in enumerate(F7_COLS[:4]) for b in F7_COLS[i + 1:4]))
def q_corr_matrix_panel(spark, sf):
    li = S.table(spark, sf, "lineitem")
    return rounded(st.corr_pairs(li, F7_COLS[:4], keys=["l_returnflag"]), 6)


def _corr_filter_sql() -> str:
    parts = [f"SELECT '{F7_FEATS[0]}' AS feature, 0 AS position, CAST(NULL AS DOUBLE) AS max_abs_corr, TRUE AS kept"]
    for j, b in enumerate(F7_FEATS[1:], start=1):
        rs = [_nn(f"abs(corr({a}, {b}))") for a in F7_FEATS[:j]]
        m = f"greatest({', '.join(rs)})" if len(rs) > 1 else rs[0]
        parts.append(f"SELECT '{b}', {j}, {r(m, 6)}, COALESCE(NOT ({m} > 0.95), TRUE) FROM d")
    return f"WITH d AS ({F7_SQL}) " + " UNION ALL ".join(parts)


@query("q_corr_filter", _corr_filter_sql())
def q_corr_filter(spark, sf):
    return rounded(rd.correlation_filter(S.lineitem_wide(spark, sf), F7_FEATS), 6)


@query("q_f_regression", f"""
WITH d AS ({F7_SQL}),
s AS ({' UNION ALL '.join(f"SELECT '{c}' AS feature, {i} AS position, {_nn(f'corr({c}, target)')} AS r, COUNT(*) AS n FROM d"
                          for i, c in enumerate(F7_FEATS))}),
f AS (SELECT feature, position, r, CASE WHEN abs(r) = 1 THEN 'inf'::DOUBLE ELSE r * r / (1.0 - r * r) * (n - 2) END AS f FROM s)
SELECT feature, position, {r('r', 6)} AS r, {r('f', 2)} AS f_score,
       CAST(row_number() OVER (ORDER BY CASE WHEN f > 1e12 THEN f ELSE floor(f * 1e6 + 0.5) END DESC NULLS LAST,
                               position) AS INTEGER) AS rank FROM f
""")
def q_f_regression(spark, sf):
    out = rd.f_regression_scores(S.lineitem_wide(spark, sf), "target", F7_FEATS)
    return rounded(out, {"r": 6, "f_score": 2})


def _mi_sql(feats, target, bins=10) -> str:
    long = " UNION ALL ".join(f"SELECT {target} AS y, '{c}' AS feature, CAST({c} AS DOUBLE) AS v FROM d" for c in feats)
    vals = " UNION ALL ".join(f"SELECT '{c}' AS feature, CAST({c} AS DOUBLE) AS v FROM d" for c in [*feats, target])
    pos = " UNION ALL ".join(f"SELECT '{c}' AS feature, {i} AS position" for i, c in enumerate(feats))
    return f"""
WITH d AS ({F7_SQL}),
lng AS ({long}),
vals AS ({vals}),
rk AS (SELECT feature, v, rank() OVER (PARTITION BY feature ORDER BY v) - 1 AS r0,
              COUNT(*) OVER (PARTITION BY feature) AS n FROM vals),
vb AS (SELECT DISTINCT feature, v, CAST(floor(r0 * {bins} / n) AS INTEGER) AS bin FROM rk),
xb AS (SELECT lng.feature, lng.y, vb.bin FROM lng JOIN vb ON lng.feature = vb.feature AND lng.v = vb.v),
yb AS (SELECT v AS y, bin AS ybin FROM vb WHERE feature = '{target}'),
j AS (SELECT xb.feature, xb.bin, yb.ybin FROM xb JOIN yb ON xb.y = yb.y),
jt AS (SELECT feature, bin, ybin, COUNT(*) AS nxy FROM j GROUP BY ALL),
px AS (SELECT feature, bin, SUM(nxy) AS nx FROM jt GROUP BY ALL),
py AS (SELECT feature, ybin, SUM(nxy) AS ny FROM jt GROUP BY ALL),
tt AS (SELECT feature, SUM(nxy) AS nt FROM jt GROUP BY ALL),
mi AS (SELECT jt.feature, SUM(CAST(nxy AS DOUBLE) / nt * ln(CAST(nxy AS DOUBLE) * nt / (nx * ny))) AS mi
       FROM jt JOIN px USING (feature, bin) JOIN py USING (feature, ybin) JOIN tt USING (feature) GROUP BY jt.feature),
ps AS ({pos})
SELECT ps.feature, ps.position, {r('mi', 6)} AS mi,
       CAST(row_number() OVER (ORDER BY floor(mi * 1e10 + 0.5) DESC NULLS LAST, ps.position) AS INTEGER) AS rank
FROM ps LEFT JOIN mi ON ps.feature = mi.feature
"""


@query("q_mutual_info", _mi_sql(F7_FEATS, "target"))
def q_mutual_info(spark, sf):
    return rounded(rd.mutual_info_scores(S.lineitem_wide(spark, sf), "target", F7_FEATS), 6)


def _embedding_cols(spark, sf, dims=64):
    e = S.table(spark, sf, "embeddings")
    return e.select("vec_id", "label", *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(dims)])


@query("q_pca_variance")
def q_pca_variance(spark, sf):
    df = _embedding_cols(spark, sf)
    pca = rd.fit_pca(df, [f"e{i}" for i in range(64)])
    return rounded(rd.variance_table(spark, pca, 20), 6)


@query("q_pca_loadings")
def q_pca_loadings(spark, sf):
    df = _embedding_cols(spark, sf)
    pca = rd.fit_pca(df, [f"e{i}" for i in range(64)])
    return rounded(rd.loading_table(spark, pca), 6)


@query("q_pca_scores")
def q_pca_scores(spark, sf):
    df = _embedding_cols(spark, sf)
    cols = [f"e{i}" for i in range(64)]
    pca = rd.fit_pca(df, cols)
    k = rd.components_for_threshold(pca.explained_ratio, 0.95)
    return rounded(pca.scores(df, k).select("vec_id", "label", *[f"PC{i + 1}" for i in range(k)]), 6)


@query("q_pca_wide_rows")
def q_pca_wide_rows(spark, sf):
    df = S.lineitem_wide(spark, sf)
    pca = rd.fit_pca(df, F7_FEATS)
    return rounded(rd.variance_table(spark, pca), 6)


@query("q_lasso_select")
def q_lasso_select(spark, sf):
    return rounded(rd.lasso_selection(S.lineitem_wide(spark, sf), "target", F7_FEATS[:4] + ["net"], 0.01), 6)


@query("q_reduce_dimensions")
def q_reduce_dimensions(spark, sf):
    feats = fe.engineer_features(f1(spark, sf), "revenue", "date", max_lag=3)
    out, meta = rd.reduce_dimensions(feats, "revenue", date_col="date", use_pca=True,
                                     feature_selection_method="f_regression", top_n_features=5)
    return rounded(out, 6)


@query("q_reduce_dimensions_mi")
def q_reduce_dimensions_mi(spark, sf):
    feats = fe.engineer_features(f1(spark, sf), "revenue", "date", max_lag=3)
    out, meta = rd.reduce_dimensions(feats, "revenue", date_col="date", use_pca=False,
                                     feature_selection_method="mutual_info", top_n_features=5)
    sel = meta["selected_features"]
    return spark.createDataFrame([(i + 1, c) for i, c in enumerate(sel)], "rank int, feature string")


# =============================================================== splits and folds (SPL1-SPL4)
def _split_sql(rule: str, keys: bool) -> str:
    src = F2_SQL if keys else F1_SQL
    part = "PARTITION BY o_orderpriority " if keys else ""
    kc = "o_orderpriority, " if keys else ""
    if rule == "three_way":
        case = ("CASE WHEN idx < floor(n * (1.0::DOUBLE - 0.2::DOUBLE - 0.1::DOUBLE)) THEN 'train' "
                "WHEN idx < floor(n * (1.0::DOUBLE - 0.2::DOUBLE)) THEN 'validation' ELSE 'test' END")
    elif rule == "train_test":
        case = "CASE WHEN idx < n - floor(n * 0.2::DOUBLE) THEN 'train' ELSE 'test' END"
    else:
        case = "CASE WHEN idx < floor(n * (1.0::DOUBLE - 0.2::DOUBLE)) THEN 'train' ELSE 'test' END"
    return f"""
WITH s AS (SELECT {kc}date, row_number() OVER ({part}ORDER BY date) - 1 AS idx, COUNT(*) OVER ({part.strip()}) AS n
           FROM ({src}))
SELECT {kc}date, CAST(idx AS BIGINT) AS idx, {case} AS part FROM s
"""


def _split(spark, sf, rule, keys):
    df = (f2(spark, sf) if keys else f1(spark, sf))
    k = ["o_orderpriority"] if keys else []
    out = sp.split_labels(df, k, ["date"], rule, 0.2, 0.1)
    return out.select(*k, "date", "idx", "part")


@query("q_split_three_way", _split_sql("three_way", False))
def q_split_three_way(spark, sf):
    return _split(spark, sf, "three_way", False)


@query("q_split_three_way_panel", _split_sql("three_way", True))
def q_split_three_way_panel(spark, sf):
    return _split(spark, sf, "three_way", True)


@query("q_split_train_test", _split_sql("train_test", False))
def q_split_train_test(spark, sf):
    return _split(spark, sf, "train_test", False)


@query("q_split_forecast", _split_sql("forecast", False))
def q_split_forecast(spark, sf):
    return _split(spark, sf, "forecast", False)


def _folds_sql(keys: bool) -> str:
    src = F2_SQL if keys else F1_SQL
    kc = "o_orderpriority, " if keys else ""
    grp = "GROUP BY o_orderpriority" if keys else ""
    return f"""
WITH c AS (SELECT {kc}COUNT(*) AS n FROM ({src}) {grp}),
f AS (SELECT {kc}n, n // 6 AS sz, unnest(generate_series(0, 4)) AS fold FROM c)
SELECT {kc}CAST(fold AS INTEGER) AS fold, CAST(n - (5 - fold) * sz AS BIGINT) AS train_end,
       CAST(n - (5 - fold) * sz AS BIGINT) AS test_start, CAST(n - (5 - fold) * sz + sz AS BIGINT) AS test_end,
       (n - (5 - fold) * sz) >= floor(n * 0.7::DOUBLE) AS kept
FROM f
"""


@query("q_cv_folds", _folds_sql(False))
def q_cv_folds(spark, sf):
    return sp.cv_folds(f1(spark, sf), [], 5)


@query("q_cv_folds_panel", _folds_sql(True))
def q_cv_folds_panel(spark, sf):
    return sp.cv_folds(f2(spark, sf), ["o_orderpriority"], 5)


# =============================================================== models (MDL1-MDL11, AGG8, AGG10)
@query("q_linear_fit", f"""
SELECT {r('regr_intercept(revenue, n)', 4)} AS intercept, {r('regr_slope(revenue, n)', 6)} AS n FROM ({F1_SQL})
""")
def q_linear_fit(spark, sf):
    return rounded(md.fit_linear_per_series(f1(spark, sf), [], ["n"], "revenue"), {"intercept": 4, "n": 6})


@query("q_linear_fit_panel", f"""
SELECT o_orderpriority, {r('regr_intercept(revenue, n)', 4)} AS intercept, {r('regr_slope(revenue, n)', 6)} AS n
FROM ({F2_SQL}) GROUP BY o_orderpriority
""")
def q_linear_fit_panel(spark, sf):
    out = md.fit_linear_per_series(f2(spark, sf), ["o_orderpriority"], ["n"], "revenue")
    return rounded(out, {"intercept": 4, "n": 6})


@query("q_ridge_fit_panel", f"""
WITH s AS (SELECT o_orderpriority, regr_sxy(revenue, n) AS sxy, regr_sxx(revenue, n) AS sxx, AVG(revenue) AS my,
           AVG(n) AS mx FROM ({F2_SQL}) GROUP BY o_orderpriority)
SELECT o_orderpriority, {r('my - sxy / (sxx + 1000.0) * mx', 4)} AS intercept, {r('sxy / (sxx + 1000.0)', 6)} AS n FROM s
""")
def q_ridge_fit_panel(spark, sf):
    out = md.fit_linear_per_series(f2(spark, sf), ["o_orderpriority"], ["n"], "revenue", alpha=1000.0)
    return rounded(out, {"intercept": 4, "n": 6})


def _mllib_coefs(spark, sf, model_type, params=None):
    df = S.lineitem_wide(spark, sf)
    feats = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    m = md.train_model(df, feats, "target", model_type, params)
    return rounded(md.importances(m, feats, spark), 4)


def _coef_sql(penalty: float) -> str:
    feats = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    cols = ", ".join(f"{c} AS f{i}" for i, c in enumerate(feats))
    rows = " UNION ALL ".join(f"SELECT '{c}' AS feature, {r(f'w{i}', 4)} AS coefficient FROM lf" for i, c in enumerate(feats))
    return f"WITH x AS (SELECT {cols}, target AS y FROM ({F7_SQL})),\n{osql.linear_fit('x', 4, [penalty] * 4)}\n{rows}"


@query("q_linear_mllib", _coef_sql(0.0))
def q_linear_mllib(spark, sf):
    return _mllib_coefs(spark, sf, "linear")


@query("q_ridge", _coef_sql(1.0))
def q_ridge(spark, sf):
    return _mllib_coefs(spark, sf, "ridge", {"alpha": 1.0})


@query("q_lasso")
def q_lasso(spark, sf):
    return _mllib_coefs(spark, sf, "lasso", {"alpha": 0.01})


@query("q_elasticnet")
def q_elasticnet(spark, sf):
    return _mllib_coefs(spark, sf, "elasticnet", {"alpha": 0.01, "l1_ratio": 0.5})


def _tree_eval(spark, sf, model_type, params=None):
    df = S.lineitem_wide(spark, sf)
    feats = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    lab = sp.split_labels(df, [], ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], "train_test", 0.2)
    m = md.train_model(lab.where("part = 'train'"), feats, "target", model_type, params)
    _, met = md.evaluate_model(m, lab.where("part = 'test'"), feats, "target")
    return met, m, feats


@query("q_random_forest")
def q_random_forest(spark, sf):
    met, _, _ = _tree_eval(spark, sf, "randomforest", {"n_estimators": 100, "max_depth": 10})
    return met


@query("q_gbt")
def q_gbt(spark, sf):
    met, _, _ = _tree_eval(spark, sf, "gbm", {"n_estimators": 100, "learning_rate": 0.1, "max_depth": 3})
    return met


@query("q_importances")
def q_importances(spark, sf):
    _, m, feats = _tree_eval(spark, sf, "gbm", {"n_estimators": 100, "learning_rate": 0.1, "max_depth": 3})
    return rounded(md.importances(m, feats, spark), 6)


_TREND_SQL = f"""
WITH s AS (SELECT *, CAST(row_number() OVER (ORDER BY date) - 1 AS DOUBLE) AS idx FROM ({F1_SQL})),
c AS (SELECT regr_intercept(revenue, idx) AS b, regr_slope(revenue, idx) AS w FROM s),
p AS (SELECT s.date, s.idx, s.revenue, c.b + c.w * s.idx AS prediction FROM s, c)
"""


def _trend(spark, sf):
    """F1 with a fitted linear time trend as prediction (normal equations by aggregation)."""
    d = fe.row_index(f1(spark, sf), [], ["date"]).withColumn("idx", F.col("idx").cast("double"))
    coefs = md.fit_linear_per_series(d, [], ["idx"], "revenue")
    return md.predict_linear(d, coefs, [], ["idx"])


_MET_DIG = {"mse": 0, "rmse": 4, "mae": 4, "mape": 6, "r2": 6}


@query("q_metrics", _TREND_SQL + f"""
, m AS (SELECT AVG(revenue) AS ybar FROM p)
SELECT CAST(COUNT(*) AS BIGINT) AS n, {r('SQRT(AVG((revenue - prediction) * (revenue - prediction)))', 4)} AS rmse,
  {r('AVG(abs(revenue - prediction))', 4)} AS mae,
  {r('AVG(CASE WHEN revenue != 0 THEN abs((revenue - prediction) / revenue) END) * 100', 6)} AS mape,
  {r('1 - SUM((revenue - prediction) * (revenue - prediction)) / SUM((revenue - ybar) * (revenue - ybar))', 6)} AS r2
FROM p, m
""")
def q_metrics(spark, sf):
    met = st.regression_metrics(_trend(spark, sf), "revenue", "prediction")
    return rounded(met.drop("mse"), _MET_DIG)


def _cv_sql(keys: bool, splits: int = 5, summary: bool = False) -> str:
    src = F2_SQL if keys else F1_SQL
    part = "PARTITION BY o_orderpriority " if keys else ""
    kc = "o_orderpriority, " if keys else ""
    kj = "s.o_orderpriority = f.o_orderpriority" if keys else "TRUE"
    grp = "o_orderpriority, " if keys else ""
    if summary:
        m = osql.metrics("revenue")
        stats = ", ".join(f"{r(f'AVG({c})', _MET_DIG[c])} AS mean_{c}, {r(f'stddev_pop({c})', _MET_DIG[c])} AS std_{c}" for c in m)
        tail = (f"e AS (SELECT {grp}fold, {', '.join(f'{v} AS {c}' for c, v in m.items())} FROM p JOIN yb USING ({grp}fold) "
                f"GROUP BY {grp}fold)\nSELECT {grp}{stats} FROM e GROUP BY {grp.strip(', ') or 'ALL'}")
        return _cv_sql(keys, splits).rsplit("\nSELECT", 1)[0] + ",\n" + tail
    return f"""
WITH s AS (SELECT {kc}date, revenue, n AS cnt, CAST(row_number() OVER ({part}ORDER BY date) - 1 AS BIGINT) AS idx
           FROM ({src})),
c AS (SELECT {kc}COUNT(*) AS n FROM s {'GROUP BY o_orderpriority' if keys else ''}),
f0 AS (SELECT {kc}n, n // {splits + 1} AS sz, unnest(generate_series(0, {splits - 1})) AS fold FROM c),
f AS (SELECT {kc}fold, n - ({splits} - fold) * sz AS ts, n - ({splits} - fold) * sz + sz AS te FROM f0
      WHERE n - ({splits} - fold) * sz >= floor(n * 0.7::DOUBLE)),
tr AS (SELECT {'f.o_orderpriority, ' if keys else ''}f.fold, regr_intercept(s.revenue, s.cnt) AS b,
              regr_slope(s.revenue, s.cnt) AS w FROM s JOIN f ON {kj} AND s.idx < f.ts
       GROUP BY {'f.o_orderpriority, ' if keys else ''}f.fold),
te AS (SELECT {'f.o_orderpriority, ' if keys else ''}f.fold, s.revenue, s.cnt FROM s JOIN f ON {kj}
       AND s.idx >= f.ts AND s.idx < f.te),
p AS (SELECT te.*, tr.b + tr.w * te.cnt AS prediction FROM te JOIN tr USING ({grp}fold)),
yb AS (SELECT {grp}fold, AVG(revenue) AS ybar FROM p GROUP BY ALL)
SELECT {grp}CAST(fold AS INTEGER) AS fold, CAST(COUNT(*) AS BIGINT) AS n,
  {r('SQRT(AVG((revenue - prediction) * (revenue - prediction)))', 4)} AS rmse,
  {r('AVG(abs(revenue - prediction))', 4)} AS mae,
  {r('AVG(CASE WHEN revenue != 0 THEN abs((revenue - prediction) / revenue) END) * 100', 6)} AS mape,
  {r('1 - SUM((revenue - prediction) * (revenue - prediction)) / SUM((revenue - ybar) * (revenue - ybar))', 6)} AS r2
FROM p JOIN yb USING ({grp}fold) GROUP BY {grp}fold
"""


@query("q_cv_scores", _cv_sql(False))
def q_cv_scores(spark, sf):
    per_fold, _, _ = md.cv_linear(f1(spark, sf), ["n"], "revenue", [], 5, order=["date"])
    return rounded(per_fold.drop("mse"), _MET_DIG)


@query("q_cv_scores_panel", _cv_sql(True))
def q_cv_scores_panel(spark, sf):
    per_fold, _, _ = md.cv_linear(f2(spark, sf), ["n"], "revenue", ["o_orderpriority"], 5, order=["date"])
    return rounded(per_fold.drop("mse"), _MET_DIG)


@query("q_cv_summary", _cv_sql(True, 3, summary=True))
def q_cv_summary(spark, sf):
    _, summary, _ = md.cv_linear(f2(spark, sf), ["n"], "revenue", ["o_orderpriority"], 3, order=["date"])
    return rounded(summary, {f"{s}_{m}": d for m, d in _MET_DIG.items() for s in ("mean", "std")})


_TWO_SQL = f"""
WITH s AS (SELECT date, CAST(n AS DOUBLE) AS f0, avg_price AS f1, revenue AS y,
           row_number() OVER (ORDER BY date) - 1 AS idx, COUNT(*) OVER () AS n FROM ({F1_SQL})),
"""
_MET_SQL = ", ".join(f"{r(e, _MET_DIG[m])} AS {m}" for m, e in osql.metrics().items())


@query("q_cv_mllib", _TWO_SQL + f"""
f0 AS (SELECT n, n // 6 AS sz, unnest(generate_series(0, 4)) AS fold FROM (SELECT DISTINCT n FROM s)),
f AS (SELECT fold, n - (5 - fold) * sz AS ts, n - (5 - fold) * sz + sz AS te FROM f0 WHERE n - (5 - fold) * sz >= floor(n * 0.7::DOUBLE)),
x AS (SELECT fold, f0, f1, y FROM s JOIN f ON s.idx < f.ts),
{osql.linear_fit('x', 2, keys=['fold'])},
p AS (SELECT f.fold, f.ts, r.y, {osql.predicted(2)} AS prediction FROM s r JOIN f ON r.idx >= f.ts AND r.idx < f.te
      JOIN lf c ON c.fold = f.fold),
q AS (SELECT *, AVG(y) OVER (PARTITION BY fold) AS ybar FROM p)
SELECT CAST(fold AS INTEGER) AS fold, CAST(ts AS BIGINT) AS train_size, CAST(COUNT(*) AS BIGINT) AS test_size, {_MET_SQL}
FROM q GROUP BY fold, ts
""")
def q_cv_mllib(spark, sf):
    per_fold, summary = md.time_series_cv(f1(spark, sf), ["n", "avg_price"], "revenue", "linear", n_splits=5,
                                          order=["date"])
    return rounded(per_fold, _MET_DIG)


@query("q_train_and_evaluate", _TWO_SQL + f"""
x AS (SELECT * FROM s WHERE idx < n - floor(n * 0.2::DOUBLE)),
{osql.linear_fit('x', 2)},
p AS (SELECT r.y, {osql.predicted(2)} AS prediction FROM s r, lf c WHERE r.idx >= r.n - floor(r.n * 0.2::DOUBLE)),
q AS (SELECT *, AVG(y) OVER () AS ybar FROM p)
SELECT CAST(COUNT(*) AS BIGINT) AS n, {_MET_SQL} FROM q
""")
def q_train_and_evaluate(spark, sf):
    res = md.train_and_evaluate(f1(spark, sf), "revenue", ["n", "avg_price"], "date", "linear", use_cv=True)
    return rounded(res.metrics.drop("mse"), _MET_DIG)


# =============================================================== residual diagnostics (MDL12, WIN10-WIN15, AGG9-AGG14)
@query("q_residual_stats", _TREND_SQL + f"""
SELECT CAST(COUNT(*) AS BIGINT) AS n, {r('AVG(revenue - prediction)', 4)} AS mean,
  {r('stddev_pop(revenue - prediction)', 4)} AS std, {r('MIN(revenue - prediction)', 4)} AS min,
  {r('MAX(revenue - prediction)', 4)} AS max FROM p
""")
def q_residual_stats(spark, sf):
    out = dg.residual_tests(_trend(spark, sf), "revenue", "prediction", order=["date"])
    return rounded(out.select("n", "mean", "std", "min", "max"), 4)


_RESID_LAG_SQL = _TREND_SQL + """
, e AS (SELECT date, revenue - prediction AS e FROM p),
m AS (SELECT AVG(e) AS mu FROM e),
l AS (SELECT e.e, e.e - m.mu AS c, lag(e.e) OVER (ORDER BY date) AS e1, lag(e.e - m.mu) OVER (ORDER BY date) AS c1 FROM e, m)
"""


@query("q_durbin_watson", _RESID_LAG_SQL + f"""
, d AS (SELECT SUM((e - e1) * (e - e1)) / SUM(e * e) AS dw FROM l)
SELECT {r('dw', 6)} AS durbin_watson, CASE WHEN dw < 1.5 THEN 'Positive autocorrelation'
  WHEN dw > 2.5 THEN 'Negative autocorrelation' ELSE 'No significant autocorrelation' END AS durbin_watson_interpretation
FROM d
""")
def q_durbin_watson(spark, sf):
    out = dg.residual_tests(_trend(spark, sf), "revenue", "prediction", order=["date"])
    return rounded(out.select("durbin_watson", "durbin_watson_interpretation"), 6)


@query("q_ljung_box", _RESID_LAG_SQL + f"""
, q AS (SELECT CAST(COUNT(*) AS DOUBLE) AS n, SUM(c * c1) / SUM(c * c) AS rho FROM l)
SELECT {r('n * (n + 2) * rho * rho / (n - 1)', 6)} AS ljung_box_stat FROM q
""")
def q_ljung_box(spark, sf):
    out = dg.residual_tests(_trend(spark, sf), "revenue", "prediction", order=["date"])
    return rounded(out.select("ljung_box_stat"), 6)


_RES_DIG = {"mean": 4, "std": 4, "min": 4, "max": 4, "ljung_box_stat": 6, "ljung_box_pvalue": 6, "durbin_watson": 6}


@query("q_residual_tests_panel", f"""
WITH s AS (SELECT *, CAST(row_number() OVER (PARTITION BY o_orderpriority ORDER BY date) - 1 AS DOUBLE) AS idx FROM ({F2_SQL})),
c AS (SELECT o_orderpriority, regr_intercept(revenue, idx) AS b, regr_slope(revenue, idx) AS w FROM s GROUP BY 1),
e AS (SELECT s.o_orderpriority, s.idx, s.revenue - c.b - c.w * s.idx AS e FROM s JOIN c USING (o_orderpriority)),
m AS (SELECT *, e - AVG(e) OVER (PARTITION BY o_orderpriority) AS c FROM e),
l AS (SELECT *, lag(e) OVER (PARTITION BY o_orderpriority ORDER BY idx) AS e1,
      lag(c) OVER (PARTITION BY o_orderpriority ORDER BY idx) AS c1 FROM m),
t AS (SELECT o_orderpriority, COUNT(*) AS n, AVG(e) AS mean, stddev_pop(e) AS sd, MIN(e) AS lo, MAX(e) AS hi,
      COUNT(*) * (COUNT(*) + 2.0) / (COUNT(*) - 1.0) * pow(SUM(c * c1) / SUM(c * c), 2) AS q,
      SUM((e - e1) * (e - e1)) / SUM(e * e) AS dw FROM l GROUP BY 1),
z AS (SELECT *, sqrt(q / 2) AS z FROM t)
SELECT o_orderpriority, CAST(n AS BIGINT) AS n, {r('mean')} AS mean, {r('sd')} AS std, {r('lo')} AS min, {r('hi')} AS max,
  {r('q', 6)} AS ljung_box_stat, {r(f'1 - {osql.erf("z")}', 6)} AS ljung_box_pvalue, {r('dw', 6)} AS durbin_watson,
  CASE WHEN dw < 1.5 THEN 'Positive autocorrelation' WHEN dw > 2.5 THEN 'Negative autocorrelation'
       ELSE 'No significant autocorrelation' END AS durbin_watson_interpretation
FROM z
""")
def q_residual_tests_panel(spark, sf):
    d = fe.row_index(f2(spark, sf), ["o_orderpriority"], ["date"]).withColumn("idx", F.col("idx").cast("double"))
    coefs = md.fit_linear_per_series(d, ["o_orderpriority"], ["idx"], "revenue")
    pred = md.predict_linear(d, coefs, ["o_orderpriority"], ["idx"])
    return rounded(dg.residual_tests(pred, "revenue", "prediction", ["o_orderpriority"], ["date"]), _RES_DIG)


def _acf_sql(nlags: int = 20, src: str = F1_SQL, col: str = "revenue", keys: str = "", order: str = "date") -> str:
    k = f"{keys}, " if keys else ""
    part = f"PARTITION BY {keys} " if keys else ""
    lags = ", ".join(f"lag(c, {i}) OVER ({part}ORDER BY {order}) AS l{i}" for i in range(1, nlags + 1))
    sums = ", ".join(f"SUM(c * l{i}) AS s{i}" for i in range(1, nlags + 1))
    rows = " UNION ALL ".join(f"SELECT {k}{i} AS lag, COALESCE({f's{i}'}, 0) / s0 AS acf, n FROM sm" for i in range(0, nlags + 1))
    return f"""
WITH s AS (SELECT * FROM ({src}) WHERE {col} IS NOT NULL),
c AS (SELECT *, {col} - AVG({col}) OVER ({part.strip()}) AS c FROM s),
l AS (SELECT {k}c, {lags} FROM c),
sm AS (SELECT {k}COUNT(*) AS n, SUM(c * c) AS s0, {sums} FROM l {f'GROUP BY {keys}' if keys else ''}),
a AS ({rows}),
v AS (SELECT {k}lag, acf, n, COALESCE(SUM(CASE WHEN lag >= 1 THEN acf * acf ELSE 0 END)
        OVER ({part}ORDER BY lag ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cum FROM a),
se AS (SELECT {k}lag, acf, sqrt(CASE WHEN lag = 0 THEN 0.0 WHEN lag = 1 THEN 1.0 / n ELSE (1.0 + 2.0 * cum) / n END) AS se FROM v)
SELECT {k}CAST(lag AS INTEGER) AS lag, {r('acf', 6)} AS acf, {r(f'acf - {dg.Z95!r} * se', 6)} AS conf_lo,
       {r(f'acf + {dg.Z95!r} * se', 6)} AS conf_hi FROM se
"""


@query("q_acf", _acf_sql())
def q_acf(spark, sf):
    return rounded(dg.acf(f1(spark, sf), "revenue", 20, order=["date"]), 6)


@query("q_acf_panel", _acf_sql(10, F6_SQL, "value", "user_id", "ts, event_id"))
def q_acf_panel(spark, sf):
    return rounded(dg.acf(S.events_with_gaps(spark, sf), "value", 10, keys=["user_id"], order=["ts", "event_id"]), 6)


def _qq_sql(keys: str, rows: str) -> str:
    """CTEs up to ``pts``: position, normal quantile and ordered value of ``v`` of ``rows``."""
    k = f"{keys}, " if keys else ""
    part = f"PARTITION BY {keys}" if keys else ""
    return f"""
o AS (SELECT {k}v, row_number() OVER ({part} ORDER BY v) AS i, CAST(COUNT(*) OVER ({part}) AS DOUBLE) AS n FROM {rows}),
u AS (SELECT *, CASE WHEN i = n THEN pow(0.5, 1.0 / n) WHEN i = 1 THEN 1 - pow(0.5, 1.0 / n)
      ELSE (i - 0.3175::DOUBLE) / (n + 0.365::DOUBLE) END AS pos FROM o),
pts AS (SELECT {k}i - 1 AS i, {fx.normal_ppf_sql('pos')} AS theoretical, v AS ordered FROM u)
"""


_QQ_DIG = {"theoretical": 6, "ordered": 4}


@query("q_qq", _TREND_SQL + f""", e AS (SELECT revenue - prediction AS v FROM p),{_qq_sql('', 'e')}
SELECT CAST(i AS BIGINT) AS i, {r('theoretical', 6)} AS theoretical, {r('ordered', 4)} AS ordered FROM pts""")
def q_qq(spark, sf):
    pts, line = dg.qq_table(_trend(spark, sf).withColumn("e", F.col("revenue") - F.col("prediction")), "e")
    return rounded(pts, _QQ_DIG)


@query("q_qq_line", f"""WITH e AS (SELECT event_type, value AS v FROM ({F6_SQL}) WHERE value IS NOT NULL),{_qq_sql('event_type', 'e')}
SELECT event_type, {r('regr_slope(ordered, theoretical)', 6)} AS slope, {r('regr_intercept(ordered, theoretical)', 6)} AS intercept,
       {r('corr(ordered, theoretical)', 6)} AS r FROM pts GROUP BY event_type""")
def q_qq_line(spark, sf):
    pts, line = dg.qq_table(S.events_with_gaps(spark, sf), "value", keys=["event_type"])
    return rounded(line, 6)


@query("q_error_hist", _TREND_SQL + f"""
, e AS (SELECT revenue - prediction AS v FROM p), b AS (SELECT MIN(v) AS lo, MAX(v) AS hi FROM e),
h AS (SELECT CASE WHEN hi = lo THEN 1 ELSE least(floor((v - lo) / (hi - lo) * 20) + 1, 20) END AS bin, lo, hi FROM e, b)
SELECT CAST(g.bin AS INTEGER) AS bin, {r('b.lo + (b.hi - b.lo) / 20 * (g.bin - 1)', 4)} AS lo,
       {r('CASE WHEN b.hi = b.lo THEN b.hi ELSE b.lo + (b.hi - b.lo) / 20 * g.bin END', 4)} AS hi,
       (SELECT CAST(COUNT(*) AS BIGINT) FROM h WHERE h.bin = g.bin) AS count
FROM b JOIN (SELECT unnest(range(1, 21)) AS bin) g ON g.bin <= CASE WHEN b.hi = b.lo THEN 1 ELSE 20 END
""")
def q_error_hist(spark, sf):
    t = _trend(spark, sf).withColumn("e", F.col("revenue") - F.col("prediction"))
    return rounded(st.histogram(t, "e", 20), 4)


@query("q_histogram_panel", f"""
WITH e AS (SELECT event_type, value AS v FROM ({F6_SQL}) WHERE value IS NOT NULL),
b AS (SELECT event_type, MIN(v) AS lo, MAX(v) AS hi FROM e GROUP BY 1),
h AS (SELECT e.event_type, CASE WHEN hi = lo THEN 1 ELSE least(floor((v - lo) / (hi - lo) * 10) + 1, 10) END AS bin, lo, hi
      FROM e JOIN b USING (event_type))
SELECT b.event_type, CAST(g.bin AS INTEGER) AS bin, {r('b.lo + (b.hi - b.lo) / 10 * (g.bin - 1)', 6)} AS lo,
       {r('CASE WHEN b.hi = b.lo THEN b.hi ELSE b.lo + (b.hi - b.lo) / 10 * g.bin END', 6)} AS hi,
       (SELECT CAST(COUNT(*) AS BIGINT) FROM h WHERE h.event_type = b.event_type AND h.bin = g.bin) AS count
FROM b JOIN (SELECT unnest(range(1, 11)) AS bin) g ON g.bin <= CASE WHEN b.hi = b.lo THEN 1 ELSE 10 END
""")
def q_histogram_panel(spark, sf):
    return rounded(st.histogram(S.events_with_gaps(spark, sf), "value", 10, keys=["event_type"]), 6)


@query("q_mean_error", _TREND_SQL + f"SELECT {r('AVG(revenue - prediction)', 4)} AS mean_error FROM p")
def q_mean_error(spark, sf):
    return rounded(st.mean_error(_trend(spark, sf), "revenue", "prediction"), 4)


def _box_sql(part: str) -> str:
    return f"""
WITH v AS (SELECT CAST({part}(l_shipdate) AS INTEGER) AS g, l_extendedprice AS x FROM lineitem),
q AS (SELECT g, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS med, quantile_cont(x, 0.75) AS q3 FROM v GROUP BY g),
j AS (SELECT v.g, v.x, q.q1, q.med, q.q3, v.x BETWEEN q.q1 - 1.5 * (q.q3 - q.q1) AND q.q3 + 1.5 * (q.q3 - q.q1) AS inside
      FROM v JOIN q USING (g))
SELECT g AS {part}, {r('FIRST(q1)', 4)} AS q1, {r('FIRST(med)', 4)} AS median, {r('FIRST(q3)', 4)} AS q3,
  {r('MIN(CASE WHEN inside THEN x END)', 4)} AS whisker_lo, {r('MAX(CASE WHEN inside THEN x END)', 4)} AS whisker_hi,
  CAST(COUNT(CASE WHEN NOT inside THEN 1 END) AS BIGINT) AS outliers, CAST(COUNT(*) AS BIGINT) AS n
FROM j GROUP BY g
"""


def _box(spark, sf, part):
    li = S.table(spark, sf, "lineitem")
    fn = F.year if part == "year" else F.month
    v = li.select(fn("l_shipdate").alias(part), "l_extendedprice")
    return rounded(st.boxplot_stats(v, "l_extendedprice", [part]), 4)


@query("q_boxplot_year", _box_sql("year"))
def q_boxplot_year(spark, sf):
    return _box(spark, sf, "year")


@query("q_boxplot_month", _box_sql("month"))
def q_boxplot_month(spark, sf):
    return _box(spark, sf, "month")


@query("q_kde", f"""
WITH v AS (SELECT l_extendedprice AS x FROM lineitem),
s AS (SELECT COUNT(x) AS n, stddev_samp(x) AS sd, MIN(x) AS lo, MAX(x) AS hi FROM v),
g AS (SELECT i, lo + (hi - lo) * i / 99 AS gx, sd * pow(n, -0.2) AS h, n FROM s, (SELECT unnest(generate_series(0, 99)) AS i))
SELECT {r('gx', 4)} AS x, {r('SUM(exp(-0.5 * pow((gx - x) / h, 2))) * (1.0 / (n * h * sqrt(2 * pi())))', 10)} AS density
FROM g, v GROUP BY i, gx, h, n
""")
def q_kde(spark, sf):
    li = S.table(spark, sf, "lineitem")
    return rounded(st.kde(li, "l_extendedprice", 100), {"x": 4, "density": 10})


def _decomp_sql(model: str, p: int = 12) -> str:
    h = p // 2
    det = "observed - trend" if model == "additive" else "observed / trend"
    cen = "pm - pc" if model == "additive" else "pm / pc"
    res = "observed - trend - seasonal" if model == "additive" else "observed / (trend * seasonal)"
    return f"""
WITH s AS (SELECT date, revenue AS observed, row_number() OVER (ORDER BY date) - 1 AS idx FROM ({F1_SQL})),
t AS (SELECT *, CASE WHEN COUNT(observed) OVER (ORDER BY idx ROWS BETWEEN {h} PRECEDING AND {h} FOLLOWING) = {p + 1}
        THEN (SUM(observed) OVER (ORDER BY idx ROWS BETWEEN {h} PRECEDING AND {h} FOLLOWING)
              - 0.5 * lag(observed, {h}) OVER (ORDER BY idx) - 0.5 * lead(observed, {h}) OVER (ORDER BY idx)) / {p}
        END AS trend FROM s),
d AS (SELECT *, idx % {p} AS phase, {det} AS det FROM t),
ph AS (SELECT phase, AVG(det) AS pm FROM d GROUP BY phase),
pc AS (SELECT AVG(pm) AS pc FROM ph),
sea AS (SELECT phase, {cen} AS seasonal FROM ph, pc)
SELECT date, CAST(idx AS BIGINT) AS idx, {r('observed', 2)} AS observed, {r('trend', 4)} AS trend,
       {r('seasonal', 6)} AS seasonal, {r(res, 6)} AS resid
FROM d JOIN sea USING (phase)
"""


def _decomp(spark, sf, model):
    out = dg.decompose(f1(spark, sf), "revenue", 12, model, order=["date"])
    return rounded(out, {"observed": 2, "trend": 4, "seasonal": 6, "resid": 6})


@query("q_decompose_additive", _decomp_sql("additive"))
def q_decompose_additive(spark, sf):
    return _decomp(spark, sf, "additive")


@query("q_decompose_multiplicative", _decomp_sql("multiplicative"))
def q_decompose_multiplicative(spark, sf):
    return _decomp(spark, sf, "multiplicative")


def _decomp_panel_sql(p: int = 7) -> str:
    w = "OVER (PARTITION BY user_id ORDER BY idx"
    frame = f"{w} ROWS BETWEEN {p // 2} PRECEDING AND {p // 2} FOLLOWING)"
    return f"""
WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx FROM ({F6_SQL})),
i AS (SELECT user_id, event_id, idx, value, last_value(value IGNORE NULLS) {w}) AS pv,
  last_value(CASE WHEN value IS NOT NULL THEN idx END IGNORE NULLS) {w}) AS pi,
  first_value(value IGNORE NULLS) {w} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nv,
  first_value(CASE WHEN value IS NOT NULL THEN idx END IGNORE NULLS) {w} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ni
  FROM e),
s AS (SELECT user_id, event_id, idx, CASE WHEN value IS NOT NULL THEN value WHEN pv IS NULL THEN NULL WHEN nv IS NULL THEN pv
      ELSE pv + (nv - pv) * CAST(idx - pi AS DOUBLE) / CAST(ni - pi AS DOUBLE) END AS x FROM i),
t AS (SELECT *, CASE WHEN COUNT(x) {frame} = {p} THEN SUM(x) {frame} / {p} END AS trend FROM s),
ph AS (SELECT user_id, idx % {p} AS phase, AVG(x - trend) AS pm FROM t GROUP BY 1, 2),
se AS (SELECT *, pm - AVG(pm) OVER (PARTITION BY user_id) AS seasonal FROM ph)
SELECT t.user_id, t.event_id, {r('trend', 6)} AS trend, {r('seasonal', 6)} AS seasonal, {r('x - trend - seasonal', 6)} AS resid
FROM t JOIN se ON t.user_id = se.user_id AND t.idx % {p} = se.phase
"""


@query("q_decompose_panel", _decomp_panel_sql())
def q_decompose_panel(spark, sf):
    s = pr.interpolate_linear(S.events_with_gaps(spark, sf), ["value"], ["user_id"], ["ts", "event_id"])
    out = dg.decompose(s, "value", 7, "additive", keys=["user_id"], order=["ts", "event_id"])
    return rounded(out.select("user_id", "event_id", "trend", "seasonal", "resid"), 6)


_RO_W, _RO_STEP = 12, 6


@query("q_rolling_origin", f"""
WITH s AS (SELECT date, revenue, row_number() OVER (ORDER BY date) - 1 AS idx,
             AVG(revenue) OVER (ORDER BY date ROWS BETWEEN {_RO_W - 1} PRECEDING AND CURRENT ROW) AS m12,
             COUNT(*) OVER () AS n FROM ({F1_SQL})),
w AS (SELECT (idx + 1) // {_RO_STEP} AS window_id, m12 AS yhat FROM s
      WHERE (idx + 1) % {_RO_STEP} = 0 AND idx + 1 >= {_RO_W} AND idx + 1 + {_RO_W} <= n),
p AS (SELECT window_id, unnest(generate_series(0, {_RO_W - 1})) AS pos, yhat FROM w)
SELECT CAST(p.window_id AS BIGINT) AS window_id, CAST(p.pos AS INTEGER) AS pos, {r('p.yhat', 2)} AS yhat,
       CAST(p.window_id * {_RO_STEP} + p.pos AS BIGINT) AS idx, {r('s.revenue', 2)} AS actual
FROM p LEFT JOIN s ON s.idx = p.window_id * {_RO_STEP} + p.pos
""")
def q_rolling_origin(spark, sf):
    d = fe.create_rolling_features(f1(spark, sf), ["revenue"], [_RO_W], ["mean"], order=["date"])
    d = fe.row_index(d, [], ["date"])
    d = join_on_keys(d, d.agg(F.count(F.lit(1)).alias("__n")), [], "inner")
    e = d.where(((F.col("idx") + 1) % _RO_STEP == 0) & (F.col("idx") + 1 >= _RO_W) & (F.col("idx") + 1 + _RO_W <= F.col("__n")))
    preds = e.select(((F.col("idx") + 1) / _RO_STEP).cast("long").alias("window_id"),
                     F.explode(F.sequence(F.lit(0), F.lit(_RO_W - 1))).alias("pos"),
                     F.col(f"revenue_roll_{_RO_W}_mean").alias("yhat"))
    out = dg.rolling_origin_table(d.select("idx", F.col("revenue").alias("y")), preds, _RO_STEP)
    return rounded(out.select("window_id", "pos", "yhat", "idx", "actual"), 2)


# =============================================================== forecasting (FC1-FC7, JN4, FRQ6)
def _forecaster(spark, sf, keys=(), regressors=(), holidays=None, seasonalities=None):
    cfg = fc.ForecastConfig(yearly_seasonality=True, regressors=list(regressors),
                            seasonalities=list(seasonalities or []))
    src = f2(spark, sf) if keys else f1(spark, sf)
    return fc.AdditiveForecaster(cfg, keys=list(keys), ds="date", y="revenue", holidays=holidays), src


@query("q_forecast")
def q_forecast(spark, sf):
    m, src = _forecaster(spark, sf)
    lab = sp.split_labels(src, [], ["date"], "forecast", 0.2)
    m.fit(lab.where("part = 'train'"))
    pred = m.predict(lab)
    test = pred.where("part = 'test'")
    return rounded(st.regression_metrics(test, "revenue", "yhat"), 6)


@query("q_forecast_panel")
def q_forecast_panel(spark, sf):
    m, src = _forecaster(spark, sf, keys=["o_orderpriority"], regressors=["n"])
    lab = sp.split_labels(src, ["o_orderpriority"], ["date"], "forecast", 0.2)
    m.fit(lab.where("part = 'train'"))
    pred = m.predict(lab)
    return rounded(st.regression_metrics(pred.where("part = 'test'"), "revenue", "yhat", ["o_orderpriority"]), 6)


@query("q_forecast_components")
def q_forecast_components(spark, sf):
    m, src = _forecaster(spark, sf, seasonalities=[{"name": "quarterly", "period": 91.25, "fourier_order": 3}])
    m.fit(src)
    fut = m.make_future(src, 12)
    return rounded(m.predict(fut), 4)


def _holidays(spark, sf):
    """Holiday table derived from the orders calendar: every year start present in the data."""
    o = S.table(spark, sf, "orders")
    return o.select(F.trunc(F.to_date("o_orderdate"), "year").alias("ds"), F.lit("new_year").alias("holiday")).distinct()


@query("q_holiday_features", f"""
WITH h AS (SELECT DISTINCT CAST(date_trunc('year', o_orderdate) AS DATE) AS ds FROM orders)
SELECT s.date, CAST(CASE WHEN h.ds IS NULL THEN 0 ELSE 1 END AS INTEGER) AS holiday_new_year
FROM ({F1_SQL}) s LEFT JOIN h ON s.date = h.ds
""")
def q_holiday_features(spark, sf):
    out = fc.holiday_features(f1(spark, sf), _holidays(spark, sf), "date")
    return out.select("date", "holiday_new_year")


@query("q_forecast_holidays")
def q_forecast_holidays(spark, sf):
    m, src = _forecaster(spark, sf, holidays=_holidays(spark, sf))
    m.fit(src)
    return rounded(m.predict(src).select("date", "revenue", "yhat", "holidays"), 4)


@query("q_regressor_future", f"""
WITH s AS ({F2_SQL}),
last AS (SELECT o_orderpriority, MAX(date) AS mx, AVG(n) AS mn FROM s GROUP BY 1),
fut AS (SELECT o_orderpriority, date FROM s UNION
        SELECT o_orderpriority, CAST(unnest(generate_series(mx + INTERVAL 1 MONTH, mx + INTERVAL 6 MONTH, INTERVAL 1 MONTH))
               AS DATE) FROM last)
SELECT fut.o_orderpriority, fut.date, {r('COALESCE(CAST(s.n AS DOUBLE), last.mn)', 6)} AS n
FROM fut LEFT JOIN s ON fut.o_orderpriority = s.o_orderpriority AND fut.date = s.date
JOIN last ON fut.o_orderpriority = last.o_orderpriority
""")
def q_regressor_future(spark, sf):
    src = f2(spark, sf).withColumn("n", F.col("n").cast("double"))
    fut = pr.future_frame(src, "date", 6, ["o_orderpriority"])
    out = fc.regressor_future(fut, src, ["n"], ["o_orderpriority"], "date", "actual")
    return rounded(out.select("o_orderpriority", "date", "n"), 6)


@query("q_custom_seasonality", f"""
SELECT date, {', '.join(f"{r(f'sin({2 * math.pi * h / 91.25!r} * CAST(date - DATE {chr(39)}1970-01-01{chr(39)} AS DOUBLE))', 6)} AS quarterly_s{h}, "
                        f"{r(f'cos({2 * math.pi * h / 91.25!r} * CAST(date - DATE {chr(39)}1970-01-01{chr(39)} AS DOUBLE))', 6)} AS quarterly_c{h}"
                        for h in (1, 2, 3))}
FROM ({F1_SQL})
""")
def q_custom_seasonality(spark, sf):
    out = fc.seasonality_features(f1(spark, sf), "date", "quarterly", 91.25, 3)
    return rounded(out.select("date", *[f"quarterly_{t}{h}" for h in (1, 2, 3) for t in ("s", "c")]), 6)


# =============================================================== sinks and the end-to-end job (SNK*, SRC1, SRC3, PIP*)
@query("q_csv_roundtrip", f"SELECT date, {r('revenue', 2)} AS revenue, n, {r('avg_price', 4)} AS avg_price FROM ({F1_SQL})")
def q_csv_roundtrip(spark, sf):
    import uuid
    from almanac.session import scratch_path
    path = scratch_path(spark, f"csv-{uuid.uuid4().hex}")
    io.write_table(f1(spark, sf), path, fmt="csv")
    back = io.load_data(spark, path, date_col="date", fmt="csv",
                        schema="date STRING, revenue DOUBLE, n BIGINT, avg_price DOUBLE")
    return rounded(back, {"revenue": 2, "avg_price": 4})


@query("q_pipeline_summary")
def q_pipeline_summary(spark, sf):
    from almanac.plans.pipeline import PipelineConfig, run_pipeline
    cfg = PipelineConfig(target_col="revenue", date_col="date", model_type="linear", max_lag=3, use_pca=False,
                         feature_selection_method="f_regression", top_n_features=5)
    return run_pipeline(spark, f1(spark, sf), cfg).summary


# =============================================================== more sources and statistics (SRC3, AGG2, AGG5, MLE lambdas)
@query("q_read_datasets", f"""
SELECT 'orders' AS dataset, date, {r('revenue', 2)} AS value FROM ({F1_SQL})
UNION ALL
SELECT 'shipments' AS dataset, d AS date, {r('qty', 2)} AS value FROM ({S.shipments_sql('quarter')})
""")
def q_read_datasets(spark, sf):
    import uuid
    from almanac.session import scratch_path
    root = scratch_path(spark, f"datasets-{uuid.uuid4().hex}")
    io.write_table(f1(spark, sf).select("date", F.col("revenue").alias("value")), f"{root}/orders", fmt="csv")
    io.write_table(S.shipments(spark, sf, "quarter").select(F.col("d").alias("date"), F.col("qty").alias("value")),
                   f"{root}/shipments", fmt="csv")
    out = io.read_datasets(spark, root, "*.csv", schema="date DATE, value DOUBLE")
    return rounded(out.select("dataset", "date", "value"), 2)


@query("q_column_stats", f"WITH d AS ({F7_SQL}) " + " UNION ALL ".join(
    f"SELECT '{c}' AS column, {r(f'AVG({c})', 6)} AS mean, {r(f'MIN({c})', 6)} AS min, {r(f'MAX({c})', 6)} AS max, "
    f"{r(_nn(f'stddev_samp({c})'), 6)} AS sd FROM d" for c in F7_COLS))
def q_column_stats(spark, sf):
    return rounded(st.column_stats(S.lineitem_wide(spark, sf), F7_COLS, ["mean", "min", "max", "sd"]), 6)


@query("q_distinct_values", "SELECT DISTINCT CAST(year(l_shipdate) AS INTEGER) AS year FROM lineitem")
def q_distinct_values(spark, sf):
    return st.distinct_values(S.table(spark, sf, "lineitem").select(F.year("l_shipdate").alias("year")), "year")


def _mle(spark, sf, kind, keys):
    df = S.balances(spark, sf).select("c_mktsegment", F.col("c_acctbal").alias("x"))
    t = SeriesTransformer(keys=keys)
    t.fit_transform(df, ["x"], [kind])
    st_ = t.steps[0].fitted
    tab = st_.as_table(spark)
    return rounded(tab.select(*keys, F.col("x__lam").alias("lambda")), 3)


def _mle_sql(kind: str, keys: list[str]) -> str:
    k = "".join(f"{c}, " for c in keys)
    part = f"PARTITION BY {', '.join(keys)}" if keys else ""
    x = (f"c_acctbal + CASE WHEN MIN(c_acctbal) OVER ({part}) <= 0 THEN abs(MIN(c_acctbal) OVER ({part})) + 1 ELSE 0 END"
         if kind == "box_cox" else "c_acctbal")
    return f"WITH d AS (SELECT {k}{x} AS x FROM customer),\n{osql.best_lambda('d', kind, keys)}\nSELECT {k}{r('lam', 3)} AS lambda FROM lam"


@query("q_box_cox_mle", _mle_sql("box_cox", []))
def q_box_cox_mle(spark, sf):
    return _mle(spark, sf, "box_cox", [])


@query("q_yeo_johnson_mle", _mle_sql("yeo_johnson", []))
def q_yeo_johnson_mle(spark, sf):
    return _mle(spark, sf, "yeo_johnson", [])


@query("q_yeo_johnson_mle_panel", _mle_sql("yeo_johnson", ["c_mktsegment"]))
def q_yeo_johnson_mle_panel(spark, sf):
    return _mle(spark, sf, "yeo_johnson", ["c_mktsegment"])


# =============================================================== blocked plans on real data
# The same operators with a small block size, so the scalable path (bucketed index, halos,
# carried scans, ranked quantiles) is checked against the same oracle SQL as the plain path.
from almanac.plans.ordered import block_rows, series_hint, series_plan  # noqa: E402

_SMALL_BLOCK = 997


def _blocked(name: str, base: str, rows: int = _SMALL_BLOCK):
    fn = QUERIES[base]

    def run(spark, sf):
        with block_rows(spark, rows):
            return fn(spark, sf)
    run.__name__ = name
    QUERIES[name] = run
    if base in SQL:
        SQL[name] = SQL[base]


for _b in ("q_lags_global", "q_rolling_global", "q_ffill_global", "q_bfill_global", "q_interpolate_global",
           "q_row_index_global", "q_boxplot_year", "q_mutual_info"):
    _blocked(f"{_b}_blocked", _b)
# short series (80 monthly rows, 49-86 events per user): blocks of 37 rows, still wider than
# every frame these operators use (20 lags at most)
for _b in ("q_fill_median", "q_fill_group_median", "q_split_three_way", "q_frequency_detect_events", "q_acf",
           "q_decompose_additive", "q_inverse_diff", "q_lags", "q_ffill", "q_fourier", "q_engineer_features",
           "q_seasonal_diff_panel", "q_cv_scores_panel", "q_rolling_origin"):
    _blocked(f"{_b}_blocked", _b, 37)


def _hot_events(spark, sf):
    """Events with a hot key: users below 50 share key 0 (about a third of all rows)."""
    ev = S.events_with_gaps(spark, sf)
    return ev.withColumn("k", F.when(F.col("user_id") < 50, F.lit(0)).otherwise(F.col("user_id")))


_HOT_SQL = f"SELECT *, CASE WHEN user_id < 50 THEN 0 ELSE user_id END AS k FROM ({F6_SQL})"


@query("q_lags_hot_key", f"""
SELECT event_id, {r('lag(value, 1) OVER (PARTITION BY k ORDER BY ts, event_id)')} AS value_lag_1,
       {r('lag(value, 5) OVER (PARTITION BY k ORDER BY ts, event_id)')} AS value_lag_5,
       {r('AVG(value) OVER (PARTITION BY k ORDER BY ts, event_id ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)')}
         AS value_roll_6_mean
FROM ({_HOT_SQL})
""")
def q_lags_hot_key(spark, sf):
    ev = _hot_events(spark, sf)
    with block_rows(spark, _SMALL_BLOCK):
        # size once, index once: the rolling step reuses the decision and the row positions
        with series_hint(series_plan(ev, ["k"], ["ts", "event_id"])):
            d = fe.create_lagged_features(ev, ["value"], [1, 5], keys=["k"], order=["ts", "event_id"], keep_index=True)
            d = fe.create_rolling_features(d, ["value"], [6], ["mean"], keys=["k"], order=["ts", "event_id"])
    return rounded(d.select("event_id", "value_lag_1", "value_lag_5", "value_roll_6_mean"))


@query("q_ffill_hot_key", f"""
SELECT event_id, {r("COALESCE(value, last_value(value IGNORE NULLS) OVER (PARTITION BY k ORDER BY ts, event_id "
                    "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value(value IGNORE NULLS) OVER "
                    "(PARTITION BY k ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))")} AS value
FROM ({_HOT_SQL})
""")
def q_ffill_hot_key(spark, sf):
    with block_rows(spark, _SMALL_BLOCK):
        out = pr.handle_missing_values(_hot_events(spark, sf), "forward", keys=["k"], order=["ts", "event_id"],
                                       columns=["value"])
    return rounded(out.select("event_id", "value"))


@query("q_median_hot_key", f"""
SELECT k, {r('median(value)')} AS value FROM ({_HOT_SQL}) WHERE value IS NOT NULL GROUP BY k
""")
def q_median_hot_key(spark, sf):
    with block_rows(spark, _SMALL_BLOCK):
        out = pr.exact_median(_hot_events(spark, sf), ["k"], ["value"])
    return rounded(out)


@query("q_linear_fit_hot_key", f"""
SELECT k, {r('regr_intercept(value, CAST(event_id AS DOUBLE))', 6)} AS intercept,
       {r('regr_slope(value, CAST(event_id AS DOUBLE))', 9)} AS event_id
FROM ({_HOT_SQL}) WHERE value IS NOT NULL GROUP BY k
""")
def q_linear_fit_hot_key(spark, sf):
    ev = _hot_events(spark, sf).withColumn("event_id", F.col("event_id").cast("double"))
    with block_rows(spark, _SMALL_BLOCK):
        out = md.fit_linear_per_series(ev, ["k"], ["event_id"], "value")
    return rounded(out, {"intercept": 6, "event_id": 9})


@query("q_corr_hot_key", f"""
SELECT k, 'value' AS a, 'x' AS b, {r(_nn('corr(value, x)'), 6)} AS r
FROM (SELECT k, value, CAST(event_id % 97 AS DOUBLE) AS x FROM ({_HOT_SQL})) GROUP BY k
""")
def q_corr_hot_key(spark, sf):
    ev = _hot_events(spark, sf).withColumn("x", (F.col("event_id") % 97).cast("double"))
    with block_rows(spark, _SMALL_BLOCK):
        out = st.corr_pairs(ev, ["value", "x"], keys=["k"])
    return rounded(out, 6)


# =============================================================== inputs outside the usual fixtures
@query("q_interpolate_user_idx", _interp_sql(True))
def q_interpolate_user_idx(spark, sf):
    own = S.events_with_gaps(spark, sf).withColumn("idx", -F.col("event_id"))
    out = pr.interpolate_linear(own, ["value"], keys=["user_id"], order=["ts", "event_id"])
    return rounded(out.select("event_id", "value"))


@query("q_split_user_idx", f"SELECT date, part FROM ({_split_sql('train_test', False)})")
def q_split_user_idx(spark, sf):
    out = sp.split_labels(f1(spark, sf).withColumn("idx", F.lit(7)), [], ["date"], "train_test", 0.2)
    return out.where("idx = 7").select("date", "part")


@query("q_inverse_diff_user_idx", f"SELECT date, {r('revenue', 2)} AS revenue FROM ({F1_SQL})")
def q_inverse_diff_user_idx(spark, sf):
    t = SeriesTransformer(order=["date"])
    d = t.fit_transform(_diff_df(spark, sf, False).withColumn("idx", F.lit(1)), ["revenue"], ["diff"], {"diff_lag": 3})
    return rounded(t.inverse_transform(d).drop("idx"), 2)


@query("q_cv_scores_six_splits", _cv_sql(False, 6))
def q_cv_scores_six_splits(spark, sf):
    per_fold, _, _ = md.cv_linear(f1(spark, sf), ["n"], "revenue", [], 6, order=["date"])
    return rounded(per_fold.drop("mse"), _MET_DIG)


@query("q_metrics_null_predictions", _TREND_SQL + f"""
, complete AS (SELECT * FROM p WHERE CAST(idx AS INTEGER) % 3 <> 0), m AS (SELECT AVG(revenue) AS ybar FROM complete)
SELECT CAST(COUNT(*) AS BIGINT) AS n, {r('SQRT(AVG((revenue - prediction) * (revenue - prediction)))', 4)} AS rmse,
  {r('AVG(abs(revenue - prediction))', 4)} AS mae,
  {r('AVG(CASE WHEN revenue != 0 THEN abs((revenue - prediction) / revenue) END) * 100', 6)} AS mape,
  {r('1 - SUM((revenue - prediction) * (revenue - prediction)) / SUM((revenue - ybar) * (revenue - ybar))', 6)} AS r2
FROM complete, m
""")
def q_metrics_null_predictions(spark, sf):
    t = _trend(spark, sf).withColumn("prediction", F.when(F.col("idx") % 3 != 0, F.col("prediction")))
    return rounded(st.regression_metrics(t, "revenue", "prediction").drop("mse"), _MET_DIG)


@query("q_fill_median_null_key", f"""
WITH e AS (SELECT event_id, CASE WHEN user_id % 5 <> 0 THEN user_id END AS k, value FROM ({F6_SQL})),
m AS (SELECT k, median(value) AS med FROM e GROUP BY k)
SELECT e.event_id, {r('COALESCE(e.value, m.med)')} AS value FROM e JOIN m ON e.k IS NOT DISTINCT FROM m.k
""")
def q_fill_median_null_key(spark, sf):
    e = S.events_with_gaps(spark, sf).select("event_id", F.when(F.col("user_id") % 5 != 0, F.col("user_id")).alias("k"), "value")
    return rounded(pr.handle_missing_values(e, "median", keys=["k"], columns=["value"]).select("event_id", "value"))


_FUTURE_SQL = {
    "daily": ("D", "CAST(MAX(date) AS DATE) + CAST(i AS INTEGER)"),
    "weekly": ("W", "CAST(MAX(date) AS DATE) + CAST(7 - isodow(MAX(date)) % 7 + 7 * (i - 1) AS INTEGER)"),
    "month_end": ("M", "last_day(CAST(date_trunc('month', MAX(date)) + to_months(CAST(i - CASE WHEN MAX(date) < last_day(MAX(date)) THEN 1 ELSE 0 END AS INTEGER)) AS DATE))"),
    "quarter_start": ("QS", "CAST(date_trunc('quarter', MAX(date)) + to_months(CAST(3 * i AS INTEGER)) AS DATE)"),
    "year_start": ("YS", "CAST(date_trunc('year', MAX(date)) + to_months(CAST(12 * i AS INTEGER)) AS DATE)"),
}


def _future_query(name: str, freq: str, expr: str) -> None:
    @query(f"q_future_frame_{name}", f"SELECT {expr} AS date FROM ({F1_SQL}), range(1, 9) t(i) GROUP BY i")
    def run(spark, sf):
        return pr.future_frame(f1(spark, sf), "date", 8, freq=freq, include_history=False)


for _name, (_freq, _expr) in _FUTURE_SQL.items():
    _future_query(_name, _freq, _expr)


@query("q_lag_longer_than_block", f"""
SELECT event_id, {r('lag(value, 100) OVER (ORDER BY ts, event_id)')} AS value_lag_100 FROM ({F6_SQL})""")
def q_lag_longer_than_block(spark, sf):
    out = fe.create_lagged_features(S.events_with_gaps(spark, sf), ["value"], [100], order=["ts", "event_id"], block_rows=37)
    return rounded(out.select("event_id", "value_lag_100"))


@query("q_lags_text_order", f"SELECT event_id, {r('lag(value, 2) OVER (ORDER BY event_type, event_id)')} AS value_lag_2 FROM events")
def q_lags_text_order(spark, sf):
    out = fe.create_lagged_features(S.table(spark, sf, "events"), ["value"], [2], order=["event_type", "event_id"], block_rows=997)
    return rounded(out.select("event_id", "value_lag_2"))


@query("q_row_index_heavy_ties", """
SELECT event_id, CAST(row_number() OVER (ORDER BY date_trunc('month', ts), event_id) - 1 AS BIGINT) AS pos FROM events""")
def q_row_index_heavy_ties(spark, sf):
    ev = S.table(spark, sf, "events").select("event_id", F.to_date(F.date_trunc("month", "ts")).alias("m"))
    return fe.row_index(ev, [], ["m", "event_id"], block_rows=97, name="pos").select("event_id", "pos")


@query("q_boxplot_outliers", f"""
WITH v AS (SELECT event_type, value FROM ({F6_SQL}) WHERE value IS NOT NULL),
q AS (SELECT event_type, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM v GROUP BY 1)
SELECT v.event_type, {r('v.value')} AS value FROM v JOIN q ON v.event_type IS NOT DISTINCT FROM q.event_type
WHERE NOT v.value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)""")
def q_boxplot_outliers(spark, sf):
    return rounded(st.boxplot_outliers(S.events_with_gaps(spark, sf), "value", ["event_type"]))


@query("q_pipeline_forecast")
def q_pipeline_forecast(spark, sf):
    from almanac.plans.pipeline import PipelineConfig, run_pipeline
    cfg = PipelineConfig(target_col="revenue", date_col="date", model_type="prophet", use_pca=False, feature_selection_method="f_regression",
                         top_n_features=3, forecast_periods=6)
    return run_pipeline(spark, f1(spark, sf), cfg).forecast.select("ds", "yhat", "yhat_lower", "yhat_upper", "actual")


@query("q_direct_preset")
def q_direct_preset(spark, sf):
    """The direct job: target carried, preset configuration, forecast over the history and a year."""
    from almanac.operators.forecast import AdditiveForecaster, direct_preset, forecast_with_actuals
    d = f1(spark, sf).select(F.col("date").alias("ds"), F.col("revenue").alias("y"), F.col("n").cast("double").alias("n"))
    conf = direct_preset(["n"])
    conf.carry_target = True
    model = AdditiveForecaster(conf).fit(d.withColumn("y", F.when(F.month("ds") != 5, F.col("y"))))
    return forecast_with_actuals(model.predict(model.make_future(d, 12)), d, [], "ds", "y").select("ds", "yhat", "actual")


# =============================================================== narrow variants with closed forms
def _one_feature_sql(shrunk: str) -> str:
    return f"""
WITH m AS (SELECT covar_pop(target, l_quantity) AS c, var_pop(l_quantity) AS v, stddev_pop(l_quantity) AS s FROM ({F7_SQL}))
SELECT {shrunk} FROM m"""


def _soft(c: str, a: str) -> str:
    return f"(sign({c}) * greatest(abs({c}) - {a}, 0))"


@query("q_lasso_one_feature", _one_feature_sql(f"'l_quantity' AS feature, {r(_soft('c', '50000.0') + ' / v', 3)} AS coefficient"))
def q_lasso_one_feature(spark, sf):
    m = md.train_model(S.lineitem_wide(spark, sf), ["l_quantity"], "target", "lasso", {"alpha": 50000.0})
    return rounded(md.importances(m, ["l_quantity"], spark), 3)


@query("q_elasticnet_one_feature", _one_feature_sql(
    f"'l_quantity' AS feature, {r(_soft('c', '100.0 * 0.5') + ' / (v + 100.0 * 0.5)', 3)} AS coefficient"))
def q_elasticnet_one_feature(spark, sf):
    m = md.train_model(S.lineitem_wide(spark, sf), ["l_quantity"], "target", "elasticnet", {"alpha": 100.0, "l1_ratio": 0.5})
    return rounded(md.importances(m, ["l_quantity"], spark), 3)


@query("q_lasso_select_one_feature", _one_feature_sql(
    f"'l_quantity' AS feature, {r(_soft('c / s', '1000.0'), 3)} AS coefficient, abs(c / s) > 1000.0 AS selected"))
def q_lasso_select_one_feature(spark, sf):
    return rounded(rd.lasso_selection(S.lineitem_wide(spark, sf), "target", ["l_quantity"], 1000.0), 3)


@query("q_pca_two_columns", f"""
WITH c AS (SELECT corr(l_extendedprice, net) AS r FROM ({F7_SQL}))
SELECT CAST(1 AS INTEGER) AS component, {r('(1 + abs(r)) / 2', 6)} AS ratio FROM c
UNION ALL SELECT CAST(2 AS INTEGER), {r('(1 - abs(r)) / 2', 6)} FROM c""")
def q_pca_two_columns(spark, sf):
    """The correlation matrix of two columns has the eigenvalues 1 + |r| and 1 - |r|."""
    pca = rd.fit_pca(S.lineitem_wide(spark, sf), ["l_extendedprice", "net"])
    out = [(i + 1, float(v)) for i, v in enumerate(pca.explained_ratio)]
    return rounded(spark.createDataFrame(out, "component int, ratio double"), 6)


@query("q_pca_two_columns_scores", f"""
WITH m AS (SELECT AVG(l_extendedprice) AS ma, AVG(net) AS mb, stddev_pop(l_extendedprice) AS sa, stddev_pop(net) AS sb
           FROM ({F7_SQL}))
SELECT l_orderkey, l_linenumber, {r('((l_extendedprice - ma) / sa + (net - mb) / sb) / sqrt(2)', 6)} AS "PC1"
FROM ({F7_SQL}), m""")
def q_pca_two_columns_scores(spark, sf):
    """Price and net price correlate positively, so the first component is their scaled sum."""
    df = S.lineitem_wide(spark, sf)
    pca = rd.fit_pca(df, ["l_extendedprice", "net"])
    return rounded(pca.scores(df, 1).select("l_orderkey", "l_linenumber", "PC1"), 6)


_STUMP_ORDER = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
_STUMP_SQL = f"""
WITH s AS (SELECT target AS y, CASE WHEN l_quantity > 25 THEN 1.0 ELSE 0.0 END AS f0, COUNT(*) OVER () AS n,
             row_number() OVER (ORDER BY {', '.join(_STUMP_ORDER)}) - 1 AS idx FROM ({F7_SQL})),
w AS (SELECT f0, AVG(y) AS prediction FROM s WHERE idx < n - floor(n * 0.2::DOUBLE) GROUP BY f0),
q AS (SELECT s.y, w.prediction, AVG(s.y) OVER () AS ybar FROM s JOIN w USING (f0) WHERE s.idx >= s.n - floor(s.n * 0.2::DOUBLE))
SELECT CAST(COUNT(*) AS BIGINT) AS n, {_MET_SQL} FROM q
"""


def _stump(spark, sf, model_type, params):
    """One split on a two-valued feature: the prediction is the mean target of the side."""
    df = S.lineitem_wide(spark, sf).withColumn("big", F.when(F.col("l_quantity") > 25, 1.0).otherwise(0.0))
    lab = sp.split_labels(df, [], _STUMP_ORDER, "train_test", 0.2)
    m = md.train_model(lab.where("part = 'train'"), ["big"], "target", model_type, params)
    _, met = md.evaluate_model(m, lab.where("part = 'test'"), ["big"], "target")
    return rounded(met.drop("mse"), _MET_DIG)


@query("q_gbt_stump", _STUMP_SQL)
def q_gbt_stump(spark, sf):
    return _stump(spark, sf, "gbm", {"n_estimators": 1, "learning_rate": 1.0, "max_depth": 1})


@query("q_forest_stump", _STUMP_SQL)
def q_forest_stump(spark, sf):
    """Without bootstrap every tree sees every row."""
    return _stump(spark, sf, "randomforest", {"n_estimators": 3, "max_depth": 1, "bootstrap": False})


def _forecast_small_sql(keys: list[str], src: str, changepoints: int, ahead: int = 0) -> str:
    """The additive model with a quarterly wave, one regressor and few changepoints: 1 + changepoints + 2 + 1 columns; with
    ``ahead`` the months after the data instead of the data."""
    k = "".join(f"{c}, " for c in keys)
    part = f"PARTITION BY {', '.join(keys)} " if keys else ""
    grp = f" GROUP BY {', '.join(keys)}" if keys else ""
    join = f"JOIN {{}} USING ({', '.join(keys)})" if keys else "CROSS JOIN {}"
    cps = "".join(f", MAX(CASE WHEN idx = CAST(round({j}::DOUBLE * (floor(n * 0.8::DOUBLE) - 1) / {changepoints}) AS BIGINT) "
                  f"THEN day END) AS c{j}" for j in range(1, changepoints + 1))
    t = "((day - t0) / span)"
    ang = f"{2 * math.pi / 91.25!r}::DOUBLE * day"
    cols = [t, *[f"greatest({t} - (c{j} - t0) / span, 0)" for j in range(1, changepoints + 1)], f"sin({ang})", f"cos({ang})",
            "(reg - rm) / rs"]
    pen = [0.0, *[0.05 ** 2 / 0.05 ** 2] * changepoints, 0.05 ** 2 / 10.0 ** 2, 0.05 ** 2 / 10.0 ** 2, 0.05 ** 2 / 10.0 ** 2]
    p = len(cols)
    feats = ', '.join(f'{c} AS f{i}' for i, c in enumerate(cols))
    on = " AND ".join(f"r.{c} = c.{c}" for c in keys) or "TRUE"
    rows = "x" if not ahead else f"""(SELECT *, {feats} FROM (
  SELECT {k}a.date, CAST(a.date - DATE '1970-01-01' AS DOUBLE) AS day, rm AS reg, t0, span, ys, rm, rs{''.join(f', c{j}' for j in range(1, changepoints + 1))}
  FROM (SELECT {k}CAST(MAX(date) + to_months(i::INT) AS DATE) AS date FROM s, range(1, {ahead + 1}) r(i) GROUP BY {k}i) a {join.format('g')}))"""
    offs = [f"(r.f{i} - c.m{i})" for i in range(p)]
    of_fit = " + ".join(f"{offs[i]} * {offs[j]} * c.v{i}_{j}" for i in range(p) for j in range(p))
    size = " + ".join(f"abs(c.w{j})" for j in range(1, changepoints + 1)) or "0"
    drift = f"2.0 * {changepoints} * pow(({size}) / {max(changepoints, 1)}, 2) * pow(greatest(r.f0 - 1, 0), 3) / 3"
    return f"""
WITH s AS (SELECT {k}date, revenue, CAST(n AS DOUBLE) AS reg, CAST(date - DATE '1970-01-01' AS DOUBLE) AS day,
           row_number() OVER ({part}ORDER BY date) - 1 AS idx, COUNT(*) OVER ({part.strip()}) AS n FROM ({src})),
g AS (SELECT {k}MIN(day) AS t0, MAX(day) - MIN(day) AS span, MAX(abs(revenue)) AS ys, AVG(reg) AS rm, stddev_pop(reg) AS rs{cps}
      FROM s{grp}),
x AS MATERIALIZED (SELECT {k}date, revenue, ys, revenue / ys AS y, {feats}
      FROM s {join.format('g')}),
{osql.linear_fit('x', p, pen, keys, inverse=True)},
e AS (SELECT {k.replace(keys[0], 'r.' + keys[0]) if keys else ''}stddev_pop(r.y - ({osql.predicted(p)})) AS sd, COUNT(*) AS rows FROM x r JOIN lf c ON {on}{grp.replace(keys[0], 'r.' + keys[0]) if keys else ''}),
f AS (SELECT r.*, {osql.predicted(p)} AS yh, {of_fit} AS q, {drift} AS drift FROM {rows} r JOIN lf c ON {on}),
b AS (SELECT f.*, {fc.statistics.NormalDist().inv_cdf(0.9)!r}::DOUBLE * sqrt(sd * sd * (1 + 1.0 / e.rows + q) + drift) AS half FROM f {join.format('e')})
SELECT {k}date, {r('yh * ys', 2)} AS yhat, {r('(yh - half) * ys', 2)} AS yhat_lower, {r('(yh + half) * ys', 2)} AS yhat_upper FROM b
"""


def _forecast_small(spark, sf, keys, changepoints, ahead=0):
    cfg = fc.ForecastConfig(yearly_seasonality=False, n_changepoints=changepoints, regressors=["n"],
                            seasonalities=[{"name": "quarterly", "period": 91.25, "fourier_order": 1}])
    src = f2(spark, sf) if keys else f1(spark, sf)
    m = fc.AdditiveForecaster(cfg, keys=keys, ds="date", y="revenue").fit(src)
    at = m.make_future(src, ahead, include_history=False) if ahead else src
    return rounded(m.predict(at).select(*keys, "date", "yhat", "yhat_lower", "yhat_upper"), 2)


@query("q_forecast_interval", _forecast_small_sql([], F1_SQL, 2, 24))
def q_forecast_interval(spark, sf):
    """Two years ahead: the interval widens month by month."""
    return _forecast_small(spark, sf, [], 2, 24)


@query("q_forecast_interval_panel", _forecast_small_sql(["o_orderpriority"], F2_SQL, 2, 12))
def q_forecast_interval_panel(spark, sf):
    return _forecast_small(spark, sf, ["o_orderpriority"], 2, 12)


@query("q_forecast_small", _forecast_small_sql([], F1_SQL, 2))
def q_forecast_small(spark, sf):
    return _forecast_small(spark, sf, [], 2)


@query("q_forecast_no_changepoints", _forecast_small_sql([], F1_SQL, 0))
def q_forecast_no_changepoints(spark, sf):
    return _forecast_small(spark, sf, [], 0)


@query("q_forecast_small_panel", _forecast_small_sql(["o_orderpriority"], F2_SQL, 3))
def q_forecast_small_panel(spark, sf):
    return _forecast_small(spark, sf, ["o_orderpriority"], 3)


# =============================================================== training per series, filling from training rows
_PANEL_TRAIN_SQL = f"""
WITH s AS (SELECT o_orderpriority, date, CAST(n AS DOUBLE) AS f0, avg_price AS f1, revenue AS y,
           row_number() OVER (PARTITION BY o_orderpriority ORDER BY date) - 1 AS idx, COUNT(*) OVER (PARTITION BY o_orderpriority) AS n
           FROM ({F2_SQL})),
x AS (SELECT * FROM s WHERE idx < n - floor(n * 0.2::DOUBLE)),
{osql.linear_fit('x', 2, [2.0, 2.0], ['o_orderpriority'])},
p AS (SELECT r.o_orderpriority, r.y, {osql.predicted(2)} AS prediction FROM s r JOIN lf c ON r.o_orderpriority = c.o_orderpriority
      WHERE r.idx >= r.n - floor(r.n * 0.2::DOUBLE)),
q AS (SELECT *, AVG(y) OVER (PARTITION BY o_orderpriority) AS ybar FROM p)
"""


@query("q_train_and_evaluate_panel", _PANEL_TRAIN_SQL + f"""
SELECT o_orderpriority, CAST(COUNT(*) AS BIGINT) AS n, {_MET_SQL} FROM q GROUP BY o_orderpriority""")
def q_train_and_evaluate_panel(spark, sf):
    res = md.train_and_evaluate(f2(spark, sf), "revenue", ["n", "avg_price"], "date", "ridge", {"alpha": 2.0}, use_cv=False,
                                keys=["o_orderpriority"])
    return rounded(res.metrics.drop("mse"), _MET_DIG)


@query("q_train_panel_importances", _PANEL_TRAIN_SQL + f"""
SELECT o_orderpriority, 'n' AS feature, {r('w0', 4)} AS coefficient FROM lf
UNION ALL SELECT o_orderpriority, 'avg_price' AS feature, {r('w1', 4)} AS coefficient FROM lf""")
def q_train_panel_importances(spark, sf):
    res = md.train_and_evaluate(f2(spark, sf), "revenue", ["n", "avg_price"], "date", "ridge", {"alpha": 2.0}, use_cv=False,
                                keys=["o_orderpriority"])
    return rounded(res.importances, 4)


@query("q_train_scope_panel", f"""
WITH s AS (SELECT o_orderpriority, date, CASE WHEN month(date) <> 4 THEN CAST(n AS DOUBLE) END AS g, revenue AS y,
           row_number() OVER (PARTITION BY o_orderpriority ORDER BY date) - 1 AS idx, COUNT(*) OVER (PARTITION BY o_orderpriority) AS n
           FROM ({F2_SQL})),
m AS (SELECT o_orderpriority, AVG(g) AS mg FROM s WHERE idx < n - floor(n * 0.2::DOUBLE) GROUP BY 1),
d AS (SELECT s.*, COALESCE(g, mg) AS f0 FROM s JOIN m USING (o_orderpriority)),
x AS (SELECT * FROM d WHERE idx < n - floor(n * 0.2::DOUBLE)),
{osql.linear_fit('x', 1, None, ['o_orderpriority'])}
SELECT r.o_orderpriority, r.date, CAST(r.idx AS BIGINT) AS idx, CASE WHEN r.idx < r.n - floor(r.n * 0.2::DOUBLE) THEN 'train' ELSE 'test' END
       AS part, {r('r.y', 2)} AS actual, {r(osql.predicted(1), 3)} AS predicted
FROM d r JOIN lf c ON r.o_orderpriority = c.o_orderpriority""")
def q_train_scope_panel(spark, sf):
    d = f2(spark, sf).withColumn("n", F.when(F.month("date") != 4, F.col("n").cast("double")))
    res = md.train_and_evaluate(d, "revenue", ["n"], "date", "linear", use_cv=False, keys=["o_orderpriority"], fit_scope="train")
    return rounded(res.predictions, {"actual": 2, "predicted": 3})


# =============================================================== order engine: working names and text order
#: Column names that a plan might take for its own, with what they hold.
_OWN = {"_x": "l_partkey", "_c": "l_suppkey", "_off": "l_tax", "_bk": "l_linestatus", "__block": "l_discount", "__part": "l_returnflag"}
_OWN_SQL = ", ".join(f"{e} AS {n}" for n, e in _OWN.items())
_LINE_ORDER = ["ship", "l_orderkey", "l_linenumber", "_x", "_c"]
_LINES_SQL = f"""SELECT l_orderkey, l_linenumber, {_OWN_SQL}, CAST(l_shipdate AS DATE) AS ship,
  CASE WHEN l_quantity % 3 <> 0 THEN l_quantity END AS qty FROM lineitem"""


def _lines(spark, sf):
    own = [F.col(e).alias(n) for n, e in _OWN.items()]
    return S.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", *own, F.to_date("l_shipdate").alias("ship"),
                                                 F.when(F.col("l_quantity") % 3 != 0, F.col("l_quantity")).alias("qty"))


@query("q_split_clash_names", f"""
WITH i AS (SELECT *, row_number() OVER (ORDER BY {', '.join(_LINE_ORDER)}) - 1 AS idx, count(*) OVER () AS n FROM ({_LINES_SQL}))
SELECT * EXCLUDE (n), CASE WHEN idx < floor(n * (1.0::DOUBLE - 0.2::DOUBLE - 0.1::DOUBLE)) THEN 'train'
                           WHEN idx < floor(n * (1.0::DOUBLE - 0.2::DOUBLE)) THEN 'validation' ELSE 'test' END AS part FROM i""")
def q_split_clash_names(spark, sf):
    return sp.split_labels(_lines(spark, sf), order=_LINE_ORDER)


@query("q_ffill_clash_names", f"""
SELECT * EXCLUDE (qty), COALESCE(qty, last_value(qty IGNORE NULLS) OVER (ORDER BY {', '.join(_LINE_ORDER)} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
         first_value(qty IGNORE NULLS) OVER (ORDER BY {', '.join(_LINE_ORDER)} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS qty
FROM ({_LINES_SQL})""")
def q_ffill_clash_names(spark, sf):
    return pr.handle_missing_values(_lines(spark, sf), "forward", date_col="ship", order=_LINE_ORDER, columns=["qty"])


# a key that is also hot: every row of one ship mode group, cut into ranges with the others
@query("q_ffill_clash_names_panel", f"""
SELECT * EXCLUDE (qty), COALESCE(qty, last_value(qty IGNORE NULLS) OVER (PARTITION BY _bk ORDER BY {', '.join(_LINE_ORDER)} ROWS BETWEEN UNBOUNDED PRECEDING
  AND CURRENT ROW), first_value(qty IGNORE NULLS) OVER (PARTITION BY _bk ORDER BY {', '.join(_LINE_ORDER)} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS qty
FROM ({_LINES_SQL})""")
def q_ffill_clash_names_panel(spark, sf):
    return pr.handle_missing_values(_lines(spark, sf), "forward", date_col="ship", keys=["_bk"], order=_LINE_ORDER, columns=["qty"], block_rows=5_000)


_ISO_SQL = f"SELECT *, strftime(ship, '%Y-%m-%d') || 'T' || lpad(l_orderkey::VARCHAR, 9, '0') AS iso FROM ({_LINES_SQL})"
_ISO_ORDER = ["iso", "l_linenumber", "_x", "_c"]


@query("q_lags_iso_text_order", f"""
SELECT iso, l_linenumber, _x, _c, _off, _bk, lag(qty, 1) OVER w AS qty_lag_1, lag(qty, 7) OVER w AS qty_lag_7, lead(qty, 2) OVER w AS "qty_lag_-2"
FROM ({_ISO_SQL}) WINDOW w AS (ORDER BY {', '.join(_ISO_ORDER)})""")
def q_lags_iso_text_order(spark, sf):
    iso = F.concat(F.date_format("ship", "yyyy-MM-dd"), F.lit("T"), F.lpad(F.col("l_orderkey").cast("string"), 9, "0"))
    out = fe.create_lagged_features(_lines(spark, sf).withColumn("iso", iso), ["qty"], [1, 7, -2], order=_ISO_ORDER)
    return out.select("iso", "l_linenumber", "_x", "_c", "_off", "_bk", "qty_lag_1", "qty_lag_7", "qty_lag_-2")


@query("q_row_index_decimal_order", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, row_number() OVER (PARTITION BY l_returnflag ORDER BY amount NULLS FIRST, l_orderkey, l_linenumber, l_partkey, l_suppkey) - 1 AS idx
FROM (SELECT *, CASE WHEN l_quantity % 3 <> 0 THEN CAST(l_quantity AS DECIMAL(30, 10)) END AS amount FROM lineitem)""")
def q_row_index_decimal_order(spark, sf):
    d = S.table(spark, sf, "lineitem").withColumn("amount", F.when(F.col("l_quantity") % 3 != 0, F.col("l_quantity").cast("decimal(30,10)")))
    out = fe.row_index(d, ["l_returnflag"], ["amount", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], block_rows=3_000)
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "idx")


# =============================================================== rows that had no oracle: shortcuts, identity, listing, splits
@query("q_shortcuts", f"""
WITH s AS (SELECT date, revenue AS x, row_number() OVER (ORDER BY date) AS i FROM ({F1_SQL})),
m AS (SELECT MIN(x) AS mn, MAX(x) AS mx, AVG(x) AS mu, stddev_pop(x) AS sd FROM s)
SELECT date, {r(f'ln(x + {_LOG_OFF})', 6)} AS logged, {r('x - lag(x, 2) OVER (ORDER BY date)', 2)} AS step,
       {r('x - lag(x, 12) OVER (ORDER BY date)', 2)} AS season, {r(f'(x - mn) / {_RNG}', 6)} AS unit, {r(f'(x - mu) / {_SD}', 6)} AS score
FROM s, m""")
def q_shortcuts(spark, sf):
    """The five shortcuts (TRF4), each on the same series."""
    from almanac.operators import transforms as tr
    base = f1(spark, sf).select("date", F.col("revenue").alias("x"))
    made = {"logged": tr.log_scale_transform(base, ["x"]), "step": tr.difference_transform(base, ["x"], 2, order=["date"]),
            "season": tr.seasonal_difference_transform(base, ["x"], order=["date"]), "unit": tr.normalize_columns(base, ["x"]),
            "score": tr.standardize_columns(base, ["x"])}
    out = base.select("date")
    for name, (df, _) in made.items():
        out = out.join(df.withColumnRenamed("x", name), "date")
    return rounded(out, {"logged": 6, "step": 2, "season": 2, "unit": 6, "score": 6})


@query("q_align_identity", f"SELECT date, {r('revenue', 2)} AS revenue, 2::BIGINT AS times FROM ({F1_SQL})")
def q_align_identity(spark, sf):
    """Monthly data, and a frequency that cannot be aligned, stay as they are (FRQ4)."""
    src = f1(spark, sf).select("date", "revenue")
    both = pr.align_to_monthly(src, "monthly").unionByName(pr.align_to_monthly(src, "weekly"))
    return rounded(both.groupBy("date", "revenue").agg(F.count(F.lit(1)).alias("times")), 2)


@query("q_list_datasets", "SELECT unnest(['nation.csv', 'region.csv']) AS name, (SELECT COUNT(*) FROM nation) + (SELECT COUNT(*) FROM region) AS rows")
def q_list_datasets(spark, sf):
    """Files of a folder by pattern, their rows read in one scan (SRC3)."""
    from almanac.session import scratch_path
    root = scratch_path(spark, f"exports-{uuid.uuid4().hex}")
    for t in ("nation", "region"):
        S.table(spark, sf, t).select(F.lit(t).alias("t")).coalesce(1).write.mode("overwrite").option("header", True).csv(f"{root}/{t}.csv")
    found = io.read_datasets(spark, root)
    names = [n for n in ("nation.csv", "region.csv") if io.list_available_datasets(spark, f"{root}/{n}", "*.csv")]
    names += io.list_available_datasets(spark, f"{root}/none", "*.csv")
    return spark.createDataFrame([(n, found.count()) for n in names], "name string, rows long")


@query("q_split_data", f"""
WITH i AS (SELECT row_number() OVER (ORDER BY date) - 1 AS idx, count(*) OVER () AS n FROM ({F1_SQL}))
SELECT CASE WHEN idx < floor(n * (1.0::DOUBLE - 0.2::DOUBLE - 0.1::DOUBLE)) THEN 'train'
            WHEN idx < floor(n * (1.0::DOUBLE - 0.2::DOUBLE)) THEN 'validation' ELSE 'test' END AS part, COUNT(*) AS rows FROM i GROUP BY 1""")
def q_split_data(spark, sf):
    parts = zip(("train", "validation", "test"), sp.split_data(f1(spark, sf), order=["date"]))
    tables = [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(p).alias("part"), "rows") for p, df in parts]
    return tables[0].unionByName(tables[1]).unionByName(tables[2])


@query("q_run_summary", f"SELECT 'f1' AS data, 'revenue' AS target, COUNT(*) AS n, {r('AVG(revenue)', 2)} AS mean, 2::BIGINT AS features FROM ({F1_SQL})")
def q_run_summary(spark, sf):
    """A summary row with fixed columns, its list counted (SNK4)."""
    st_ = f1(spark, sf).agg(F.count(F.lit(1)).alias("n"), F.avg("revenue").alias("mean")).first()
    out = io.run_summary(spark, {"data": "f1", "target": "revenue", "n": st_["n"], "mean": st_["mean"], "features": ["n", "avg_price"]})
    return rounded(out.withColumn("features", F.size("features").cast("long")), 2)


# =============================================================== principal components and reduction per series
@query("q_pca_panel_two_columns", f"""
WITH c AS (SELECT o_orderpriority, corr(revenue, n) AS r FROM ({F2_SQL}) GROUP BY 1)
SELECT o_orderpriority, 1 AS component, {r('(1 + abs(r)) / 2', 6)} AS ratio, {r('(1 + abs(r)) / 2', 6)} AS cumulative,
       {r('1 / sqrt(2)', 6)} AS first, {r('sign(r) / sqrt(2)', 6)} AS second FROM c
UNION ALL SELECT o_orderpriority, 2, {r('(1 - abs(r)) / 2', 6)}, 1.0, {r('1 / sqrt(2)', 6)}, {r('-sign(r) / sqrt(2)', 6)} FROM c""")
def q_pca_panel_two_columns(spark, sf):
    """Per series: the eigenvalues 1 + |r| and 1 - |r|, loadings of 1 / sqrt(2) (DIM2-DIM4, DIM9). Loadings tie in size up to
    the last digit, so their sign is taken from the first here."""
    from almanac.operators import gram
    out = gram.components(gram.moments(f2(spark, sf), ["o_orderpriority"], [F.col("revenue"), F.col("n")]))
    sign = F.signum(F.col("loadings")[0])
    return rounded(out.select("o_orderpriority", "component", F.col("explained_variance_ratio").alias("ratio"), "cumulative",
                              (sign * F.col("loadings")[0]).alias("first"), (sign * F.col("loadings")[1]).alias("second")), 6)


@query("q_pca_tables_two_columns", f"""
WITH c AS (SELECT corr(l_extendedprice, net) AS r FROM ({F7_SQL})),
v AS (SELECT 'PC1' AS component, (1 + abs(r)) / 2 AS ratio, (1 + abs(r)) / 2 AS upto FROM c
      UNION ALL SELECT 'PC2', (1 - abs(r)) / 2, 1.0 FROM c)
SELECT component, {r('ratio', 6)} AS ratio, {r('upto', 6)} AS upto, 2::BIGINT AS loadings, {r('sqrt(2)', 6)} AS size, 1::BIGINT AS enough FROM v""")
def q_pca_tables_two_columns(spark, sf):
    """Variance table, loading table and the number of components for half the variance (DIM3, DIM4, DIM9, ORD3)."""
    pca = rd.fit_pca(S.lineitem_wide(spark, sf), ["l_extendedprice", "net"])
    loads = rd.loading_table(spark, pca).groupBy("component").agg(F.count(F.lit(1)).alias("loadings"), F.sum(F.abs("loading")).alias("size"))
    var = rd.variance_table(spark, pca).select("component", F.col("explained_variance_ratio").alias("ratio"), F.col("cumulative").alias("upto"))
    enough = rd.components_for_threshold(pca.explained_ratio, 0.5)
    return rounded(var.join(loads, "component").withColumn("enough", F.lit(enough).cast("long")), 6)


_PANEL3_SQL = f"SELECT *, n * n AS n2 FROM (SELECT o_orderpriority, date, revenue, CAST(n AS DOUBLE) AS n, avg_price FROM ({F2_SQL}))"


def _panel3(spark, sf):
    return f2(spark, sf).select("o_orderpriority", "date", "revenue", F.col("n").cast("double").alias("n"), "avg_price").withColumn("n2", F.col("n") * F.col("n"))


@query("q_corr_filter_panel", f"""
WITH c AS (SELECT o_orderpriority, corr(n, avg_price) AS ab, corr(n, n2) AS ac, corr(avg_price, n2) AS bc FROM ({_PANEL3_SQL}) GROUP BY 1),
u AS (SELECT o_orderpriority, 'n' AS feature, 0 AS position, NULL::DOUBLE AS m FROM c
      UNION ALL SELECT o_orderpriority, 'avg_price', 1, abs(ab) FROM c UNION ALL SELECT o_orderpriority, 'n2', 2, greatest(abs(ac), abs(bc)) FROM c)
SELECT o_orderpriority, feature, position, {r('m', 6)} AS max_abs_corr, coalesce(m <= 0.95, true) AS kept FROM u""")
def q_corr_filter_panel(spark, sf):
    return rounded(rd.correlation_filter(_panel3(spark, sf), ["n", "avg_price", "n2"], keys=["o_orderpriority"]), 6)


@query("q_reduce_panel", f"""
WITH s AS ({_PANEL3_SQL}),
c AS (SELECT o_orderpriority, abs(corr(n, avg_price)) AS ab, abs(corr(n, n2)) AS ac, abs(corr(avg_price, n2)) AS bc FROM s GROUP BY 1)
SELECT o_orderpriority, date, {r('revenue', 2)} AS revenue, {r('n')} AS n, {r('CASE WHEN ab <= 0.95 THEN avg_price ELSE 0 END')} AS avg_price
FROM s JOIN c USING (o_orderpriority)""")
def q_reduce_panel(spark, sf):
    """Per series: the square of a column goes, as it follows the column; the others stay (DIM8 with keys)."""
    out, meta = rd.reduce_dimensions(_panel3(spark, sf), "revenue", ["n", "avg_price", "n2"], use_pca=False, feature_selection_method="f_regression",
                                     top_n_features=1, keys=["o_orderpriority"])
    return rounded(out.select("o_orderpriority", "date", "revenue", "n", "avg_price"), {"revenue": 2})


@query("q_reduce_panel_selection", f"""
WITH c AS (SELECT o_orderpriority, corr(n, revenue) AS a, corr(avg_price, revenue) AS b, abs(corr(n, avg_price)) AS ab FROM ({_PANEL3_SQL}) GROUP BY 1)
SELECT o_orderpriority, CASE WHEN a * a >= b * b OR ab > 0.95 THEN 'n' ELSE 'avg_price' END AS feature, 1 AS rank FROM c""")
def q_reduce_panel_selection(spark, sf):
    _, meta = rd.reduce_dimensions(_panel3(spark, sf), "revenue", ["n", "avg_price", "n2"], use_pca=False, feature_selection_method="f_regression",
                                   top_n_features=1, keys=["o_orderpriority"])
    return meta["selection"].select("o_orderpriority", "feature", "rank")


@query("q_reduce_panel_pca", f"""
WITH s AS (SELECT o_orderpriority, date, revenue, CAST(n AS DOUBLE) AS n, avg_price FROM ({F2_SQL})),
m AS (SELECT o_orderpriority, AVG(n) AS ma, AVG(avg_price) AS mb, stddev_pop(n) AS sa, stddev_pop(avg_price) AS sb, corr(n, avg_price) AS r FROM s GROUP BY 1)
SELECT o_orderpriority, date, {r('abs((n - ma) / sa + sign(r) * (avg_price - mb) / sb) / sqrt(2)', 6)} AS size FROM s JOIN m USING (o_orderpriority)""")
def q_reduce_panel_pca(spark, sf):
    """The first component of two columns per series; its sign is open where loadings tie, so sizes are compared."""
    out, _ = rd.reduce_dimensions(f2(spark, sf), "revenue", ["n", "avg_price"], pca_variance_threshold=0.5, keys=["o_orderpriority"])
    return rounded(out.select("o_orderpriority", "date", F.abs("PC1").alias("size")), 6)


@query("q_mutual_info_panel", f"""
WITH s AS (SELECT o_orderpriority AS k, CAST(n AS DOUBLE) AS x, revenue AS y FROM ({F2_SQL})),
b AS (SELECT k, floor((rank() OVER (PARTITION BY k ORDER BY x) - 1) * 4 / COUNT(*) OVER (PARTITION BY k)) AS xb,
             floor((rank() OVER (PARTITION BY k ORDER BY y) - 1) * 4 / COUNT(*) OVER (PARTITION BY k)) AS yb FROM s),
j AS (SELECT k, xb, yb, COUNT(*)::DOUBLE AS nxy FROM b GROUP BY ALL),
t AS (SELECT *, SUM(nxy) OVER (PARTITION BY k, xb) AS nx, SUM(nxy) OVER (PARTITION BY k, yb) AS ny, SUM(nxy) OVER (PARTITION BY k) AS nt FROM j)
SELECT k AS o_orderpriority, 'n' AS feature, 0 AS position, {r('SUM(nxy / nt * ln(nxy * nt / (nx * ny)))', 6)} AS mi, 1 AS rank FROM t GROUP BY k""")
def q_mutual_info_panel(spark, sf):
    return rounded(rd.mutual_info_scores(f2(spark, sf), "revenue", ["n"], bins=4, keys=["o_orderpriority"]), 6)


@query("q_lasso_panel_one_feature", f"""
WITH s AS (SELECT o_orderpriority, CAST(n AS DOUBLE) AS x, revenue AS y FROM ({F2_SQL})),
c AS (SELECT o_orderpriority, covar_pop(x, y) AS c, var_pop(x) AS v, AVG(x) AS mx, AVG(y) AS my FROM s GROUP BY 1),
w AS (SELECT *, sign(c) * greatest(abs(c) - 1000.0, 0) / v AS w FROM c)
SELECT o_orderpriority, {r('w', 4)} AS n, {r('my - w * mx', 2)} AS intercept FROM w""")
def q_lasso_panel_one_feature(spark, sf):
    out = md.fit_linear_per_series(f2(spark, sf), ["o_orderpriority"], ["n"], "revenue", 1000.0, "lasso")
    return rounded(out, {"n": 4, "intercept": 2})


@query("q_elasticnet_panel_two_features", f"""
WITH s AS (SELECT o_orderpriority, CAST(n AS DOUBLE) AS x1, CAST(month(date) AS DOUBLE) AS x2, revenue AS y FROM ({F2_SQL})),
c AS (SELECT o_orderpriority, var_pop(x1) + 0.5 AS a, covar_pop(x1, x2) AS b, var_pop(x2) + 0.5 AS d, covar_pop(x1, y) AS e, covar_pop(x2, y) AS f
      FROM s GROUP BY 1),
g AS (SELECT *, s1.s AS s1, s2.s AS s2 FROM c, (VALUES (-1.0), (0.0), (1.0)) s1(s), (VALUES (-1.0), (0.0), (1.0)) s2(s)),
-- for each pair of signs the minimum with these signs; the one whose signs come out is the solution
w AS (SELECT *, CASE WHEN s1 = 0 THEN 0 WHEN s2 = 0 THEN (e - 0.5 * s1) / a ELSE ((e - 0.5 * s1) * d - (f - 0.5 * s2) * b) / (a * d - b * b) END AS w1,
                CASE WHEN s2 = 0 THEN 0 WHEN s1 = 0 THEN (f - 0.5 * s2) / d ELSE ((f - 0.5 * s2) * a - (e - 0.5 * s1) * b) / (a * d - b * b) END AS w2 FROM g),
v AS (SELECT *, a * w1 * w1 / 2 + d * w2 * w2 / 2 + b * w1 * w2 - e * w1 - f * w2 + 0.5 * (abs(w1) + abs(w2)) AS loss FROM w WHERE sign(w1) = s1 AND sign(w2) = s2)
SELECT o_orderpriority, {r('arg_min(w1, loss)', 4)} AS n, {r('arg_min(w2, loss)', 4)} AS m FROM v GROUP BY 1""")
def q_elasticnet_panel_two_features(spark, sf):
    d = f2(spark, sf).withColumn("m", F.month("date").cast("double"))
    out = md.fit_linear_per_series(d, ["o_orderpriority"], ["n", "m"], "revenue", 1.0, "elasticnet", 0.5)
    return rounded(out.select("o_orderpriority", "n", "m"), 4)


# =============================================================== forecast tables, future frames, the direct job
@query("q_future_hourly_regressor", """
WITH h AS (SELECT date_trunc('hour', ts) AS ds, COUNT(*)::DOUBLE AS r FROM events GROUP BY 1),
f AS (SELECT ds FROM h UNION ALL SELECT (SELECT MAX(ds) FROM h) + to_hours(i::INT) FROM range(1, 6) t(i))
SELECT f.ds, floor(coalesce(h.r, (SELECT AVG(r) FROM h)) * 10000 + 0.5001::DOUBLE) / 10000 AS r FROM f LEFT JOIN h USING (ds)""")
def q_future_hourly_regressor(spark, sf):
    """Hours of the data and five more, each with the regressor of its hour."""
    d = (S.table(spark, sf, "events").groupBy(F.date_trunc("hour", "ts").alias("ds")).agg(F.count(F.lit(1)).cast("double").alias("r"))
         .withColumn("y", F.col("r")))
    cfg = fc.ForecastConfig(yearly_seasonality=False, n_changepoints=0, regressors=["r"])
    return rounded(fc.AdditiveForecaster(cfg).make_future(d, 5, "h"))


@query("q_reduce_repeated_dates", f"SELECT l_shipdate, {r('target', 2)} AS target, {r('l_quantity')} AS l_quantity, COUNT(*) AS times FROM ({F7_SQL}) GROUP BY ALL")
def q_reduce_repeated_dates(spark, sf):
    """A dropped feature comes back by the fallback; dates and targets repeat, rows don't multiply."""
    df = S.lineitem_wide(spark, sf).select("l_shipdate", "target", "l_quantity", F.col("l_quantity").alias("copy"))
    out, meta = rd.reduce_dimensions(df, "target", ["l_quantity", "copy"], "l_shipdate", use_pca=False, feature_selection_method="none")
    assert meta["selected_features"] == ["l_quantity", "copy"]
    out = out.where(F.col("copy") == F.col("l_quantity"))
    return rounded(out.select("l_shipdate", "target", "l_quantity"), {"target": 2}).groupBy("l_shipdate", "target", "l_quantity").agg(
        F.count(F.lit(1)).alias("times"))


def _direct_small_sql(metrics: bool) -> str:
    base = _forecast_small_sql([], "SELECT * FROM train", 2)
    body = base[base.index("WITH s AS") + 5:base.index("\ne AS (SELECT")].rstrip().rstrip(",")
    feats = base[base.index("revenue / ys AS y, ") + len("revenue / ys AS y, "):base.index("\n      FROM s CROSS JOIN g")]
    own = f"""
WITH d AS (SELECT date, COALESCE(CASE WHEN month(date) <> 5 THEN revenue END, AVG(CASE WHEN month(date) <> 5 THEN revenue END) OVER ()) AS revenue, n,
           row_number() OVER (ORDER BY date) - 1 AS place, COUNT(*) OVER () AS size FROM ({F1_SQL})),
train AS (SELECT date, revenue, n FROM d WHERE place < floor(size * (1.0::DOUBLE - 0.2::DOUBLE))),
{body},
q AS (SELECT date, revenue AS y, place, size, {feats}, ys FROM (SELECT *, CAST(date - DATE '1970-01-01' AS DOUBLE) AS day, CAST(n AS DOUBLE) AS reg FROM d) CROSS JOIN g),
p AS (SELECT r.date, r.y, ({osql.predicted(6)}) * r.ys AS prediction, r.place >= floor(r.size * (1.0::DOUBLE - 0.2::DOUBLE)) AS late FROM q r CROSS JOIN lf c)"""
    if metrics:
        return own + f""",
t AS (SELECT *, AVG(y) OVER () AS ybar FROM p WHERE late)
SELECT CAST(COUNT(*) AS BIGINT) AS n, {_MET_SQL} FROM t"""
    return own + f"""
SELECT date AS ds, {r('prediction', 1)} AS yhat, {r('y', 2)} AS actual, CASE WHEN late THEN 'test' ELSE 'train' END AS part FROM p"""


def _direct_small(spark, sf):
    from almanac.plans.pipeline import run_direct
    cfg = fc.ForecastConfig(yearly_seasonality=False, n_changepoints=2, regressors=["n"],
                            seasonalities=[{"name": "quarterly", "period": 91.25, "fourier_order": 1}])
    src = f1(spark, sf).withColumn("revenue", F.when(F.month("date") != 5, F.col("revenue")))
    return run_direct(src, "revenue", "date", ["n", "missing"], config=cfg)


@query("q_direct_job", _direct_small_sql(True))
def q_direct_job(spark, sf):
    """The direct job: mean-filled target, fit on four fifths, metrics of the rest (FC6, SNK5), with a narrow model."""
    return rounded(_direct_small(spark, sf).metrics.drop("mse"), _MET_DIG)


@query("q_direct_job_forecast", _direct_small_sql(False))
def q_direct_job_forecast(spark, sf):
    """Its forecast table with the part of every date (FC5, FC7)."""
    return rounded(_direct_small(spark, sf).forecast.select("ds", "yhat", "actual", "part"), {"yhat": 1, "actual": 2})


@query("q_load_and_prepare", f"""
WITH s AS (SELECT date, CASE WHEN month(date) = 5 THEN NULL ELSE revenue END AS revenue, n, year(date) AS y, month(date) AS m FROM ({F1_SQL})),
t AS (SELECT * FROM s WHERE date >= (SELECT MIN(date) FROM s WHERE revenue IS NOT NULL) AND date <= (SELECT MAX(date) FROM s WHERE revenue IS NOT NULL))
SELECT date, {r('COALESCE(revenue, AVG(revenue) OVER ())', 2)} AS revenue, n, 'monthly' AS frequency FROM t""")
def q_load_and_prepare(spark, sf):
    """Frequency, trim, two-stage fill (a month of a year is its own group, so the series mean fills), calendar columns (PIP1)."""
    from almanac.plans.pipeline import PipelineConfig, load_and_prepare
    src = f1(spark, sf).select("date", F.when(F.month("date") != 5, F.col("revenue")).alias("revenue"), "n")
    out, freq = load_and_prepare(src, PipelineConfig(target_col="revenue"))
    assert {"year", "month"} <= set(out.columns)
    return rounded(out.select("date", "revenue", F.col("n").cast("long").alias("n")), 2).withColumn("frequency", F.lit(freq))
