"""Residual tests and plot-data tables (MDL12, WIN10-WIN15, AGG9, AGG11-AGG14).

The plots themselves are not drawn; their data are DataFrames. Order-based statistics
use the series plan (bounded frames with halos), every sum is a group aggregate."""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from almanac.functions import formulas as fx
from almanac.operators.stats import pearson
from almanac.plans.fitted import Fitted
from almanac.plans.ordered import IDX, join_on_keys, series_plan

Z95 = 1.959963984540054  # standard normal quantile at 0.975


@F.pandas_udf(T.DoubleType())
def chi2_1_sf(q: pd.Series) -> pd.Series:
    """P(chi-square with 1 degree of freedom > q) = erfc(sqrt(q / 2)); one value per series."""
    return q.map(lambda v: math.erfc(math.sqrt(v / 2.0)) if v is not None and v == v and v >= 0 else float("nan"))


def _residuals(df: DataFrame, y: str, p: str | None, keys, order) -> DataFrame:
    e = (F.col(y) - F.col(p)) if p else F.col(y)
    return df.select(*keys, *[c for c in order if c not in keys], e.alias("__e")).where(F.col("__e").isNotNull())


def residual_tests(df: DataFrame, y: str, p: str | None = None, keys: Sequence[str] = (),
                   order: Sequence[str] = ("date",), block_rows: int | None = None) -> DataFrame:
    """Per series: n, mean, std (population), min, max of the residuals, Ljung-Box at lag 1
    (statistic and p-value), Durbin-Watson and its reading (MDL12, AGG9, WIN11, WIN12)."""
    keys = list(keys)
    e = _residuals(df, y, p, keys, list(order))
    fit = Fitted.fit(e, keys, {"__mu": F.avg("__e")})
    based, prm, drop = fit.attach(e)
    based = based.withColumn("__c", F.col("__e") - prm["__mu"]).drop(*drop)
    plan = series_plan(based, keys, list(order), block_rows)
    if plan.blocked:
        based = plan.index(based)
    lagged = plan.bounded(based, lambda w: {"__e1": F.lag("__e", 1).over(w), "__c1": F.lag("__c", 1).over(w)}, back=1)
    st = lagged.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg("__e").alias("mean"), F.stddev_pop("__e").alias("std"),
        F.min("__e").alias("min"), F.max("__e").alias("max"),
        F.sum(F.col("__c") * F.col("__c1")).alias("__num"), F.sum(F.col("__c") * F.col("__c")).alias("__den"),
        F.sum(F.pow(F.col("__e") - F.col("__e1"), 2)).alias("__dwn"), F.sum(F.col("__e") * F.col("__e")).alias("__dwd"),
    )
    n = F.col("n").cast("double")
    rho = F.try_divide(F.col("__num"), F.col("__den"))
    q = F.try_divide(n * (n + 2) * rho * rho, n - 1)
    dw = F.try_divide(F.col("__dwn"), F.col("__dwd"))
    out = st.select(*keys, F.col("n").cast("long").alias("n"), "mean", "std", "min", "max",
                    q.alias("ljung_box_stat"), dw.alias("durbin_watson"))
    out = out.withColumn("ljung_box_pvalue", chi2_1_sf(F.col("ljung_box_stat")))
    reading = (F.when(F.col("durbin_watson") < 1.5, "Positive autocorrelation")
               .when(F.col("durbin_watson") > 2.5, "Negative autocorrelation")
               .otherwise("No significant autocorrelation"))
    return out.withColumn("durbin_watson_interpretation", reading)


def acf(df: DataFrame, col: str, nlags: int = 20, keys: Sequence[str] = (), order: Sequence[str] = ("date",),
        block_rows: int | None = None) -> DataFrame:
    """Autocorrelation at lags 0..nlags with the Bartlett 95% band (WIN10): one window pass
    for all lags, one aggregate, then a running sum over the (tiny) lag table."""
    keys = list(keys)
    e = _residuals(df, col, None, keys, list(order))
    fit = Fitted.fit(e, keys, {"__mu": F.avg("__e")})
    based, prm, drop = fit.attach(e)
    based = based.withColumn("__c", F.col("__e") - prm["__mu"]).drop(*drop)
    plan = series_plan(based, keys, list(order), block_rows)
    if plan.blocked:
        based = plan.index(based)
    lagged = plan.bounded(based, lambda w: {f"__l{k}": F.lag("__c", k).over(w) for k in range(1, nlags + 1)}, back=nlags)
    sums = lagged.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), F.sum(F.col("__c") * F.col("__c")).alias("__s0"),
                                     *[F.sum(F.col("__c") * F.col(f"__l{k}")).alias(f"__s{k}") for k in range(1, nlags + 1)])
    body = ", ".join(f"{k}, `__s{k}`" for k in range(0, nlags + 1))
    long = sums.select(*keys, "__n", "__s0", F.expr(f"stack({nlags + 1}, {body}) as (lag, __sk)"))
    long = long.withColumn("acf", F.try_divide(F.coalesce(F.col("__sk"), F.lit(0.0)), F.col("__s0")))
    w = Window.partitionBy(*keys).orderBy("lag").rowsBetween(Window.unboundedPreceding, -1)
    cum = F.sum(F.when(F.col("lag") >= 1, F.col("acf") * F.col("acf")).otherwise(F.lit(0.0))).over(w)
    var = (F.when(F.col("lag") == 0, F.lit(0.0)).when(F.col("lag") == 1, F.lit(1.0) / F.col("__n"))
           .otherwise((F.lit(1.0) + F.lit(2.0) * cum) / F.col("__n")))
    out = long.withColumn("__se", F.sqrt(var))
    return out.select(*keys, F.col("lag").cast("int").alias("lag"), "acf",
                      (F.col("acf") - Z95 * F.col("__se")).alias("conf_lo"),
                      (F.col("acf") + Z95 * F.col("__se")).alias("conf_hi"))


def qq_table(df: DataFrame, col: str, keys: Sequence[str] = (), block_rows: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Normal Q-Q data (WIN14): ordered values against normal quantiles at Filliben's plotting
    positions, and the least-squares line (slope, intercept, r) per series."""
    keys = list(keys)
    v = df.select(*keys, F.col(col).alias("ordered")).where(F.col("ordered").isNotNull())
    plan = series_plan(v, keys, ["ordered"], block_rows)  # tied values give identical output rows
    r = plan.with_count(plan.index(v))
    n = F.col("__n").cast("double")
    i = F.col(IDX).cast("double") + 1
    last = F.pow(F.lit(0.5), F.lit(1.0) / n)
    pos = F.when(i == n, last).when(i == 1, F.lit(1.0) - last).otherwise((i - 0.3175) / (n + 0.365))
    pts = r.withColumn("__pos", pos).select(*keys, F.col(IDX).alias("i"), F.expr(fx.normal_ppf_sql("__pos")).alias("theoretical"),
                                            "ordered")
    line = pts.groupBy(*keys).agg(F.regr_slope("ordered", "theoretical").alias("slope"),
                                  F.regr_intercept("ordered", "theoretical").alias("intercept"),
                                  pearson(F.col("ordered"), F.col("theoretical")).alias("r"))
    return pts, line


def decompose(df: DataFrame, col: str, period: int = 12, model: str = "additive", keys: Sequence[str] = (),
              order: Sequence[str] = ("date",), block_rows: int | None = None) -> DataFrame:
    """Classical decomposition (WIN13): centred moving average (2 x p with half weights at the
    ends for even p), phase means of the detrended series over idx mod p centred to mean 0
    (additive) or 1 (multiplicative), residual. Columns: keys, order, idx, observed,
    trend, seasonal, resid."""
    keys, order = list(keys), list(order)
    if model not in ("additive", "multiplicative"):
        raise ValueError("model must be additive or multiplicative")
    d = df.select(*keys, *[c for c in order if c not in keys], F.col(col).cast("double").alias("observed"))
    plan = series_plan(d, keys, order, block_rows)
    d = plan.index(d)
    h = period // 2
    even = period % 2 == 0

    def build(w):
        frame = w.rowsBetween(-h, h)
        s = F.sum("observed").over(frame)
        c = F.count("observed").over(frame)
        if even:
            val = (s - 0.5 * F.lag("observed", h).over(w) - 0.5 * F.lead("observed", h).over(w)) / period
            ok = c == period + 1
        else:
            val = s / period
            ok = c == period
        return {"trend": F.when(ok, val)}

    d = plan.bounded(d, build, back=h, fwd=h)
    detr = (F.col("observed") - F.col("trend")) if model == "additive" else F.try_divide(F.col("observed"), F.col("trend"))
    d = d.withColumn("__phase", F.col(IDX) % period).withColumn("__det", detr)
    ph = d.groupBy(*keys, "__phase").agg(F.avg("__det").alias("__pm"))
    centre = ph.groupBy(*keys).agg(F.avg("__pm").alias("__pc"))
    ph = join_on_keys(ph, centre, keys, "inner")
    adj = (F.col("__pm") - F.col("__pc")) if model == "additive" else F.try_divide(F.col("__pm"), F.col("__pc"))
    ph = ph.select(*keys, "__phase", adj.alias("seasonal"))
    out = join_on_keys(d, ph, [*keys, "__phase"], "left")
    resid = (F.col("observed") - F.col("trend") - F.col("seasonal")) if model == "additive" else (
        F.try_divide(F.col("observed"), F.col("trend") * F.col("seasonal")))
    return out.withColumn("resid", resid).drop("__phase", "__det").withColumnRenamed(IDX, "idx")


def rolling_origin_table(actual: DataFrame, predictions: DataFrame, step: int, keys: Sequence[str] = (),
                         y: str = "y") -> DataFrame:
    """Forecast overlay data (WIN15): window i covers rows i*step .. i*step+len-1; predictions
    ``(keys, window_id, pos, yhat)`` are placed on ``idx = window_id*step + pos`` and joined to
    the actual values ``(keys, idx, y)``."""
    keys = list(keys)
    p = predictions.withColumn("idx", (F.col("window_id") * step + F.col("pos")).cast("long"))
    return join_on_keys(p, actual.select(*keys, "idx", F.col(y).alias("actual")), [*keys, "idx"], "left")
