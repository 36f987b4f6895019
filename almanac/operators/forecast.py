"""Additive forecasting (FC1-FC7, FRQ6, JN4).

Re-aimed from a sampling-based Bayesian forecaster to a Spark job with the same model
structure: piecewise-linear trend with changepoints, Fourier seasonalities (periods in
days), extra regressors and holiday indicators, fitted per series as a penalised least
squares (MAP with Gaussian priors whose scales are the prior-scale parameters). The design
matrix is a set of column expressions, its cross-products are one group aggregate per
series (skew-safe), the small systems are solved per series, and predictions and
components are again plain expressions.

The interval of a prediction adds three variances: of the residuals; of the coefficients, from the inverse of the
penalised cross-products; and of trend changes still to come, which arrive at the rate of the fitted
changepoints with Laplace-distributed sizes of their mean size, so beyond the data it grows with the cube of the horizon."""

from __future__ import annotations

import logging
import math
import statistics
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from almanac.operators import gram
from almanac.operators.prepare import future_frame, handle_missing_values
from almanac.plans.fitted import Fitted
from almanac.plans.ordered import IDX, join_on_keys, series_plan
from almanac.plans.staged import staged

log = logging.getLogger(__name__)

HOLIDAY_BROADCAST_ROWS = 100_000


@dataclass
class ForecastConfig:
    yearly_seasonality: bool = True
    weekly_seasonality: bool = False
    daily_seasonality: bool = False
    seasonalities: list[dict] = field(default_factory=list)   # {name, period (days), fourier_order}
    changepoint_prior_scale: float = 0.05
    seasonality_prior_scale: float = 10.0
    regressor_prior_scale: float = 10.0
    holidays_prior_scale: float = 10.0
    n_changepoints: int = 25
    changepoint_range: float = 0.8
    regressors: list[str] = field(default_factory=list)
    interval_width: float = 0.8
    noise_scale: float = 0.05
    carry_target: bool = False  # fill a missing target from the row before, then from the row after

    def season_terms(self) -> list[tuple[str, float, int]]:
        terms = []
        if self.yearly_seasonality:
            terms.append(("yearly", 365.25, 10))
        if self.weekly_seasonality:
            terms.append(("weekly", 7.0, 3))
        if self.daily_seasonality:
            terms.append(("daily", 1.0, 4))
        for s in self.seasonalities:
            terms.append((s["name"], float(s["period"]), int(s.get("fourier_order", 5))))
        return terms


def _days(c: Column, dtype: T.DataType) -> Column:
    """Days since 1970-01-01 as a double (fractional for timestamps)."""
    if isinstance(dtype, T.DateType):
        return F.unix_date(c).cast("double")
    return F.unix_micros(c.cast("timestamp")).cast("double") / F.lit(86_400_000_000.0)


def carry_target(df: DataFrame, y: str, keys: Sequence[str] = (), ds: str = "ds", block_rows: int | None = None) -> DataFrame:
    """A missing target takes the last value before it, at the start the first one after (IMP8)."""
    return handle_missing_values(df, "forward", date_col=ds, keys=keys, order=[ds], columns=[y], block_rows=block_rows)


def direct_preset(regressors: Sequence[str]) -> ForecastConfig:
    """Configuration of the direct job (FC6): a stiff trend, wide seasonal and regressor priors and a
    quarterly seasonality."""
    return ForecastConfig(changepoint_prior_scale=0.01, seasonality_prior_scale=5.0, regressor_prior_scale=5.0,
                          seasonalities=[{"name": "quarterly", "period": 91.25, "fourier_order": 3}], regressors=list(regressors))


def to_forecast_frame(df: DataFrame, date_col: str, target_col: str, regressors: Sequence[str] = (),
                      keys: Sequence[str] = ()) -> DataFrame:
    """keys, ``ds``, ``y`` and the regressors (PRJ5)."""
    return df.select(*keys, F.col(date_col).alias("ds"), F.col(target_col).alias("y"), *regressors)


def seasonality_features(df: DataFrame, ds: str, name: str, period: float, fourier_order: int) -> DataFrame:
    """Custom seasonality columns ``{name}_s{h}`` / ``{name}_c{h}`` = sin/cos(2*pi*h*days/period),
    days counted from 1970-01-01 (FC2)."""
    day = _days(F.col(ds), df.schema[ds].dataType)
    cols = {}
    for h in range(1, fourier_order + 1):
        ang = F.lit(2 * math.pi * h / period) * day
        cols[f"{name}_s{h}"] = F.sin(ang)
        cols[f"{name}_c{h}"] = F.cos(ang)
    return df.withColumns(cols)


def holiday_features(df: DataFrame, holidays: DataFrame, ds: str = "ds", names: Sequence[str] | None = None) -> DataFrame:
    """Indicator column ``holiday_{name}`` per holiday (FC3). ``holidays`` is (ds, holiday);
    it is broadcast only when its row count is below a fixed bound, else joined by shuffle."""
    h = holidays.select(F.to_date("ds").alias("__hd"), F.col("holiday"))
    if names is None:
        names = sorted(r["holiday"] for r in h.where(F.col("holiday").isNotNull()).select("holiday").distinct().collect())
    wide = h.groupBy("__hd").agg(*[F.max(F.when(F.col("holiday") == n, 1).otherwise(0)).alias(f"holiday_{n}") for n in names])
    small = holidays.count() <= HOLIDAY_BROADCAST_ROWS
    right = F.broadcast(wide) if small else wide
    out = df.join(right, F.to_date(F.col(ds)) == F.col("__hd"), "left").drop("__hd")
    return out.fillna(0, subset=[f"holiday_{n}" for n in names])


def regressor_future(future: DataFrame, history: DataFrame, regressors: Sequence[str], keys: Sequence[str] = (),
                     ds: str = "ds", mode: str = "actual") -> DataFrame:
    """Regressor values on a future frame (JN4): known values joined on (keys, ds) — only
    when ``mode='actual'`` — and the series mean of the regressor elsewhere."""
    keys = list(keys)
    regs = list(regressors)
    fit = Fitted.fit(history, keys, {f"__mean_{r}": F.avg(r) for r in regs})
    out = future
    if mode == "actual":
        known = history.select(*keys, ds, *[F.col(r).alias(f"__k_{r}") for r in regs])
        out = join_on_keys(out, known, [*keys, ds], "left")
    based, p, drop = fit.attach(out)
    filled = {r: F.coalesce(F.col(f"__k_{r}"), p[f"__mean_{r}"]) if mode == "actual" else p[f"__mean_{r}"] for r in regs}
    res = based.withColumns(filled).drop(*drop)
    return res.drop(*[f"__k_{r}" for r in regs]) if mode == "actual" else res


class AdditiveForecaster:
    """Fit and predict an additive trend + seasonality + regressors model per series."""

    def __init__(self, config: ForecastConfig | None = None, keys: Sequence[str] = (), ds: str = "ds", y: str = "y",
                 holidays: DataFrame | None = None, block_rows: int | None = None):
        self.cfg = config or ForecastConfig()
        self.keys = list(keys)
        self.ds, self.y = ds, y
        self.holidays = holidays
        self.block_rows = block_rows
        self.state: Fitted | None = None
        self.coefs: DataFrame | None = None
        self.columns: list[str] = []
        self.groups: dict[str, list[str]] = {}
        self.holiday_names: list[str] = []

    # ------------------------------------------------------------ design matrix
    def _design(self, df: DataFrame) -> DataFrame:
        """Design columns as one SQL expression each (one planner call per column)."""
        cfg, ds = self.cfg, self.ds
        dtype = df.schema[ds].dataType
        based, p, drop = self.state.attach_sql(df)
        if isinstance(dtype, T.DateType):
            day = f"CAST(unix_date(`{ds}`) AS DOUBLE)"
        else:
            day = f"(CAST(unix_micros(CAST(`{ds}` AS TIMESTAMP)) AS DOUBLE) / 86400000000.0D)"
        t = f"(({day} - {p['t0']}) / {p['tspan']})"
        cols: dict[str, str] = {"__t": t}
        groups: dict[str, list[str]] = {"trend": ["__t"]}
        for j in range(cfg.n_changepoints):
            cols[f"__cp{j}"] = f"greatest({t} - element_at({p['cps']}, {j + 1}), 0.0D)"
            groups["trend"].append(f"__cp{j}")
        for sname, period, order in cfg.season_terms():
            names = []
            for h in range(1, order + 1):
                ang = f"({2 * math.pi * h / period!r}D * {day})"
                cols[f"__{sname}_s{h}"] = f"sin({ang})"
                cols[f"__{sname}_c{h}"] = f"cos({ang})"
                names += [f"__{sname}_s{h}", f"__{sname}_c{h}"]
            groups[sname] = names
        for r in cfg.regressors:
            cols[f"__r_{r}"] = f"((CAST(`{r}` AS DOUBLE) - {p['__rm_' + r]}) / {p['__rs_' + r]})"
            groups[r] = [f"__r_{r}"]
        for hname in self.holiday_names:
            cols[f"__h_{hname}"] = f"CAST(`holiday_{hname}` AS DOUBLE)"
            groups.setdefault("holidays", []).append(f"__h_{hname}")
        cols["__ys"] = p["yscale"]
        out = based.select("*", *[F.expr(e).alias(n) for n, e in cols.items()]).drop(*drop)
        self.groups = groups
        return out

    def _penalties(self) -> list[float]:
        cfg = self.cfg
        s2 = cfg.noise_scale ** 2
        pen = []
        for g, names in self.groups.items():
            for n in names:
                if n == "__t":
                    pen.append(0.0)
                elif n.startswith("__cp"):
                    pen.append(s2 / cfg.changepoint_prior_scale ** 2)
                elif g == "holidays":
                    pen.append(s2 / cfg.holidays_prior_scale ** 2)
                elif g in cfg.regressors:
                    pen.append(s2 / cfg.regressor_prior_scale ** 2)
                else:
                    pen.append(s2 / cfg.seasonality_prior_scale ** 2)
        return pen

    # ------------------------------------------------------------ fit
    def fit(self, df: DataFrame) -> "AdditiveForecaster":
        cfg, keys, ds, y = self.cfg, self.keys, self.ds, self.y
        for r in cfg.regressors:
            if r not in df.columns:
                raise ValueError(f"regressor {r!r} missing from the data")
        if y not in df.columns:
            raise ValueError(f"target {y!r} missing from the data")
        d = carry_target(df, y, keys, ds, self.block_rows) if cfg.carry_target else df
        d = d.where(F.col(y).isNotNull())
        if self.holidays is not None:
            self.holiday_names = sorted(r["holiday"] for r in self.holidays.select("holiday").distinct().collect())
            d = holiday_features(d, self.holidays, ds, self.holiday_names)
        dtype = d.schema[ds].dataType
        day = _days(F.col(ds), dtype)
        plan = series_plan(d, keys, [ds], self.block_rows)
        wanted = [c for c in d.columns if c in (*keys, ds, y, *cfg.regressors) or c.startswith("holiday_")]
        idx = staged(plan.index(d.select(*wanted)), "forecast-rows")
        stats = idx.groupBy(*keys).agg(
            F.min(day).alias("t0"), (F.max(day) - F.min(day)).alias("__span"), F.max(F.abs(F.col(y))).alias("__ya"),
            F.count(F.lit(1)).alias("__n"),
            *[F.avg(r).alias(f"__rm_{r}") for r in cfg.regressors],
            *[F.stddev_pop(r).alias(f"__rs0_{r}") for r in cfg.regressors])
        # changepoint positions: evenly spaced rows of the first changepoint_range of history
        ncp = cfg.n_changepoints
        hist = F.floor(F.col("__n").cast("double") * F.lit(cfg.changepoint_range)).cast("long")
        # sequence(1, 0) counts down, so the positions are cut to ncp
        pos = F.transform(F.slice(F.sequence(F.lit(1), F.lit(max(ncp, 1))), 1, ncp),
                          lambda j: F.round(j.cast("double") * (hist - 1).cast("double") / F.lit(float(max(ncp, 1)))).cast("long"))
        stats = stats.withColumn("__pos", pos)
        at = join_on_keys(idx.select(*keys, IDX, day.alias("__day")), stats.select(*keys, "__pos", "t0", "__span"),
                          keys, "inner")
        at = at.where(F.array_contains("__pos", F.col(IDX)))  # at most ncp rows per series
        cps = at.groupBy(*keys).agg(F.sort_array(F.collect_list("__day")).alias("__cpd"),
                                    F.first("t0").alias("__t0"), F.first("__span").alias("__sp"))
        tspan = F.when(F.col("__sp") > 0, F.col("__sp")).otherwise(F.lit(1.0))
        cps = cps.select(*keys, F.transform("__cpd", lambda v: (v - F.col("__t0")) / tspan).alias("cps"))
        state = join_on_keys(stats, cps, keys, "left").select(
            *keys, "t0", F.when(F.col("__span") > 0, F.col("__span")).otherwise(F.lit(1.0)).alias("tspan"),
            F.when(F.col("__ya") > 0, F.col("__ya")).otherwise(F.lit(1.0)).alias("yscale"),
            F.coalesce(F.col("cps"), F.array().cast("array<double>")).alias("cps"),
            *[F.col(f"__rm_{r}") for r in cfg.regressors],
            *[F.when(F.col(f"__rs0_{r}") > 0, F.col(f"__rs0_{r}")).otherwise(F.lit(1.0)).alias(f"__rs_{r}")
              for r in cfg.regressors])
        # pad missing changepoints (short series) with +inf so their hinge is 0
        state = state.withColumn("cps", F.concat("cps", F.array_repeat(F.lit(float("inf")),
                                                                       F.lit(ncp) - F.size("cps"))))
        self.state = Fitted.from_table(keys, state) if keys else Fitted(keys, row=state.first().asDict())
        des = self._design(idx)
        self.columns = [n for names in self.groups.values() for n in names]
        mom = gram.moments(des, keys, [*[F.col(c) for c in self.columns], F.col(y) / F.col("__ys")])
        found = gram.fits_with_spread(mom, self._penalties())
        w = F.col("weights")
        hinges = [i for i, c in enumerate(self.columns) if c.startswith("__cp")]
        size = sum((F.abs(w[i]) for i in hinges), F.lit(0.0)) / F.lit(float(max(len(hinges), 1)))
        coefs = found.select(*keys, "intercept", *[w[i].alias(c) for i, c in enumerate(self.columns)], F.col("rows").alias("__rows"),
                             F.sqrt(F.col("sse") / F.col("rows")).alias("__sd"), (F.lit(2.0 * len(hinges)) * size * size).alias("__drift"),
                             F.col("means").alias("__mu"), F.col("inverse").alias("__inv"))
        self.coefs = staged(coefs, "forecast-fits") if keys else coefs
        return self

    def _apply(self, des: DataFrame) -> DataFrame:
        """Fitted value, its standard deviation and one column per component group, one SQL expression each."""
        keys = self.keys
        coef = Fitted.from_table(keys, self.coefs) if keys else Fitted(keys, row=self.coefs.first().asDict())
        j, w, drop = coef.attach_sql(des)
        comp = {}
        for g, names in self.groups.items():
            comp[g] = " + ".join(f"coalesce({w[n]} * `{n}`, 0.0D)" for n in names)
        comp["trend"] = f"{comp['trend']} + {w['intercept']}"
        total = " + ".join(f"`__g_{g}`" for g in comp)
        off = ", ".join(f"coalesce(`{n}` - element_at({w['__mu']}, {i + 1}), 0.0D)" for i, n in enumerate(self.columns)) \
            if keys else ", ".join(f"coalesce(`{n}` - {m!r}D, 0.0D)" for n, m in zip(self.columns, coef.row["__mu"]))
        added = "0.0D, (s, v) -> s + v)"
        of_fit = f"aggregate(zip_with({w['__inv']}, __off, (line, x) -> x * aggregate(zip_with(line, __off, (a, b) -> a * b), {added}), {added}"
        ahead = "greatest(`__t` - 1.0D, 0.0D)"
        var = (f"{w['__sd']} * {w['__sd']} * (1.0D + 1.0D / {w['__rows']} + {of_fit}) "
               f"+ {w['__drift']} * {ahead} * {ahead} * {ahead} / 3.0D")
        out = j.select("*", *[F.expr(e).alias(f"__g_{g}") for g, e in comp.items()], F.expr(f"array({off})").alias("__off"))
        return out.select("*", F.expr(total).alias("__fit"), F.expr(f"sqrt({var})").alias("__spread")).drop("__off", *drop)

    # ------------------------------------------------------------ predict
    def make_future(self, df: DataFrame, periods: int, freq: str = "MS", include_history: bool = True,
                    regressor_mode: str = "actual") -> DataFrame:
        """History dates plus ``periods`` period starts per series (FRQ6), regressors filled
        from history or the mean (JN4)."""
        fut = future_frame(df, self.ds, periods, self.keys, freq, include_history)
        if self.cfg.regressors:
            # at the resolution of the frame, one row per series and time: rows of the same time count by their mean
            at = F.col(self.ds).cast(fut.schema[self.ds].dataType)
            hist = df.groupBy(*self.keys, at.alias(self.ds)).agg(*[F.avg(r).alias(r) for r in self.cfg.regressors])
            fut = regressor_future(fut, hist, self.cfg.regressors, self.keys, self.ds, regressor_mode)
        return fut

    def predict(self, df: DataFrame) -> DataFrame:
        """keys, ds, yhat, yhat_lower, yhat_upper and one column per component (FC7), named ``{regressor}_effect``
        where the input holds a column of the component's name."""
        d = df
        if self.holiday_names:
            d = holiday_features(d, self.holidays, self.ds, self.holiday_names)
        des = self._design(d)
        out = self._apply(des)
        z = statistics.NormalDist().inv_cdf(0.5 + self.cfg.interval_width / 2)
        ys = F.col("__ys")
        yhat = F.col("__fit") * ys
        half = F.lit(z) * F.col("__spread") * ys
        comps = {g: F.col(f"__g_{g}") * ys for g in self.groups}
        keep = [c for c in df.columns]
        res = out.select(*keep, yhat.alias("yhat"), (yhat - half).alias("yhat_lower"), (yhat + half).alias("yhat_upper"),
                           *[e.alias(f"{g}_effect" if g in keep else g) for g, e in comps.items()])
        return res


def forecast_with_actuals(forecast: DataFrame, actual: DataFrame, keys: Sequence[str], ds: str, y: str,
                          part: str | None = None) -> DataFrame:
    """Forecast table joined to the actual values on (keys, ds) (FC5, FC7), with ``part``: of a row with an actual value that of
    the column ``part`` (history, if none is given), of the others future. Actual values of the same time count by their mean."""
    at = F.col(ds).cast(forecast.schema[ds].dataType)
    own = F.lit("history") if part is None else F.col(part)
    a = actual.groupBy(*keys, at.alias(ds)).agg(F.avg(y).alias("actual"), F.min(own).alias("part"))
    return join_on_keys(forecast, a, [*keys, ds], "left").withColumn("part", F.coalesce("part", F.lit("future")))
