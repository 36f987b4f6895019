"""The end-to-end job (PIP1, PIP2, SNK1-SNK4): prepare -> features -> reduce -> train ->
summary. Each stage hands over through a Parquet table in the run folder (below the
shared ``spark.checkpoint.dir`` unless an output folder is given), which also cuts the
lineage between stages, and leaves a marker from which a stopped run goes on."""

from __future__ import annotations

import datetime as _dt
import hashlib
import json
import logging
import os
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from almanac.functions.calendar import add_time_variables
from almanac.operators.features import engineer_features
from almanac.operators.forecast import (AdditiveForecaster, ForecastConfig, direct_preset, forecast_with_actuals,
                                         to_forecast_frame)
from almanac.operators.model import TrainResult, train_and_evaluate
from almanac.operators.prepare import frequency_of, handle_missing_values, step_of, trim_to_common_date_range
from almanac.operators.reduce import reduce_dimensions
from almanac.operators.split import split_labels
from almanac.operators.stats import regression_metrics
from almanac.plans.ordered import series_hint, series_plan
from almanac.plans.staged import staged
from almanac.session import scratch_path
from almanac.sources.io import run_id, run_summary, write_table

log = logging.getLogger(__name__)


@dataclass
class PipelineConfig:
    target_col: str
    date_col: str = "date"
    model_type: str = "linear"
    params: dict = field(default_factory=dict)
    fill_method: str = "mean"
    create_lags: bool = True
    create_fourier: bool = True
    create_rolling: bool = True
    log_transform: bool = False
    max_lag: int = 3
    fourier_periods: Sequence[float] | None = None
    fourier_harmonics: int = 2
    use_pca: bool = True
    pca_variance_threshold: float = 0.95
    feature_selection_method: str = "mutual_info"
    top_n_features: int = 20
    test_size: float = 0.2
    use_cv: bool = True
    cv_splits: int = 5
    output_dir: str | None = None
    data_name: str = "input"
    forecast: ForecastConfig | None = None  # for model_type "prophet"; regressors are added to it
    forecast_periods: int = 12
    keys: Sequence[str] = ()  # series of a panel: every step works per series
    resume: str | None = None  # folder of a run that stopped: its finished stages of the same input and settings are read again


@dataclass
class RunResult:
    run_dir: str
    frequency: str
    prepared: DataFrame
    features: DataFrame
    reduced: DataFrame
    metadata: dict
    train: TrainResult | None
    summary: DataFrame
    forecast: DataFrame | None = None


@dataclass
class DirectResult:
    metrics: DataFrame
    forecast: DataFrame
    model: AdditiveForecaster
    run_dir: str


def run_direct(df: DataFrame, target_col: str, date_col: str = "date", regressors: Sequence[str] = (), keys: Sequence[str] = (),
               config: ForecastConfig | None = None, test_size: float = 0.2, future_periods: int = 0, output_dir: str | None = None) -> DirectResult:
    """The direct job (FC6, SNK5), per series: missing target and regressor values take the mean of all rows, the model (by default
    the direct preset) is fitted on the first ``1 - test_size`` of the rows and scored on the rest. The run folder gets ``metrics``
    (lines of text) and ``forecast`` (the fitted, scored and ``future_periods`` coming dates, with part and components)."""
    keys = list(keys)
    regs = [c for c in regressors if c in df.columns]
    for c in regressors:
        if c not in df.columns:
            log.warning("regressor %r not found", c)
    for c in (target_col, date_col):
        if c not in df.columns:
            raise ValueError(f"column {c!r} not found")
    rid = run_id("direct")
    run_dir = os.path.join(output_dir, rid) if output_dir else scratch_path(df.sparkSession, os.path.join("runs", rid))
    data = to_forecast_frame(df, date_col, target_col, regs, keys)
    data = handle_missing_values(data, "mean", date_col="ds", keys=keys, columns=["y", *regs])
    rows = staged(split_labels(data, keys, ["ds"], "forecast", test_size), "direct-rows")
    model = AdditiveForecaster(config or direct_preset(regs), keys=keys).fit(rows.where("part = 'train'").select(*data.columns))
    metrics = regression_metrics(model.predict(rows.where("part = 'test'").select(*data.columns)), "y", "yhat", keys)
    metrics = staged(metrics, "direct-metrics")  # one row a series
    named = [F.concat(F.lit(f"{k}: "), F.coalesce(F.col(k).cast("string"), F.lit("null"))) for k in keys]
    lines = [F.concat(F.lit(f"{name}: "), F.format_string("%.4f" + more, m)) for name, m, more in
             (("RMSE", "rmse", ""), ("MAE", "mae", ""), ("MAPE", "mape", "%%"), ("R2", "r2", ""))]
    metrics.select(F.explode(F.array(*named, *lines)).alias("value")).coalesce(1).write.text(os.path.join(run_dir, "metrics"))
    frame = rows.select(*data.columns).drop("y")
    if future_periods:
        step = step_of(rows, "ds")
        frame = frame.unionByName(model.make_future(rows, future_periods, step, include_history=False), allowMissingColumns=True)
    forecast = forecast_with_actuals(model.predict(frame), rows, keys, "ds", "y", "part")
    path = write_table(forecast, os.path.join(run_dir, "forecast"), sort_by=[*keys, "ds"])
    return DirectResult(metrics, df.sparkSession.read.parquet(path), model, run_dir)


def _fill_groups(frequency: str) -> list[str] | None:
    return {"monthly": ["year", "month"], "quarterly": ["year", "quarter"]}.get(frequency)


#: Parameters of the job where the caller gives none; the model functions keep their own defaults.
JOB_PARAMS = {"ridge": {"alpha": 1.0}, "lasso": {"alpha": 0.01}, "elasticnet": {"alpha": 0.01, "l1_ratio": 0.5},
              "randomforest": {"n_estimators": 100, "max_depth": 10},
              "gbm": {"n_estimators": 100, "learning_rate": 0.1, "max_depth": 3}}


def load_and_prepare(df: DataFrame, cfg: PipelineConfig) -> tuple[DataFrame, str]:
    """Frequency, trim to the common range, two-stage imputation, calendar columns (PIP1)."""
    if cfg.target_col not in df.columns:
        raise ValueError(f"target column {cfg.target_col!r} not found")
    keys = list(cfg.keys)
    freq = frequency_of(df, cfg.date_col, keys)
    out = trim_to_common_date_range(df, cfg.date_col, keys)
    out = handle_missing_values(out, cfg.fill_method, fill_groups=_fill_groups(freq), date_col=cfg.date_col, keys=keys)
    if "year" not in out.columns or "month" not in out.columns:
        out = add_time_variables(out, cfg.date_col)
    return out, freq


class Stages:
    """Stage tables of a run folder. A finished stage leaves a marker with the fingerprint of what it was made from: the input's
    rows and columns, and the settings. A stage whose marker has the same fingerprint is read again instead of run."""

    def __init__(self, spark: SparkSession, run_dir: str, df: DataFrame, cfg: PipelineConfig):
        self.spark, self.run_dir, self.done = spark, run_dir, []
        settings = {k: repr(v) for k, v in vars(cfg).items() if k not in ("output_dir", "resume")}
        content = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).alias("h")).first()
        text = json.dumps([settings, df.schema.json(), content["n"], str(content["h"])], sort_keys=True)
        self.fingerprint = hashlib.sha256(text.encode()).hexdigest()

    def table(self, name: str, build: Callable[[], tuple[DataFrame, dict]], sort_by: Sequence[str] | None = None) -> tuple[DataFrame, dict]:
        """The stage's table and what else it found out (a JSON-able dict, kept in the marker)."""
        path, marker = os.path.join(self.run_dir, name), os.path.join(self.run_dir, "markers", name)
        known = self._marker(marker)
        if known and known["fingerprint"] == self.fingerprint:
            log.info("stage %r is read from %s", name, path)
            return self.spark.read.parquet(path), json.loads(known["found"])
        out, found = build()
        write_table(out, path, sort_by=sort_by)
        row = self.spark.createDataFrame([(name, self.fingerprint, json.dumps(found))], "stage string, fingerprint string, found string")
        row.coalesce(1).write.mode("overwrite").json(marker)
        self.done.append(name)
        return self.spark.read.parquet(path), found

    def _marker(self, path: str):
        try:
            return self.spark.read.schema("stage string, fingerprint string, found string").json(path).first()
        except AnalysisException:  # no such stage yet
            return None


def _forecast_run(spark: SparkSession, cfg: PipelineConfig, run_dir: str, freq: str, prepared: DataFrame, feats: DataFrame,
                  reduced: DataFrame, meta: dict, chosen: Sequence[str]) -> RunResult:
    """Fit the additive forecaster on the first part, score it on the rest, and forecast beyond the data."""
    keys = list(cfg.keys)
    base = cfg.forecast or ForecastConfig(carry_target=True)
    conf = replace(base, regressors=[*base.regressors, *(c for c in chosen if c not in base.regressors)])
    data = to_forecast_frame(reduced, cfg.date_col, cfg.target_col, conf.regressors, keys)
    data = handle_missing_values(data, "mean", date_col="ds", keys=keys, columns=conf.regressors) if conf.regressors else data
    labelled = staged(split_labels(data, keys, ["ds"], "forecast", cfg.test_size), "forecast-rows")
    model = AdditiveForecaster(conf, keys=keys).fit(labelled.where("part = 'train'").select(*data.columns))
    metrics = staged(regression_metrics(model.predict(labelled.where("part = 'test'").select(*data.columns)), "y", "yhat", keys), "forecast-metrics")
    rows = labelled.select(*data.columns)
    future = model.make_future(rows, cfg.forecast_periods, step_of(rows, "ds", keys), include_history=True)
    forecast = forecast_with_actuals(model.predict(future), labelled, keys, "ds", "y", "part")
    forecast = spark.read.parquet(write_table(forecast, os.path.join(run_dir, "forecast"), sort_by=[*keys, "ds"]))
    summary = _summarised(spark, cfg, run_dir, freq, metrics, conf.regressors, {})
    return RunResult(run_dir, freq, prepared, feats, reduced, meta, None, summary, forecast)


def _summarised(spark: SparkSession, cfg: PipelineConfig, run_dir: str, freq: str, metrics: DataFrame, features: Sequence[str], more: dict) -> DataFrame:
    """One-row summary, written beside the metrics of every series; of a panel it holds the mean metrics."""
    write_table(metrics, os.path.join(run_dir, "metrics"))
    m = metrics.agg(F.count(F.lit(1)).alias("series"), *[F.avg(c).alias(c) for c in ("rmse", "mae", "mape", "r2")]).first()
    row = {"timestamp": _dt.datetime.now().isoformat(timespec="seconds"), "data": cfg.data_name, "target": cfg.target_col, "model": cfg.model_type,
           "frequency": freq, "n_features": len(features), **{c: None if m[c] is None else float(m[c]) for c in ("rmse", "mae", "mape", "r2")},
           **more, "features": list(features)}
    if cfg.keys:
        row["series"] = m["series"]
    summary = run_summary(spark, row)
    summary.coalesce(1).write.mode("overwrite").json(os.path.join(run_dir, "summary"))
    return summary


def run_pipeline(spark: SparkSession, df: DataFrame, cfg: PipelineConfig) -> RunResult:
    """Full run (PIP2), of one series or with ``keys`` of every series of a panel. Returns the stage tables, the training result
    and a one-row summary. A run that stopped goes on from its last finished stage with ``resume``."""
    rid, keys = run_id(cfg.model_type), list(cfg.keys)
    run_dir = cfg.resume or (os.path.join(cfg.output_dir, rid) if cfg.output_dir else scratch_path(spark, os.path.join("runs", rid)))
    stages = Stages(spark, run_dir, df, cfg)

    def prepare() -> tuple[DataFrame, dict]:
        out, freq = load_and_prepare(df, cfg)
        return out, {"frequency": freq}

    prepared, found = stages.table("prepared_data", prepare)
    freq = found["frequency"]

    def engineer() -> tuple[DataFrame, dict]:
        # size the series once; feature steps keep every row, so they reuse the decision
        with series_hint(series_plan(prepared, keys, [cfg.date_col])):
            return engineer_features(prepared, cfg.target_col, cfg.date_col, create_lags=cfg.create_lags,
                                     create_fourier=cfg.create_fourier, create_rolling=cfg.create_rolling,
                                     log_transform=cfg.log_transform, max_lag=cfg.max_lag, periods=cfg.fourier_periods,
                                     harmonics=cfg.fourier_harmonics, keys=keys), {}

    feats, _ = stages.table("engineered_features", engineer)
    feats = handle_missing_values(feats, cfg.fill_method, fill_groups=_fill_groups(freq), date_col=cfg.date_col, keys=keys)
    meta: dict = {}

    def reduce() -> tuple[DataFrame, dict]:
        reduced, more = reduce_dimensions(feats, cfg.target_col, date_col=cfg.date_col, use_pca=cfg.use_pca,
                                          pca_variance_threshold=cfg.pca_variance_threshold,
                                          feature_selection_method=cfg.feature_selection_method,
                                          top_n_features=cfg.top_n_features, keys=keys)
        meta.update(more)
        return reduced, {k: more.get(k) for k in ("pca_applied", "pca_components", "selected_features", "feature_selection_method", "original_features")}

    reduced, found = stages.table("reduced_data", reduce)
    meta = {**found, **meta}
    chosen = meta.get("pca_components") if meta.get("pca_applied") else meta["selected_features"]
    if cfg.model_type == "prophet":
        return _forecast_run(spark, cfg, run_dir, freq, prepared, feats, reduced, meta, chosen)
    train = train_and_evaluate(reduced, cfg.target_col, chosen, cfg.date_col, cfg.model_type,
                               cfg.params or JOB_PARAMS.get(cfg.model_type, {}), cfg.test_size, cfg.use_cv, cfg.cv_splits, keys=keys)
    verdict = train.residual_tests.first()
    summary = _summarised(spark, cfg, run_dir, freq, train.metrics, chosen,
                          {} if keys or not verdict else {"autocorrelation": verdict["durbin_watson_interpretation"]})
    return RunResult(run_dir, freq, prepared, feats, reduced, meta, train, summary)
