"""The full run: on a panel, resumed after a stop, and the direct job."""

import datetime as dt
import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from almanac.operators import prepare
from almanac.plans import pipeline as pl


def months(spark, keys=("a",), n=84):
    rng = np.random.default_rng(4)
    rows = []
    for k in keys:
        for i in range(n):
            x, z = rng.normal(), rng.normal()
            y = 50 + i + 8 * math.sin(2 * math.pi * i / 12) + 3 * x + rng.normal(scale=0.3)
            rows.append((k, dt.date(2015 + i // 12, i % 12 + 1, 1), None if i == 40 else float(y), float(100 + x), float(z)))
    return spark.createDataFrame(rows, "k string, date date, y double, price double, rate double")


def config(**more):
    return pl.PipelineConfig(target_col="y", model_type="ridge", use_pca=False, feature_selection_method="f_regression", top_n_features=6, use_cv=False, **more)


def test_a_stopped_run_goes_on(spark, monkeypatch, tmp_path):
    df = months(spark).drop("k")
    stop = RuntimeError("stopped after features")

    def broken(*a, **k):
        raise stop

    monkeypatch.setattr(pl, "reduce_dimensions", broken)
    with pytest.raises(RuntimeError):
        pl.run_pipeline(spark, df, config(output_dir=str(tmp_path)))
    (run,) = os.listdir(tmp_path)
    folder = str(tmp_path / run)
    assert sorted(os.listdir(f"{folder}/markers")) == ["engineered_features", "prepared_data"]
    monkeypatch.undo()
    ran = []
    for name in ("load_and_prepare", "engineer_features", "reduce_dimensions"):
        fn = getattr(pl, name)
        monkeypatch.setattr(pl, name, lambda *a, fn=fn, name=name, **k: (ran.append(name), fn(*a, **k))[1])
    res = pl.run_pipeline(spark, df, config(resume=folder))
    assert ran == ["reduce_dimensions"] and res.frequency == "monthly" and res.run_dir == folder
    assert res.summary.first()["r2"] > 0.5 and res.train.predictions.count() == 84
    again = pl.run_pipeline(spark, df, config(resume=folder))
    assert ran == ["reduce_dimensions"] and again.metadata["selected_features"] == res.metadata["selected_features"]
    pl.run_pipeline(spark, df.withColumn("price", F.col("price") + 1), config(resume=folder))  # another input: every stage runs
    assert ran[1:] == ["load_and_prepare", "engineer_features", "reduce_dimensions"]


@pytest.mark.parametrize("use_pca", [False, True])
def test_a_panel_runs_per_series(spark, use_pca):
    df = months(spark, ("a", "b", None))
    cfg = config(keys=["k"], create_lags=True)
    cfg.use_pca = use_pca
    res = pl.run_pipeline(spark, df, cfg)
    row = res.summary.first()
    assert row["series"] == 3 and res.train.metrics.where("r2 IS NOT NULL").count() == 3
    assert use_pca or res.train.metrics.where("r2 > 0.3").count() >= 2
    assert res.prepared.count() == 252 == res.reduced.count() and res.prepared.where("y IS NULL").count() == 0
    alone = pl.run_pipeline(spark, df.where("k = 'a'").drop("k"), config()) if not use_pca else None
    if alone:
        ours = res.train.metrics.where("k = 'a'").first()
        assert res.metadata["selection"].where("k = 'a'").count() == 6
        assert set(alone.metadata["selected_features"]) <= set(res.metadata["selected_features"]) and ours["n"] == alone.train.metrics.first()["n"]


def test_the_forecast_of_a_panel(spark):
    cfg = config(keys=["k"], forecast_periods=4, forecast=pl.ForecastConfig(yearly_seasonality=False, n_changepoints=3, carry_target=True))
    cfg.model_type, cfg.top_n_features = "prophet", 2
    res = pl.run_pipeline(spark, months(spark, ("a", "b")), cfg)
    got = {(r["k"], r["part"]): r["count"] for r in res.forecast.groupBy("k", "part").count().collect()}
    assert got == {(k, p): n for k in "ab" for p, n in (("train", 67), ("test", 17), ("future", 4))}
    assert res.summary.first()["series"] == 2


def test_the_direct_job_writes_metrics(spark, tmp_path):
    res = pl.run_direct(months(spark, ("a", "b")), "y", "date", ["price", "none"], ["k"], future_periods=3, output_dir=str(tmp_path),
                        config=pl.ForecastConfig(n_changepoints=3, regressors=["price"]))
    lines = [r["value"] for r in spark.read.text(f"{res.run_dir}/metrics").collect()]
    want = {r["k"]: r for r in res.metrics.collect()}
    at = lines.index("k: b")
    assert len(lines) == 10 and lines[at + 1] == f"RMSE: {want['b']['rmse']:.4f}" and lines[at + 3].endswith("%")
    parts = {(r["k"], r["part"]): r["count"] for r in res.forecast.groupBy("k", "part").count().collect()}
    assert parts == {(k, p): n for k in "ab" for p, n in (("train", 67), ("test", 17), ("future", 3))}
    assert res.forecast.where("part = 'future' AND yhat IS NULL").count() == 0 and {"trend", "yearly", "price_effect"} <= set(res.forecast.columns)
    with pytest.raises(ValueError):
        pl.run_direct(months(spark), "none")


@pytest.mark.parametrize("step, want", [("1 day", "D"), ("7 days", "W"), ("1 month", "MS"), ("3 months", "QS"), ("1 year", "YS"), ("1 hour", "h")])
def test_futures_follow_the_spacing(spark, step, want):
    df = spark.range(40).select(F.expr(f"timestamp'2015-01-01' + id * interval {step}").alias("ds"))
    assert prepare.step_of(df, "ds") == want
