"""Fits from cross-products: folds, coordinate descent, components; forecast intervals and future frames."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from almanac.operators import forecast as fc
from almanac.operators import gram
from almanac.operators import model as md
from almanac.operators import reduce as rd

DAY = dt.date(2020, 1, 1)


def panel(spark, n=60, series=3, seed=5, holes=False):
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(series):
        for i in range(n + k):
            x = rng.normal(size=4) + 10 * k
            y = 3 + 2 * x[0] - x[1] + 0.2 * rng.normal()
            x = [None if holes and rng.random() < 0.1 else float(v) for v in x]
            rows.append((f"s{k}", DAY + dt.timedelta(days=i), float(y), *x))
    return spark.createDataFrame(rows, "k string, date date, y double, a double, b double, c double, d double")


@pytest.mark.parametrize("model, params", [("lasso", {"alpha": 0.1}), ("elasticnet", {"alpha": 0.3, "l1_ratio": 0.4})])
def test_descent_per_series_equals_mllib(spark, model, params):
    df, feats = panel(spark), ["a", "b", "c", "d"]
    got = {r["k"]: r for r in md.fit_linear_per_series(df, ["k"], feats, "y", params["alpha"], model, params.get("l1_ratio", 0.5)).collect()}
    for k in ("s0", "s1", "s2"):
        one = VectorAssembler(inputCols=feats, outputCol="f").transform(df.where(F.col("k") == k))
        sd = one.agg(F.stddev_pop("y")).first()[0]
        l1 = params["alpha"] * params.get("l1_ratio", 1.0)
        lam = l1 + (params["alpha"] - l1) * sd
        ref = LinearRegression(featuresCol="f", labelCol="y", standardization=False, elasticNetParam=l1 / lam, regParam=lam, maxIter=5000, tol=1e-12)
        ref = ref.fit(one)
        assert [got[k][f] for f in feats] == pytest.approx(list(ref.coefficients), abs=2e-4)
        assert got[k]["intercept"] == pytest.approx(ref.intercept, abs=5e-3)


def test_descent_finds_the_minimum():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(80, 6))
    x[:, 3] = x[:, 1]  # tied columns
    y = x @ np.array([1.0, 0, -2, 0, 0, 0.3]) + rng.normal(size=80)
    a, c = x.T @ x / 80, x.T @ y / 80
    def value(w):
        return w @ a @ w / 2 - c @ w + 0.1 * np.abs(w).sum() + 0.05 / 2 * w @ w
    w = gram.descend(a, c, 0.1, 0.05)
    for _ in range(2_000):
        assert value(w) <= value(w + rng.normal(size=6) * 10.0 ** rng.uniform(-6, 0)) + 1e-12


@pytest.mark.parametrize("model, alpha", [("ridge", 0.0), ("ridge", 5.0), ("lasso", 0.05)])
def test_folds_from_running_sums_equal_fits_of_copied_rows(spark, model, alpha):
    df, feats, splits = panel(spark, holes=True), ["a", "b"], 4
    per_fold, summary, folds = md.cv_linear(df, feats, "y", ["k"], splits, alpha, model_type=model)
    got = {(r["k"], r["fold"]): r for r in per_fold.collect()}
    assert {(r["k"], r["fold"]) for r in folds.collect()} == set(got) and summary.count() == 3
    for (k, fold), r in got.items():
        rows = df.where(F.col("k") == k).orderBy("date").collect()
        size = len(rows) // (splits + 1)
        start = len(rows) - (splits - fold) * size
        train = spark.createDataFrame(rows[:start], df.schema)
        w = md.fit_linear_per_series(train, [], feats, "y", alpha, model).first()
        err = [t["y"] - (w["intercept"] + w["a"] * t["a"] + w["b"] * t["b"]) for t in rows[start:start + size] if None not in (t["a"], t["b"])]
        assert r["n"] == len(err) and r["rmse"] == pytest.approx(math.sqrt(np.mean(np.square(err))), rel=1e-8)


def test_a_fold_without_labels_keeps_the_others(spark):
    df = panel(spark, n=60, series=1).withColumn("y", F.when(F.dayofyear("date").between(21, 30), None).otherwise(F.col("y")))
    per_fold, _, folds = md.cv_linear(df, ["a", "b"], "y", [], 5, initial_train_size=1)
    assert folds.count() == 5 and {r["fold"] for r in per_fold.collect()} == {0, 2, 3, 4}


NAMES = ["prediction", "fold", "intercept", "features", "part", "seg", "weights", "rows", "x0", "k0", "__w0"]


@pytest.mark.parametrize("keys", [[], ["seg0"]])
@pytest.mark.parametrize("model", ["ridge", "gbm"])
def test_features_of_any_name(spark, keys, model):
    if keys and model == "gbm":
        return
    rng = np.random.default_rng(3)
    rows = [(f"s{i % 2}", DAY + dt.timedelta(days=i // 2), float(i), *map(float, rng.normal(size=len(NAMES)))) for i in range(160)]
    df = spark.createDataFrame(rows, "seg0 string, date date, target double, " + ", ".join(f"{n} double" for n in NAMES))
    df = df if keys else df.where("seg0 = 's0'").drop("seg0")
    params = {"alpha": 1.0} if model == "ridge" else {"n_estimators": 2}
    res = md.train_and_evaluate(df, "target", NAMES, "date", model, params, n_cv_splits=3, keys=keys)
    assert res.metrics.count() == (2 if keys else 1) and res.importances.count() == len(NAMES) * (2 if keys else 1)
    assert res.predictions.columns[-4:] == ["idx", "part", "actual", "predicted"] and res.cv_folds.count() > 0
    assert res.residual_tests.count() == (2 if keys else 1)


@pytest.mark.parametrize("model", ["lasso", "elasticnet"])
def test_panel_training_of_sparse_models(spark, model):
    res = md.train_and_evaluate(panel(spark), "y", ["a", "b", "c", "d"], "date", model, {"alpha": 0.01}, keys=["k"], n_cv_splits=3)
    assert {r["k"] for r in res.metrics.where("r2 > 0.9").collect()} == {"s0", "s1", "s2"}
    assert spark.catalog.listTables() == [] and not spark.sparkContext._jsc.getPersistentRDDs()


def test_lasso_selection_per_series(spark):
    df = panel(spark, holes=True)
    got = rd.lasso_selection(df, "y", ["a", "b", "c", "d"], 0.1, ["k"]).where("selected")
    assert {(r["k"], r["feature"]) for r in got.collect()} >= {(f"s{k}", f) for k in range(3) for f in "ab"}


# ---------------------------------------------------------------- forecasts

def wave(spark, n=96, noise=0.5, seed=1, keys=1):
    rng = np.random.default_rng(seed)
    rows, level = [], 0.0
    for k in range(keys):
        slope, level = 0.8, 100.0
        for i in range(n):
            if rng.random() < 0.15:
                slope += rng.laplace(0, 0.4)
            level += slope
            d = dt.date(2010 + i // 12, i % 12 + 1, 1)
            rows.append((k, d, level + 12 * math.sin(2 * math.pi * (d - dt.date(1970, 1, 1)).days / 365.25) + rng.normal(scale=noise)))
    return spark.createDataFrame(rows, "k int, ds date, y double")


def test_the_interval_widens_with_the_horizon(spark):
    df = wave(spark).drop("k")
    m = fc.AdditiveForecaster(fc.ForecastConfig(n_changepoints=10), ds="ds", y="y").fit(df)
    got = m.predict(m.make_future(df, 24)).orderBy("ds").collect()
    width = [r["yhat_upper"] - r["yhat_lower"] for r in got]
    ahead = width[96:]
    assert all(b > a for a, b in zip(ahead[5:], ahead[6:])) and ahead[-1] > 1.1 * max(width[20:90]) and min(width) > 0


def test_held_out_coverage_of_the_interval(spark):
    """Series as the model has them: changes of the slope in the first four fifths of the history, and after it at the same rate."""
    rng, rows, n = np.random.default_rng(6), [], 96
    for k in range(40):
        cps = {round(j * (math.floor(n * 0.8) - 1) / 10) for j in range(1, 11)}
        slope, level = 0.8, 100.0
        for i in range(n + 24):
            if i in cps or i >= n and rng.random() < 10 / n:
                slope += rng.laplace(0, 0.4)
            level += slope
            rows.append((k, dt.date(2010 + i // 12, i % 12 + 1, 1), level + rng.normal()))
    df = spark.createDataFrame(rows, "k int, ds date, y double")
    cfg = fc.ForecastConfig(yearly_seasonality=False, n_changepoints=10, changepoint_prior_scale=0.5)
    m = fc.AdditiveForecaster(cfg, keys=["k"], ds="ds", y="y").fit(df.where("ds < '2018-01-01'"))
    out = m.predict(df.where("ds >= '2018-01-01'")).withColumn("hit", F.col("y").between(F.col("yhat_lower"), F.col("yhat_upper")).cast("int"))
    near, far = (out.where(f"ds {c} '2019-01-01'").agg(F.avg("hit")).first()[0] for c in ("<", ">="))
    assert 0.6 <= near <= 0.97 and 0.6 <= far <= 0.97, (near, far)  # asked for 0.8


def test_hourly_future_with_a_regressor(spark):
    rows = [(dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), float(i), float(i % 24)) for i in range(72)]
    df = spark.createDataFrame(rows, "ds timestamp, y double, r double")
    cfg = fc.ForecastConfig(yearly_seasonality=False, n_changepoints=2, regressors=["r"])
    m = fc.AdditiveForecaster(cfg, ds="ds", y="y").fit(df)
    fut = m.make_future(df, 5, "h").orderBy("ds").collect()
    assert len(fut) == 77 and [r["r"] for r in fut[:72]] == [float(i % 24) for i in range(72)] and fut[-1]["r"] == pytest.approx(11.5)
    daily = m.make_future(df, 2, "D").orderBy("ds").collect()
    assert len(daily) == 5 and daily[0]["r"] == pytest.approx(11.5)  # rows of one time count by their mean
    table = fc.forecast_with_actuals(m.predict(m.make_future(df, 5, "h")), df.unionByName(df), [], "ds", "y")
    assert table.count() == 77 and {(r["part"], r["count"]) for r in table.groupBy("part").count().collect()} == {("history", 72), ("future", 5)}


def test_reduction_of_repeated_dates(spark):
    df = spark.createDataFrame([("2024-01-01", 1.0, float(i), 2.0 * i) for i in range(40)], "date string, y double, a double, b double")
    out, meta = rd.reduce_dimensions(df, "y", ["a", "b"], use_pca=False, feature_selection_method="none")
    assert out.count() == 40 and meta["selected_features"] == ["a", "b"] and {"a", "b"} <= set(out.columns)
