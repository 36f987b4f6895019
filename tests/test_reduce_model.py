import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from almanac.operators import model as md
from almanac.operators import reduce as rd
from almanac.operators import split as sp
from almanac.operators import stats as st
from almanac.operators.diagnostics import residual_tests


def test_correlation_filter_order_and_constant(spark):
    rows = [(float(i), 2.0 * i, 3.0 * i + 1, 1.0, float((i * 7) % 5)) for i in range(20)]
    df = spark.createDataFrame(rows, "a double, b double, c double, k double, z double")
    kept = rd.kept_features(rd.correlation_filter(df, ["a", "b", "c", "k", "z"]))
    assert kept == ["a", "k", "z"]


def test_pca_threshold_rule():
    assert rd.components_for_threshold([0.6, 0.3, 0.1], 0.85) == 2
    assert rd.components_for_threshold([0.6, 0.3, 0.1], 1.0) == 3


def test_pca_matches_numpy(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 4)) @ rng.normal(size=(4, 4))
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double, d double")
    res = rd.fit_pca(df, ["a", "b", "c", "d"])
    z = (x - x.mean(0)) / x.std(0)
    ev = np.linalg.eigvalsh(np.cov(z.T))[::-1]
    assert np.allclose(res.explained_ratio, ev / ev.sum(), atol=1e-9)
    for j in range(4):
        assert res.components[np.argmax(np.abs(res.components[:, j])), j] > 0


def test_folds_and_split_rules(spark):
    df = spark.createDataFrame([(i,) for i in range(107)], "t int")
    kept = sp.cv_folds(df, [], 5).where("kept").collect()
    assert [(r["train_end"], r["test_end"] - r["test_start"]) for r in kept] == [(90, 17)]
    parts = {r["part"]: r["count"] for r in sp.split_labels(df, [], ["t"], "train_test", 0.2).groupBy("part").count().collect()}
    assert parts == {"train": 86, "test": 21}
    parts = {r["part"]: r["count"] for r in sp.split_labels(df, [], ["t"], "forecast", 0.2).groupBy("part").count().collect()}
    assert parts == {"train": 85, "test": 22}


def test_mape_with_zeros(spark):
    df = spark.createDataFrame([(0.0, 1.0), (2.0, 1.0)], "y double, p double")
    assert math.isclose(st.regression_metrics(df, "y", "p").first()["mape"], 50.0)
    df0 = spark.createDataFrame([(0.0, 1.0), (0.0, 1.0)], "y double, p double")
    m = st.regression_metrics(df0, "y", "p").first()
    assert m["mape"] is None and m["r2"] == 0.0


def test_durbin_watson_bounds(spark):
    # residuals alternating +1/-1 give DW near 4; constant sign near 0
    df = spark.createDataFrame([(i, float((-1) ** i)) for i in range(50)], "t int, e double")
    r = residual_tests(df, "e", None, order=["t"]).first()
    assert r["durbin_watson_interpretation"] == "Negative autocorrelation"
    assert 0 <= r["ljung_box_pvalue"] <= 1


def _xy(n=200, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3)) * [1.0, 3.0, 0.5]
    y = 2.0 + x @ [1.5, -0.7, 3.0] + rng.normal(scale=2.5, size=n)
    return x, y


def test_normal_equations_and_ridge(spark):
    x, y = _xy()
    df = spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, y)], "a double, b double, c double, y double")
    ols = md.fit_linear_per_series(df, [], ["a", "b", "c"], "y").first()
    xc, yc = x - x.mean(0), y - y.mean()
    w = np.linalg.lstsq(xc, yc, rcond=None)[0]
    assert np.allclose([ols["a"], ols["b"], ols["c"]], w, atol=1e-9)
    alpha = 10.0
    wr = np.linalg.solve(xc.T @ xc + alpha * np.eye(3), xc.T @ yc)
    ridge = md.fit_linear_per_series(df, [], ["a", "b", "c"], "y", alpha).first()
    assert np.allclose([ridge["a"], ridge["b"], ridge["c"]], wr, atol=1e-9)
    # the MLlib path with the mapped regParam agrees with the closed form
    m = md.train_model(df, ["a", "b", "c"], "y", "ridge", {"alpha": alpha})
    assert np.allclose(m.coefficients.toArray(), wr, atol=1e-6)


def test_unknown_model_type():
    with pytest.raises(ValueError):
        md.make_estimator("nope")
