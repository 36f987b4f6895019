import datetime as dt
import math

import numpy as np
import pytest

from almanac.operators import forecast as fc
from almanac.operators import split as sp
from almanac.operators import stats as st


def _synthetic(spark, n=120, keys=False):
    rng = np.random.default_rng(11)
    rows = []
    for k in (["a", "b"] if keys else ["a"]):
        reg = rng.normal(size=n)
        for i in range(n):
            d = dt.date(2010 + i // 12, i % 12 + 1, 1)
            y = 100 + 0.8 * i + 12 * math.sin(2 * math.pi * (d - dt.date(1970, 1, 1)).days / 365.25) + 4 * reg[i]
            y += rng.normal(scale=0.5)
            rows.append((k, d, float(y), float(reg[i])))
    return spark.createDataFrame(rows, "k string, ds date, y double, r double")


@pytest.mark.parametrize("keys", [False, True])
def test_forecast_recovers_signal(spark, keys):
    df = _synthetic(spark, keys=keys)
    k = ["k"] if keys else []
    cfg = fc.ForecastConfig(regressors=["r"])
    m = fc.AdditiveForecaster(cfg, keys=k, ds="ds", y="y")
    lab = sp.split_labels(df, k, ["ds"], "forecast", 0.2)
    m.fit(lab.where("part = 'train'"))
    pred = m.predict(lab).where("part = 'test'")
    for row in st.regression_metrics(pred, "y", "yhat", k).collect():
        assert row["mape"] < 2.0, row


def test_missing_regressor_raises(spark):
    df = _synthetic(spark)
    with pytest.raises(ValueError):
        fc.AdditiveForecaster(fc.ForecastConfig(regressors=["zz"]), ds="ds", y="y").fit(df)


def test_future_frame_and_components(spark):
    df = _synthetic(spark, n=36)
    m = fc.AdditiveForecaster(fc.ForecastConfig(regressors=["r"]), ds="ds", y="y").fit(df)
    fut = m.make_future(df.select("ds", "y", "r"), 6)
    out = m.predict(fut)
    assert out.count() == 42
    assert {"yhat", "yhat_lower", "yhat_upper", "trend", "yearly", "r"} <= set(out.columns)
    last = out.orderBy("ds").collect()[-1]
    assert last["ds"] == dt.date(2013, 6, 1) and last["yhat_lower"] < last["yhat"] < last["yhat_upper"]
