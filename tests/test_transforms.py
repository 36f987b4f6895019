import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from almanac.operators.transforms import SeriesTransformer, TransformationPipeline


def _df(spark, xs):
    return spark.createDataFrame([(i, float(x) if x is not None else None) for i, x in enumerate(xs)], "t int, x double")


def _vals(df):
    return [r["x"] for r in df.orderBy("t").collect()]


def test_constant_scaling(spark):
    df = _df(spark, [5, 5, 5])
    for kind in ("standardize", "normalize"):
        assert _vals(SeriesTransformer().fit_transform(df, ["x"], [kind])) == [0.0, 0.0, 0.0]


def test_log_offset_min_zero(spark):
    df = _df(spark, [0, 1, 2])
    t = SeriesTransformer()
    out = _vals(t.fit_transform(df, ["x"], ["log"]))
    assert math.isclose(out[0], 0.0)  # offset abs(0) + 1


def test_diff_inverse_with_gap_poisons_class(spark):
    xs = [1, 2, 3, 5, 8, 13, 21, 34, 55, 89]
    df = _df(spark, xs)
    t = SeriesTransformer(order=["t"])
    d = t.fit_transform(df, ["x"], ["diff"], {"diff_lag": 3})
    d = d.withColumn("x", F.when(F.col("t") == 4, F.lit(None)).otherwise(F.col("x")))
    back = _vals(t.inverse_transform(d))
    want = [float(x) for x in xs]
    for i in range(10):
        if i >= 4 and i % 3 == 1:
            assert back[i] is None
        else:
            assert math.isclose(back[i], want[i])


@pytest.mark.parametrize("lam", [-1.0, 0.0, 0.5, 1.0, 1.7, 2.0, 3.0])
def test_yeo_johnson_round_trip(spark, lam):
    xs = [-3.5, -1.0, -0.2, 0.0, 0.3, 1.0, 4.2]
    df = _df(spark, xs)
    t = SeriesTransformer()
    back = _vals(t.inverse_transform(t.fit_transform(df, ["x"], ["yeo_johnson"], {"yeo_johnson_lambda": lam})))
    assert np.allclose(back, xs, atol=1e-9)


@pytest.mark.parametrize("lam", [0.0, 0.5, 1.0, -1.0])
def test_box_cox_round_trip(spark, lam):
    for xs in ([0.5, 1.0, 3.0, 7.5], [-2.0, 0.0, 1.0, 5.0]):
        df = _df(spark, xs)
        t = SeriesTransformer()
        back = _vals(t.inverse_transform(t.fit_transform(df, ["x"], ["box_cox"], {"box_cox_lambda": lam})))
        assert np.allclose(back, xs, atol=1e-9)


def _bc_llf(x, lam):
    y = np.log(x) if abs(lam) < 1e-10 else (x ** lam - 1) / lam
    return (lam - 1) * np.log(x).sum() - len(x) / 2 * np.log(y.var())


def test_box_cox_mle_matches_brute_force(spark):
    rng = np.random.default_rng(7)
    xs = rng.lognormal(1.0, 0.6, 400)
    t = SeriesTransformer()
    t.fit_transform(_df(spark, xs), ["x"], ["box_cox"])
    lam = t.steps[0].fitted.row["x__lam"]
    grid = np.linspace(lam - 0.05, lam + 0.05, 2001)
    best = grid[np.argmax([_bc_llf(xs, g) for g in grid])]
    assert abs(best - lam) < 1e-3


def test_pipeline_chain_round_trip(spark):
    xs = [3.0, 1.0, 4.0, 1.0, 5.0, 9.0, 2.0, 6.0, 5.0, 3.0, 5.0, 8.0, 9.0, 7.0]
    df = _df(spark, xs)
    p = TransformationPipeline(order=["t"]).add_step(["x"], ["log", "diff"]).add_step(["x"], ["standardize"])
    back = _vals(p.inverse_transform(p.fit_transform(df)))
    assert np.allclose(back, xs, atol=1e-9)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.floats(min_value=-1e3, max_value=1e3, allow_nan=False), min_size=3, max_size=12),
       st.sampled_from(["log", "sqrt", "standardize", "normalize", "yeo_johnson"]))
def test_round_trip_property(spark, xs, kind):
    df = _df(spark, xs)
    t = SeriesTransformer()
    params = {"yeo_johnson_lambda": 0.7}
    back = _vals(t.inverse_transform(t.fit_transform(df, ["x"], [kind], params)))
    assert np.allclose(back, xs, atol=1e-6, rtol=1e-9)
