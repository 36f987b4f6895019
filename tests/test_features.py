import math

from pyspark.sql import functions as F

from almanac.operators import features as fe


def test_rolling_first_row_and_all_null(spark):
    df = spark.createDataFrame([(0, 5.0), (1, None), (2, None), (3, None), (4, 2.0)], "t int, v double")
    out = fe.create_rolling_features(df, ["v"], [2], ["mean", "std", "min", "max"], order=["t"]).orderBy("t").collect()
    assert out[0]["v_roll_2_std"] is None and out[0]["v_roll_2_mean"] == 5.0
    assert out[2]["v_roll_2_mean"] is None and out[3]["v_roll_2_max"] is None  # window of nulls only
    assert out[4]["v_roll_2_min"] == 2.0


def test_lags_count_null_rows_and_negative_lag(spark):
    df = spark.createDataFrame([(0, 1.0), (1, None), (2, 3.0)], "t int, v double")
    out = fe.create_lagged_features(df, ["v"], [1, 2, -1], order=["t"]).orderBy("t").collect()
    assert [r["v_lag_1"] for r in out] == [None, 1.0, None]
    assert [r["v_lag_2"] for r in out] == [None, None, 1.0]
    assert [r["v_lag_-1"] for r in out] == [None, 3.0, None]


def test_log_offset_rules(spark):
    df = spark.createDataFrame([(-5.0,), (0.0,), (3.0,)], "v double")
    out = [r["v_log"] for r in fe.safe_log_transform(df, ["v"], offset=1.0).collect()]
    assert math.isclose(out[0], math.log(1.0)) and math.isclose(out[2], math.log(9.0))  # offset 6


def test_fourier_positions(spark):
    df = spark.createDataFrame([(i,) for i in range(24)], "t int")
    out = fe.create_fourier_terms(df, [12], 1, order=["t"]).orderBy("t").collect()
    for r in out:
        assert math.isclose(r["sin_12_1"], math.sin(2 * math.pi * r["t"] / 12), abs_tol=1e-12)
        assert math.isclose(r["cos_12_1"], math.cos(2 * math.pi * r["t"] / 12), abs_tol=1e-12)


def test_interaction_and_missing_column(spark):
    df = spark.createDataFrame([(2.0, 3.0)], "a double, b double")
    out = fe.create_interaction_features(df, [("a", "b"), ("a", "zz")])
    assert out.columns == ["a", "b", "a_b_interaction"] and out.first()["a_b_interaction"] == 6.0


def test_keyed_equals_unkeyed_on_one_series(spark):
    df = spark.createDataFrame([(i, float(i * i % 7)) for i in range(30)], "t int, v double")
    a = fe.create_rolling_features(df, ["v"], [3], ["mean"], order=["t"])
    b = fe.create_rolling_features(df.withColumn("k", F.lit("x")), ["v"], [3], ["mean"], keys=["k"], order=["t"])
    assert sorted(a.select("t", "v_roll_3_mean").collect()) == sorted(b.select("t", "v_roll_3_mean").collect())
