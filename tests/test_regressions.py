"""Faults of an earlier round stay mended."""

import datetime as dt
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from almanac.operators import forecast, model, prepare, reduce, transforms
from almanac.plans.ordered import IDX, series_plan
from almanac.plans.pipeline import _fill_groups
from almanac.sources import io
from almanac.sources import series as S
from tests.conftest import SF


def test_a_tied_value_spreads_over_tasks(spark):
    df = spark.range(4000).select(F.lit(5.0).alias("v"), F.col("id"))
    for order, ties in ((["v"], "row"), (["v"], "min"), (["v", "id"], "row")):
        out = series_plan(df, [], order, block_rows=100).index(df, ties=ties)
        got = sorted(r[IDX] for r in out.collect())
        assert got == ([0] * 4000 if ties == "min" else list(range(4000)))
        if len(order) == 2:
            assert all(r[IDX] == r["id"] for r in out.collect())
        parts = series_plan(df, [], order, block_rows=100)._ranged(df, "part", "at").groupBy("part").count().collect()
        assert max(r["count"] for r in parts) < 1000


def test_unkeyed_series_are_cut_without_a_single_task(spark):
    ev = S.events_with_gaps(spark, SF.replace("0.001", "0.01")).unionByName(S.events_with_gaps(spark, SF))
    plan = series_plan(ev, [], ["ts", "event_id"])
    assert plan.blocked and plan.block_rows * int(spark.conf.get("spark.sql.shuffle.partitions")) >= plan.rows


def test_lambda_search_widens(spark):
    x = np.arange(1, 400) ** (1 / 8.5)
    found = transforms.fit_lambda(spark.createDataFrame([(float(v),) for v in x], "x double"), [], {"x": F.col("x")}, "box_cox").row["x__lam"]

    def likelihood(lam):
        return (lam - 1) * np.log(x).sum() - len(x) / 2 * np.log(np.var((x ** lam - 1) / lam))

    best = max(np.arange(1, 20, 0.01), key=likelihood)
    assert best > 5.3 and abs(found - best) < 0.02


def test_bounds_keep_the_time_of_day():
    assert io._as_date("2024-01-01 12:00") == dt.datetime(2024, 1, 1, 12) and io._as_date("2024-01-01") == dt.date(2024, 1, 1)


def test_datasets_below_a_folder_of_the_same_name(spark, tmp_path):
    root = tmp_path / "exports"
    for part in ("a.csv", "exports/b.csv"):
        os.makedirs((root / part).parent, exist_ok=True)
        (root / part).write_text("x\n1\n")
    assert {r["dataset"] for r in io.read_datasets(spark, str(root)).collect()} == {"a", "exports"}


def test_run_ids_differ_within_a_second():
    when = dt.datetime(2024, 1, 1)
    assert io.run_id("linear", when) != io.run_id("linear", when)


def test_ordered_output(spark, tmp_path):
    path = io.write_table(spark.range(1000).select((F.lit(1000) - F.col("id")).alias("x")), str(tmp_path / "t"), sort_by=["x"])
    files = sorted(f for f in os.listdir(path) if f.endswith(".parquet"))
    rows = [r["x"] for f in files for r in spark.read.parquet(f"{path}/{f}").collect()]
    assert rows == sorted(rows)


def test_selectors_take_null_features(spark):
    df = spark.createDataFrame([(float(i), float(i % 7) if i % 5 else None, float(i * 2)) for i in range(60)], "y double, a double, b double")
    assert reduce.lasso_selection(df, "y", ["a", "b"], 0.01).count() == 2
    assert reduce.mutual_info_scores(df, "y", ["a", "b"]).orderBy("rank").first()["feature"] == "b"
    kept, meta = reduce.reduce_dimensions(df.withColumn("date", F.lit("2024-01-01")), "y", ["a", "b"], use_pca=False, feature_selection_method="lasso")
    assert "a" not in kept.columns or kept.where("a IS NULL").count() == 12


def test_training_uses_fill_groups(spark):
    rows = [(dt.date(2020, 1, 1) + dt.timedelta(days=i), i % 2, float(i % 2 * 100 + i), None if i % 10 == 3 else float(i % 2 * 100)) for i in range(60)]
    df = spark.createDataFrame(rows, "date date, g int, y double, x double")
    grouped = model.train_and_evaluate(df, "y", ["x"], use_cv=False, fill_groups=["g"]).metrics.first()["rmse"]
    plain = model.train_and_evaluate(df, "y", ["x"], use_cv=False).metrics.first()["rmse"]
    assert grouped < plain


def test_model_defaults_and_limits():
    assert model.make_estimator("lasso", {}, "y").getRegParam() == 1.0
    with pytest.raises(ValueError):
        model.make_estimator("randomforest", {"max_depth": 31}, "y")
    assert model.make_estimator("randomforest", {}, "y").getMaxDepth() == 30


def test_fill_groups_follow_the_frequency():
    assert _fill_groups("quarterly") == ["year", "quarter"] and _fill_groups("annual") is None and _fill_groups("unknown") is None


def test_unknown_frequency_is_an_error(spark):
    with pytest.raises(ValueError):
        prepare.future_frame(spark.createDataFrame([(dt.date(2024, 1, 1),)], "date date"), "date", 1, freq="X")


def test_hourly_future(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1, 22, 30),)], "date timestamp")
    got = [r["date"] for r in prepare.future_frame(df, "date", 2, freq="h", include_history=False).orderBy("date").collect()]
    assert got == [dt.datetime(2024, 1, 1, 23), dt.datetime(2024, 1, 2, 0)]


def test_target_is_carried(spark):
    df = spark.createDataFrame([(dt.date(2024, 1, d), v) for d, v in ((1, None), (2, 1.0), (3, None), (4, 2.0))], "ds date, y double")
    assert [r["y"] for r in forecast.carry_target(df, "y").orderBy("ds").collect()] == [1.0, 1.0, 1.0, 2.0]


def test_training_scope_and_panel_models(spark):
    rows = [(k, i, float(i), None if i % 3 == 0 else float(i % 7), 2.0 * (i % 7) + (10 if k == "b" else 0))
            for k in "ab" for i in range(40)]
    df = spark.createDataFrame(rows, "k string, date int, t double, x double, y double")
    for scope in ("all", "train"):
        res = model.train_and_evaluate(df, "y", ["t", "x"], "date", "linear", use_cv=True, keys=["k"], fit_scope=scope)
        assert {r["k"]: r["n"] for r in res.metrics.collect()} == {"a": 8, "b": 8}
        assert res.cv_summary.count() == 2 and res.importances.count() == 4
    with pytest.raises(ValueError):
        model.train_and_evaluate(df, "y", ["t"], "date", "gbm", keys=["k"])
    with pytest.raises(ValueError):
        model.train_and_evaluate(df, "y", ["t"], "date", "linear", fit_scope="test")


def test_lambda_of_constant_values(spark):
    df = spark.createDataFrame([(4.0,)] * 5, "x double")
    assert transforms.fit_lambda(df, [], {"x": F.col("x")}, "box_cox").row["x__lam"] == 1.0


def test_normal_quantile_expression(spark):
    from statistics import NormalDist

    from almanac.functions.formulas import normal_ppf_sql
    ps = [1e-300, 1e-12, 0.01, 0.074, 0.076, 0.3, 0.5, 0.8, 0.95, 1 - 1e-9]
    got = spark.createDataFrame([(p,) for p in [*ps, 0.0, 1.0]], "p double").select(F.expr(normal_ppf_sql("p"))).collect()
    assert [r[0] for r in got[:-2]] == pytest.approx([NormalDist().inv_cdf(p) for p in ps], rel=1e-12, abs=1e-12)
    assert got[-2][0] is None and got[-1][0] is None
