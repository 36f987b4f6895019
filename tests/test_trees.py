"""Trees fitted to cells of equal bins against MLlib's trees on the rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from almanac.operators import model as md
from almanac.operators import trees

FEATS = ["a", "b", "c"]
GBM = {"n_estimators": 8, "learning_rate": 0.1, "max_depth": 3}


def table(spark, n=6000, seed=1):
    r = np.random.default_rng(seed)
    a, b = r.integers(0, 30, n) / 2.0, r.integers(0, 7, n) - 3.0
    y = 5 * a + b * b + np.where(a > 4, 10, 0) * (b > 0) + r.normal(size=n)
    rows = list(zip(range(n), a.tolist(), b.tolist(), [1.0] * n, y.tolist()))
    return spark.createDataFrame(rows, "id int, a double, b double, c double, y double").repartition(4)


@pytest.fixture
def binned(monkeypatch):
    monkeypatch.setattr(trees, "BIN_ROWS", 1000)


@pytest.mark.parametrize("kind,params", [("gbm", GBM), ("randomforest", {"n_estimators": 2, "max_depth": 4, "bootstrap": False})])
def test_cells_give_the_trees_of_the_rows(spark, binned, kind, params):
    df = table(spark)
    got = md.train_model(df, FEATS, "y", kind, params)
    assert isinstance(got, trees.BinnedTrees)
    want = md.make_estimator(kind, params, "y").fit(md.assemble(df, FEATS))
    assert got.featureImportances.toArray() == pytest.approx(want.featureImportances.toArray(), abs=1e-9)
    other = spark.createDataFrame([(1, -9.0, 0.0, 2.0, 0.0), (2, 4.1, 0.5, 1.0, 0.0), (3, 4.25, 9.0, 1.0, 0.0), (4, None, 1.0, 1.0, 0.0)], df.schema)
    for d in (df, other):
        pair = [{r["id"]: r["prediction"] for r in md.predictions(m, d, FEATS).collect()} for m in (got, want)]
        assert pair[0] == pytest.approx(pair[1], rel=1e-9)
    assert md.predictions(got, df, FEATS).columns == [*df.columns, "prediction"]


def test_a_forest_draws_rows(spark, binned):
    df = table(spark)
    params = {"n_estimators": 30, "max_depth": 5}
    got = md.train_model(df, FEATS, "y", "randomforest", params)
    want = md.make_estimator("randomforest", params, "y").fit(md.assemble(df, FEATS))
    assert isinstance(got, trees.BinnedTrees) and len(got.models) == 30
    met = [md.evaluate_model(m, df, FEATS, "y")[1].first()["rmse"] for m in (got, want)]
    assert met[0] == pytest.approx(met[1], rel=0.02)
    assert got.featureImportances.toArray() == pytest.approx(want.featureImportances.toArray(), abs=0.01)


def test_bags_hold_poisson_counts_of_the_rows(spark):
    n, grown = 4000, 20
    one = spark.range(n).select(F.lit(0).alias("b0"), F.col("id").cast("double").alias("y"))  # one large cell
    path, schema = trees._bags(one, ["b0"], grown, 1.0, 7)
    bags = {r["tree"]: r for r in spark.read.parquet(path).groupBy("tree").agg(F.sum("w").alias("w"), (F.sum(F.expr("w * y")) / F.sum("w")).alias("m")).collect()}
    assert sorted(bags) == list(range(grown)) and len({r["w"] for r in bags.values()}) > 10
    assert np.mean([r["w"] for r in bags.values()]) == pytest.approx(n, abs=5 * (n / grown) ** 0.5)
    sd = (n * n / 12 / n) ** 0.5  # of a bag's mean
    assert np.std([r["m"] for r in bags.values()]) == pytest.approx(sd, rel=0.6)
    each = spark.range(n).select(F.col("id").cast("int").alias("b0"), F.lit(1.0).alias("y"))  # a cell a row
    w = spark.read.parquet(trees._bags(each, ["b0"], 5, 1.0, 7)[0]).select("w").toPandas()["w"]
    assert len(w) / (5 * n) == pytest.approx(1 - np.exp(-1), abs=0.02) and (w ** 2).sum() / (5 * n) == pytest.approx(2, abs=0.1)


def test_wide_columns_get_bins_of_equal_frequency(spark, binned):
    df = spark.range(4000).select(F.col("id").cast("double").alias("a"), F.lit(2.0).alias("c"), (F.col("id") * 0.5).alias("y"))
    m = md.train_model(df, ["a", "c"], "y", "gbm", GBM)
    assert isinstance(m, trees.BinnedTrees) and m.thresholds == [[125 * (i + 1) - 0.5 for i in range(31)], []]


def test_missing_values_and_unlike_rows_stay_with_mllib(spark, binned):
    df = table(spark)
    est = md.make_estimator("gbm", GBM, "y")
    for bad in (df.withColumn("a", F.when(F.col("id") != 5, F.col("a"))), df.withColumn("y", F.when(F.col("id") != 5, F.col("y")).otherwise(float("nan")))):
        assert trees.fit_binned(bad, FEATS, "y", est) is None
    r = df.select(*[F.rand(i).alias(c) for i, c in enumerate(FEATS)], "y")
    assert trees.fit_binned(r, FEATS, "y", est) is None
