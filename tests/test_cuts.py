"""Exact cuts of equal-frequency bins against sorting."""

import math
import random

import pytest
from pyspark.sql import types as T

from almanac.operators import stats


def sorted_cuts(values, bins):
    v = sorted(math.inf if math.isnan(x) else x for x in values if x is not None)
    n = len(v)
    return [v[-(-j * n // bins) - 1] for j in range(1, bins)] if n else []


@pytest.mark.parametrize("bins", [2, 4, 10])
@pytest.mark.parametrize("limit", [100_000, 20])
def test_cuts_equal_sorting(spark, monkeypatch, bins, limit):
    monkeypatch.setattr(stats, "CUT_ROWS", limit)
    monkeypatch.setattr(stats, "CUT_SAMPLE", 500)
    r = random.Random(bins)
    n = 4_000
    cols = {"u": [r.random() for _ in range(n)], "ties": [float(r.choice((1, 1, 1, 2, 7))) for _ in range(n)], "const": [3.0] * n,
            "holes": [None if r.random() < 0.3 else r.gauss(0, 1) for _ in range(n)], "empty": [None] * n, "near": [1.0 + r.randrange(3) * 2.0 ** -52 for _ in range(n)],
            "wild": [r.choice((math.inf, -math.inf, math.nan, 0.0, -0.0, 1e300, r.random())) for _ in range(n)]}
    schema = T.StructType([T.StructField(c, T.DoubleType()) for c in cols])
    df = spark.createDataFrame(list(zip(*cols.values())), schema).repartition(6)
    got = stats.exact_cuts(df, list(cols), bins)
    assert got == {c: sorted_cuts(v, bins) for c, v in cols.items()}


def test_cuts_of_an_empty_table(spark):
    assert stats.exact_cuts(spark.createDataFrame([], "a double, b double"), ["a", "b"], 4) == {"a": [], "b": []}
