import datetime as dt

import pytest
from pyspark.sql import functions as F

from almanac.operators import prepare as pr


def _dates(spark, ds):
    return spark.createDataFrame([(d,) for d in ds], "date date")


def _freq(spark, ds):
    return pr.detect_frequency(_dates(spark, ds), "date").first()["frequency"]


def _gap_series(gap, n=6):
    start = dt.date(2020, 1, 1)
    return [start + dt.timedelta(days=gap * i) for i in range(n)]


@pytest.mark.parametrize("gap,want", [(25, "monthly"), (32, "monthly"), (85, "quarterly"), (95, "quarterly"),
                                      (350, "annual"), (380, "annual"), (24, "unknown"), (33, "unknown")])
def test_frequency_bounds(spark, gap, want):
    assert _freq(spark, _gap_series(gap)) == want


def test_frequency_fallbacks(spark):
    q = [dt.date(2020, 1, 15), dt.date(2020, 4, 2), dt.date(2020, 7, 28), dt.date(2020, 10, 1), dt.date(2021, 1, 30)]
    assert _freq(spark, q) == "quarterly"
    a = [dt.date(2000, 3, 1), dt.date(2000, 3, 20), dt.date(2005, 3, 1), dt.date(2030, 3, 9)]
    assert _freq(spark, a) == "annual"


def test_frequency_short(spark):
    assert _freq(spark, []) == "unknown" or pr.detect_frequency(_dates(spark, []), "date").count() == 0
    assert _freq(spark, [dt.date(2020, 1, 1)]) == "unknown"


def test_quarterly_alignment(spark):
    df = spark.createDataFrame([(dt.date(2020, m, 1), float(m)) for m in (1, 2, 4, 7, 10)], "date date, v double")
    out = pr.align_to_monthly(df, "quarterly", "date").orderBy("date").collect()
    assert len(out) == 12
    assert out[0]["date"] == dt.date(2019, 10, 1) and out[0]["v"] == 1.0
    assert out[-1]["date"] == dt.date(2020, 9, 1) and out[-1]["v"] == 10.0


def test_annual_alignment(spark):
    df = spark.createDataFrame([(dt.date(2020, 6, 30), 5.0)], "date date, v double")
    out = pr.align_to_monthly(df, "annual", "date").collect()
    assert len(out) == 12 and all(r["v"] == 5.0 for r in out)


def test_trim_disjoint_and_dead_column(spark):
    rows = [(dt.date(2020, m, 1), float(m) if m <= 3 else None, float(m) if m >= 6 else None, None) for m in range(1, 10)]
    df = spark.createDataFrame(rows, "date date, a double, b double, dead double")
    assert pr.trim_to_common_date_range(df, "date").count() == 9          # disjoint: unchanged
    rows2 = [(dt.date(2020, m, 1), float(m) if m >= 2 else None, float(m) if m <= 7 else None, None) for m in range(1, 10)]
    df2 = spark.createDataFrame(rows2, "date date, a double, b double, dead double")
    got = sorted(r["date"].month for r in pr.trim_to_common_date_range(df2, "date").collect())
    assert got == [2, 3, 4, 5, 6, 7]                                       # dead column ignored


def test_two_stage_mean(spark):
    rows = [(1, "g1", 1.0), (2, "g1", 3.0), (3, "g2", None), (4, "g2", None), (5, None, None), (6, "g1", None)]
    df = spark.createDataFrame(rows, "id int, g string, v double")
    out = {r["id"]: r["v"] for r in pr.handle_missing_values(df, "mean", fill_groups=["g"], columns=["v"]).collect()}
    # group g1 -> 2.0; g2 all null and the null group key get the mean of the stage-1 column (1, 3, 2 -> 2.0)
    assert out == {1: 1.0, 2: 3.0, 3: 2.0, 4: 2.0, 5: 2.0, 6: 2.0}


def test_ffill_bfill_edges(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([None, 1.0, None, 2.0, None])], "t int, v double")
    f = [r["v"] for r in pr.handle_missing_values(df, "forward", order=["t"], columns=["v"]).orderBy("t").collect()]
    b = [r["v"] for r in pr.handle_missing_values(df, "backward", order=["t"], columns=["v"]).orderBy("t").collect()]
    assert f == [1.0, 1.0, 1.0, 2.0, 2.0]
    assert b == [1.0, 1.0, 2.0, 2.0, 2.0]


def test_interpolate(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([None, 1.0, None, None, 4.0, None])], "t int, v double")
    got = [r["v"] for r in pr.interpolate_linear(df, ["v"], order=["t"]).orderBy("t").collect()]
    assert got == [None, 1.0, 2.0, 3.0, 4.0, 4.0]


def test_unknown_method(spark):
    df = spark.createDataFrame([(1, 1.0)], "t int, v double")
    with pytest.raises(ValueError):
        pr.handle_missing_values(df, "nope")


def test_exact_median_matches_numpy(spark):
    import numpy as np
    vals = [3.0, 1.0, 4.0, 1.0, 5.0, 9.0, 2.0, 6.0]
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    assert pr.exact_median(df, [], ["v"]).first()["v"] == float(np.median(vals))
    assert pr.exact_median(df, [], ["v"], block_rows=3).first()["v"] == float(np.median(vals))


def test_merge_prefixes_and_spine(spark):
    m = spark.createDataFrame([(dt.date(2020, i, 1), float(i)) for i in range(1, 13)], "date date, v double")
    q = spark.createDataFrame([(dt.date(2020, i, 1), float(i)) for i in (1, 4, 7, 10)], "date date, v double")
    out = pr.merge_datasets({"m": m, "q": q}, "date")
    assert {"m_v", "q_v", "Q1", "period"} <= set(out.columns)
    assert out.count() == 15  # 2019-10 .. 2020-12
