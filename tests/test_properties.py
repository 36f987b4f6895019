import datetime as dt

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from almanac.operators import prepare as pr
from almanac.operators import split as sp


@settings(max_examples=6, deadline=None)
@given(st.integers(min_value=3, max_value=15), st.data())
def test_trim_is_idempotent(spark, n, data):
    # idempotent when each column's values are contiguous (a gap right at the new boundary
    # would move the first/last valid date again, as in the reference)
    spans = [sorted(data.draw(st.lists(st.integers(0, n - 1), min_size=2, max_size=2))) for _ in range(2)]
    rows = [(dt.date(2020, 1, 1) + dt.timedelta(days=31 * i),
             1.0 if spans[0][0] <= i <= spans[0][1] else None, 2.0 if spans[1][0] <= i <= spans[1][1] else None)
            for i in range(n)]
    df = spark.createDataFrame(rows, "date date, a double, b double")
    once = pr.trim_to_common_date_range(df, "date")
    twice = pr.trim_to_common_date_range(once, "date")
    assert sorted(once.collect()) == sorted(twice.collect())


@settings(max_examples=6, deadline=None)
@given(st.integers(min_value=12, max_value=400), st.integers(min_value=2, max_value=8))
def test_fold_train_never_reaches_test(spark, n, splits):
    df = spark.range(n).withColumnRenamed("id", "t")
    for f in sp.cv_folds(df, [], splits).collect():
        assert f["train_end"] <= f["test_start"] < f["test_end"] <= n
        assert f["kept"] == (f["train_end"] >= int(n * 0.7))


def test_keyed_equals_unkeyed_fill(spark):
    df = spark.createDataFrame([(i, None if i % 3 == 0 else float(i)) for i in range(40)], "t int, v double")
    a = pr.handle_missing_values(df, "forward", order=["t"], columns=["v"])
    b = pr.handle_missing_values(df.withColumn("k", F.lit(7)), "forward", keys=["k"], order=["t"], columns=["v"])
    assert sorted(a.select("t", "v").collect()) == sorted(b.select("t", "v").collect())
