"""Blocked plan == plain window, keyed and unkeyed; no single-partition exchange on the
row-level path of a blocked plan."""
import math

import pytest
from pyspark.sql import functions as F

from almanac.plans.ordered import IDX, series_plan
from almanac.sources import series as S
from conftest import SF01


def _run(ev, keys, block_rows):
    p = series_plan(ev, keys, ["ts", "event_id"], block_rows=block_rows)
    d = p.index(ev)
    d = p.bounded(d, lambda w: {"lag2": F.lag("value", 2).over(w), "r3": F.avg("value").over(w.rowsBetween(-2, 0)),
                                "ld1": F.lead("value", 1).over(w)}, back=2, fwd=1)
    d = p.scan(d, [("ff", "last", F.col("value")), ("bf", "first", F.col("value")), ("cs", "sum", F.col("value"))])
    return p, {r["event_id"]: r for r in d.select("event_id", IDX, "lag2", "r3", "ld1", "ff", "bf", "cs").collect()}


def _same(a, b):
    if a is None or b is None:
        return a is None and b is None
    return math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)


@pytest.mark.parametrize("keys", [[], ["user_id"]])
def test_blocked_equals_plain(spark, keys):
    ev = S.events_with_gaps(spark, SF01)
    p1, plain = _run(ev, keys, 10 ** 9)
    p2, blocked = _run(ev, keys, 53)
    assert not p1.blocked and p2.blocked
    assert plain.keys() == blocked.keys()
    for k, r in plain.items():
        for c in (IDX, "lag2", "r3", "ld1", "ff", "bf", "cs"):
            assert _same(r[c], blocked[k][c]), (k, c, r[c], blocked[k][c])


def test_a_hot_key_is_indexed_over_several_ranges(spark):
    ev = S.table(spark, SF01, "events").select("event_id", "ts", "value",
                                               F.when(F.col("user_id") < 20, 0).otherwise(F.col("user_id")).alias("u"))
    p = series_plan(ev, ["u"], ["ts", "event_id"], block_rows=300)
    assert p.blocked and p.rows == ev.count()
    got = {r["event_id"]: r[IDX] for r in p.index(ev).collect()}
    q = series_plan(ev, ["u"], ["ts", "event_id"], block_rows=10 ** 9)
    want = {r["event_id"]: r[IDX] for r in q.index(ev).collect()}
    assert got == want
    parts = p._ranged(ev, "part", "at").where("u = 0").groupBy("part").count().collect()
    assert len(parts) > 1


MINUTES = "cast(timestampadd(MINUTE, cast(id as int), timestamp'2024-01-01') as string)"


@pytest.mark.parametrize("order", [MINUTES, "cast(id as decimal(30,9)) / 7", "if(id % 3 = 0, null, 'same')", "cast(null as date)", "id % 2 = 0",
                                   "cast(concat('prefix-', lpad(cast(id as string), 9, '0')) as binary)"])
def test_order_values_of_any_type_spread(spark, order):
    df = spark.range(20_000).selectExpr("id", f"{order} as o", "map('a', 1) as m")
    p = series_plan(df, [], ["o", "id"], block_rows=1_000)
    sizes = [r["count"] for r in p._ranged(df, "part", "at").groupBy("part").count().collect()]
    assert max(sizes) < 4_000 and sum(sizes) == 20_000
    plain = series_plan(df, [], ["o", "id"], block_rows=10 ** 9)
    plain.blocked = False
    assert ({r["id"]: r[IDX] for r in p.index(df).select("id", IDX).collect()}
            == {r["id"]: r[IDX] for r in plain.index(df).select("id", IDX).collect()})


def test_ties_take_the_smallest_position(spark):
    df = spark.range(3_000).selectExpr("id", "id % 3 as k", "cast(id % 10 as string) as v")
    p = series_plan(df, ["k"], ["v"], block_rows=100)
    got = {(r["k"], r["v"]): r["r"] for r in p.index(df, "r", ties="min").collect()}
    plain = series_plan(df, ["k"], ["v"], block_rows=10 ** 9)
    assert p.blocked and got == {(r["k"], r["v"]): r["r"] for r in plain.index(df, "r", ties="min").collect()}


#: Names that earlier plans used for working columns of their own.
OWN = ["_x", "_x2", "_hot", "_bkd", "_bk", "_sub", "_off", "_n", "_c", "_blk", "_home", "__n", "__part", "__at", "__tie", "__block", "__copy", "__off",
       "__home", "__rk0", "n"]


@pytest.mark.parametrize("keys", [[], ["n"]])
def test_no_column_of_the_input_is_lost(spark, keys):
    from almanac.operators import features, prepare, split
    df = spark.range(20_000).select("id", *[(F.col("id") % (i + 3)).alias(c) for i, c in enumerate(OWN)],
                                    F.when(F.col("id") % 4 > 0, F.col("id").cast("double")).alias("v"))
    with_block = dict(keys=keys, order=["id"], block_rows=700)
    outs = [features.create_lagged_features(df, ["v"], [1, 3], **with_block), prepare.interpolate_linear(df, ["v"], **with_block),
            prepare.handle_missing_values(df, "forward", columns=["v"], **with_block), split.split_labels(df, **with_block)]
    added = [{"v_lag_1", "v_lag_3"}, set(), set(), {"part", "idx"}]
    want = {tuple(r) for r in df.drop("v").collect()}
    for out, more in zip(outs, added):
        assert set(out.columns) == {*df.columns, *more}
        assert {tuple(r) for r in out.select(*df.drop("v").columns).collect()} == want


def test_blocked_plan_has_no_single_partition_exchange(spark):
    ev = S.events_with_gaps(spark, SF01)
    p = series_plan(ev, [], ["ts", "event_id"], block_rows=500)
    d = p.bounded(p.index(ev), lambda w: {"lag1": F.lag("value", 1).over(w)}, back=1)
    plan = d._jdf.queryExecution().executedPlan().toString()
    # the only single-partition step allowed is over the tiny bucket-count table
    row_level = [line for line in plan.splitlines() if "SinglePartition" in line]
    assert len(row_level) <= 1


def test_frames_wider_than_a_block(spark):
    ev = S.events_with_gaps(spark, SF01)
    build = lambda w: {"x": F.lag("value", 23).over(w), "z": F.lead("value", 12).over(w)}
    got = []
    for rows in (5, 10 ** 9):
        p = series_plan(ev, ["user_id"], ["ts", "event_id"], block_rows=rows)
        got.append({r["event_id"]: (r["x"], r["z"]) for r in p.bounded(p.index(ev), build, back=23, fwd=12).collect()})
    assert got[0] == got[1]


def test_series_hint_reuses_decision(spark):
    from almanac.plans.ordered import series_hint
    ev = S.events_with_gaps(spark, SF01)
    measured = series_plan(ev, ["user_id"], ["ts", "event_id"], block_rows=53)
    with series_hint(measured):
        p = series_plan(ev.withColumn("x", F.lit(1)), ["user_id"], ["ts"])
    assert p.blocked and p.rows == measured.rows and p.block_rows == 53 and p.order == ["ts"]
    assert not series_plan(ev, ["user_id"], ["ts"], block_rows=10 ** 9).blocked
