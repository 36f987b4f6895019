"""Aggregations and statistics (AGG1-AGG14).

Everything is one or two passes of partial/final hash aggregation. Exact quantiles use the
distributed row index (rank, then pick the middle ranks) instead of a percentile buffer, so
a hot group is never held in one task's memory."""

from __future__ import annotations

import bisect
import itertools
import math
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from almanac.plans.fitted import Fitted
from almanac.plans.ordered import IDX, colocate_series, join_on_keys, series_plan
from almanac.plans.staged import staged
from almanac.session import ensure_checkpoint_dir

#: Matrix cells that a task holds at most (128 MB) before it hands its partial sums on.
PARTIAL_CELLS = 16_000_000


def pearson(a: Column, b: Column) -> Column:
    """Pearson correlation as an aggregate that is NULL (not an error under ANSI mode) when
    either side is constant: covar_pop / (sd_pop(a) * sd_pop(b)), both over the rows where
    a and b are present."""
    both = a.isNotNull() & b.isNotNull()
    x, y = F.when(both, a), F.when(both, b)
    den = F.stddev_pop(x) * F.stddev_pop(y)
    return F.when(den > 0, F.covar_pop(x, y) / den)


def value_ranks(df: DataFrame, keys: Sequence[str], value: str, sums: dict[str, Column] | None = None,
                block_rows: int | None = None) -> DataFrame:
    """One row per distinct non-null value of each series: keys, ``value``, ``__c`` (its rows), ``__r0``
    (rows with a smaller value), ``__n`` (rows of the series) and the given ``sums`` over its rows.

    Equal values are counted before the shuffle, so ties cost nothing; the distinct values are checkpointed
    once and everything after that (sizes, cuts, running sum) reads them instead of the input."""
    keys = list(keys)
    ensure_checkpoint_dir(df.sparkSession)
    d = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(
        F.count(F.lit(1)).alias("__c"), *[c.alias(n) for n, c in (sums or {}).items()]).checkpoint()
    plan = series_plan(d, keys, [value], block_rows)
    if plan.blocked:
        d = plan.index(d)
    d = plan.scan(d, [("__r0", "sum", F.col("__c"))]).withColumn("__r0", F.col("__r0") - F.col("__c")).drop(IDX)
    if plan.blocked:
        return plan.with_stats(d, {"__n": F.sum("__c")})
    return d.withColumn("__n", F.sum("__c").over(Window.partitionBy(*keys)))


#: Rows of the sample that brackets the cuts at first, relative rank error of its sketch, values between two brackets that are ranked at once.
CUT_SAMPLE, CUT_ACCURACY, CUT_ROWS = 100_000, 2_000, 100_000


def exact_cuts(df: DataFrame, columns: Sequence[str], bins: int) -> dict[str, list[float]]:
    """Upper ends of all but the last of ``bins`` equal-frequency bins of each column, exactly: the values at 0-based ranks
    ceil(j n / bins) - 1 of its n values, NULLs left out and NaN taken for infinity. No column is sorted: quantiles of a sample bracket every cut, one pass counts
    all values at and between the brackets, and only values that lie in the gap with the cut are ranked; a gap
    of more than ``CUT_ROWS`` values is bracketed again, by a sketch of its values. Where a bracket lies changes the work only. What reaches the driver are counts of columns x cuts."""
    cols = list(columns)
    value = lambda c: F.col(c).cast("double")
    d = staged(df.select(*[F.when(F.isnan(value(c)), float("inf")).otherwise(value(c) + 0.0).alias(f"c{i}") for i, c in enumerate(cols)]), "cuts")
    probs = sorted({min(1.0, max(0.0, j / bins + e)) for j in range(1, bins) for e in (-0.006, 0.006)})
    rows = d.count()
    some = d.sample(CUT_SAMPLE / rows, seed=7) if rows > 2 * CUT_SAMPLE else d
    first = some.agg(*[F.percentile_approx(f"c{i}", probs, CUT_ACCURACY).alias(f"b{i}") for i in range(len(cols))]).first()
    bounds = [_finite(first[f"b{i}"] or []) for i in range(len(cols))]
    cuts: list[list] = [[] for _ in cols]
    stuck: set[tuple[int, int]] = set()  # gaps of infinite or equal values, which no bound divides
    while True:
        held = _counted(d, bounds)
        gaps: dict[tuple[int, int], list[tuple[int, int]]] = {}  # (column, gap): (cut, rank in the gap)
        for i, counts in enumerate(held):
            n, at = sum(counts), 0
            cuts[i] = [None] * (bins - 1 if n else 0)
            upto = list(itertools.accumulate(counts))
            for j in range(len(cuts[i])):
                rank = -(-(j + 1) * n // bins) - 1
                while upto[at] <= rank:
                    at += 1
                if at % 2:  # values that equal a bound
                    cuts[i][j] = bounds[i][at // 2]
                else:
                    gaps.setdefault((i, at // 2), []).append((j, rank - (upto[at] - counts[at])))
        wide = [g for g in gaps if held[g[0]][2 * g[1]] > CUT_ROWS and (g[0], bounds[g[0]][g[1] - 1] if g[1] else None) not in stuck]
        if not wide:
            break
        probs = [k / 200 for k in range(1, 200)]
        inner = d.agg(*[F.percentile_approx(F.when(_in_gap(i, g, bounds[i]), F.col(f"c{i}")), probs, CUT_ACCURACY).alias(f"g{t}")
                        for t, (i, g) in enumerate(wide)]).first()
        found = [(i, bounds[i][g - 1] if g else None, _finite(inner[f"g{t}"])) for t, (i, g) in enumerate(wide)]
        for i, low, more in found:
            if set(more) <= set(bounds[i]):
                stuck.add((i, low))
            bounds[i] = _finite([*bounds[i], *more])
    if gaps:
        places, placed = _placed(d, bounds)
        of = {(i, p): t for t, (i, g) in enumerate(gaps) for p, place in enumerate(places[i]) if place == 2 * g}
        t = F.coalesce(*[F.when((F.col("i") == i) & (F.col("p") == p), t) for (i, p), t in of.items()])
        wanted = reduce(lambda a, b: a | b, [(F.col("i") == i) & F.col("p").isin([p for j, p in of if j == i]) for i in {j for j, _ in of}])
        values = placed.where(wanted).select(t.alias("t"), "v")
        ranked = values.groupBy("t", "v").count().withColumn("upto", F.sum("count").over(Window.partitionBy("t").orderBy("v")))
        wanted = {t: ranks for t, ranks in enumerate(gaps.values())}
        hit = reduce(lambda a, b: a | b, [(F.col("t") == t) & (F.col("upto") - F.col("count") <= r) & (F.col("upto") > r)
                                          for t, ranks in wanted.items() for _, r in ranks])
        found = ranked.where(hit).collect()  # at most one row a cut
        for t, (i, _) in enumerate(gaps):
            for j, r in wanted[t]:
                cuts[i][j] = next(x["v"] for x in found if x["t"] == t and x["upto"] - x["count"] <= r < x["upto"])
    return dict(zip(cols, cuts))


def _in_gap(i: int, gap: int, bounds: list[float]) -> Column:
    """Whether a value of column ``i`` lies between the bounds around ``gap``."""
    low = F.col(f"c{i}") > bounds[gap - 1] if gap else F.lit(True)
    return low & (F.col(f"c{i}") < bounds[gap]) if gap < len(bounds) else low & F.col(f"c{i}").isNotNull()


def _finite(values: Sequence[float]) -> list[float]:
    return sorted({x for x in values if math.isfinite(x)})


def _placed(d: DataFrame, bounds: list[list[float]]) -> tuple[list[list[int]], DataFrame]:
    """Rows i (column), p (bucket) and v of all values, and the place of each bucket: twice the bounds below it, one more for
    the bucket that a bound and the next double make, which holds this bound alone."""
    splits = [sorted({-math.inf, math.inf, *([] if b else [0.0]), *b, *(math.nextafter(x, math.inf) for x in b)}) for b in bounds]
    n = range(len(bounds))
    bucketed = Bucketizer(splitsArray=splits, inputCols=[f"c{i}" for i in n], outputCols=[f"p{i}" for i in n], handleInvalid="keep").transform(d)
    pairs = F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"p{i}").cast("int").alias("p"), F.col(f"c{i}").alias("v")) for i in n])
    places = [[2 * bisect.bisect_left(b, low) + (low in b) for low in of[:-1]] for b, of in zip(bounds, splits)]
    return places, bucketed.select(F.explode(pairs).alias("s")).select("s.*").where("v IS NOT NULL")


def _counted(d: DataFrame, bounds: list[list[float]]) -> list[list[int]]:
    """Values per column in the gaps (even places) and at the bounds (odd places)."""
    places, placed = _placed(d, bounds)
    out = [[0] * (2 * len(b) + 1) for b in bounds]
    for r in placed.groupBy("i", "p").count().collect():
        out[r["i"]][places[r["i"]][r["p"]]] += r["count"]
    return out


def exact_quantiles(df: DataFrame, group: Sequence[str], col: str, probs: Sequence[float],
                    names: Sequence[str] | None = None, block_rows: int | None = None) -> DataFrame:
    """Linear-interpolated quantiles per group (numpy / pandas default), exact."""
    group = list(group)
    names = list(names or [f"q{int(round(p * 100))}" for p in probs])
    r = value_ranks(df.select(*group, F.col(col).alias("__v")), group, "__v", block_rows=block_rows)
    pos = [F.lit(p) * (F.col("__n") - 1) for p in probs]

    def holds(x: Column) -> Column:
        return (F.col("__r0") <= x) & (x < F.col("__r0") + F.col("__c"))

    r = r.where(reduce(lambda a, b: a | b, [holds(F.floor(x)) | holds(F.ceil(x)) for x in pos]))
    aggs = []
    for x, n in zip(pos, names):
        lo_v = F.max(F.when(holds(F.floor(x)), F.col("__v")))
        hi_v = F.max(F.when(holds(F.ceil(x)), F.col("__v")))
        frac = F.max(x - F.floor(x))
        aggs.append((lo_v + (hi_v - lo_v) * frac).alias(n))
    return r.groupBy(*group).agg(*aggs)


def column_stats(df: DataFrame, columns: Sequence[str], stats: Sequence[str] = ("mean", "min", "max"),
                 keys: Sequence[str] = ()) -> DataFrame:
    """Long table (keys..., column, stat values) from one aggregate over all columns (AGG2)."""
    fns = {"mean": F.avg, "min": F.min, "max": F.max, "sd": F.stddev_samp, "sd_pop": F.stddev_pop,
           "count": F.count, "sum": F.sum}
    keys = list(keys)
    wide = df.groupBy(*keys).agg(*[fns[s](c).cast("double").alias(f"{c}__{s}") for c in columns for s in stats])
    parts = ", ".join(f"'{c}', " + ", ".join(f"`{c}__{s}`" for s in stats) for c in columns)
    names = ", ".join(["column", *stats])
    return wide.select(*keys, F.expr(f"stack({len(columns)}, {parts}) as ({names})"))


def corr_pairs(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = (), absolute: bool = False,
               upper_only: bool = True) -> DataFrame:
    """Pearson correlation of every column pair, pairwise-complete (a pair uses the rows where
    both are present), long output (keys..., a, b, r) with a before b in column order; NULL
    when either side is constant on those rows (AGG6, AGG7).

    Values are centred by the column means (one aggregate), then every task computes its
    partial pair statistics with five p x p matrix products in NumPy (counts, masked sums,
    masked squares, cross-products); a Spark group aggregate adds the partials, so p(p-1)/2
    pairs never become p^2 aggregate expressions and no group meets in one task."""
    keys = list(keys)
    cols = list(columns)
    p = len(cols)
    means = Fitted.fit(df, keys, {f"__m{i}": F.avg(c) for i, c in enumerate(cols)})
    based, prm, drop = means.attach(df)
    cen = based.select(*keys, *[(F.col(c).cast("double") - prm[f"__m{i}"]).alias(f"__c{i}") for i, c in enumerate(cols)])
    cen = colocate_series(cen, keys)
    ccols = [f"__c{i}" for i in range(p)]
    iu, ju = np.triu_indices(p, 1)
    key_fields = [df.schema[k] for k in keys]
    schema = T.StructType(key_fields + [T.StructField(n, t) for n, t in (
        ("i", T.IntegerType()), ("j", T.IntegerType()), ("n", T.DoubleType()), ("sa", T.DoubleType()),
        ("sb", T.DoubleType()), ("qa", T.DoubleType()), ("qb", T.DoubleType()), ("sab", T.DoubleType()))])

    def partial(batches):
        acc: dict = {}
        for pdf in batches:
            groups = pdf.groupby(keys, dropna=False, sort=False) if keys else [((), pdf)]
            for k, g in groups:
                x = g[ccols].to_numpy(dtype=float)
                m = (~np.isnan(x)).astype(float)
                x0 = np.nan_to_num(x)
                mats = (m.T @ m, x0.T @ m, (x0 * x0).T @ m, x0.T @ x0)
                kk = k if isinstance(k, tuple) else (k,)
                acc[kk] = [a + b for a, b in zip(acc[kk], mats)] if kk in acc else list(mats)
                if len(acc) * 4 * p * p > PARTIAL_CELLS:  # partials are added up later, so they may leave early
                    yield from emit(acc)
                    acc = {}
        yield from emit(acc)

    def emit(acc):
        for kk, (nn, sx, sq, sxy) in acc.items():
            out = {c: [None if kk[t] != kk[t] else kk[t]] * len(iu) for t, c in enumerate(keys)}  # NaN: a NULL key
            out.update(i=iu.astype(np.int32), j=ju.astype(np.int32), n=nn[iu, ju], sa=sx[iu, ju], sb=sx[ju, iu],
                       qa=sq[iu, ju], qb=sq[ju, iu], sab=sxy[iu, ju])
            yield pd.DataFrame(out)

    sums = cen.mapInPandas(partial, schema).groupBy(*keys, "i", "j").agg(
        *[F.sum(c).alias(c) for c in ("n", "sa", "sb", "qa", "qb", "sab")])
    n = F.col("n")
    cov = F.col("sab") - F.col("sa") * F.col("sb") / n
    va = F.col("qa") - F.col("sa") * F.col("sa") / n
    vb = F.col("qb") - F.col("sb") * F.col("sb") / n
    # a column constant on the pair's rows has a variance of exactly 0 up to rounding noise
    tiny = F.lit(1e-12)
    ok = (n > 0) & (va > tiny * F.col("qa")) & (vb > tiny * F.col("qb"))
    r = F.when(ok, cov / F.sqrt(va * vb))
    names = F.array(*[F.lit(c) for c in cols])
    out = sums.select(*keys, F.element_at(names, F.col("i") + 1).alias("a"), F.element_at(names, F.col("j") + 1).alias("b"),
                      (F.abs(r) if absolute else r).alias("r"))
    if not upper_only:
        out = out.unionByName(out.select(*keys, F.col("b").alias("a"), F.col("a").alias("b"), "r"))
    return out


def regression_metrics(df: DataFrame, y: str, p: str, keys: Sequence[str] = ()) -> DataFrame:
    """mse, rmse, mae, mape (rows with y = 0 skipped; NULL if none left) and r2 (AGG8).

    r2 follows the usual convention for a constant target: 1 for a perfect fit, else 0.
    The mean of y is found in a first aggregate, so the total sum of squares is the
    two-pass (stable) form. All of it, ``n`` included, is over the rows with target and prediction."""
    keys = list(keys)
    df = df.where(F.col(y).isNotNull() & F.col(p).isNotNull())
    fit = Fitted.fit(df, keys, {"__ybar": F.avg(y)})
    based, prm, drop = fit.attach(df)
    e = F.col(y) - F.col(p)
    ss_res = F.sum(e * e)
    ss_tot = F.sum(F.pow(F.col(y) - prm["__ybar"], 2))
    agg = based.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(e * e).alias("mse"),
        F.avg(F.abs(e)).alias("mae"),
        (F.avg(F.when(F.col(y) != 0, F.abs(e / F.col(y)))) * 100).alias("mape"),
        ss_res.alias("__res"), ss_tot.alias("__tot"),
    )
    r2 = F.when(F.col("__tot") == 0, F.when(F.col("__res") == 0, F.lit(1.0)).otherwise(F.lit(0.0))).otherwise(
        F.lit(1.0) - F.col("__res") / F.col("__tot"))
    return agg.select(*keys, F.col("n").cast("long").alias("n"), "mse", F.sqrt("mse").alias("rmse"), "mae", "mape",
                      r2.alias("r2"))


def residual_summary(df: DataFrame, y: str, p: str, keys: Sequence[str] = ()) -> DataFrame:
    """mean, population sd, min and max of y - p (AGG9)."""
    e = F.col(y) - F.col(p)
    return df.groupBy(*keys).agg(F.avg(e).alias("mean"), F.stddev_pop(e).alias("std"), F.min(e).alias("min"),
                                 F.max(e).alias("max"))


def histogram(df: DataFrame, col: str, bins: int = 20, keys: Sequence[str] = ()) -> DataFrame:
    """Equal-width histogram between min and max, empty bins included; the maximum belongs to the last bin;
    a constant column is one bin (AGG12). Columns: keys..., bin (1..n), lo, hi, count.
    bin = least(floor((x - min) / (max - min) * n) + 1, n)."""
    keys = list(keys)
    v = df.select(*keys, F.col(col).alias("__v")).where(F.col("__v").isNotNull())
    fit = Fitted.fit(v, keys, {"__lo": F.min("__v"), "__hi": F.max("__v")})
    based, p, drop = fit.attach(v)
    lo, hi = p["__lo"], p["__hi"]
    raw = F.floor((F.col("__v") - lo) / (hi - lo) * F.lit(bins)) + 1
    b = F.when(hi == lo, F.lit(1)).otherwise(F.least(raw, F.lit(bins)))
    full = based.withColumn("bin", b.cast("int")).groupBy(*keys, "bin").agg(
        F.count(F.lit(1)).cast("long").alias("__n"), F.first(lo).alias("__lo"), F.first(hi).alias("__hi"))
    # the counts of a series are at most ``bins`` entries: spread them over all its bins
    per = full.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("bin", "__n"))).alias("__at"),
                                  F.first("__lo").alias("__lo"), F.first("__hi").alias("__hi")).where(F.col("__lo").isNotNull())
    last = F.when(F.col("__hi") == F.col("__lo"), F.lit(1)).otherwise(F.lit(bins))
    out = per.select("*", F.explode(F.sequence(F.lit(1), last)).alias("bin"))
    w2 = (F.col("__hi") - F.col("__lo")) / F.lit(bins)
    return out.select(*keys, "bin", (F.col("__lo") + w2 * (F.col("bin") - 1)).alias("lo"),
                      F.when(F.col("__hi") == F.col("__lo"), F.col("__hi")).otherwise(
                          F.col("__lo") + w2 * F.col("bin")).alias("hi"),
                      F.coalesce(F.try_element_at("__at", F.col("bin")), F.lit(0)).cast("long").alias("count"))


def kde(df: DataFrame, col: str, points: int = 100) -> DataFrame:
    """Gaussian kernel density on an even grid between min and max, Scott bandwidth
    sd * n^(-1/5) (AGG13). One pass for the moments, one pass with one sum per grid point;
    the grid positions are literals, so there is no join at all."""
    st = df.agg(F.count(col).alias("n"), F.stddev_samp(col).alias("sd"), F.min(col).alias("lo"),
                F.max(col).alias("hi")).first()
    n, sd, lo, hi = st["n"], st["sd"], st["lo"], st["hi"]
    spark = df.sparkSession
    if not n or sd is None or sd == 0:
        return spark.createDataFrame([], "x double, density double")
    h = sd * n ** (-0.2)
    grid = [lo + (hi - lo) * i / (points - 1) for i in range(points)]
    norm = 1.0 / (n * h * math.sqrt(2 * math.pi))
    sums = [F.sum(F.exp(F.lit(-0.5) * F.pow((F.lit(g) - F.col(col)) / F.lit(h), 2))).alias(f"d{i}")
            for i, g in enumerate(grid)]
    row = df.agg(*sums)
    body = ", ".join(f"{g!r}D, d{i} * {norm!r}D" for i, g in enumerate(grid))
    return row.select(F.expr(f"stack({points}, {body}) as (x, density)"))


def boxplot_outliers(df: DataFrame, col: str, group: Sequence[str], block_rows: int | None = None) -> DataFrame:
    """The rows outside the 1.5 IQR fences of their group: group..., value (AGG11)."""
    group = list(group)
    q = exact_quantiles(df, group, col, [0.25, 0.75], ["q1", "q3"], block_rows)
    v = df.select(*group, F.col(col).alias("value")).where(F.col("value").isNotNull())
    iqr = F.col("q3") - F.col("q1")
    inside = F.col("value").between(F.col("q1") - F.lit(1.5) * iqr, F.col("q3") + F.lit(1.5) * iqr)
    return join_on_keys(v, q, group, "inner").where(~inside).select(*group, "value")


def boxplot_stats(df: DataFrame, col: str, group: Sequence[str], block_rows: int | None = None) -> DataFrame:
    """Quartiles, 1.5 IQR whiskers (most extreme values inside the fences) and outlier count
    per group (AGG11)."""
    group = list(group)
    q = exact_quantiles(df, group, col, [0.25, 0.5, 0.75], ["q1", "median", "q3"], block_rows)
    v = df.select(*group, F.col(col).alias("__v")).where(F.col("__v").isNotNull())
    j = join_on_keys(v, q, group, "inner")
    iqr = F.col("q3") - F.col("q1")
    lo_f = F.col("q1") - F.lit(1.5) * iqr
    hi_f = F.col("q3") + F.lit(1.5) * iqr
    inside = F.col("__v").between(lo_f, hi_f)
    return j.groupBy(*group).agg(
        F.first("q1").alias("q1"), F.first("median").alias("median"), F.first("q3").alias("q3"),
        F.min(F.when(inside, F.col("__v"))).alias("whisker_lo"),
        F.max(F.when(inside, F.col("__v"))).alias("whisker_hi"),
        F.count(F.when(~inside, 1)).cast("long").alias("outliers"),
        F.count(F.lit(1)).cast("long").alias("n"),
    )


def mean_error(df: DataFrame, y: str, p: str, keys: Sequence[str] = ()) -> DataFrame:
    """Mean of y - p (AGG14)."""
    return df.groupBy(*keys).agg(F.avg(F.col(y) - F.col(p)).alias("mean_error"))


def distinct_values(df: DataFrame, col: str) -> DataFrame:
    """AGG5."""
    return df.select(col).distinct()
