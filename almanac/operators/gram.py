"""Linear fits, cross-validation and principal components from cross-products.

Everything here needs, of the rows of a series, only sums: per pair of columns the rows that have both, the sums of
both and of their product. They are added up in NumPy inside each task and then by a group aggregate, per
series and segment. A segment is a stretch of a series that enters every later training set as a
whole, so the cross-products of an expanding window are running sums over segments and no row is copied.
What is solved afterwards is p x p per series: least squares, ridge, coordinate descent for lasso and elastic net,
or an eigen-decomposition, one group a series in ``applyInPandas``, on the driver for a series without keys.

Columns are taken by place, so no name of the input meets a working column."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from almanac.plans.fitted import Fitted
from almanac.plans.ordered import colocate_series

#: Numbers that a task holds before its partial sums leave it.
PARTIAL_CELLS = 16_000_000
MODELS = ("linear", "ridge", "lasso", "elasticnet")
SWEEPS = 20_000
#: Segments that hold something else of a series: the shifts of its columns (in si), which of them are kept (n: 1 or 0).
SHIFTS, KEPT = -1, -2


def null(value):
    """A key as pandas hands it over, its missing value as None."""
    return None if value is None or value is pd.NaT or value is pd.NA or value != value else value


@dataclass
class Moments:
    """``table``: k0.., seg, i, j (i <= j) and over the rows that have both columns n, si, sj, q (product); columns are
    shifted by a number per series and column, which segment SHIFTS holds."""

    table: DataFrame
    keys: list[str]
    key_types: list[T.DataType]
    p: int


def moments(df: DataFrame, keys: Sequence[str], columns: Sequence[Column], segment: Column | None = None, colocate: bool = True) -> Moments:
    """Pair sums of ``columns`` per series and segment. Means of the whole series shift the columns first, so products
    lose no digits; ``seg`` -1 holds the shifts (in si). Rows of a series need not be together; ``colocate`` brings
    them near each other first, which keeps partial sums few where series are many."""
    keys, p = list(keys), len(columns)
    ks, xs = [f"k{i}" for i in range(len(keys))], [f"x{i}" for i in range(p)]
    d = df.select(*[F.col(k).alias(a) for k, a in zip(keys, ks)], *[c.cast("double").alias(x) for c, x in zip(columns, xs)],
                  (F.lit(0) if segment is None else segment).cast("int").alias("seg"))
    means = Fitted.fit(d, ks, {f"m{i}": F.avg(x) for i, x in enumerate(xs)})
    based, m, _ = means.attach(d)
    d = based.select(*ks, "seg", *[(F.col(x) - F.coalesce(m[f"m{i}"], F.lit(0.0))).alias(x) for i, x in enumerate(xs)])
    if colocate:
        d = colocate_series(d, ks)
    iu, ju = np.triu_indices(p)
    sums = ("n", "si", "sj", "q")
    fields = [T.StructField(a, df.schema[k].dataType) for k, a in zip(keys, ks)] + [T.StructField("seg", T.IntegerType())]
    schema = T.StructType(fields + [T.StructField(c, T.IntegerType()) for c in "ij"] + [T.StructField(c, T.DoubleType()) for c in sums])
    by = [*ks, "seg"]

    def partial(batches):
        acc: dict = {}
        for pdf in batches:
            for k, g in pdf.groupby(by, dropna=False, sort=False):
                x = g[xs].to_numpy(dtype=float)
                there = ~np.isnan(x)
                x, there = np.where(there, x, 0.0), there.astype(float)
                more = np.stack([there.T @ there, x.T @ there, there.T @ x, x.T @ x])
                acc[k] = acc[k] + more if k in acc else more
                if len(acc) * 4 * p * p > PARTIAL_CELLS:  # partials are added up later, so they may leave early
                    yield from emit(acc)
                    acc = {}
        yield from emit(acc)

    def emit(acc):
        for k, mats in acc.items():
            out = {c: [null(v)] * len(iu) for c, v in zip(by, k)}
            out.update(i=iu.astype(np.int32), j=ju.astype(np.int32), **{c: mats[t][iu, ju] for t, c in enumerate(sums)})
            yield pd.DataFrame(out)

    table = d.mapInPandas(partial, schema).groupBy(*by, "i", "j").agg(*[F.sum(c).alias(c) for c in sums])
    shifts = means.as_table(df.sparkSession) if keys else df.sparkSession.createDataFrame([means.row], ", ".join(f"m{i} double" for i in range(p)))
    body = ", ".join(f"{i}, m{i}" for i in range(p))
    long = shifts.select(*ks, F.expr(f"stack({p}, {body}) as (i, si)"))
    table = table.unionByName(long.select(*ks, F.lit(SHIFTS).alias("seg"), "i", F.col("i").alias("j"), F.lit(0.0).alias("n"), "si",
                                          F.lit(0.0).alias("sj"), F.lit(0.0).alias("q")))
    return Moments(table, keys, [df.schema[k].dataType for k in keys], p)


@dataclass
class Sums:
    """Sums of one series up to a segment, as matrices."""

    n: np.ndarray
    s: np.ndarray  # s[i, j]: sum of column i over the rows that have j too
    q: np.ndarray
    shift: np.ndarray

    def centred(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows and means of every column, and cross-products of the columns less their means, missing values counting as the mean."""
        rows = np.diag(self.n)
        m = np.divide(np.diag(self.s), rows, out=np.zeros(len(rows)), where=rows > 0)
        g = self.q - self.s * m[None, :] - (self.s * m[None, :]).T + np.outer(m, m) * self.n
        return rows, np.where(rows > 0, m + self.shift, np.nan), g


def running_sums(pdf: pd.DataFrame, p: int, segments: int | None = None) -> list[tuple[int, Sums]]:
    """(segment, sums of all segments up to it) in order, of one series; of the segments that hold rows, or of ``segments``
    segments from the first that does."""
    n, s, q = np.zeros((p, p)), np.zeros((p, p)), np.zeros((p, p))
    seg = pdf["seg"].to_numpy()
    of = pdf[seg == SHIFTS]
    shift = np.zeros(p)
    shift[of["i"].to_numpy()] = np.nan_to_num(of["si"].to_numpy(dtype=float))
    out = []
    held = np.unique(seg[seg >= 0])
    for at in held if segments is None or not len(held) else range(held[0], segments):
        part = pdf[seg == at]
        i, j = part["i"].to_numpy(), part["j"].to_numpy()
        d = i != j
        for mat, up, low in ((n, "n", "n"), (s, "si", "sj"), (q, "q", "q")):
            a, b = part[up].to_numpy(dtype=float), part[low].to_numpy(dtype=float)
            mat[i, j] += a
            mat[j[d], i[d]] += b[d]
        out.append((int(at), Sums(n.copy(), s.copy(), q.copy(), shift)))
    return out


def per_series(mom: Moments, solve: Callable[[pd.DataFrame], list[tuple]], fields: list[T.StructField]) -> DataFrame:
    """Rows that ``solve`` makes of the sums of each series, with its keys under their own names."""
    ks = [f"k{i}" for i in range(len(mom.keys))]
    names = [f.name for f in fields]
    spark = mom.table.sparkSession
    if not ks:  # numbers of columns squared, whatever the number of rows
        rows = solve(mom.table.toPandas())
        return spark.createDataFrame(rows, T.StructType(fields))
    schema = T.StructType([T.StructField(k, t) for k, t in zip(ks, mom.key_types)] + fields)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame(solve(pdf), columns=names)
        for at, k in enumerate(ks):
            out.insert(at, k, pd.Series([null(pdf[k].iloc[0])] * len(out), dtype=object))
        return out

    out = mom.table.groupBy(*ks).applyInPandas(run, schema)
    return out.select(*[F.col(k).alias(name) for k, name in zip(ks, mom.keys)], *names)


# ------------------------------------------------------------------ solvers
def descend(a: np.ndarray, c: np.ndarray, l1: float, l2: float) -> np.ndarray:
    """Minimum of w'aw / 2 - c'w + l1 |w|_1 + l2 |w|^2 / 2 by coordinate descent with covariance updates."""
    w, left = np.zeros(len(c)), c.copy()
    diag = np.diag(a)
    limit = 1e-13 * max(1.0, float(np.abs(c).max(initial=0.0)))
    for _ in range(SWEEPS):
        moved = 0.0
        for j in range(len(c)):
            if diag[j] + l2 <= 0:
                continue
            pull = left[j] + diag[j] * w[j]
            new = np.sign(pull) * max(abs(pull) - l1, 0.0) / (diag[j] + l2)
            if new != w[j]:
                left -= a[:, j] * (new - w[j])
                moved = max(moved, abs(new - w[j]) * (diag[j] + l2))
                w[j] = new
        if moved <= limit:
            break
    return w


def coefficients(sums: Sums, model: str, alpha: float | Sequence[float], l1_ratio: float = 0.5) -> tuple[float, np.ndarray, np.ndarray, np.ndarray, float]:
    """Intercept, weights, feature means, the (penalised) Gram matrix and the sum of squared residuals; the last column is
    the target.

    linear and ridge: residuals squared + alpha * w^2 (a number, or one for each feature); lasso: 1/(2n) residuals squared
    + alpha |w|; elastic net: the same with alpha * l1_ratio, and alpha * (1 - l1_ratio) / 2 * w^2."""
    _, means, g = sums.centred()
    k = len(means) - 1
    n = max(float(sums.n[k, k]), 1.0)
    gram, cross = g[:k, :k], g[:k, k]
    if model in ("linear", "ridge"):
        penalty = np.zeros(k) if model == "linear" else np.broadcast_to(np.asarray(alpha, dtype=float), (k,))
        gram = gram + np.diag(penalty)
        w = np.linalg.lstsq(gram, cross, rcond=None)[0] if k else np.zeros(0)
    else:
        ratio = 1.0 if model == "lasso" else l1_ratio
        w = descend(gram / n, cross / n, float(alpha) * ratio, float(alpha) * (1 - ratio))
    full = g[:k, :k]
    sse = max(0.0, float(g[k, k] - 2 * w @ cross + w @ full @ w))
    mu = np.nan_to_num(means)
    return float(mu[k] - mu[:k] @ w), w, mu[:k], gram, sse


FIT = [T.StructField("seg", T.IntegerType()), T.StructField("rows", T.DoubleType()), T.StructField("intercept", T.DoubleType()),
       T.StructField("weights", T.ArrayType(T.DoubleType()))]


def fits(mom: Moments, model: str = "linear", alpha: float | Sequence[float] = 0.0, l1_ratio: float = 0.5,
         segments: int | None = None) -> DataFrame:
    """One fit per series and segment (see :func:`running_sums`), on all rows up to the segment's end: keys, seg, rows, intercept,
    weights."""
    if model not in MODELS:
        raise ValueError(f"{model!r} has no fit from cross-products; one of {', '.join(MODELS)}")

    p = mom.p  # not the table: solve runs in the workers

    def solve(pdf: pd.DataFrame) -> list[tuple]:
        out = []
        for seg, sums in running_sums(pdf, p, segments):
            b, w, *_ = coefficients(sums, model, alpha, l1_ratio)
            out.append((seg, float(sums.n[-1, -1]), b, w.tolist()))
        return out

    return per_series(mom, solve, FIT)


SPREAD = [*FIT, T.StructField("sse", T.DoubleType()), T.StructField("means", T.ArrayType(T.DoubleType())),
          T.StructField("inverse", T.ArrayType(T.ArrayType(T.DoubleType())))]


def fits_with_spread(mom: Moments, alpha: float | Sequence[float] = 0.0) -> DataFrame:
    """Ridge fits with what the spread of predictions needs: sse, feature means, inverse of the penalised Gram matrix."""
    p = mom.p  # not the table: solve runs in the workers

    def solve(pdf: pd.DataFrame) -> list[tuple]:
        out = []
        for seg, sums in running_sums(pdf, p):
            b, w, mu, gram, sse = coefficients(sums, "ridge", alpha)
            inverse = np.linalg.pinv(gram, hermitian=True) if len(w) else np.zeros((0, 0))
            out.append((seg, float(sums.n[-1, -1]), b, w.tolist(), sse, mu.tolist(), inverse.tolist()))
        return out

    return per_series(mom, solve, SPREAD)


# ------------------------------------------------------------------ principal components
COMPONENT = [T.StructField("component", T.IntegerType()), T.StructField("explained_variance_ratio", T.DoubleType()),
             T.StructField("cumulative", T.DoubleType()), T.StructField("loadings", T.ArrayType(T.DoubleType())),
             T.StructField("means", T.ArrayType(T.DoubleType())), T.StructField("scales", T.ArrayType(T.DoubleType()))]


def components(mom: Moments, standardize: bool = True, kept: DataFrame | None = None) -> DataFrame:
    """Principal components per series: keys, component (from 1), explained_variance_ratio, cumulative, loadings (the largest
    positive), means and scales. Missing values count as the mean; columns that do not vary, and where ``kept`` (keys, position,
    kept) is given those not kept, have loading 0."""
    p = mom.p  # not the table: solve runs in the workers
    if kept is not None:
        flags = kept.select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(mom.keys)], F.lit(KEPT).alias("seg"), F.col("position").cast("int").alias("i"),
                            F.col("position").cast("int").alias("j"), F.col("kept").cast("double").alias("n"), *[F.lit(0.0).alias(c) for c in ("si", "sj", "q")])
        mom = Moments(mom.table.unionByName(flags), mom.keys, mom.key_types, p)

    def solve(pdf: pd.DataFrame) -> list[tuple]:
        sums = running_sums(pdf, p)
        if not sums:
            return []
        rows, means, g = sums[-1][1].centred()
        flags = pdf[pdf["seg"] == KEPT]
        use = np.sort(flags["i"].to_numpy()[flags["n"].to_numpy() > 0]) if len(flags) else np.arange(p)
        if not len(use):
            return []
        out = []
        for c, ratio, upto, v, _, scales in principal(rows[use], means[use], g[np.ix_(use, use)], standardize):
            full, scaled = np.zeros(p), np.ones(p)
            full[use], scaled[use] = v, scales
            out.append((c, ratio, upto, full.tolist(), np.nan_to_num(means).tolist(), scaled.tolist()))
        return out

    return per_series(mom, solve, COMPONENT)


def principal(rows: np.ndarray, means: np.ndarray, g: np.ndarray, standardize: bool) -> list[tuple]:
    """Components of the centred cross-products ``g``."""
    n = max(float(rows.max(initial=0.0)), 1.0)
    var = np.diag(g) / n
    scales = np.where(var > 0, np.sqrt(np.where(var > 0, var, 1.0)), 1.0) if standardize else np.ones(len(var))
    values, vectors = np.linalg.eigh(g / n / np.outer(scales, scales))
    order = np.argsort(-values, kind="stable")
    values, vectors = np.maximum(values[order], 0.0), vectors[:, order]
    total = values.sum()
    ratio = values / total if total > 0 else np.zeros(len(values))
    upto = np.cumsum(ratio)
    out = []
    for j in range(len(values)):
        v = vectors[:, j]
        v = v * (-1.0 if v[int(np.argmax(np.abs(v)))] < 0 else 1.0)
        out.append((j + 1, float(ratio[j]), float(upto[j]), v.tolist(), np.nan_to_num(means).tolist(), scales.tolist()))
    return out
