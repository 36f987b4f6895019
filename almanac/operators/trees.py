"""Forests and boosted trees of long tables (MDL5, MDL6).

MLlib's trees see of a row only the bin of each feature and the label, and of a node only sums over rows. Rows that
agree in every bin are therefore one row of their mean label, weighted with their number: splits, gains, leaves and
importances come out as from the rows, and a round of boosting reads the cells instead of the table. Bins hold all
rows' values: one for each value up to ``maxBins`` values, equal-frequency bins with exact cuts beyond (MLlib takes
its candidates from a sample of 10,000 rows). A forest's bootstrap draws rows, not cells: each of its trees has its
own counts and means by cell, drawn in one pass over the rows."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator, Sequence
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.ml.feature import Bucketizer, VectorAssembler
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import DecisionTreeRegressor, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.util import inheritable_thread_target

from almanac.operators.stats import exact_cuts
from almanac.plans.ordered import join_on_keys
from almanac.plans.staged import fresh, staged
from almanac.session import scratch_path

#: MLlib reads the rows themselves below so many rows, or where a cell would hold fewer rows than this on average.
BIN_ROWS, CELL_ROWS = 1_000_000, 20
FITS_AT_ONCE = 8  # trees of a forest that are grown side by side


def numbered(df: DataFrame, columns: Sequence[str], cuts: Sequence[Sequence[float]], out: Sequence[str]) -> DataFrame:
    """``df`` with the bin number of each column: how many of its cuts lie below the value. Missing values lie above all."""
    at = [i for i, c in enumerate(cuts) if len(c)]
    temp = fresh([*df.columns, *out], *[f"__v{i}" for i in at])
    d = df.withColumns({t: F.coalesce(F.col(columns[i]).cast("double"), F.lit(float("nan"))) for t, i in zip(temp, at)})
    if at:  # a bin of Bucketizer begins at its split, so the split is the next number after the cut
        splits = [[-math.inf, *(float(np.nextafter(v, math.inf)) for v in cuts[i]), math.inf] for i in at]
        d = Bucketizer(splitsArray=splits, inputCols=temp, outputCols=[out[i] for i in at], handleInvalid="keep").transform(d)
    return d.withColumns({out[i]: F.lit(0.0) for i in range(len(cuts)) if i not in at}).drop(*temp)


class BinnedTrees:
    """Regression trees over bin numbers; predicts the mean of ``models`` (the trees of a forest, or one boosted model)."""

    def __init__(self, models: Sequence, features: Sequence[str], thresholds: Sequence[Sequence[float]], features_col: str, prediction_col: str):
        self.models, self.features, self.thresholds = list(models), list(features), [list(t) for t in thresholds]
        self.features_col, self.prediction_col = features_col, prediction_col

    @property
    def featureImportances(self):
        total = sum(m.featureImportances.toArray() for m in self.models)
        return Vectors.dense(total / total.sum() if total.sum() > 0 else total)

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with the prediction: the distinct combinations of bins are scored and joined back."""
        bins = fresh([*df.columns, self.prediction_col], *[f"__b{i}" for i in range(len(self.features))])
        d = numbered(df, self.features, self.thresholds, bins)
        scored = VectorAssembler(inputCols=bins, outputCol=self.features_col).transform(d.select(*bins).distinct())
        for m in self.models:
            scored = m.transform(scored)
        mean = sum((F.col(m.getPredictionCol()) for m in self.models), F.lit(0.0)) / len(self.models)
        return join_on_keys(d, staged(scored.select(*bins, mean.alias(self.prediction_col)), "tree-scores"), bins, "left").drop(*bins)


def fit_binned(df: DataFrame, features: Sequence[str], label: str, est) -> BinnedTrees | None:
    """The model of the MLlib estimator ``est`` (boosted trees, or a forest that tries every feature) fitted to the cells of
    ``df``. None where cells save little, or where values are missing or infinite, which MLlib refuses."""
    plain = all(isinstance(df.schema[c].dataType, (T.NumericType, T.BooleanType)) for c in [*features, label])
    if not features or not plain or df.count() < BIN_ROWS:
        return None
    xs, bs = [f"x{i}" for i in range(len(features))], [f"b{i}" for i in range(len(features))]
    rows = staged(df.select(*[(F.col(c).cast("double") + 0.0).alias(x) for c, x in zip([*features, label], [*xs, "y"])]), "tree-rows")
    refused = " or ".join(f"{x} is null or isnan({x}) or abs({x}) = double('inf')" for x in [*xs, "y"])
    seen = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.expr(refused)).alias("refused"), *[F.approx_count_distinct(x).alias(x) for x in xs]).first()
    if seen["refused"]:
        return None
    cuts = _cuts(rows, xs, est.getMaxBins(), seen)
    coded = numbered(rows, xs, cuts, bs).withColumns({b: F.col(b).cast("int") for b in bs})
    ends = [f(x).alias(f"{name}{i}") for i, x in enumerate(xs) for name, f in (("lo", F.min), ("hi", F.max))]
    cells = staged(coded.groupBy(*bs).agg(F.avg("y").alias("y"), F.count(F.lit(1)).cast("double").alias("w"), *ends), "tree-cells")
    n_cells = cells.count()
    if n_cells * CELL_ROWS > seen["n"]:
        return None
    col, out = est.getFeaturesCol(), est.getPredictionCol()
    asm = VectorAssembler(inputCols=bs, outputCol=col)
    bins = max(est.getMaxBins(), math.isqrt(n_cells) + 1)  # MLlib looks at maxBins^2 rows for its candidates: at every cell
    if isinstance(est, RandomForestRegressor) and est.getBootstrap():
        bags, schema = _bags(coded.select(*bs, "y"), bs, est.getNumTrees(), est.getSubsamplingRate(), est.getSeed())

        def grow(t: int):
            tree = DecisionTreeRegressor(featuresCol=col, labelCol="y", weightCol="w", predictionCol=f"__p{t}", maxDepth=est.getMaxDepth(),
                                         maxBins=bins, seed=est.getSeed())
            return tree.fit(asm.transform(df.sparkSession.read.schema(schema).parquet(f"{bags}/tree={t}")))

        with ThreadPool(min(FITS_AT_ONCE, est.getNumTrees())) as pool:
            models = pool.map(inheritable_thread_target(df.sparkSession)(grow), range(est.getNumTrees()), chunksize=1)
    else:
        whole = est.copy({est.labelCol: "y", est.weightCol: "w", est.maxBins: bins})
        models = [whole.fit(asm.transform(cells.select(*bs, "y", "w")))]
    return BinnedTrees(models, features, _thresholds(cells, cuts), col, out)


def _cuts(rows: DataFrame, xs: Sequence[str], bins: int, distinct) -> list[list[float]]:
    """Last values of all but the highest bin of each column."""
    cuts: dict[str, list[float]] = {}
    few = [x for x in xs if distinct[x] <= 2 * bins]
    if few:
        values = rows.agg(*[F.sort_array(F.collect_set(x)).alias(x) for x in few]).first()
        cuts = {x: values[x][:-1] for x in few if len(values[x]) <= bins}
    rest = [x for x in xs if x not in cuts]
    if rest:
        cuts |= {x: sorted(set(v)) for x, v in exact_cuts(rows, rest, bins).items()}
    return [cuts[x] for x in xs]


def _thresholds(cells: DataFrame, cuts: Sequence[Sequence[float]]) -> list[list[float]]:
    """Midpoints between the values on both sides of each cut, as MLlib places its thresholds; cuts without a value above stay."""
    out = []
    for i, at in enumerate(cuts):
        ends = {int(r[0]): r for r in cells.groupBy(f"b{i}").agg(F.min(f"lo{i}"), F.max(f"hi{i}")).collect()}  # one row a bin
        mid = [(ends[b][2] / 2 + ends[b + 1][1] / 2, ends[b][2], ends[b + 1][1]) if b in ends and b + 1 in ends else (v, v, math.inf)
               for b, v in enumerate(at)]
        out.append([m if low <= m < high else low for m, low, high in mid])
    return out


def _bags(coded: DataFrame, bs: Sequence[str], trees: int, rate: float, seed: int) -> tuple[str, str]:
    """Bootstrap samples of the rows, summed by cell: each row enters each tree a Poisson(``rate``) number of times, drawn as so
    many rows of a batch with replacement. Rows are ordered by cell, equal ones by a random number, so that a batch holds few cells
    and a large cell spreads over tasks. Returns the folder (one part per tree) and the schema of a part."""
    schema = ", ".join([*(f"{b} int" for b in bs), "y double", "w double"])

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rng = np.random.default_rng([seed, TaskContext.get().partitionId()])
        for pdf in batches:
            codes, y = pdf[list(bs)].to_numpy(), pdf["y"].to_numpy()
            if not len(y):
                continue
            first = np.r_[True, (codes[1:] != codes[:-1]).any(axis=1)]
            cell, heads = np.cumsum(first) - 1, codes[first]
            parts = []
            for t in range(trees):
                at = rng.integers(len(y), size=rng.poisson(rate * len(y)))
                w = np.bincount(cell[at], minlength=len(heads))
                held = np.flatnonzero(w)
                mean = np.bincount(cell[at], weights=y[at], minlength=len(heads))[held] / w[held]
                parts.append((heads[held], mean, w[held], np.full(len(held), t)))
            found = pd.DataFrame(np.concatenate([p[0] for p in parts]), columns=list(bs))
            yield found.assign(y=np.concatenate([p[1] for p in parts]), w=np.concatenate([p[2] for p in parts]).astype(float),
                               tree=np.concatenate([p[3] for p in parts]))

    spread = coded.withColumn("r", F.rand(seed))
    spread = spread.repartitionByRange(*bs, "r").sortWithinPartitions(*bs, "r")
    path = scratch_path(coded.sparkSession, f"tree-bags-{uuid.uuid4().hex}")
    spread.mapInPandas(draw, f"{schema}, tree int").repartition("tree", bs[0]).write.partitionBy("tree").parquet(path)
    return path, schema
