"""Dimension reduction and feature selection (DIM1-DIM9, AGG7).

Correlation, F scores and mutual information are group aggregates over the rows; only
p x p (or p x k) objects — a correlation matrix, PCA components — are ever small enough
to sit on the driver, and they do not grow with the number of rows."""

from __future__ import annotations

import logging
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from almanac.functions.schema import CALENDAR_COLUMNS, numeric_columns
from almanac.operators import gram
from almanac.operators.stats import corr_pairs, exact_cuts, pearson
from almanac.plans.fitted import Fitted, sql_literal
from almanac.plans.ordered import join_on_keys, series_plan
from almanac.plans.staged import staged

log = logging.getLogger(__name__)


def mean_impute(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Fill each column with its mean (IMP7)."""
    fit = Fitted.fit(df, keys, {f"__m_{c}": F.avg(c) for c in columns})
    based, p, drop = fit.attach(df)
    return based.withColumns({c: F.coalesce(F.col(c).cast("double"), p[f"__m_{c}"]) for c in columns}).drop(*drop)


# ------------------------------------------------------------------ DIM1
def correlation_filter(df: DataFrame, columns: Sequence[str], threshold: float = 0.95, impute: bool = True,
                       keys: Sequence[str] = ()) -> DataFrame:
    """Per series and column in the given order: dropped if its absolute correlation with any earlier
    column exceeds the threshold (earlier columns count even when dropped themselves);
    NaN correlations never drop. Returns (keys..., feature, position, max_abs_corr, kept)."""
    keys, cols = list(keys), list(columns)
    ks = [f"k{i}" for i in range(len(keys))]
    data = mean_impute(df, cols, keys) if impute else df
    data = data.select(*[F.col(k).alias(a) for k, a in zip(keys, ks)], *cols) if keys else data
    pairs = corr_pairs(data, cols, ks, absolute=True)
    spark = df.sparkSession
    names = spark.createDataFrame([(c, i) for i, c in enumerate(cols)], "feature string, position int")
    r = F.nanvl(F.col("r"), F.lit(None).cast("double"))
    worst = pairs.groupBy(*ks, F.col("b").alias("feature")).agg(F.max(r).alias("max_abs_corr"))
    every = names if not keys else data.select(*ks).distinct().withColumn(
        "f", F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.lit(i).alias("position")) for i, c in enumerate(cols)]))).select(*ks, "f.*")
    out = join_on_keys(every, worst, [*ks, "feature"], "left")
    kept = F.coalesce(~(F.col("max_abs_corr") > threshold), F.lit(True))
    return out.select(*[F.col(a).alias(k) for a, k in zip(ks, keys)], "feature", "position", "max_abs_corr", kept.alias("kept"))


def kept_features(filter_table: DataFrame) -> list[str]:
    return [r["feature"] for r in filter_table.where("kept").orderBy("position").collect()]


# ------------------------------------------------------------------ DIM6
def f_regression_scores(df: DataFrame, target: str, features: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """F = r^2 / (1 - r^2) * (n - 2) per feature and series, ranked descending (NaN last, r = +-1 first).
    Columns: keys..., feature, position, r, f_score, rank."""
    keys, feats = list(keys), list(features)
    ks = [f"k{i}" for i in range(len(keys))]
    aggs = []
    for i, c in enumerate(feats):
        aggs += [pearson(F.col(c), F.col(target)).alias(f"r{i}"),
                 F.count(F.when(F.col(target).isNotNull() & F.col(c).isNotNull(), 1)).alias(f"n{i}")]
    wide = df.groupBy(*[F.col(k).alias(a) for k, a in zip(keys, ks)]).agg(*aggs)
    body = ", ".join(f"{i}, r{i}, n{i}" for i in range(len(feats)))
    long = wide.select(*ks, F.expr(f"stack({len(feats)}, {body}) as (position, r, n)"))
    r = F.nanvl(F.col("r"), F.lit(None).cast("double"))
    f = F.when(F.abs(r) == 1, F.lit(float("inf"))).otherwise(r * r / (F.lit(1.0) - r * r) * (F.col("n") - 2))
    long = long.select(*ks, "position", r.alias("r"), f.alias("f_score"))
    # rank on F rounded to 1e-6 (monotone copies of a feature tie exactly in theory and only
    # differ by summation order); very large or infinite scores rank as they are
    fs = F.col("f_score")
    key = F.when(fs > 1e12, fs).otherwise(F.floor(fs * 1e6 + 0.5).cast("double"))
    return _ranked(long, df, keys, feats, key, ["r", "f_score"])


# ------------------------------------------------------------------ DIM5
def equal_frequency_bin(df: DataFrame, keys: Sequence[str], value: str, bins: int = 10, out: str = "bin",
                        block_rows: int | None = None) -> DataFrame:
    """Add ``out`` = floor(r0 * bins / n) per series (``keys``), r0 the number of smaller
    values (equal values share a bin), n the number of non-null values. Rows with a NULL
    value are dropped. One sort (distributed min-rank index) plus a per-series count."""
    keys = list(keys)
    d = df.where(F.col(value).isNotNull())
    plan = series_plan(d, keys, [value], block_rows)
    r = plan.with_count(plan.index(d, "__r0", ties="min"))
    return r.withColumn(out, F.floor(F.col("__r0") * bins / F.col("__n")).cast("int")).drop("__r0", "__n")


def mutual_info_scores(df: DataFrame, target: str, features: Sequence[str], bins: int = 10,
                       block_rows: int | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """Binned mutual information (nats) between each feature and the target, equal-frequency
    bins, per series; ranked descending. Columns: keys..., feature, position, mi, rank. Re-aimed from a
    nearest-neighbour estimator: deterministic and a plain group aggregate.

    Without keys the bins' exact cuts are found first (:func:`~almanac.operators.stats.exact_cuts`), a row's bins are comparisons with
    them, and one aggregate counts (feature, bin, target's bin); no value is sorted. With keys the rows are ranked per series."""
    keys, feats = list(keys), list(features)
    ks = [f"k{i}" for i in range(len(keys))]
    d = mean_impute(df, [*feats, target], keys)
    xs = [f"x{i}" for i in range(len(feats))]
    d = d.select(*[F.col(k).alias(a) for k, a in zip(keys, ks)], *[F.col(c).cast("double").alias(x) for c, x in zip(feats, xs)],
                 F.col(target).cast("double").alias("y"))
    if keys:
        d = equal_frequency_bin(d, ks, "y", bins, "ybin", block_rows)
        body = ", ".join(f"{i}, {x}" for i, x in enumerate(xs))
        long = d.select(*ks, "ybin", F.expr(f"stack({len(xs)}, {body}) as (position, v)"))
        long = equal_frequency_bin(long, [*ks, "position"], "v", bins, "bin", block_rows)
    else:
        cuts = exact_cuts(d, [*xs, "y"], bins)
        place = {c: sum(((F.col(c) > v).cast("int") for v in at), F.lit(0)) for c, at in cuts.items()}
        body = ", ".join(f"{i}, {x}" for i, x in enumerate(xs))
        long = (d.where("y IS NOT NULL").select(place["y"].alias("ybin"), *[F.when(F.col(x).isNotNull(), place[x]).alias(x) for x in xs])
                .select("ybin", F.expr(f"stack({len(xs)}, {body}) as (position, bin)")).where("bin IS NOT NULL"))
    at = [*ks, "position"]
    joint = long.groupBy(*at, "bin", "ybin").agg(F.count(F.lit(1)).alias("nxy"))
    wx = Window.partitionBy(*at, "bin")      # joint table: at most bins^2 rows per feature
    wy = Window.partitionBy(*at, "ybin")
    wt = Window.partitionBy(*at)
    t = joint.select(*at, "nxy", F.sum("nxy").over(wx).alias("nx"), F.sum("nxy").over(wy).alias("ny"),
                     F.sum("nxy").over(wt).alias("nt"))
    pxy = F.col("nxy") / F.col("nt")
    term = pxy * F.log(F.col("nxy") * F.col("nt") / (F.col("nx") * F.col("ny")))
    mi = t.groupBy(*at).agg(F.sum(term).alias("mi"))
    # rank on mi rounded to 1e-10: equal scores (e.g. monotone copies of a feature) differ
    # only in summation order, and then the earlier feature wins
    key = F.floor(F.col("mi") * 1e10 + 0.5)
    return _ranked(mi, df, keys, feats, key, ["mi"])


def _ranked(scores: DataFrame, df: DataFrame, keys: list[str], feats: list[str], by, values: list[str]) -> DataFrame:
    """Scores (k0.., position, values) with feature names and a rank per series, every feature of every series."""
    ks = [f"k{i}" for i in range(len(keys))]
    spark = df.sparkSession
    names = spark.createDataFrame([(c, i) for i, c in enumerate(feats)], "feature string, position int")
    if not keys:
        every = names
    else:  # one row per series and feature
        body = ", ".join(str(i) for i in range(len(feats)))
        every = df.select(*[F.col(k).alias(a) for k, a in zip(keys, ks)]).distinct().withColumn("position", F.expr(f"explode(array({body}))"))
        every = every.join(F.broadcast(names), "position")  # p names
    out = join_on_keys(every, scores, [*ks, "position"], "left")
    w = Window.partitionBy(*ks).orderBy(F.desc_nulls_last(by), "position")  # p rows a series
    return out.select(*[F.col(a).alias(k) for a, k in zip(ks, keys)], "feature", "position", *values, F.row_number().over(w).alias("rank"))


# ------------------------------------------------------------------ DIM7
def lasso_selection(df: DataFrame, target: str, features: Sequence[str], alpha: float = 0.01, keys: Sequence[str] = ()) -> DataFrame:
    """Non-zero lasso coefficients (|w| > 1e-8) on z-scored features (population sd), per series, by coordinate descent on
    one table of cross-products. Columns: keys..., feature, coefficient, selected."""
    keys, feats = list(keys), list(features)
    d = mean_impute(df, [*feats, target], keys)
    mom = gram.moments(d, keys, [F.col(c) for c in [*feats, target]])
    p = mom.p

    def solve(pdf):
        rows, _, g = gram.running_sums(pdf, p)[-1][1].centred()
        n = max(float(rows.max()), 1.0)
        sd = np.sqrt(np.maximum(np.diag(g)[:-1], 0.0) / n)
        scale = np.where(sd > 0, sd, 1.0)
        w = gram.descend(g[:-1, :-1] / n / np.outer(scale, scale), g[:-1, -1] / n / scale, alpha, 0.0)
        return [(c, float(x), bool(abs(x) > 1e-8)) for c, x in zip(feats, w)]

    return gram.per_series(mom, solve, [T.StructField("feature", T.StringType()), T.StructField("coefficient", T.DoubleType()),
                                        T.StructField("selected", T.BooleanType())])


# ------------------------------------------------------------------ DIM2-DIM4, DIM9
@dataclass
class PcaResult:
    features: list[str]
    components: np.ndarray          # p x k, columns = components, sign fixed
    explained_ratio: list[float]
    means: dict = field(default_factory=dict)
    scales: dict = field(default_factory=dict)
    model: object = None            # fitted MLlib PCAModel (unsigned components)
    signs: list[float] = field(default_factory=list)

    def standardized_vector(self, df: DataFrame, out: str = "__v") -> DataFrame:
        z = [F.expr(f"(coalesce(CAST(`{c}` AS DOUBLE), {sql_literal(self.means[c])}) - {sql_literal(self.means[c])}) "
                    f"/ {sql_literal(self.scales[c])}").alias(f"__z{i}") for i, c in enumerate(self.features)]
        zed = df.select("*", *z)
        vec = VectorAssembler(inputCols=[f"__z{i}" for i in range(len(self.features))], outputCol=out).transform(zed)
        return vec.drop(*[f"__z{i}" for i in range(len(self.features))])

    def scores(self, df: DataFrame, k: int | None = None, prefix: str = "PC") -> DataFrame:
        """Add PC1..PCk: the fitted model projects the centred (and scaled) vector in the JVM,
        then each component gets its sign (largest absolute loading positive)."""
        k = self.components.shape[1] if k is None else k
        vec = self.standardized_vector(df)
        proj = self.model.transform(vec).withColumn("__a", vector_to_array("__pc"))
        cols = [(F.col("__a")[j] * F.lit(self.signs[j])).alias(f"{prefix}{j + 1}") for j in range(k)]
        return proj.select(*df.columns, *cols)


def fit_pca(df: DataFrame, columns: Sequence[str], standardize: bool = True, n_components: int | None = None) -> PcaResult:
    """PCA on mean-imputed (and by default z-scored, population sd) columns. Scores are
    centred (Spark's PCA does not centre) and each component's largest absolute loading
    is positive."""
    cols = list(columns)
    st = df.agg(*[F.avg(c).alias(f"m_{c}") for c in cols], *[F.stddev_pop(c).alias(f"s_{c}") for c in cols],
                F.count(F.lit(1)).alias("__n")).first()
    means = {c: float(st[f"m_{c}"] or 0.0) for c in cols}
    scales = {c: (float(st[f"s_{c}"]) if standardize and st[f"s_{c}"] else 1.0) for c in cols}
    n = int(st["__n"])
    k = min(n, len(cols)) if n_components is None else int(n_components)
    res = PcaResult(cols, np.zeros((len(cols), k)), [], means, scales)
    vec = res.standardized_vector(df.select(*cols))
    model = PCA(k=k, inputCol="__v", outputCol="__pc").fit(vec)
    comps = model.pc.toArray().copy()
    signs = []
    for j in range(comps.shape[1]):
        i = int(np.argmax(np.abs(comps[:, j])))
        sgn = -1.0 if comps[i, j] < 0 else 1.0
        comps[:, j] *= sgn
        signs.append(sgn)
    res.components, res.model, res.signs = comps, model, signs
    res.explained_ratio = [float(x) for x in model.explainedVariance.toArray()]
    return res


def components_for_threshold(ratios: Sequence[float], threshold: float) -> int:
    """Smallest k whose cumulative ratio reaches the threshold; all if never reached (DIM3)."""
    cum = np.cumsum(ratios)
    hit = np.nonzero(cum >= threshold)[0]
    return int(hit[0]) + 1 if len(hit) else len(ratios)


def variance_table(spark, pca: PcaResult, max_components: int = 20) -> DataFrame:
    """component, explained_variance_ratio, cumulative (DIM9)."""
    ratios = pca.explained_ratio[:max_components]
    cum = np.cumsum(pca.explained_ratio)[:max_components]
    rows = [(f"PC{i + 1}", i + 1, float(r), float(c)) for i, (r, c) in enumerate(zip(ratios, cum))]
    return spark.createDataFrame(rows, "component string, position int, explained_variance_ratio double, cumulative double")


def loading_table(spark, pca: PcaResult, top_components: int = 5, top_features: int = 5) -> DataFrame:
    """For the first components, the features with the largest absolute loading (DIM4, ORD3)."""
    rows = []
    for j in range(min(top_components, pca.components.shape[1])):
        col = pca.components[:, j]
        order = np.argsort(-np.abs(col), kind="stable")[:top_features]
        for rank, i in enumerate(order, start=1):
            rows.append((f"PC{j + 1}", rank, pca.features[i], float(col[i]), float(pca.explained_ratio[j])))
    return spark.createDataFrame(rows, "component string, rank int, feature string, loading double, "
                                       "explained_variance_ratio double")


# ------------------------------------------------------------------ DIM8
def reduce_dimensions(df: DataFrame, target_col: str, feature_cols: Sequence[str] | None = None, date_col: str = "date",
                      use_pca: bool = True, pca_variance_threshold: float = 0.95,
                      feature_selection_method: str = "mutual_info", top_n_features: int = 10,
                      lasso_alpha: float = 0.01, keys: Sequence[str] = ()) -> tuple[DataFrame, dict]:
    """Correlation filter, optional PCA, feature selection with the reference's fallbacks.
    The result keeps date and target plus the PCA scores or the filtered features.

    With ``keys`` every series has its own filter, components and selection; they are tables in the metadata (``filter``, ``pca``,
    ``selection``), and ``selected_features`` is what any series selects. A feature that a series does not keep, and a
    component beyond its own, is 0 there, so it has no part in a model of that series."""
    if feature_cols is None:
        feature_cols = numeric_columns(df, [date_col, target_col, *CALENDAR_COLUMNS, *keys])
    feats = [c for c in feature_cols if c in df.columns]
    if keys:
        return _reduce_panel(df, target_col, feats, date_col, list(keys), use_pca, pca_variance_threshold, feature_selection_method,
                             top_n_features, lasso_alpha)
    data = mean_impute(df, feats)
    filt = correlation_filter(data, feats, impute=False)
    kept = kept_features(filt)
    meta: dict = {"original_features": feats, "pca_applied": False, "feature_selection_method": feature_selection_method,
                  "selected_features": []}
    base_cols = [c for c in (*keys, date_col, target_col) if c in df.columns]
    if use_pca and kept:
        pca = fit_pca(data, kept)
        k = components_for_threshold(pca.explained_ratio, pca_variance_threshold)
        result = pca.scores(data, k).select(*base_cols, *[f"PC{i + 1}" for i in range(k)])
        meta.update(pca_applied=True, pca_components=[f"PC{i + 1}" for i in range(k)],
                    pca_explained_variance=pca.explained_ratio[:k], n_components_used=k, pca=pca)
        avail = meta["pca_components"]
    else:
        result = df.select(*base_cols, *[c for c in kept if c not in base_cols])  # as they came, not imputed
        avail = kept
    ranked = _selection(result, target_col, avail, feature_selection_method, top_n_features, lasso_alpha) if avail else []
    # nothing chosen: leading components, or without them the features as given
    selected = ranked or (meta.get("pca_components") or feats)[:top_n_features]
    if missing := [c for c in selected if c not in result.columns]:  # the filter dropped them: one more projection of the same rows
        result = df.select(*result.columns, *missing)
    meta["selected_features"] = selected
    return result, meta


def _reduce_panel(df: DataFrame, target: str, feats: list[str], date_col: str, keys: list[str], use_pca: bool, threshold: float,
                  method: str, top: int, alpha: float) -> tuple[DataFrame, dict]:
    data = staged(mean_impute(df, feats, keys), "reduce-rows")
    filt = staged(correlation_filter(data, feats, impute=False, keys=keys), "reduce-filter")  # p rows a series
    meta: dict = {"original_features": feats, "pca_applied": False, "feature_selection_method": method, "filter": filt}
    base = [c for c in (*keys, date_col, target) if c in df.columns]
    if use_pca:
        comps = gram.components(gram.moments(data, keys, [F.col(c) for c in feats]), kept=filt)
        enough = F.coalesce(F.lag("cumulative").over(Window.partitionBy(*keys).orderBy("component")), F.lit(0.0)) < threshold
        comps = staged(comps.withColumn("used", enough), "reduce-components")  # at most p rows a series
        most = comps.where("used").agg(F.max("component")).first()[0] or 0
        lines = (comps.where("used").groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("component", "loadings"))).alias("__lines"),
                                                        F.first("means").alias("__means"), F.first("scales").alias("__scales")))
        based = join_on_keys(data, lines, keys, "left")
        z = F.array(*[(F.col(c).cast("double") - F.col("__means")[i]) / F.col("__scales")[i] for i, c in enumerate(feats)])
        dot = "aggregate(zip_with(get(__lines, {j}).loadings, __z, (a, b) -> a * b), 0.0D, (s, v) -> s + v)"
        names = [f"PC{j + 1}" for j in range(most)]
        result = based.withColumn("__z", z).select(*base, *[F.coalesce(F.expr(dot.format(j=j)), F.lit(0.0)).alias(n) for j, n in enumerate(names)])
        meta.update(pca_applied=True, pca=comps, pca_components=names, n_components_used=most)
        avail = names
    else:
        wide = filt.groupBy(*keys).agg(*[F.max(F.when(F.col("feature") == c, F.col("kept"))).alias(f"__k{i}") for i, c in enumerate(feats)])
        based = join_on_keys(df, wide, keys, "left")
        some = {r["feature"] for r in filt.where("kept").select("feature").distinct().collect()}  # names of columns
        avail = [c for c in feats if c in some]
        result = based.select(*[c for c in base if c not in avail],
                              *[F.when(F.col(f"__k{feats.index(c)}"), F.col(c)).otherwise(F.lit(0.0)).alias(c) for c in avail])
    result = staged(result, "reduced")
    if method not in SELECTORS:
        log.warning("unknown feature selection method %r", method)
        meta.update(selection=None, selected_features=avail[:top])
        return result, meta
    chosen = staged(SELECTORS[method](result, target, avail, top, alpha, keys), "reduce-selection")
    some = {r["feature"] for r in chosen.select("feature").distinct().collect()}
    meta.update(selection=chosen, selected_features=[c for c in avail if c in some] or avail[:top])
    return result, meta


#: Rows of the score table that are selected, by method.
SELECTORS = {
    "mutual_info": lambda df, y, x, top, alpha, keys=(): mutual_info_scores(df, y, x, keys=keys).where(F.col("rank") <= top).orderBy("rank"),
    "f_regression": lambda df, y, x, top, alpha, keys=(): f_regression_scores(df, y, x, keys).where(F.col("rank") <= top).orderBy("rank"),
    "lasso": lambda df, y, x, top, alpha, keys=(): lasso_selection(df, y, x, alpha, keys).where("selected"),
}


def _selection(df: DataFrame, target: str, features: Sequence[str], method: str, top: int, alpha: float) -> list[str]:
    if method not in SELECTORS:
        log.warning("unknown feature selection method %r", method)
        return []
    return [r["feature"] for r in SELECTORS[method](df, target, features, top, alpha).collect()]
