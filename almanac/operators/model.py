"""Regression models, evaluation, cross-validation (MDL1-MDL11, AGG8, AGG10).

Two fitting paths:

* **MLlib** estimators for one model over all rows (linear, ridge, lasso, elastic net,
  random forest, gradient-boosted trees; long tables reach the trees as weighted cells, :mod:`almanac.operators.trees`);
* **cross-products by aggregation** (:mod:`almanac.operators.gram`) for linear, ridge, lasso and elastic-net fits per
  series and for their cross-validation: no series is ever held in one task, hot keys included, and only p x p
  systems, one row per series, are solved with NumPy in ``applyInPandas``."""

from __future__ import annotations

import logging
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from almanac.operators import gram
from almanac.operators.split import cv_folds, split_labels
from almanac.operators.stats import regression_metrics
from almanac.operators.trees import fit_binned
from almanac.plans.fitted import Fitted
from almanac.plans.ordered import IDX, join_on_keys, series_plan
from almanac.plans.staged import fresh, staged

log = logging.getLogger(__name__)

MODEL_TYPES = ("linear", "ridge", "lasso", "elasticnet", "randomforest", "gbm")
FEATURES, PREDICTION = "__features", "__prediction"  # MLlib's columns while a model runs
PART = "__part_of"
MAX_DEPTH = 30  # of MLlib's trees


def assemble(df: DataFrame, features: Sequence[str], out: str = FEATURES) -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol=out, handleInvalid="keep").transform(df)


def make_estimator(model_type: str = "linear", params: dict | None = None, label: str = "label",
                   label_sd: float | None = None, n: int | None = None):
    """MLlib estimator with the reference's parameter conventions (MDL1-MDL7).

    ridge: sum-of-squares penalty alpha*||w||^2 -> regParam = alpha * sd_pop(y) / n;
    lasso: (1/2n) SSE + alpha*||w||_1 -> regParam = alpha;
    elastic net: lambda = alpha*l1 + alpha*(1-l1)*sd_pop(y), mixing = alpha*l1/lambda."""
    params = dict(params or {})
    common = dict(featuresCol=FEATURES, labelCol=label, predictionCol=PREDICTION)
    if model_type == "linear":
        return LinearRegression(solver="normal", regParam=0.0, **common)
    if model_type == "ridge":
        alpha = float(params.get("alpha", 1.0))
        if label_sd is None or n is None:
            raise ValueError("ridge needs the label sd and the row count")
        return LinearRegression(solver="normal", elasticNetParam=0.0, regParam=alpha * label_sd / n,
                                standardization=False, **common)
    if model_type == "lasso":
        alpha = float(params.get("alpha", 1.0))
        return LinearRegression(elasticNetParam=1.0, regParam=alpha, standardization=False, maxIter=1000,
                                tol=1e-10, **common)
    if model_type == "elasticnet":
        alpha = float(params.get("alpha", 1.0))
        l1 = float(params.get("l1_ratio", 0.5))
        if label_sd is None:
            raise ValueError("elastic net needs the label sd")
        lam = alpha * l1 + alpha * (1 - l1) * label_sd
        return LinearRegression(elasticNetParam=(alpha * l1 / lam) if lam else 0.0, regParam=lam,
                                standardization=False, maxIter=1000, tol=1e-10, **common)
    if model_type == "randomforest":
        depth = params.get("max_depth")
        if depth is not None and int(depth) > MAX_DEPTH:
            raise ValueError(f"max_depth {depth} is beyond the {MAX_DEPTH} levels that MLlib trees have")
        if depth is None:
            log.info("no max_depth: MLlib's deepest trees, %d levels", MAX_DEPTH)
        return RandomForestRegressor(numTrees=int(params.get("n_estimators", 100)),
                                     maxDepth=MAX_DEPTH if depth is None else int(depth),
                                     featureSubsetStrategy="all", bootstrap=bool(params.get("bootstrap", True)),
                                     seed=int(params.get("random_state", 42)), **common)
    if model_type == "gbm":
        return GBTRegressor(maxIter=int(params.get("n_estimators", 100)), stepSize=float(params.get("learning_rate", 0.1)),
                            maxDepth=int(params.get("max_depth", 3)), seed=int(params.get("random_state", 42)), **common)
    raise ValueError(f"unknown model type {model_type!r}")


def train_model(df: DataFrame, features: Sequence[str], label: str, model_type: str = "linear", params: dict | None = None):
    """Fit one MLlib model on all rows of ``df`` (MDL1-MDL6); trees of a long table are fitted to its cells."""
    sd = n = None
    if model_type in ("ridge", "elasticnet"):
        st = df.agg(F.stddev_pop(label).alias("sd"), F.count(F.lit(1)).alias("n")).first()
        sd, n = float(st["sd"] or 0.0), int(st["n"])
    est = make_estimator(model_type, params, label, sd, n)
    binned = fit_binned(df, features, label, est) if model_type in ("randomforest", "gbm") else None
    return binned or est.fit(assemble(df, features))


def evaluate_model(model, df: DataFrame, features: Sequence[str], label: str, keys: Sequence[str] = ()):
    """Predictions and metrics (MDL8). Returns (predictions, metrics); the column of predictions is the last one, ``prediction``
    or longer where the input has that name."""
    pred = predictions(model, df, features)
    return pred, regression_metrics(pred, label, pred.columns[-1], keys)


def predictions(model, df: DataFrame, features: Sequence[str]) -> DataFrame:
    (out,) = fresh(df.columns, "prediction")
    return model.transform(assemble(df, features)).drop(FEATURES).withColumnRenamed(PREDICTION, out)


def importances(model, features: Sequence[str], spark) -> DataFrame:
    """Tree feature importances sorted descending (MDL10) or linear coefficients sorted by
    absolute value (MDL11)."""
    if hasattr(model, "featureImportances"):
        vals = model.featureImportances.toArray().tolist()
        rows = sorted(zip(features, vals), key=lambda t: -t[1])
        return spark.createDataFrame(rows, "feature string, importance double")
    vals = model.coefficients.toArray().tolist()
    rows = sorted(zip(features, vals), key=lambda t: -abs(t[1]))
    return spark.createDataFrame(rows, "feature string, coefficient double")


# ------------------------------------------------------------------ fits from cross-products, per series
def fit_linear_per_series(df: DataFrame, keys: Sequence[str], features: Sequence[str], label: str,
                          alpha: float | Sequence[float] = 0.0, model_type: str = "ridge", l1_ratio: float = 0.5) -> DataFrame:
    """OLS (alpha = 0), ridge (penalty alpha * ||w||^2 on the sum of squares, intercept not penalised), lasso or elastic net per
    series. Returns keys..., intercept, one coefficient column per feature; the intercept's column gets a longer
    name where a key or feature has it."""
    keys, feats = list(keys), list(features)
    d = df.where(F.col(label).isNotNull())
    found = gram.fits(gram.moments(d, keys, [F.col(c) for c in [*feats, label]]), model_type, alpha, l1_ratio)
    k = len(keys)
    names = fresh([*keys, *feats], "intercept") + [f"c{i}" for i in range(len(found.columns))]
    intercept, c = names[0], names[1:]
    d = found.toDF(*c)  # by place: keys, segment, rows, intercept, weights
    return d.select(*[F.col(c[i]).alias(key) for i, key in enumerate(keys)], F.col(c[k + 2]).alias(intercept),
                    *[F.col(c[k + 3])[i].alias(f) for i, f in enumerate(feats)])


def predict_linear(df: DataFrame, coefs: DataFrame, keys: Sequence[str], features: Sequence[str],
                   out: str = "prediction") -> DataFrame:
    """``df`` with the prediction of the coefficients (columns: keys, intercept, one per feature, in this order)."""
    keys = list(keys)
    names = fresh([*df.columns, out], *[f"__w{i}" for i in range(len(features) + 1)])
    c = coefs.toDF(*keys, *names)
    j = join_on_keys(df, c, keys, "left")
    pred = F.col(names[0])
    for f, w in zip(features, names[1:]):
        pred = pred + F.col(w) * F.col(f)
    return j.withColumn(out, pred).drop(*names)


# ------------------------------------------------------------------ cross-validation (SPL4, AGG10)
def time_series_cv(df: DataFrame, features: Sequence[str], label: str, model_type: str = "linear",
                   params: dict | None = None, n_splits: int = 5, initial_train_size: int | None = None,
                   order: Sequence[str] = ("date",)) -> tuple[DataFrame, DataFrame]:
    """Expanding-window CV of one model. Returns (per-fold metrics, mean/std summary).
    Folds are a small table; each kept fold is one fit on ``idx < train_end``."""
    spark = df.sparkSession
    if model_type in gram.MODELS:  # all folds from running sums of cross-products
        p = params or {}
        per_fold, summary, folds = cv_linear(df, features, label, [], n_splits, _alpha(model_type, p), initial_train_size, order,
                                             model_type=model_type, l1_ratio=float(p.get("l1_ratio", 0.5)))
        sized = folds.select("fold", F.col("train_end").alias("train_size"), (F.col("test_end") - F.col("test_start")).alias("test_size"))
        return per_fold.join(sized, "fold").select("fold", "train_size", "test_size", *METRICS), summary
    plan = series_plan(df, [], list(order))
    d = df if IDX in df.columns else plan.index(df)
    d = staged(d.select(IDX, label, *[c for c in features if c != label]), "cv-rows")
    folds = cv_folds(d, [], n_splits, initial_train_size).where("kept").collect()  # at most n_splits rows
    rows = []
    for f in folds:
        train = d.where(F.col(IDX) < f["train_end"])
        test = d.where((F.col(IDX) >= f["test_start"]) & (F.col(IDX) < f["test_end"]))
        m = train_model(train, features, label, model_type, params)
        _, met = evaluate_model(m, test, features, label)
        r = met.first()
        rows.append((int(f["fold"]), int(f["train_end"]), int(f["test_end"] - f["test_start"]), *[r[m] for m in METRICS]))
    per_fold = spark.createDataFrame(rows, "fold int, train_size long, test_size long, rmse double, mae double, "
                                           "mape double, r2 double")
    return per_fold, _summary(per_fold, [])


METRICS = ("rmse", "mae", "mape", "r2")


def _summary(per_fold: DataFrame, keys: list[str]) -> DataFrame:
    return per_fold.groupBy(*keys).agg(*[F.avg(m).alias(f"mean_{m}") for m in METRICS], *[F.stddev_pop(m).alias(f"std_{m}") for m in METRICS])


def _alpha(model_type: str, params: dict) -> float:
    return 0.0 if model_type == "linear" else float(params.get("alpha", 1.0))


def cv_linear(df: DataFrame, features: Sequence[str], label: str, keys: Sequence[str] = (), n_splits: int = 5,
              alpha: float = 0.0, initial_train_size: int | None = None, order: Sequence[str] = ("date",),
              block_rows: int | None = None, model_type: str = "ridge", l1_ratio: float = 0.5) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Expanding-window CV of a linear, ridge, lasso or elastic-net model. The test parts cut a series into segments, each row
    lies in one; the cross-products of a fold's training rows are the running sum over the segments before its test part, so
    all folds of all series come from one aggregate and no row is copied. Test rows are scored with a join.
    Returns (per-fold metrics, mean/std per series, fold table)."""
    keys, feats = list(keys), list(features)
    plan = series_plan(df, keys, list(order), block_rows)
    d = df if IDX in df.columns else plan.index(df)
    ks, xs = [f"k{i}" for i in range(len(keys))], [f"x{i}" for i in range(len(feats))]
    (n,) = fresh(d.columns, "__n")
    size = F.floor(F.col(n) / F.lit(n_splits + 1))
    after = F.col(IDX) - (F.col(n) - n_splits * size)  # rows since the first fold's test part began
    segment = F.when((after < 0) | (size == 0), 0).otherwise(F.floor(after / size) + 1)
    d = staged(plan.with_count(d, n).select(*[F.col(k).alias(a) for k, a in zip(keys, ks)], *[F.col(c).alias(x) for c, x in zip(feats, xs)],
                                            F.col(label).cast("double").alias("y"), segment.cast("int").alias("fold")), "cv-rows")
    folds = cv_folds(d, ks, n_splits, initial_train_size).where("kept")
    # a fold is trained on the segments up to its own number; the next one holds its test rows
    known = d.where(F.col("y").isNotNull())
    coefs = gram.fits(gram.moments(known, ks, [F.col(c) for c in [*xs, "y"]], F.col("fold"), colocate=False), model_type, alpha, l1_ratio, n_splits)
    coefs = join_on_keys(coefs.withColumnRenamed("seg", "fold"), folds.select(*ks, "fold"), [*ks, "fold"], "inner")
    test = d.where(F.col("fold") > 0).withColumn("fold", F.col("fold") - 1)
    scored = join_on_keys(test, coefs.select(*ks, "fold", "intercept", "weights"), [*ks, "fold"], "inner")
    pred = F.col("intercept")
    for i, x in enumerate(xs):
        pred = pred + F.col("weights")[i] * F.col(x)
    (fold,) = fresh(keys, "fold")
    back = [F.col(a).alias(k) for a, k in zip(ks, keys)]
    per_fold = regression_metrics(scored.withColumn("prediction", pred), "y", "prediction", [*ks, "fold"])
    per_fold = per_fold.select(*back, F.col("fold").alias(fold), *per_fold.columns[len(ks) + 1:])
    return per_fold, _summary(per_fold, keys), folds.select(*back, F.col("fold").alias(fold), *folds.columns[len(ks) + 1:])


# ------------------------------------------------------------------ train and evaluate (MDL9)
@dataclass
class TrainResult:
    model: object
    metrics: DataFrame
    predictions: DataFrame
    cv_folds: DataFrame | None
    cv_summary: DataFrame | None
    residual_tests: DataFrame
    importances: DataFrame


def train_and_evaluate(df: DataFrame, target_col: str, feature_cols: Sequence[str], date_col: str = "date",
                       model_type: str = "linear", params: dict | None = None, test_size: float = 0.2,
                       use_cv: bool = True, n_cv_splits: int = 5, fill_groups: Sequence[str] | None = None,
                       keys: Sequence[str] = (), fit_scope: str = "all") -> TrainResult:
    """Impute, split in time order, fit, evaluate, cross-validate and test residuals.

    With ``keys`` every series is filled, split, fitted (linear, ridge, lasso or elastic net, one coefficient row per series as
    ``model``) and scored by itself, all in the same jobs. ``fit_scope='train'`` takes the filling means
    from the training rows only; ``'all'`` from every row."""
    from almanac.operators.diagnostics import residual_tests
    from almanac.operators.prepare import handle_missing_values
    feats = [c for c in feature_cols if c in df.columns]
    for c in feature_cols:
        if c not in df.columns:
            log.warning("feature %r not found", c)
    if model_type not in MODEL_TYPES:
        raise ValueError(f"unknown model type {model_type!r}")
    if fit_scope not in ("all", "train"):
        raise ValueError(f"unknown fit scope {fit_scope!r}")
    keys = list(keys)
    if keys and model_type not in gram.MODELS:
        raise ValueError(f"one {model_type} model per series is not offered; fit the series without keys")
    feats = [c for c in feats if c != target_col and c not in keys]
    groups = [g for g in fill_groups or [] if g in df.columns and g not in (*keys, date_col, target_col, *feats)]
    d = df.select(*keys, date_col, target_col, *feats, *groups)
    if fit_scope == "all":
        d = handle_missing_values(d, "mean", fill_groups=fill_groups, date_col=date_col, keys=keys, columns=[target_col, *feats])
    d = series_plan(d, keys, [date_col]).index(d)
    lab = split_labels(d, keys, [date_col], "train_test", test_size, part_col=PART)
    if fit_scope == "train":
        lab = _fill_from_train(lab, keys, list(fill_groups or []), [target_col, *feats])
    lab = staged(lab.drop(*groups), "train-rows")
    train = lab.where(F.col(PART) == "train")
    test = lab.where(F.col(PART) == "test")
    if keys:
        return _train_panel(lab, train, test, target_col, feats, date_col, model_type, params, use_cv, n_cv_splits, keys)
    model = train_model(train, feats, target_col, model_type, params)
    pred, metrics = evaluate_model(model, test, feats, target_col)
    allpred = predictions(model, lab, feats)
    out = allpred.columns[-1]
    cv_f = cv_s = None
    if use_cv:
        cv_f, cv_s = time_series_cv(lab.drop(PART), feats, target_col, model_type, params, n_cv_splits,
                                    order=[date_col])
    res = residual_tests(pred, target_col, out, order=[IDX])
    imp = importances(model, feats, df.sparkSession)
    return TrainResult(model, metrics, allpred.select(date_col, F.col(IDX).alias("idx"), F.col(PART).alias("part"), F.col(target_col).alias("actual"),
                                                      F.col(out).alias("predicted")),
                       cv_f, cv_s, res, imp)


def _fill_from_train(lab: DataFrame, keys: list[str], groups: list[str], cols: list[str]) -> DataFrame:
    """Missing values take the mean of their group, then of their series, both of training rows only."""
    if not all(g in lab.columns for g in groups):
        groups = []
    for by in [[*keys, *groups], keys] if groups else [keys]:
        means = Fitted.fit(lab.where(F.col(PART) == "train"), by, {f"__f_{c}": F.avg(c) for c in cols})
        based, mean, drop = means.attach(lab)
        lab = based.withColumns({c: F.coalesce(F.col(c), mean[f"__f_{c}"]) for c in cols}).drop(*drop)
    return lab


def _train_panel(lab: DataFrame, train: DataFrame, test: DataFrame, target: str, feats: list[str], date_col: str, model_type: str,
                 params: dict | None, use_cv: bool, n_splits: int, keys: list[str]) -> TrainResult:
    from almanac.operators.diagnostics import residual_tests
    alpha, l1 = _alpha(model_type, params or {}), float((params or {}).get("l1_ratio", 0.5))
    coefs = fit_linear_per_series(train, keys, feats, target, alpha, model_type, l1)
    (out,) = fresh(lab.columns, "prediction")
    scored = predict_linear(lab, coefs, keys, feats, out)
    pred = scored.where(F.col(PART) == "test")
    cv_f = cv_s = None
    if use_cv:
        cv_f, cv_s, _ = cv_linear(lab.drop(PART), feats, target, keys, n_splits, alpha, order=[date_col], model_type=model_type, l1_ratio=l1)
    body = ", ".join(f"'{f}', `{f}`" for f in feats)
    imp = coefs.select(*keys, F.expr(f"stack({len(feats)}, {body}) as (feature, coefficient)")).orderBy(
        *keys, F.abs("coefficient").desc(), "feature")
    return TrainResult(coefs, regression_metrics(pred, target, out, keys),
                       scored.select(*keys, date_col, F.col(IDX).alias("idx"), F.col(PART).alias("part"), F.col(target).alias("actual"),
                                     F.col(out).alias("predicted")),
                       cv_f, cv_s, residual_tests(pred, target, out, keys, [IDX]), imp)
