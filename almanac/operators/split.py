"""Chronological splits and expanding-window cross-validation folds (SPL1-SPL4).

Cuts are computed in Spark with the same double expression as the reference
(``int(n * (1 - test_size))`` etc.), per series, from the per-series row count."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from almanac.plans.ordered import IDX, series_plan
from almanac.plans.staged import fresh

RULES = ("three_way", "train_test", "forecast")


def split_labels(df: DataFrame, keys: Sequence[str] = (), order: Sequence[str] = ("date",), rule: str = "three_way",
                 test_size: float = 0.2, validation_size: float = 0.1, block_rows: int | None = None,
                 part_col: str = "part", index_col: str = "idx") -> DataFrame:
    """Add the position ``index_col`` (unless the input owns that name) and ``part`` (train / validation /
    test) to every row.

    * ``three_way`` — train below int(n*(1-test-val)), validation below int(n*(1-test)) (SPL1);
    * ``train_test`` — test = int(n*test), train = n - test (SPL2);
    * ``forecast`` — train = int(n*(1-test)) (SPL3)."""
    if rule not in RULES:
        raise ValueError(f"unknown split rule {rule!r}")
    keys = list(keys)
    plan = series_plan(df, keys, list(order), block_rows)
    had = IDX in df.columns
    d = df if had else plan.index(df)
    (count,) = fresh([*d.columns, part_col, index_col], "__n")
    d = plan.with_count(d, count)
    n = F.col(count).cast("double")
    one, ts, vs = F.lit(1.0), F.lit(float(test_size)), F.lit(float(validation_size))
    i = F.col(IDX)
    if rule == "three_way":
        val_cut = F.floor(n * (one - ts - vs))
        test_cut = F.floor(n * (one - ts))
        part = F.when(i < val_cut, "train").when(i < test_cut, "validation").otherwise("test")
    elif rule == "train_test":
        train_n = F.col(count) - F.floor(n * ts)
        part = F.when(i < train_n, "train").otherwise("test")
    else:
        part = F.when(i < F.floor(n * (one - ts)), "train").otherwise("test")
    d = d.withColumn(part_col, part).drop(count)
    if had:
        return d
    return d.drop(IDX) if index_col in df.columns else d.withColumnRenamed(IDX, index_col)


def split_data(df: DataFrame, keys: Sequence[str] = (), order: Sequence[str] = ("date",), test_size: float = 0.2,
               validation_size: float = 0.1) -> tuple[DataFrame, DataFrame, DataFrame]:
    lab = split_labels(df, keys, order, "three_way", test_size, validation_size)
    return tuple(lab.where(F.col("part") == p).drop("part") for p in ("train", "validation", "test"))


def cv_folds(df: DataFrame, keys: Sequence[str] = (), n_splits: int = 5, initial_train_size: int | None = None,
             min_train_fraction: float = 0.7) -> DataFrame:
    """Expanding-window folds per series: test size n // (splits + 1), fold i tests rows
    [n - (splits - i) * size, + size) and trains on every row before; a fold whose train
    part is shorter than int(0.7 n) (or ``initial_train_size``) is marked not kept (SPL4).
    Columns: keys..., fold, train_end, test_start, test_end (exclusive), kept."""
    keys = list(keys)
    cnt = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    size = F.floor(F.col("__n") / F.lit(n_splits + 1))
    folds = cnt.select(*keys, "__n", size.alias("__sz"), F.explode(F.sequence(F.lit(0), F.lit(n_splits - 1))).alias("fold"))
    start = F.col("__n") - (F.lit(n_splits) - F.col("fold")) * F.col("__sz")
    minimum = F.lit(initial_train_size) if initial_train_size is not None else F.floor(
        F.col("__n").cast("double") * F.lit(min_train_fraction))
    return folds.select(
        *keys, F.col("fold").cast("int").alias("fold"), start.cast("long").alias("train_end"),
        start.cast("long").alias("test_start"), (start + F.col("__sz")).cast("long").alias("test_end"),
        (start >= minimum).alias("kept"))
