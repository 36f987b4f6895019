"""Feature engineering (MTH1-MTH3, WIN1, WIN2, WIN7, TRF5).

All order-based features of one call are built in a single ``select`` over one window
spec, so Catalyst plans one exchange and one sort for all lags, rolling statistics and
Fourier positions together."""

from __future__ import annotations

import logging
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from almanac.functions import formulas as fx
from almanac.functions.calendar import create_date_features
from almanac.functions.schema import (CALENDAR_COLUMNS, KEY_INDICATOR_WORDS, LOG_CANDIDATE_WORDS, existing,
                                      name_matches, numeric_columns)
from almanac.plans.fitted import Fitted
from almanac.plans.ordered import IDX, series_plan

log = logging.getLogger(__name__)

ROLL_FUNCS = ("mean", "std", "min", "max")


def _roll(fn: str, c: str, w: Window, size: int) -> Column | None:
    frame = w.rowsBetween(-(size - 1), 0)
    if fn == "mean":
        return F.avg(c).over(frame)
    if fn == "std":
        return F.stddev_samp(c).over(frame)
    if fn == "min":
        return F.min(c).over(frame)
    if fn == "max":
        return F.max(c).over(frame)
    log.warning("unsupported rolling function %r", fn)
    return None


class FeatureSpec:
    """Collects order-based feature expressions, then evaluates them in one pass."""

    def __init__(self):
        self.items: list[tuple[str, object]] = []  # (name, builder(w) -> Column)
        self.back = 0
        self.fwd = 0
        self.needs_idx = False

    def lag(self, c: str, k: int, name: str | None = None):
        name = name or f"{c}_lag_{k}"
        if k >= 0:
            self.items.append((name, lambda w, c=c, k=k: F.lag(c, k).over(w)))
            self.back = max(self.back, k)
        else:
            self.items.append((name, lambda w, c=c, k=k: F.lead(c, -k).over(w)))
            self.fwd = max(self.fwd, -k)

    def rolling(self, c: str, size: int, fn: str):
        if fn not in ROLL_FUNCS:
            log.warning("unsupported rolling function %r", fn)
            return
        self.items.append((f"{c}_roll_{size}_{fn}", lambda w, c=c, s=size, f=fn: _roll(f, c, w, s)))
        self.back = max(self.back, size - 1)

    def fourier(self, period, harmonic: int):
        self.needs_idx = True
        for part in (0, 1):
            name = f"{'sin' if part == 0 else 'cos'}_{period}_{harmonic}"
            self.items.append((name, ("fourier", period, harmonic, part)))

    def apply(self, df: DataFrame, keys: Sequence[str], order: Sequence[str], block_rows: int | None = None,
              keep_idx: bool = False) -> DataFrame:
        if not self.items:
            return df
        plan = series_plan(df, keys, order, block_rows)
        had = IDX in df.columns
        d = df
        if plan.blocked and not had:
            d = plan.index(df)

        def build(w):
            pos = F.col(IDX) if (plan.blocked or had) else (F.row_number().over(w) - 1).cast("long")
            out = {}
            for name, b in self.items:
                if isinstance(b, tuple):
                    _, period, h, part = b
                    out[name] = fx.fourier(pos, period, h)[part]
                else:
                    out[name] = b(w)
            if keep_idx and not (plan.blocked or had):
                out[IDX] = pos
            return out

        res = plan.bounded(d, build, back=self.back, fwd=self.fwd)
        if plan.blocked and not had and not keep_idx:
            res = res.drop(IDX)
        return res


# ------------------------------------------------------------------ public operators
def create_fourier_terms(df: DataFrame, periods: Sequence[float] = (12,), harmonics: int = 3,
                         keys: Sequence[str] = (), order: Sequence[str] = ("date",),
                         block_rows: int | None = None) -> DataFrame:
    """``sin_{p}_{h}`` / ``cos_{p}_{h}`` of 2*pi*h*idx/p, idx = position in the series (MTH1)."""
    spec = FeatureSpec()
    for p in periods:
        for h in range(1, harmonics + 1):
            spec.fourier(p, h)
    return spec.apply(df, keys, order, block_rows)


def create_lagged_features(df: DataFrame, columns: Sequence[str], lags: Sequence[int], keys: Sequence[str] = (),
                           order: Sequence[str] = ("date",), block_rows: int | None = None,
                           keep_index: bool = False) -> DataFrame:
    """``{c}_lag_{k}``; missing values count as rows (WIN1). ``keep_index`` keeps the row
    private position so a following order-based call reuses it instead of re-indexing."""
    spec = FeatureSpec()
    for c in existing(df, columns):
        for k in lags:
            spec.lag(c, k)
    return spec.apply(df, keys, order, block_rows, keep_idx=keep_index)


def create_rolling_features(df: DataFrame, columns: Sequence[str], windows: Sequence[int] = (3, 6, 12),
                            functions: Sequence[str] = ROLL_FUNCS, keys: Sequence[str] = (),
                            order: Sequence[str] = ("date",), block_rows: int | None = None,
                            keep_index: bool = False) -> DataFrame:
    """``{c}_roll_{w}_{f}`` over the trailing ``w`` rows, at least one value (WIN2)."""
    spec = FeatureSpec()
    for c in existing(df, columns):
        for w in windows:
            for f in functions:
                spec.rolling(c, w, f)
    return spec.apply(df, keys, order, block_rows, keep_idx=keep_index)


def row_index(df: DataFrame, keys: Sequence[str] = (), order: Sequence[str] = ("date",),
              block_rows: int | None = None, name: str = "idx") -> DataFrame:
    """0-based position within each series (WIN7)."""
    plan = series_plan(df, keys, order, block_rows)
    return plan.index(df, name)


def safe_log_transform(df: DataFrame, columns: Sequence[str], offset: float = 1.0, keys: Sequence[str] = ()) -> DataFrame:
    """``{c}_log`` = ln(c + o), o = offset if min > 0 else abs(min) + offset (per series) (MTH2)."""
    cols = existing(df, columns)
    if not cols:
        return df
    fit = Fitted.fit(df, keys, {f"__o_{c}": fx.log_offset_feature(F.min(c), offset) for c in cols})
    based, p, drop = fit.attach(df)
    return based.withColumns({f"{c}_log": F.log(F.col(c) + p[f"__o_{c}"]) for c in cols}).drop(*drop)


def create_interaction_features(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """``{a}_{b}_interaction`` = a * b (MTH3)."""
    have = set(df.columns)
    new = {}
    for a, b in pairs:
        if a not in have or b not in have:
            log.warning("interaction %s x %s: column missing", a, b)
            continue
        new[f"{a}_{b}_interaction"] = F.col(a) * F.col(b)
    return df.withColumns(new) if new else df


def engineer_features(df: DataFrame, target_col: str, date_col: str = "date", numeric_cols: Sequence[str] | None = None,
                      create_lags: bool = True, create_fourier: bool = True, create_rolling: bool = True,
                      log_transform: bool = True, max_lag: int = 6, periods: Sequence[float] | None = None,
                      harmonics: int = 2, rolling_windows: Sequence[int] = (3, 6, 12),
                      keys: Sequence[str] = (), order: Sequence[str] | None = None,
                      block_rows: int | None = None) -> DataFrame:
    """Date parts, Fourier terms, lags of the target and key indicators, rolling means of
    key indicators and safe logs of log candidates, in one window pass (TRF5)."""
    keys = list(keys)
    order = list(order or [date_col])
    if numeric_cols is None:
        numeric_cols = numeric_columns(df, [date_col, target_col, *CALENDAR_COLUMNS, *keys])
    numeric_cols = list(numeric_cols)
    out = df
    if not all(c in out.columns for c in ("year", "month", "quarter")):
        out = create_date_features(out, date_col)
    has_q = all(f"Q{i}" in out.columns for i in range(1, 5))
    spec = FeatureSpec()
    if create_fourier:
        for p in (periods if periods is not None else ([12] if has_q else [4, 12])):
            for h in range(1, harmonics + 1):
                spec.fourier(p, h)
    key_ind = name_matches(numeric_cols, KEY_INDICATOR_WORDS)
    if create_lags:
        if target_col not in key_ind and target_col in out.columns:
            for k in range(1, max_lag + 1):
                spec.lag(target_col, k)
        for c in key_ind:
            for k in range(1, max_lag + 1):
                spec.lag(c, k)
    if create_rolling:
        for c in [c for c in key_ind if c != target_col]:
            for w in rolling_windows:
                spec.rolling(c, w, "mean")
    out = spec.apply(out, keys, order, block_rows)
    if log_transform:
        cands = [c for c in name_matches(numeric_cols, LOG_CANDIDATE_WORDS) if c != target_col]
        out = safe_log_transform(out, cands, keys=keys)
    return out
