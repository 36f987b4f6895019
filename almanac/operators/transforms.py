"""Invertible transformations with fitted state (TRF1-TRF4, MTH4-MTH15, WIN3-WIN6).

State is kept per (series, column, step): offsets, means, scales and lambdas in a small
per-series table (or literals for a single series) and the first ``k`` values of each
series for the differences. Every step with data-dependent parameters costs one
aggregate over all columns; maximum-likelihood lambdas cost about a dozen more over the columns alone, written
once: each pass narrows the root of the likelihood's derivative with two sums a column and reads a row once."""

from __future__ import annotations

import logging
from functools import reduce
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almanac.functions import formulas as fx
from almanac.plans.fitted import Fitted
from almanac.plans.ordered import IDX, join_on_keys, series_plan
from almanac.plans.staged import staged
from almanac.session import ensure_checkpoint_dir

log = logging.getLogger(__name__)

MAX_HALF_WIDTH = 640.0  # a likelihood still rising there has no maximum to speak of

KINDS = ("log", "sqrt", "diff", "seasonal_diff", "standardize", "normalize", "box_cox", "yeo_johnson")


# ------------------------------------------------------------------ lambda by maximum likelihood
def fit_lambda(df: DataFrame, keys: Sequence[str], xs: dict[str, Column], kind: str,
               passes: int = 40, half_width: float = 5.0, tolerance: float = 1e-8) -> Fitted:
    """Lambda maximising the Box-Cox or Yeo-Johnson profile log-likelihood per series and
    column. ``xs`` maps a column name to the (already offset) values. Returns a Fitted
    holding ``{name}__lam``; values that do not vary have no best lambda and get 1.

    The derivative of the likelihood is ``S - n cov(y, y') / var(y)`` (y the transformed values, y' their derivative by lambda, S
    the sum of the log scale): a bracket is widened until the derivative changes sign in it, then narrowed by
    regula falsi (halving the value of an end that stays, as Illinois does). A pass is one aggregate over all columns; with
    keys its result, one row a series, is checkpointed."""
    keys, names = list(keys), list(xs)
    if keys:
        ensure_checkpoint_dir(df.sparkSession)
    ks = [f"k{i}" for i in range(len(keys))]
    d = staged(df.select(*[F.col(k).alias(a) for k, a in zip(keys, ks)],
                         *[x.cast("double").alias(f"x{i}") for i, x in enumerate(xs.values())]), "lambda-rows")
    search = _Search(d, ks, len(names), kind)
    state = search.start(half_width)
    while half_width < MAX_HALF_WIDTH and search.most(state, "open") > 0:
        half_width *= 2
        state = search.start(half_width)
    for _ in range(passes):
        state = search.narrow(state)
        if search.most(state, "step") < tolerance:
            break
    lams = {f"{n}__lam": f"at{i}" for i, n in enumerate(names)}
    if not keys:
        return Fitted(keys, row={n: state.row[c] for n, c in lams.items()})
    return Fitted(keys, table=state.table.select(*[F.col(a).alias(k) for a, k in zip(ks, keys)], *[F.col(c).alias(n) for n, c in lams.items()]))


class _Search:
    """Brackets of the best lambdas, one row a series: per column i lo, hi, the derivative glo, ghi there, the end that moved
    last, at (the last lambda tried), step (how far the next one lies), open (1: no change of sign yet), n and s."""

    FAR = 1e300  # stands for a derivative that cannot be told: it points back to lambda 1

    def __init__(self, d: DataFrame, ks: list[str], columns: int, kind: str):
        self.d, self.ks, self.columns, self.kind = d, ks, columns, kind

    def shape(self, x: Column, lam: Column) -> tuple[Column, Column]:
        """The transformed value and its derivative by lambda."""
        if self.kind == "box_cox":
            return fx.box_cox(x, lam), fx.box_cox_by_lambda(x, lam)
        low, rest = F.greatest(x, F.lit(0.0)) + 1, F.lit(1.0) - F.least(x, F.lit(0.0))
        return fx.yeo_johnson(x, lam), F.when(x >= 0, fx.box_cox_by_lambda(low, lam)).otherwise(fx.box_cox_by_lambda(rest, F.lit(2.0) - lam))

    def derivative(self, lam: Column, n: Column, s: Column, v: Column, c: Column) -> Column:
        g = F.when(v > 0, s - n * c / v)
        return F.when(g.isNotNull() & ~F.isnan(g) & (F.abs(g) < self.FAR), g).otherwise(F.when(lam > 1, -self.FAR).otherwise(self.FAR))

    def taken(self, out: DataFrame) -> Fitted:
        return Fitted(self.ks, table=out).materialize() if self.ks else Fitted(self.ks, row=out.first().asDict())

    def most(self, state: Fitted, what: str) -> float:
        cols = [f"{what}{i}" for i in range(self.columns)]
        if state.row is not None:
            return max(state.row[c] for c in cols)
        return state.table.agg(*[F.max(c) for c in cols]).select(F.greatest(F.lit(0.0), *[F.col(f"max({c})").cast("double") for c in cols])).first()[0]

    def start(self, half: float) -> Fitted:
        aggs = []
        for i in range(self.columns):
            x = F.col(f"x{i}")
            s = F.log(x) if self.kind == "box_cox" else F.signum(x) * F.log1p(F.abs(x))
            aggs += [F.count(x).alias(f"n{i}"), F.sum(s).alias(f"s{i}"), F.var_pop(x).alias(f"w{i}")]
            for end, lam in (("lo", -half), ("hi", half)):
                y, by = self.shape(x, F.lit(lam))
                aggs += [F.var_pop(y).alias(f"v{end}{i}"), F.covar_pop(y, by).alias(f"c{end}{i}")]
        sums = self.d.groupBy(*self.ks).agg(*aggs)
        out = []
        for i in range(self.columns):
            n, s = F.col(f"n{i}").cast("double"), F.col(f"s{i}")
            glo, ghi = (self.derivative(F.lit(lam), n, s, F.col(f"v{end}{i}"), F.col(f"c{end}{i}")) for end, lam in (("lo", -half), ("hi", half)))
            flat = ~F.coalesce(F.col(f"w{i}") > 0, F.lit(False))
            out += [n.alias(f"n{i}"), s.alias(f"s{i}"), F.when(flat, 1.0).otherwise(-half).alias(f"lo{i}"), F.when(flat, 1.0).otherwise(half).alias(f"hi{i}"),
                    glo.alias(f"glo{i}"), ghi.alias(f"ghi{i}"), F.lit(0).alias(f"side{i}"), F.lit(1.0).alias(f"at{i}"), F.lit(1.0).alias(f"step{i}"),
                    (~flat & ((glo < 0) | (ghi > 0))).cast("int").alias(f"open{i}")]
        return self.taken(sums.select(*self.ks, *out))

    def narrow(self, state: Fitted) -> Fitted:
        base, p, _ = state.attach(self.d)
        aggs, names = [], ("n", "s", "lo", "hi", "glo", "ghi", "side", "at")
        for i in range(self.columns):
            q = {c: p[f"{c}{i}"] for c in names}
            width = q["hi"] - q["lo"]
            cut = (q["lo"] * q["ghi"] - q["hi"] * q["glo"]) / (q["ghi"] - q["glo"])
            far = (F.abs(q["glo"]) >= self.FAR / 2) | (F.abs(q["ghi"]) >= self.FAR / 2)
            inside = ~far & (cut > q["lo"]) & (cut < q["hi"])
            lam = F.when(inside, cut).otherwise(q["lo"] + width / 2)
            y, by = self.shape(F.col(f"x{i}"), lam)
            aggs += [F.max(F.when(F.lit(True), e)).alias(f"{c}{i}") for c, e in q.items()]
            aggs += [F.max(lam).alias(f"lam{i}"), F.var_pop(y).alias(f"v{i}"), F.covar_pop(y, by).alias(f"c{i}")]
        sums = base.groupBy(*self.ks).agg(*aggs)
        out = []
        for i in range(self.columns):
            q = {c: F.col(f"{c}{i}") for c in (*names, "lam")}
            g = self.derivative(q["lam"], q["n"], q["s"], F.col(f"v{i}"), F.col(f"c{i}"))
            up = g > 0
            done = q["lo"] == q["hi"]
            out += [q["n"], q["s"], F.when(up, q["lam"]).otherwise(q["lo"]).alias(f"lo{i}"), F.when(up, q["hi"]).otherwise(q["lam"]).alias(f"hi{i}"),
                    F.when(up, g).otherwise(F.when(q["side"] == -1, q["glo"] / 2).otherwise(q["glo"])).alias(f"glo{i}"),
                    F.when(up, F.when(q["side"] == 1, q["ghi"] / 2).otherwise(q["ghi"])).otherwise(g).alias(f"ghi{i}"),
                    F.when(up, 1).otherwise(-1).alias(f"side{i}"), F.when(done, 1.0).otherwise(q["lam"]).alias(f"at{i}"),
                    F.when(done, 0.0).otherwise(F.least(F.abs(q["lam"] - q["at"]), q["hi"] - q["lo"])).alias(f"step{i}"), F.lit(0).alias(f"open{i}")]
        return self.taken(sums.select(*self.ks, *out))


def merge_fitted(a: Fitted, b: Fitted) -> Fitted:
    if a.row is not None:
        return Fitted(a.keys, row={**a.row, **b.row})
    return Fitted(a.keys, table=join_on_keys(a.table, b.table, a.keys, "inner"))


# ------------------------------------------------------------------ steps
@dataclass
class Step:
    kind: str
    columns: list[str]
    fitted: Fitted | None = None
    options: dict = field(default_factory=dict)


class SeriesTransformer:
    """Fit, apply and invert a sequence of transformations on one or many series."""

    def __init__(self, keys: Sequence[str] = (), order: Sequence[str] | str | None = None,
                 block_rows: int | None = None):
        self.keys = list(keys)
        self.order = [order] if isinstance(order, str) else list(order or [])
        self.block_rows = block_rows
        self.steps: list[Step] = []

    # ---------------------------------------------------------------- forward
    def fit_transform(self, df: DataFrame, columns: Sequence[str], transformations: Sequence[str],
                      params: dict | None = None) -> DataFrame:
        params = params or {}
        cols = [c for c in columns if c in df.columns]
        for c in columns:
            if c not in df.columns:
                log.warning("column %r not found", c)
        self.steps = []  # refitting starts a new history
        out = df.withColumns({c: F.col(c).cast("double") for c in cols})
        for kind in transformations:
            if kind not in KINDS:
                log.warning("unknown transformation %r skipped", kind)
                continue
            out = self._forward(out, kind, cols, params)
        return out

    def _forward(self, df: DataFrame, kind: str, cols: list[str], params: dict) -> DataFrame:
        keys = self.keys
        if kind in ("log", "sqrt"):
            given = float(params.get(f"{kind}_offset", 0.0))
            rule = fx.log_offset_transform if kind == "log" else fx.sqrt_offset_transform
            fit = Fitted.fit(df, keys, {f"{c}__off": rule(F.min(c), given) for c in cols})
            fn = (lambda x, p, c: F.log(x + p[f"{c}__off"])) if kind == "log" else (
                lambda x, p, c: F.sqrt(x + p[f"{c}__off"]))
            step = Step(kind, cols, fit)
        elif kind == "standardize":
            wm, ws = bool(params.get("with_mean", True)), bool(params.get("with_std", True))
            aggs = {}
            for c in cols:
                aggs[f"{c}__mean"] = F.avg(c)
                aggs[f"{c}__sd"] = F.stddev_pop(c)
            fit = Fitted.fit(df, keys, aggs)
            fn = lambda x, p, c: fx.standardize(x, p[f"{c}__mean"], p[f"{c}__sd"], wm, ws)
            step = Step(kind, cols, fit, {"with_mean": wm, "with_std": ws})
        elif kind == "normalize":
            aggs = {}
            for c in cols:
                aggs[f"{c}__min"] = F.min(c)
                aggs[f"{c}__max"] = F.max(c)
            fit = Fitted.fit(df, keys, aggs)
            fn = lambda x, p, c: fx.normalize(x, p[f"{c}__min"], p[f"{c}__max"])
            step = Step(kind, cols, fit)
        elif kind == "box_cox":
            off = Fitted.fit(df, keys, {f"{c}__off": fx.box_cox_offset(F.min(c)) for c in cols})
            lam_given = params.get("box_cox_lambda")
            if lam_given is None:
                based, p, drop = off.attach(df)
                lam = fit_lambda(based, keys, {c: F.col(c) + p[f"{c}__off"] for c in cols}, "box_cox")
                fit = merge_fitted(off, lam)
            else:
                fit = merge_fitted(off, Fitted(keys, row={f"{c}__lam": float(lam_given) for c in cols})
                                   if not keys else Fitted.fit(df, keys, {f"{c}__lam": F.lit(float(lam_given)) for c in cols}))
            fn = lambda x, p, c: fx.box_cox(x + p[f"{c}__off"], p[f"{c}__lam"])
            step = Step(kind, cols, fit)
        elif kind == "yeo_johnson":
            lam_given = params.get("yeo_johnson_lambda")
            if lam_given is None:
                fit = fit_lambda(df, keys, {c: F.col(c) for c in cols}, "yeo_johnson")
            elif keys:
                fit = Fitted.fit(df, keys, {f"{c}__lam": F.lit(float(lam_given)) for c in cols})
            else:
                fit = Fitted(keys, row={f"{c}__lam": float(lam_given) for c in cols})
            fn = lambda x, p, c: fx.yeo_johnson(x, p[f"{c}__lam"])
            step = Step(kind, cols, fit)
        else:  # diff / seasonal_diff
            k = int(params.get("diff_lag", 1)) if kind == "diff" else int(params.get("seasonal_period", 12))
            return self._diff_forward(df, kind, cols, k)

        based, p, drop = step.fitted.attach(df)
        out = based.withColumns({c: fn(F.col(c), p, c) for c in cols}).drop(*drop)
        self.steps.append(step)
        return out

    def _plan(self, df: DataFrame):
        if not self.order:
            raise ValueError("differencing needs an order column")
        return series_plan(df, self.keys, self.order, self.block_rows)

    def _diff_forward(self, df: DataFrame, kind: str, cols: list[str], k: int) -> DataFrame:
        plan = self._plan(df)
        had_idx = IDX in df.columns
        d = df if had_idx else plan.index(df)
        seeds_aggs = {
            f"{c}__seed": F.transform(F.sort_array(F.collect_list(F.struct(F.col(IDX).alias("i"), F.col(c).alias("v")))),
                                      lambda s: s["v"])
            for c in cols
        }
        first = d.where(F.col(IDX) < k)  # at most k rows per series
        fit = Fitted.fit(first, self.keys, seeds_aggs)
        out = plan.bounded(d, lambda w: {f"__d_{c}": F.col(c) - F.lag(c, k).over(w) for c in cols}, back=k)
        out = out.withColumns({c: F.col(f"__d_{c}") for c in cols}).drop(*[f"__d_{c}" for c in cols])
        if not had_idx:
            out = out.drop(IDX)
        self.steps.append(Step(kind, cols, fit, {"k": k}))
        return out

    # ---------------------------------------------------------------- inverse
    def inverse_transform(self, df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
        out = df
        for step in reversed(self.steps):
            cols = [c for c in step.columns if (columns is None or c in columns) and c in out.columns]
            if not cols:
                continue
            if step.kind in ("diff", "seasonal_diff"):
                out = self._diff_inverse(out, step, cols)
                continue
            based, p, drop = step.fitted.attach(out)
            if step.kind == "log":
                fn = lambda y, c: fx.inv_log(y, p[f"{c}__off"])
            elif step.kind == "sqrt":
                fn = lambda y, c: fx.inv_sqrt(y, p[f"{c}__off"])
            elif step.kind == "standardize":
                wm, ws = step.options["with_mean"], step.options["with_std"]
                fn = lambda y, c: fx.inv_standardize(y, p[f"{c}__mean"], p[f"{c}__sd"], wm, ws)
            elif step.kind == "normalize":
                fn = lambda y, c: fx.inv_normalize(y, p[f"{c}__min"], p[f"{c}__max"])
            elif step.kind == "box_cox":
                fn = lambda y, c: fx.inv_box_cox(y, p[f"{c}__lam"], p[f"{c}__off"])
            else:
                fn = lambda y, c: fx.inv_yeo_johnson(y, p[f"{c}__lam"])
            out = based.withColumns({c: fn(F.col(c), c) for c in cols}).drop(*drop)
        return out

    def _diff_inverse(self, df: DataFrame, step: Step, cols: list[str]) -> DataFrame:
        """y[i] = seed[i] for i < k, else seed[i mod k] + running sum of d over the residue
        class; once a d is missing the rest of that class is missing."""
        k = step.options["k"]
        plan = self._plan(df)
        had_idx = IDX in df.columns
        d = df if had_idx else plan.index(df)
        d = d.withColumn("__cls", F.col(IDX) % F.lit(k))
        items = []
        for c in cols:
            late = F.col(IDX) >= k
            items.append((f"__s_{c}", "sum", F.when(late, F.col(c))))
            items.append((f"__n_{c}", "sum", F.when(late & F.col(c).isNull(), F.lit(1)).otherwise(F.lit(0))))
        d = plan.scan(d, items, extra=["__cls"])
        based, p, drop = step.fitted.attach(d)
        new = {}
        for c in cols:
            seed = p[f"{c}__seed"]
            at_cls = F.element_at(seed, (F.col("__cls") + 1).cast("int"))
            new[c] = (
                F.when(F.col(IDX) < k, at_cls)
                .when(F.col(f"__n_{c}") > 0, F.lit(None))
                .otherwise(at_cls + F.col(f"__s_{c}"))
            )
        out = based.withColumns(new)
        out = out.drop(*drop, "__cls", *[f"__s_{c}" for c in cols], *[f"__n_{c}" for c in cols])
        if not had_idx:
            out = out.drop(IDX)
        return out

    def state(self) -> list[dict]:
        """Human-readable history: kind, columns and (single-series) parameters."""
        return [{"kind": s.kind, "columns": s.columns, "params": (s.fitted.row if s.fitted else None), **s.options}
                for s in self.steps]


class TransformationPipeline:
    """Ordered list of steps over :class:`SeriesTransformer` (TRF3)."""

    def __init__(self, keys: Sequence[str] = (), order: Sequence[str] | str | None = None,
                 block_rows: int | None = None):
        self.keys, self.order, self.block_rows = list(keys), order, block_rows
        self.spec: list[tuple[list[str], list[str], dict]] = []
        self.fitted: list[SeriesTransformer] = []

    def add_step(self, columns: Sequence[str], transformations: Sequence[str], params: dict | None = None):
        self.spec.append((list(columns), list(transformations), dict(params or {})))
        return self

    def fit_transform(self, df: DataFrame) -> DataFrame:
        self.fitted = []
        out = df
        for cols, trs, prm in self.spec:
            t = SeriesTransformer(self.keys, self.order, self.block_rows)
            out = t.fit_transform(out, cols, trs, prm)
            self.fitted.append(t)
        return out

    def inverse_transform(self, df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
        out = df
        for t in reversed(self.fitted):
            out = t.inverse_transform(out, columns)
        return out

    def clear(self):
        self.spec, self.fitted = [], []
        return self


# ------------------------------------------------------------------ shortcuts (TRF4)
def log_scale_transform(df, columns, keys=(), order=None):
    t = SeriesTransformer(keys, order)
    return t.fit_transform(df, columns, ["log"]), t


def difference_transform(df, columns, lag: int = 1, keys=(), order=None):
    t = SeriesTransformer(keys, order)
    return t.fit_transform(df, columns, ["diff"], {"diff_lag": lag}), t


def seasonal_difference_transform(df, columns, period: int = 12, keys=(), order=None):
    t = SeriesTransformer(keys, order)
    return t.fit_transform(df, columns, ["seasonal_diff"], {"seasonal_period": period}), t


def normalize_columns(df, columns, keys=()):
    t = SeriesTransformer(keys)
    return t.fit_transform(df, columns, ["normalize"]), t


def standardize_columns(df, columns, keys=()):
    t = SeriesTransformer(keys)
    return t.fit_transform(df, columns, ["standardize"]), t
