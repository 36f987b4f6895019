"""Order-based execution for one series or a panel of series.

A DataFrame has no row order, so every order-based operator names it: ``keys`` (the
columns identifying a series, possibly none) and ``order`` (order column, then
tie-breakers; together unique within a series).

The plain plan is ``Window.partitionBy(*keys).orderBy(*order)``. It puts a whole series in
one task, which is wrong at scale in two cases: no keys at all (one global series ->
``Exchange SinglePartition``), and a hot key holding a large share of all rows. A
:class:`SeriesPlan` therefore looks at the series sizes once (one aggregate, two numbers
reach the driver) and picks:

* **plain** — when every series has at most ``block_rows`` rows (a proven bound on what a
  single task sorts; a series without keys at most ``UNKEYED_PLAIN_ROWS``);
* **blocked** — otherwise. Rows are range-partitioned on (keys, order) as they are: dates, numbers, decimals,
  text, NULLs, and where all of that is equal on a hash of the row, so that a value that fills whole
  ranges is cut too (only rows that agree in every column stay together). The sorted ranges are written once; a row's position is its
  place in its range plus the rows of its series in earlier ranges, a table of at most one
  row a range. Every operator then runs on blocks of ``block_rows`` consecutive rows:

  - bounded frames (lag, rolling, difference, centred averages) copy the last/first
    ``H`` rows of a block into the neighbouring block (a halo) and keep only home rows;
  - unbounded frames (forward/backward fill, running sums) aggregate one value per block,
    carry it over the (small) block table with a window and join it back.

As the ranges are a written table, a recomputed stage after an executor loss gives the same index. Working
columns have names that the input does not own.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from contextlib import contextmanager
from contextvars import ContextVar
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from almanac.plans.staged import fresh, staged

#: Private name of the row position: no input column is ever taken for it.
IDX = "__row_position"
DEFAULT_BLOCK_ROWS = 1_000_000
#: One series without keys is one task in the plain plan, so it is cut much earlier than one of many.
UNKEYED_PLAIN_ROWS = 10_000
#: Fewer rows are not worth a range of their own, however small the blocks.
RANGE_ROWS = 100_000
BLOCK_ROWS_CONF = "almanac.blockRows"

UNB_PRE = Window.unboundedPreceding


def _hashed(df: DataFrame) -> list[str]:
    """Columns that a row's hash can take in (maps and variants have none)."""
    return [f.name for f in df.schema.fields if not any(t in f.dataType.simpleString() for t in ("map<", "variant"))]


def _literal(v) -> Column:
    """A literal of a collected value; lists may hold rows."""
    if isinstance(v, Row):
        return F.struct(*[_literal(x).alias(n) for n, x in v.asDict(recursive=False).items()])
    if isinstance(v, list) and v and isinstance(v[0], Row):
        return F.array(*[_literal(x) for x in v])
    return F.lit(v)


def join_on_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``keys`` that also matches NULL keys (a NULL key is a series too).

    With no keys the right side is a one-row statistic: it is brought to the driver and its
    values are added as literals (no join, no nested loop), which also lets Catalyst fold
    them into the expressions that use them.
    """
    keys = list(keys)
    if not keys:
        rows = right.limit(2).collect()
        if len(rows) > 1:
            raise ValueError("a keyless join needs a one-row right side")
        if not rows:
            return left.limit(0).select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in right.schema.fields]) \
                if how == "inner" else left.select("*", *[F.lit(None).cast(f.dataType).alias(f.name)
                                                          for f in right.schema.fields])
        row = rows[0]
        return left.select("*", *[_literal(row[f.name]).cast(f.dataType).alias(f.name) for f in right.schema.fields])
    names = fresh([*left.columns, *right.columns], *[f"__rk{i}" for i in range(len(keys))])
    renamed = right.withColumnsRenamed(dict(zip(keys, names)))
    cond = None
    for k, name in zip(keys, names):
        c = left[k].eqNullSafe(renamed[name])
        cond = c if cond is None else cond & c
    return left.join(renamed, cond, how).drop(*names)


@dataclass
class SeriesPlan:
    keys: list[str]
    order: list[str]
    block_rows: int
    blocked: bool
    rows: int = 0  # of all series

    # ------------------------------------------------------------------ windows
    def window(self) -> Window:
        """Plain window over one whole series (only valid when not blocked)."""
        return Window.partitionBy(*self.keys).orderBy(*self.order)

    # ------------------------------------------------------------------ index
    def index(self, df: DataFrame, name: str = IDX, ties: str = "row") -> DataFrame:
        """Add the 0-based position of each row inside its series as ``name`` (bigint).

        ``ties='min'`` gives equal order values the smallest position among them (the
        minimum rank - 1)."""
        if not self.blocked:
            rank_fn = F.row_number if ties == "row" else F.rank
            return df.withColumn(name, (rank_fn().over(self.window()) - 1).cast("long"))

        part, at, off, n = fresh([*df.columns, name], "__part", "__at", "__off", "__n")
        rows = self._ranged(df, part, at)
        counts = rows.groupBy(*self.keys, part).agg(F.count(F.lit(1)).alias(n))
        before = F.sum(n).over(Window.partitionBy(*self.keys).orderBy(part).rowsBetween(UNB_PRE, -1))
        # only ranges in which a series goes on: at most one row a range, so it may be broadcast
        offsets = counts.select(*self.keys, part, before.alias(off)).where(F.col(off).isNotNull())
        joined = join_on_keys(rows, F.broadcast(offsets), [*self.keys, part], "left")
        place = F.row_number().over(Window.partitionBy(*self.keys, part).orderBy(at)) - 1 if self.keys else F.col(at)
        out = joined.withColumn(name, (F.coalesce(F.col(off), F.lit(0)) + place).cast("long")).drop(part, at, off)
        if ties == "row":
            return out
        (first,) = fresh(out.columns, "__first")
        firsts = out.groupBy(*self.keys, *self.order).agg(F.min(name).alias(first))
        return join_on_keys(out.drop(name), firsts.withColumnRenamed(first, name), [*self.keys, *self.order], "left")

    def _ranged(self, df: DataFrame, part: str, at: str) -> DataFrame:
        """Rows in sorted ranges, written: ``part`` numbers the range, ``at`` the row in it."""
        spark = df.sparkSession
        ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(self.rows / max(self.block_rows, RANGE_ROWS)))
        (tie,) = fresh([*df.columns, part, at], "__tie")
        by = [*self.keys, *self.order, tie]
        cut = df.withColumn(tie, F.xxhash64(*_hashed(df))).repartitionByRange(ranges, *by).sortWithinPartitions(*by)
        place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
        return staged(cut.select(*df.columns, F.spark_partition_id().alias(part), place.alias(at)), "ordered")

    # ------------------------------------------------------------------ bounded frames
    def bounded(
        self,
        df: DataFrame,
        build: Callable[[Window], dict[str, Column]],
        back: int,
        fwd: int = 0,
    ) -> DataFrame:
        """Add columns computed by window functions whose frame reaches at most ``back``
        rows behind and ``fwd`` rows ahead. ``build(w)`` returns ``{name: expr}`` where
        ``w`` is the window to use (frames are set by the caller via ``rowsBetween``).
        Requires the position column when the plan is blocked."""
        if not self.blocked:
            cols = build(self.window())
            return df.select("*", *[c.alias(n) for n, c in cols.items()])
        B = self.block_rows
        copy, block, home = fresh(df.columns, "__copy", "__block", "__home")
        blk = F.floor(F.col(IDX) / F.lit(B)).cast("long")
        pos = F.col(IDX) - blk * F.lit(B)
        copies = [F.struct(blk.alias("b"), F.lit(True).alias("home"))]
        for j in range(1, -(-back // B) + 1):  # a frame longer than a block reaches several
            copies.append(F.when(pos >= F.lit(j * B - back), F.struct((blk + j).alias("b"), F.lit(False).alias("home"))))
        for j in range(1, -(-fwd // B) + 1):
            copies.append(
                F.when((pos + (j - 1) * B < F.lit(fwd)) & (blk >= j), F.struct((blk - j).alias("b"), F.lit(False).alias("home")))
            )
        arr = F.filter(F.array(*copies), lambda s: s.isNotNull())
        ex = df.withColumn(copy, F.explode(arr)).withColumns({block: F.col(copy)["b"], home: F.col(copy)["home"]}).drop(copy)
        cols = build(Window.partitionBy(*self.keys, block).orderBy(IDX))
        return ex.select("*", *[c.alias(n) for n, c in cols.items()]).where(F.col(home)).drop(block, home)

    # ------------------------------------------------------------------ unbounded scans
    def scan(self, df: DataFrame, items: Sequence[tuple[str, str, Column]], extra: Sequence[str] = ()) -> DataFrame:
        """Running scans over each series (optionally split further by ``extra`` columns).

        ``items`` holds ``(out_name, kind, expr)``; ``kind`` is ``sum`` (running sum up to and
        including the row, NULL while nothing was summed), ``last`` (last non-null value up
        to the row) or ``first`` (first non-null value from the row on)."""
        extra = list(extra)
        if not self.blocked:
            part = [*self.keys, *extra]
            w = Window.partitionBy(*part).orderBy(*self.order)
            wr = Window.partitionBy(*part).orderBy(*[F.col(c).desc() for c in self.order])
            cols = [self._scan_expr(kind, e, w, wr).alias(n) for n, kind, e in items]
            return df.select("*", *cols)

        names = [n for n, _, _ in items]
        block, *more = fresh([*df.columns, *names], "__block", *[f"__{t}_{n}" for t in ("in", "all", "carry") for n in names])
        inner, whole, carry = (dict(zip(names, more[i * len(names):])) for i in range(3))
        part = [*self.keys, *extra, block]
        base = df.withColumn(block, F.floor(F.col(IDX) / F.lit(self.block_rows)).cast("long"))
        w_in = Window.partitionBy(*part).orderBy(IDX)
        w_in_rev = Window.partitionBy(*part).orderBy(F.col(IDX).desc())
        rows = base.select("*", *[self._scan_expr(kind, e, w_in, w_in_rev).alias(inner[n]) for n, kind, e in items])

        summary = {"sum": lambda e: F.sum(e), "last": lambda e: F.max_by(e, F.when(e.isNotNull(), F.col(IDX))),
                   "first": lambda e: F.min_by(e, F.when(e.isNotNull(), F.col(IDX)))}
        blocks = base.groupBy(*part).agg(*[summary[kind](e).alias(whole[n]) for n, kind, e in items])
        wb = Window.partitionBy(*self.keys, *extra).orderBy(block).rowsBetween(UNB_PRE, -1)
        wb_rev = Window.partitionBy(*self.keys, *extra).orderBy(F.col(block).desc()).rowsBetween(UNB_PRE, -1)
        carried = {"sum": lambda c: F.sum(c).over(wb), "last": lambda c: F.last(c, True).over(wb), "first": lambda c: F.last(c, True).over(wb_rev)}
        blocks = blocks.select(*part, *[carried[kind](F.col(whole[n])).alias(carry[n]) for n, kind, _ in items])
        out = join_on_keys(rows, blocks, part, "left")
        final = []
        for n, kind, _ in items:
            i, c = F.col(inner[n]), F.col(carry[n])
            v = F.coalesce(i, c)
            if kind == "sum":
                v = F.when(v.isNotNull(), F.coalesce(i, F.lit(0)) + F.coalesce(c, F.lit(0)))
            final.append(v.alias(n))
        return out.select("*", *final).drop(block, *inner.values(), *carry.values())

    @staticmethod
    def _scan_expr(kind: str, e: Column, w: Window, w_rev: Window) -> Column:
        """Running frames only: a frame ending at UNBOUNDED FOLLOWING is recomputed for every
        row (quadratic in the partition size), so look-ahead scans run over the reversed
        order with a running frame instead."""
        if kind == "sum":
            return F.sum(e).over(w.rowsBetween(UNB_PRE, 0))
        if kind == "last":
            return F.last(e, True).over(w.rowsBetween(UNB_PRE, 0))
        if kind == "first":
            return F.last(e, True).over(w_rev.rowsBetween(UNB_PRE, 0))
        raise ValueError(f"unknown scan kind {kind!r}")

    # ------------------------------------------------------------------ per-series stats
    def with_count(self, df: DataFrame, name: str = "__n") -> DataFrame:
        """Rows per series on every row. Plain plan: a window count over the series
        partition, which shares the exchange of the ordering window. Blocked: aggregate +
        join (the series are too big for one task)."""
        if not self.blocked:
            return df.withColumn(name, F.count(F.lit(1)).over(Window.partitionBy(*self.keys)))
        return self.with_stats(df, {name: F.count(F.lit(1))})

    def with_stats(self, df: DataFrame, aggs: dict[str, Column]) -> DataFrame:
        """Attach per-series aggregates to every row: group aggregate + join on the keys
        (no keys: one row, joined on a constant and broadcast)."""
        stats = df.groupBy(*self.keys).agg(*[c.alias(n) for n, c in aggs.items()])
        return join_on_keys(df, stats, self.keys, "left")


def colocate_series(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows in ranges of (keys, hash of the row): a task sees few series and a series of any size reaches over as many
    tasks as its share of the rows asks for. Used before per-task partial sums (Gram and pair statistics), so there are at most
    as many partials as series and ranges. Nothing is counted first and no key reaches the driver
    (Spark samples the keys to place the ranges)."""
    keys = list(keys)
    if not keys:
        return df
    return df.repartitionByRange(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys, F.xxhash64(*_hashed(df)))


@contextmanager
def block_rows(spark, rows: int):
    """Temporarily set the block size used by plans built inside the block (plans read it
    when they are built, so the DataFrames keep it after the block ends)."""
    old = spark.conf.get(BLOCK_ROWS_CONF, None)
    spark.conf.set(BLOCK_ROWS_CONF, str(int(rows)))
    try:
        yield
    finally:
        if old is None:
            spark.conf.unset(BLOCK_ROWS_CONF)
        else:
            spark.conf.set(BLOCK_ROWS_CONF, old)


_HINTS: ContextVar[dict] = ContextVar("almanac_series_hints", default={})


@contextmanager
def series_hint(plan: SeriesPlan):
    """Reuse a measured plan decision for every operator that works on series with the same
    keys and order column inside the block: steps that keep the rows of each series (features, fills,
    transforms) then skip the sizing action. The pipeline measures once per series set."""
    hints = dict(_HINTS.get())
    hints[tuple(plan.keys), plan.order[0]] = plan
    token = _HINTS.set(hints)
    try:
        yield plan
    finally:
        _HINTS.reset(token)


def series_plan(
    df: DataFrame,
    keys: Sequence[str] | None,
    order: Sequence[str] | str,
    block_rows: int | None = None,
) -> SeriesPlan:
    """Look at the series sizes once and choose the plain or the blocked plan (or take the
    decision from an enclosing :func:`series_hint` for the same keys and order column)."""
    keys = list(keys or [])
    order = [order] if isinstance(order, str) else list(order)
    hint = _HINTS.get().get((tuple(keys), order[0]))
    if hint is not None and block_rows is None:
        return SeriesPlan(keys, order, hint.block_rows, hint.blocked, hint.rows)
    if block_rows is None:
        block_rows = int(df.sparkSession.conf.get(BLOCK_ROWS_CONF, str(DEFAULT_BLOCK_ROWS)))
    if not keys:
        n = df.count()
        if n <= min(block_rows, UNKEYED_PLAIN_ROWS):
            return SeriesPlan(keys, order, block_rows, blocked=False, rows=n)
        # at least as many blocks as shuffle partitions
        tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        return SeriesPlan(keys, order, max(1, min(block_rows, -(-n // tasks))), blocked=True, rows=n)
    (n,) = fresh(keys, "n")
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias(n)).agg(F.max(n).alias("most"), F.sum(n).alias("all")).first()
    return SeriesPlan(keys, order, block_rows, blocked=(sizes["most"] or 0) > block_rows, rows=sizes["all"] or 0)
