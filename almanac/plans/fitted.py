"""Per-series fitted parameters.

Fitting is one aggregate. With no keys the result is one row, brought to the driver and
inlined as literals (constant-folded by Catalyst, no join). With keys it stays a table of
one row per series and is joined back on the keys; its size is the number of series, so
the join strategy is left to AQE, which broadcasts it only when the materialised size is
small."""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almanac.plans.ordered import join_on_keys

_ids = itertools.count()


def sql_literal(v) -> str:
    """Exact SQL text of a Python value (doubles with the D suffix, never DECIMAL)."""
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "TRUE" if v else "FALSE"
    if isinstance(v, int):
        return f"{v}L"
    if isinstance(v, float):
        if math.isnan(v):
            return "CAST('NaN' AS DOUBLE)"
        if math.isinf(v):
            return "CAST('Infinity' AS DOUBLE)" if v > 0 else "CAST('-Infinity' AS DOUBLE)"
        return f"{v!r}D"
    if isinstance(v, (list, tuple)):
        return "array(" + ", ".join(sql_literal(float(x) if isinstance(x, (int, float)) and not isinstance(x, bool)
                                                else x) for x in v) + ")"
    if isinstance(v, str):
        return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return f"'{v}'"


class Fitted:
    def __init__(self, keys: Sequence[str], row: dict | None = None, table: DataFrame | None = None):
        self.keys = list(keys)
        self.row = row
        self.table = table

    @classmethod
    def fit(cls, df: DataFrame, keys: Sequence[str], aggs: dict[str, Column]) -> "Fitted":
        keys = list(keys)
        exprs = [c.alias(n) for n, c in aggs.items()]
        if not keys:
            return cls(keys, row=df.agg(*exprs).first().asDict())
        return cls(keys, table=df.groupBy(*keys).agg(*exprs))

    @classmethod
    def from_table(cls, keys: Sequence[str], table: DataFrame) -> "Fitted":
        keys = list(keys)
        if not keys:
            return cls(keys, row=table.first().asDict())
        return cls(keys, table=table)

    def names(self) -> list[str]:
        if self.row is not None:
            return list(self.row)
        return [c for c in self.table.columns if c not in self.keys]

    def materialize(self) -> "Fitted":
        """Cut the lineage of a keyed state table (reliable checkpoint in spark.checkpoint.dir)."""
        if self.table is not None:
            self.table = self.table.checkpoint(eager=True)
        return self

    def attach(self, df: DataFrame) -> tuple[DataFrame, dict[str, Column], list[str]]:
        """Return (df with parameter columns, {name: Column}, columns to drop afterwards)."""
        if self.row is not None:
            return df, {n: F.lit(v) for n, v in self.row.items()}, []
        tag = f"__p{next(_ids)}_"
        t = self.table.select(*self.keys, *[F.col(n).alias(tag + n) for n in self.names()])
        out = join_on_keys(df, t, self.keys, "left")
        return out, {n: F.col(tag + n) for n in self.names()}, [tag + n for n in self.names()]

    def attach_sql(self, df: DataFrame) -> tuple[DataFrame, dict[str, str], list[str]]:
        """Like :meth:`attach`, but parameters come back as SQL text (exact double literals
        for one series, column references for many), for building wide projections with one
        expression string per column."""
        if self.row is not None:
            return df, {n: sql_literal(v) for n, v in self.row.items()}, []
        out, cols, drop = self.attach(df)
        return out, {n: f"`{drop[i]}`" for i, n in enumerate(cols)}, drop

    def as_table(self, spark) -> DataFrame:
        if self.table is not None:
            return self.table
        return spark.createDataFrame([self.row])
