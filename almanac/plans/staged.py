"""Tables that are written once and read again, and column names that no input owns."""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from almanac.session import scratch_path


def fresh(taken: Iterable[str], *names: str) -> list[str]:
    """``names``, made longer where a column has them (Spark compares names without regard to case)."""
    used, out = {c.lower() for c in taken}, []
    for name in names:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder of ``spark.checkpoint.dir`` and read again: it is computed once, later
    readers prune its columns, and a lost executor costs no recomputation of what came before."""
    spark = df.sparkSession
    path = scratch_path(spark, f"{name}-{uuid.uuid4().hex}")
    void = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NullType)]  # Parquet has no such type
    kept = df.drop(*void) if void else df
    kept.write.parquet(path)
    table = spark.read.schema(kept.schema).parquet(path)
    return table.withColumns({c: F.lit(None) for c in void}).select(*df.columns) if void else table
