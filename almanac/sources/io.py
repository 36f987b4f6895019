"""Sources and sinks (SRC1-SRC4, SNK1-SNK5)."""

from __future__ import annotations

import datetime as _dt
import logging
import os
import uuid
import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.errors import AnalysisException

from almanac.functions.calendar import DEFAULT_DATE_FORMATS, parse_date
from almanac.functions.schema import nan_to_null

log = logging.getLogger(__name__)


def _reader(spark: SparkSession, fmt: str, schema: T.StructType | str | None, options: dict | None):
    rd = spark.read.format(fmt)
    if fmt == "csv":
        rd = rd.option("header", True)
        if schema is None:
            rd = rd.option("inferSchema", True)
    if schema is not None:
        rd = rd.schema(schema)
    for k, v in (options or {}).items():
        rd = rd.option(k, v)
    return rd


def load_data(spark: SparkSession, path: str | Sequence[str], date_col: str = "date", start_date=None, end_date=None,
              fmt: str = "csv", schema: T.StructType | str | None = None, date_formats: Sequence[str] = DEFAULT_DATE_FORMATS,
              to_date: bool = False, options: dict | None = None) -> DataFrame:
    """Read a table of dated measurements (SRC1): header + inferred types for CSV unless a
    schema is given, date text parsed with the first matching format, NaN mapped to NULL,
    and an inclusive date range applied as a filter that reaches the scan (SRC2)."""
    df = _reader(spark, fmt, schema, options).load(path)
    if date_col not in df.columns:
        log.warning("date column %r not found", date_col)
        return nan_to_null(df)
    dt = df.schema[date_col].dataType
    if isinstance(dt, T.StringType):
        df = df.withColumn(date_col, parse_date(date_col, date_formats))
    elif to_date and isinstance(dt, (T.TimestampType, T.TimestampNTZType)):
        df = df.withColumn(date_col, F.to_date(date_col))
    df = nan_to_null(df)
    d = F.col(date_col)
    if start_date is not None:
        df = df.where(d >= F.lit(_as_date(start_date)))
    if end_date is not None:
        df = df.where(d <= F.lit(_as_date(end_date)))
    return df


def _as_date(v):
    if isinstance(v, (_dt.date, _dt.datetime)):
        return v
    text = str(v).strip()
    try:
        return _dt.date.fromisoformat(text)
    except ValueError:  # a time of day is part of the bound
        return _dt.datetime.fromisoformat(text)


def read_datasets(spark: SparkSession, directory: str, pattern: str = "*.csv", fmt: str = "csv",
                  schema: T.StructType | str | None = None) -> DataFrame:
    """All files below a directory in one scan, with a ``dataset`` column: the first path
    component below the directory, minus its extension (a file ``x.csv`` or a folder ``x/``
    of part files). SRC3 re-aimed: one distributed read instead of a loop over files."""
    opts = {"pathGlobFilter": pattern, "recursiveFileLookup": "true"}
    df = _reader(spark, fmt, schema, opts).load(directory)
    # the whole normalised path, so a folder of the same name further down is not taken for it
    root = re.sub(r"^[a-z0-9+.-]+:/+", "/", directory, flags=re.I) if "://" in directory or directory.startswith("file:") \
        else os.path.abspath(directory)
    at = re.escape("/" + os.path.normpath(root).strip("/") + "/")
    rel = F.regexp_extract(F.url_decode(F.regexp_replace("_metadata.file_path", r"\+", "%2B")), at + r"([^/]+)", 1)
    return df.withColumn("dataset", F.regexp_replace(rel, r"\.[^.]*$", ""))


def list_available_datasets(spark: SparkSession, directory: str = "exports", pattern: str = "*.csv") -> list[str]:
    """File names of the matching files; a missing directory gives an empty list (SRC3)."""
    try:
        files = spark.read.format("text").option("pathGlobFilter", pattern).load(directory).inputFiles()
    except AnalysisException:
        return []
    return sorted(os.path.basename(f) for f in files)


def ordered_output(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows in order of ``keys`` and ``order`` (ORD1): a range partition and a sort inside it, so files written
    from it follow each other."""
    return df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                partition_by: Sequence[str] | None = None, sort_by: Sequence[str] | None = None) -> str:
    """Write a stage result (SNK1-SNK3). Parquet by default; CSV with a header on request;
    ``sort_by`` orders the rows over all files."""
    if sort_by:
        df = ordered_output(df, [], sort_by)
    w = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        w = w.option("header", True)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)
    return path


def run_summary(spark: SparkSession, summary: dict) -> DataFrame:
    """One-row summary table (SNK4, SNK5): scalars as columns, lists as array<string>; a number that is missing is a NULL double."""
    row = {k: ([str(x) for x in v] if isinstance(v, (list, tuple)) else v) for k, v in summary.items()}
    types = {bool: T.BooleanType(), int: T.LongType(), str: T.StringType(), list: T.ArrayType(T.StringType())}
    return spark.createDataFrame([tuple(row.values())], T.StructType([T.StructField(k, types.get(type(v), T.DoubleType())) for k, v in row.items()]))


def run_id(model: str, when: _dt.datetime | None = None) -> str:
    """Run directory name ``{model}_{yyyyMMdd_HHmmss}_{suffix}``; the suffix keeps two runs of a second apart."""
    when = when or _dt.datetime.now()
    return f"{model}_{when.strftime('%Y%m%d_%H%M%S')}_{uuid.uuid4().hex[:8]}"
