"""almanac — a Spark-native engine for preparing, transforming and forecasting time series.

Every operator works on one series or on a panel of many series: ``keys`` names the
columns that identify a series (possibly none), ``order`` names the order column followed
by tie-breakers. The heavy lifting is DataFrame expressions, window functions, joins,
MLlib estimators and, only for per-series fits, Arrow-batched ``applyInPandas``.
"""

from almanac.plans.ordered import SeriesPlan, series_plan

__all__ = ["SeriesPlan", "series_plan"]
__version__ = "0.1.0"
