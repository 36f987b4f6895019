"""
number and the key word that name rules look for, with the sample's missing-value pattern."""
import datetime as dt
import itertools
import os
import tempfile

import numpy as np

from almanac.functions.schema import numeric_columns
from almanac.operators.features import engineer_features
from almanac.operators.prepare import frequency_of, trim_to_common_date_range
from almanac.sources.io import load_data

# (key word: measures that hold it, first month index, last month index) with month 0 = 2014-01, 134 = 2025-03
SHAPES = [
    ({"sales": 1, "consumption": 2, "price": 3, "rate": 3, "value": 1, "other": 2}, 18, 130),
    ({"production": 1, "other": 1}, 18, 131),
    ({"rate": 1}, 0, 133),
    ({"orders": 2, "production": 1, "other": 2}, 0, 132),
    ({"sales": 1, "gdp": 1}, 0, 131),
    ({"gdp": 1}, 0, 134),
    ({"rate": 1, "other": 2}, 24, 134),
]


def _groups():
    number = itertools.count()
    return [([f"m{next(number):02d}_{word}" for word, times in words.items() for _ in range(times)], lo, hi) for words, lo, hi in SHAPES]


GROUPS = _groups()
MONTHS = "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split()


def _write_csv(path):
    rng = np.random.default_rng(5)
    values = [c for cols, _, _ in GROUPS for c in cols]
    header = ["date", "year", "month", "quarter", "month_name", "month_end", "quarter_end", "Q1", "Q2", "Q3", "Q4",
              "period", *values]
    lines = [",".join(header)]
    for i in range(135):
        y, m = 2014 + i // 12, i % 12 + 1
        q = (m - 1) // 3 + 1
        me = (dt.date(y + (m == 12), m % 12 + 1, 1) - dt.timedelta(days=1))
        qe = (dt.date(y + (q == 4), (q * 3) % 12 + 1, 1) - dt.timedelta(days=1))
        row = [f"{m}/1/{y}", str(y), str(m), str(q), MONTHS[m - 1], f"{me.month}/{me.day}/{me.year}",
               f"{qe.month}/{qe.day}/{qe.year}", *[str(int(q == k)) for k in (1, 2, 3, 4)], f"{MONTHS[m - 1]}-{y % 100:02d}"]
        for cols, lo, hi in GROUPS:
            for _ in cols:
                row.append(f"{rng.uniform(1, 1000):.2f}" if lo <= i <= hi else "")
        lines.append(",".join(row))
    with open(path, "w") as f:
        f.write("\n".join(lines) + "\n")
    return header


def test_sample_shape_golden(spark):
    d = tempfile.mkdtemp(prefix="almanac-golden-")
    path = os.path.join(d, "sample.csv")
    header = _write_csv(path)
    df = load_data(spark, path, date_col="date", fmt="csv")
    assert df.count() == 135 and len(df.columns) == 38 == len(header)
    assert frequency_of(df, "date") == "monthly"
    trimmed = trim_to_common_date_range(df, "date")
    rows = trimmed.agg({"date": "min"}).first()[0], trimmed.agg({"date": "max"}).first()[0]
    assert trimmed.count() == 107 and rows == (dt.date(2016, 1, 1), dt.date(2024, 11, 1))
    assert all(v is not None for r in trimmed.select(*numeric_columns(trimmed)).collect() for v in r)
    feats = engineer_features(trimmed, "m00_sales", "date", max_lag=3, log_transform=False)
    assert len(feats.columns) == 135
    with_log = engineer_features(trimmed, "m00_sales", "date", max_lag=3, log_transform=True)
    assert len(with_log.columns) == 135 + 13
