import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from almanac.session import local_session
    s = local_session(cores="*", shuffle_partitions=8, app="almanac-tests")
    yield s


SF = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="module", autouse=True)
def nothing_left(spark):
    """The session is shared: what a file's tests leave in it (tables kept for later calls, cached rows) ends with them."""
    yield
    spark.catalog.clearCache()
    for rdd in dict(spark.sparkContext._jsc.getPersistentRDDs()).values():
        rdd.unpersist()
    for t in spark.catalog.listTables():
        spark.sql(f"DROP VIEW {t.name}" if t.isTemporary else f"DROP TABLE {t.name}")
