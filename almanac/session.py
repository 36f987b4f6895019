"""Session helpers: defaults that matter for correctness and for scale."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings this engine relies on. Time zone pinned to UTC so that timestamp <-> date
# conversions agree with the order keys; AQE on so joins against tables whose size is
# only known at run time (statistics per series, block tables) are re-planned, and
# skewed shuffle partitions are split.
ENGINE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.codegen.maxFields": "400",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "almanac") -> SparkSession:
    """A local session for tests and benchmarks (the cluster supplies its own)."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    builder = builder.config("spark.driver.memory", "16g")
    for k, v in ENGINE_CONF.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``almanac`` importable in the Python workers (the runtime form of
    ``--py-files``): the pandas UDFs and per-task NumPy kernels are module functions, which
    workers import by name. Done once per SparkContext; the zip is distributed by Spark."""
    sc = spark.sparkContext
    key = sc.applicationId
    if key in _SHIPPED:
        return
    import zipfile

    import almanac
    root = os.path.dirname(os.path.dirname(os.path.abspath(almanac.__file__)))
    zpath = os.path.join(tempfile.mkdtemp(prefix="almanac-pkg-"), "almanac.zip")
    with zipfile.ZipFile(zpath, "w", zipfile.ZIP_DEFLATED) as z:
        for dirpath, _, files in os.walk(os.path.join(root, "almanac")):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(dirpath, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(zpath)
    _SHIPPED.add(key)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster this setting names a shared file system folder and is used as is. Only
    when it is unset (local tests) a fresh scratch folder is made.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="almanac-ckpt-")
        spark.conf.set("spark.checkpoint.dir", path)
    spark.sparkContext.setCheckpointDir(path)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path below the shared checkpoint folder, for hand-over tables between stages."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, name)
