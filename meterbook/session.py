"""Session settings the operators are designed for, and staging of shared results."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Joins and aggregations are left to Catalyst and AQE.  AQE measures the real
# size of a side before it broadcasts it and splits a skewed partition of a
# join by bytes, also where that costs one more shuffle later (force...).
RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # aggregates that collect small sets stay in a hash table for this many keys
    # per task (about 1 KB each) before they fall back to sorting
    "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "65536",
}

def tune(spark: SparkSession) -> SparkSession:
    """Apply the run-time SQL settings; cluster sizing is left as it is."""
    for key, value in RUNTIME_SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def local_session(cpus: str = "8", app: str = "meterbook") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        # static: no capture of Python call sites per column expression, so plans build faster
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)


def shared_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names; in local mode, where none is named, a temporary one that ends with the process."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    folder = tempfile.mkdtemp(prefix="meterbook-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame) -> DataFrame:
    """Cut lineage through the shared checkpoint folder.

    Used where one result feeds several others and must not be computed twice
    with different partition boundaries.  Survives the loss of executors.
    """
    spark = df.sparkSession
    folder = shared_dir(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def stage_table(df: DataFrame) -> DataFrame:
    """Cut lineage by a Parquet table in the shared folder.

    For tables that are large, as it is compressed and read by column, and for
    small ones that are joined to large ones, as the size of its files is known
    when a join is planned (that of a checkpoint is not).
    """
    spark = df.sparkSession
    path = scratch_path(spark, "stage")
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
