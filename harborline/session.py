"""Session defaults and the shared folder used to cut lineage."""

from __future__ import annotations

import os
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def build_session(app: str = "harborline", master: str | None = None, **conf: str) -> SparkSession:
    """A session with AQE, UTC and Arrow on. Partition counts stay with the cluster's own settings."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; where none is set, one machine makes its own and a cluster is refused."""
    path = spark.conf.get(CHECKPOINT_KEY, None)
    if not path:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder that the driver and all executors share")
        path = os.path.join(tempfile.mkdtemp(prefix="harborline-"), "checkpoints")
        spark.conf.set(CHECKPOINT_KEY, path)
    return path


def materialize(df: DataFrame) -> DataFrame:
    """Write the rows once to the shared folder and read them back.

    Lineage ends at the written table, so a lost executor costs a re-read and later jobs see the
    same rows, and being columnar it still serves pruned and filtered scans.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "table")
    df.write.mode("errorifexists").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def scratch_root(spark: SparkSession) -> str:
    """This application's part of the shared folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/harborline-{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, for tables cut from their lineage and files read back."""
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def drop_scratch(spark: SparkSession) -> None:
    """Delete this application's scratch tables, when its last result has been written."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(scratch_root(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers (a zip added once per application)."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    archive = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="harborline-"), "harborline"), "zip", root, "harborline")
    sc.addPyFile(archive)
    _SHIPPED.add(sc.applicationId)


def fan_out(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Spread a scan of fewer splits than there are task slots before costly per-row work.

    A large table has many splits and is left alone; only small inputs pay this shuffle. With `rows`, where a split of a
    file holds very many, there are so many parts that none has many more rows than that.
    """
    parts = df.sparkSession.sparkContext.defaultParallelism
    if rows is not None:
        parts = max(parts, -(-df.count() // rows))
    return df.repartition(parts) if df.rdd.getNumPartitions() < parts else df
