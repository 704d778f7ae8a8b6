"""Session settings the operators rely on, and the shared folder streaming jobs write to."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CHECKPOINT_CONF = "spark.checkpoint.dir"


def configure(spark: SparkSession) -> SparkSession:
    """Pin what results depend on (UTC) and keep run-time re-planning on.

    Partition counts, memory and broadcast limits stay as the cluster sets them.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    return spark


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder for checkpoints, state and sinks, below the one the cluster names.

    Falls back to a temporary folder only when the session names none and runs in local mode.
    """
    root = spark.conf.get(_CHECKPOINT_CONF, None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"set {_CHECKPOINT_CONF} to a folder every executor can reach")
        root = tempfile.mkdtemp(prefix="spark-tickbars-", dir="/tmp")
        spark.conf.set(_CHECKPOINT_CONF, root)
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def materialized(df: DataFrame, purpose: str) -> DataFrame:
    """The rows written to the shared folder and read back, for a result that several steps read."""
    path = shared_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _located(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists, in whatever file system it names."""
    fs, target = _located(spark, path)
    return fs.exists(target)


def touch(spark: SparkSession, path: str) -> None:
    """Leave an empty file as a mark."""
    fs, target = _located(spark, path)
    fs.create(target, True).close()


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder this package wrote."""
    fs, target = _located(spark, path)
    fs.delete(target, True)
