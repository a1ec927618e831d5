"""Session construction and cluster-shared checkpoint handling."""

from __future__ import annotations

import os
import tempfile

from pyspark import SparkConf, SparkContext
from pyspark.sql import DataFrame, SparkSession

# Defaults for keys that the submitter has not set. A session that runs already is taken as it is.
_LOCAL_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    # delete checkpoint files once their DataFrames are garbage collected (the shared
    # folder would otherwise grow with every index and component round)
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "fathom") -> SparkSession:
    spark = SparkSession.getActiveSession()
    if spark is None:
        builder = SparkSession.builder.appName(app_name)
        if master:
            builder = builder.master(master)
        wanted = dict(_LOCAL_DEFAULTS)
        if master and master.startswith("local"):
            # local mode: the driver JVM is the only executor
            wanted["spark.driver.memory"] = "16g"
        if shuffle_partitions:
            wanted["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
        for k, v in wanted.items():
            if not _submitted(k):
                builder = builder.config(k, v)
        spark = builder.getOrCreate()
        spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def _submitted(key: str) -> bool:
    """Has whoever started this program set ``key``?"""
    if "PYSPARK_GATEWAY_PORT" in os.environ or SparkContext._jvm:  # the JVM runs: its properties tell
        SparkContext._ensure_initialized()
        return SparkConf().contains(key)
    return f"{key}=" in os.environ.get("PYSPARK_SUBMIT_ARGS", "")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    A cluster names a shared folder (HDFS/S3/...) there; we read it from the
    session. Only when nothing is configured (tests, a bare local session) do we
    pick a scratch folder ourselves.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        # one machine: driver and executors are one process
        configured = os.path.join(tempfile.gettempdir(), "checkpoints", f"fathom-{os.getpid()}")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` into the shared checkpoint folder (survives executor loss)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def table_path(spark: SparkSession, sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")
