"""Spark session and table helpers."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import DataFrame, SparkSession

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


#: For one machine: few partitions, small tasks, a large driver.  A cluster's own settings stand.
LOCAL = {
    # text work is CPU-heavy per byte: do not coalesce small shuffles into one task
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
    "spark.ui.enabled": "false",
}


def get_spark(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "glosa") -> SparkSession:
    """A session.  Under spark-submit or with ``SPARK_MASTER`` set only what results
    depend on is set here; otherwise a local session for tests and the bench."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        # call-site capture costs several JVM round trips per Column call while
        # building the (large) rule expressions; it is a debugging aid only
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    if not os.environ.get("SPARK_MASTER") and "spark.master" not in os.environ.get("PYSPARK_SUBMIT_ARGS", ""):
        local = LOCAL | {"spark.sql.shuffle.partitions": str(shuffle_partitions),
                         "spark.driver.memory": os.environ.get("GLOSA_DRIVER_MEMORY", "16g")}
        builder = builder.master(f"local[{cores}]").config(map=local)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    if spark.sparkContext.master.startswith("local["):
        ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared ``spark.checkpoint.dir``.  A fresh scratch folder
    stands in for it only under a ``local[...]`` master (tests); elsewhere an
    unset folder is an error, since executors cannot see machine-local files."""
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = tempfile.mkdtemp(prefix="glosa-ckpt-")
    spark.sparkContext.setCheckpointDir(d)
    return spark.sparkContext.getCheckpointDir() or d


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def register_tables(spark: SparkSession, sf_dir: str, names: list[str] | None = None) -> None:
    """Register the driver tables of ``sf_dir`` as temp views."""
    for name in names or TABLES:
        read_table(spark, sf_dir, name).createOrReplaceTempView(name)
