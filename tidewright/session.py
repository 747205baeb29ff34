"""Session settings, shared scratch folders and reliable lineage cuts."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(name: str = "tidewright", cores: int | str = "*", **conf: str) -> SparkSession:
    """A session for tests and benchmarks; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _checkpoint_root(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one only in local mode, where executors are this process."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    active = sc.getCheckpointDir()
    if named:
        if active is None:
            sc.setCheckpointDir(named)
        return named
    if active is None and not sc.master.startswith("local[") and sc.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if active is None:
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tidewright-"))
        active = sc.getCheckpointDir()
    return active


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared checkpoint folder."""
    return os.path.join(_checkpoint_root(spark).rstrip("/"), f"{label}-{uuid.uuid4().hex}")


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage by writing a table below the shared folder and reading it back.

    The rows are fixed from then on: a lost executor cannot change them, and a column such as
    a partition number keeps its value however often it is read.
    """
    path = scratch_path(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Give a scan of few file splits one partition per core, for work heavy on the CPU.

    A large table has more splits than cores and is left alone.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
