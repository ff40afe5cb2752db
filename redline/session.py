"""Session helpers: a tuned local session for tests/bench, table loading and
the lineage-cut folder."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def get_spark(master: str | None = None, shuffle_partitions: int = 8,
              app_name: str = "redline") -> SparkSession:
    """Session for tests and the bench. On a cluster, use the cluster's own
    session; nothing in the library depends on these settings except ANSI mode
    (which is Spark 4's default) and AQE."""
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
    )
    if master:
        builder = builder.master(master)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table (`{sf_dir}/{name}.parquet`)."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder used to cut lineage (cascade stages, iterative work).

    Read from the session (`spark.checkpoint.dir`, or the context's checkpoint
    dir). Where nothing is configured and the master is local (tests, bench) a
    folder below the warehouse is used; on a cluster an unset value is an error
    rather than a silent machine-local path.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError(
                "spark.checkpoint.dir is not set; point it at a shared folder "
                "(HDFS/S3/ABFS) that every executor can reach")
        configured = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, for a table or files written once and read back."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """`df` as a Parquet table in the shared folder: a lineage cut whose size is
    known, so that Spark can decide on a broadcast from it."""
    path = shared_path(df.sparkSession, "redline-table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def even_splits(scan: DataFrame, target: int) -> bool:
    """Whether no task that reads `scan` has more than twice an even share of its rows among
    `target` tasks. The rows are counted from the files' footers; no column is read."""
    tasks = scan.select(F.spark_partition_id().alias("task")).groupBy("task").count()
    most, rows = tasks.agg(F.max("count"), F.sum("count")).first()
    return rows is not None and most * target <= 2 * rows


def spread(df: DataFrame, scan: DataFrame | None = None) -> DataFrame:
    """Give CPU-heavy row work at least one partition per core.

    Where there are as many files as cores, and where Spark splits fewer, larger ones into
    even shares, this is a no-op (no shuffle at scale, whose disk would hold the whole
    input). Only a scan of a few files that can't be split so is redistributed round-robin,
    once. `scan` is the table that `df` is made from row by row, if not `df` itself: the files
    are listed from `df`, and where they are few, one small job counts the rows of each task of `scan`."""
    if df.isStreaming:
        return df
    target = df.sparkSession.sparkContext.defaultParallelism
    files = len(df.inputFiles())
    return df.repartition(target) if 0 < files < target and not even_splits(df if scan is None else scan, target) else df
