"""X-04: the row scorers on a file stream, with running metrics.

Row scores are stateless built-in expressions, so the same code scores a
`readStream` DataFrame; the running metrics are a streaming aggregation
(state = one small row per group) written in complete mode."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from redline.operators.scores import score_triples


def running_metrics(scored: DataFrame, group_cols=("model",)) -> DataFrame:
    return scored.groupBy(*group_cols).agg(
        F.count(F.lit(1)).alias("n"), F.avg("sari_recall").alias("sari_score"),
        F.avg("gleu").alias("gleu_score"))


def stream_triples_metrics(stream: DataFrame, group_cols=("model",)) -> DataFrame:
    """Score a streaming triples DataFrame and aggregate per group."""
    return running_metrics(score_triples(stream, metrics=("gleu", "sari_recall")), group_cols)


def write_version(batch: DataFrame, path: str, version: int) -> None:
    """One version of a result as `path/versions/<version>`, then a row in `path/commits`. A
    version that is written again replaces itself; one whose commit is missing isn't read."""
    batch.write.mode("overwrite").parquet(f"{path}/versions/{version}")
    batch.sparkSession.range(1).select(F.lit(version).cast("long").alias("version")).coalesce(1).write.mode("append").parquet(f"{path}/commits")


def read_latest(spark: SparkSession, path: str) -> DataFrame | None:
    """The last version that was committed; None before the first commit."""
    try:
        commits = spark.read.schema("version long").parquet(f"{path}/commits")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    version = commits.agg(F.max("version")).first()[0]
    return None if version is None else spark.read.parquet(f"{path}/versions/{version}")


def run_to_path(spark: SparkSession, df: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Drain everything available, writing the running table as a new version after every
    batch, and return the last one: nothing is collected. A stream that stops at any point
    leaves the last committed version readable; started again, it repeats its last batch
    under the same number, so nothing is lost or doubled."""
    q = (df.writeStream.outputMode("complete").foreachBatch(lambda batch, number: write_version(batch, path, number))
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    return read_latest(spark, path)


def run_available_now(spark: SparkSession, df: DataFrame, name: str, checkpoint: str):
    """Drain everything available into the memory sink `name` and stop."""
    q = (df.writeStream.outputMode("complete").format("memory").queryName(name)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.table(name)
