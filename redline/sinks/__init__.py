"""Writers. Every writer is a distributed DataFrame
write; partitioned layouts replace the reference's one-file-per-run naming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_triples(df: DataFrame, path: str, partition_cols=("task", "model", "dataset"),
                  fmt: str = "parquet", mode: str = "overwrite", compression: str | None = None) -> None:
    """K-01: prediction triples partitioned by run keys (Parquet; CSV with a
    header when fmt='csv', plain unless `compression` names a codec; a compressed
    part file is read by one task, so it should be written by many). A run replaces its own partitions and leaves those
    of other models, tasks and datasets alone."""
    w = (df.write.mode(mode).option("partitionOverwriteMode", "dynamic")
         .partitionBy(*[c for c in partition_cols if c in df.columns]))
    if compression is not None:
        w = w.option("compression", compression)
    if fmt == "csv":
        (w.option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False)
         .option("ignoreTrailingWhiteSpace", False).csv(path))
    else:
        w.format(fmt).save(path)


def write_metrics(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """K-02: metric records as JSON lines (one record per group)."""
    df.write.mode(mode).json(path)


def write_stage(df: DataFrame, path: str) -> None:
    """K-03: cascade stage output, partitioned by `stage` (the written stage is
    also the lineage cut when read back). Writing a stage again replaces it."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("stage").parquet(path)


def write_m2(df: DataFrame, path: str, block_col: str = "block", mode: str = "overwrite") -> None:
    """K-05: M2 text, one block per sentence followed by a blank line."""
    df.select(F.col(block_col).alias("value")).write.mode(mode).text(path, lineSep="\n\n")


__all__ = ["write_triples", "write_metrics", "write_stage", "write_m2"]
