"""Helpers shared by the corpus operators: tables, batches and lineage cuts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from redline.session import written as cut

__all__ = ["WORD", "arrow_schema", "cut", "fold", "map_rows", "slices", "table"]

#: Rust/Java/RE2 spelling of a run of anything but blank, tab, newline, vertical tab, form feed, return.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column, modulus: int) -> Column:
    """crc32 of the decimal doc_id modulo `modulus` (null id: of the empty string)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def map_rows(df: DataFrame, schema: str, make: Callable[[], Callable[..., tuple]]) -> DataFrame:
    """Row-to-row map over Arrow batches. `make` runs once per task and returns the
    function that takes one row's values and returns the output values."""
    names = [c.split()[0] for c in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, types = make(), None
        for batch in batches:
            types = types or arrow_schema(schema)
            for part in slices(batch):
                rows = [one(*r) for r in zip(*(c.to_pylist() for c in part.columns), strict=True)]
                cols = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t.type) for c, t in zip(cols, types, strict=True)], schema=types)

    return df.mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of about `limit` bytes, so that Python objects of a few
    rows live at a time however long the texts are."""
    n = max(1, batch.num_rows)
    step = max(1, int(n * limit / max(batch.nbytes, 1)))
    for at in range(0, batch.num_rows, step):
        yield batch.slice(at, step)


ARROW = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "float": pa.float32(), "string": pa.string(),
         "binary": pa.binary(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32())}


def arrow_schema(schema: str) -> pa.Schema:
    return pa.schema([(name, ARROW[kind]) for name, kind in (c.split() for c in schema.split(","))])
