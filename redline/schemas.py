"""Schemas of the reference's file formats (FIXTURES §1)."""

from pyspark.sql import types as T

PAIRS = T.StructType([T.StructField("input_text", T.StringType()),
                      T.StructField("target_text", T.StringType())])

TRIPLES = T.StructType(PAIRS.fields + [T.StructField("prediction", T.StringType())])
