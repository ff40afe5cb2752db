"""redline: Spark-native evaluation and corpus preparation for text rewriting.

Sub-packages
------------
functions  Column -> Column text functions (tokenise, clean, readability, prompts)
sources    readers for pair/triple CSV, M2, nested references, essays, documents
sinks      writers (partitioned triples, metrics JSON, M2 text, cascade stages)
operators  DataFrame -> DataFrame scorers, edit algebra, corpus dataflows, metrics
plans      derived fixtures over the driver tables and the registered queries
streaming  the same row scorers on a file stream with running metrics
"""

from redline.session import checkpoint_dir, get_spark, read_table

__all__ = ["get_spark", "read_table", "checkpoint_dir"]
