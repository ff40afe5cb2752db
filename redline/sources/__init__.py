"""Readers."""

from redline.sources.quoted import read_quoted_csv, read_runs
from redline.sources.readers import (
    PANDAS_NA,
    nonblank,
    parse_essays,
    read_documents,
    read_essays,
    read_m2,
    read_nested_refs,
    read_rejected_essays,
    read_sentences,
    read_text_parts,
    read_triples,
    rejected_essays,
    require_columns,
    route_files,
)

__all__ = ["PANDAS_NA", "nonblank", "parse_essays", "read_documents", "read_essays", "read_m2",
           "read_nested_refs", "read_quoted_csv", "read_rejected_essays", "read_runs", "read_sentences", "read_text_parts", "read_triples", "rejected_essays",
           "require_columns", "route_files"]
