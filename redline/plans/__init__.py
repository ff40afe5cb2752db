"""Derived fixtures and the registered queries (one per SURVEY §2 operator)."""

from redline.plans import q_corpus, q_edits, q_essays, q_io, q_predict, q_scores, q_text  # noqa: F401  (registers queries)
from redline.plans.registry import ORACLE, QUERIES

__all__ = ["QUERIES", "ORACLE"]
