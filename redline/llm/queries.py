"""The registered queries of the corpus operators: thin, whole tables, production parameters."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from redline.llm.common import table

#: query -> (module, tables it reads besides documents)
OPERATORS: dict[str, tuple[str, tuple[str, ...]]] = {
    "op1_pii": ("pii", ("documents",)),
    "op2_langid": ("langid", ("documents",)),
    "op3_suffix_dedup": ("suffixes", ("documents",)),
    "op4_ppm": ("ppm", ("documents",)),
    "op5_quality_rules": ("rules", ("documents", "labels")),
    "op6_bpe": ("bpe", ("documents",)),
    "op7_toxicity": ("toxicity", ("documents", "labels")),
    "op8_mix_sources": ("mixing", ("documents",)),
    "op9_simhash_dedup": ("simhash", ("documents",)),
    "op10_lattice_dedup": ("lattice", ("embeddings",)),
    "op11_phrase_mining": ("phrases", ("documents",)),
    "op12_ranked_search": ("search", ("documents", "benchmark")),
    "op13_neighbour_quality": ("neighbours", ("documents", "labels")),
}


def _query(module: str, tables: tuple[str, ...]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return importlib.import_module(f"redline.llm.{module}").query(*(table(spark, sf_dir, t) for t in tables))
    return run


def modules() -> list[str]:
    """The modules of all operators, by name."""
    return [f"redline.llm.{module}" for module, _ in OPERATORS.values()]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline
    return {name: _query(*spec) for name, spec in OPERATORS.items()} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    from redline.llm import mixing, phrases, search
    return {"op8_mix_sources": mixing.ORACLE, "op11_phrase_mining": phrases.ORACLE, "op12_ranked_search": search.ORACLE}
