"""Extra columns named like the operators' own change no result; empty tables give none."""

import pytest
from pyspark.sql import functions as F

from redline.llm import bpe, langid, lattice, mixing, neighbours, phrases, pii, ppm, rules, search, simhash, suffixes, toxicity
from redline.llm.queries import OPERATORS

NAMES = ("kind", "key", "n", "h", "gram", "cell", "node", "sketch", "least", "times", "root", "of", "m", "row", "rate", "word", "lang_pred", "score", "rank", "rule", "fp", "at", "t")


def rows(df):
    return sorted(str(tuple(r)) for r in df.collect())


@pytest.fixture(scope="module")
def texts(awkward):
    return awkward.where("doc_id is null or doc_id <> 7")


@pytest.mark.parametrize("operator", [m for _, (m, _) in OPERATORS.items()])
def test_extra_columns_and_empty_tables(spark, texts, operator):
    module = {x.__name__.rsplit(".", 1)[-1]: x for x in (bpe, langid, lattice, mixing, neighbours, phrases, pii, ppm, rules, search, simhash, suffixes, toxicity)}[operator]
    marked = spark.createDataFrame([(k, k % 2, k % 3 // 2) for k in range(1, 12)], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([(1, "the quick fox"), (2, "word x")], "item_id long, text string")
    vectors = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.1]), (3, None), (3, [0.0, 1.0])], "vec_id long, embedding array<float>")
    first = vectors if operator == "lattice" else texts
    others = {"rules": (marked,), "toxicity": (marked,), "neighbours": (marked,), "search": (items,)}.get(operator, ())
    wide = [d.select("*", *[F.lit(k).alias(n) for k, n in enumerate(NAMES) if n not in d.columns]) for d in (first, *others)]
    plain = rows(module.query(first, *others))
    assert plain and rows(module.query(*wide)) == plain
    assert rows(module.query(first.where("false"), *others)) == []
    if operator not in ("phrases", "search"):
        assert len(plain) == first.count()
