"""J-09: dense ids without a window, look-up in the row and by join."""

import random

import pytest
from pyspark.sql import functions as F

from redline.operators.corpus import dense_ids, encode_with_vocab, vocabulary


def plan(df):
    return df._jdf.queryExecution().toString()


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(5)
    names = [f"t{k}" for k in range(400)] + ["é", "世界", "x" * 300, "", "A", "a"]
    made = []
    for k in range(300):
        # one token is a third of all, and some tokens are NULL
        made.append((k, [None if rng.random() < 0.01 else "hot" if rng.random() < 0.33 else rng.choice(names) for _ in range(rng.randint(0, 60))]))
    made += [(1000, None), (1001, []), (1002, ["hot"] * 5000)]
    return made


@pytest.fixture(scope="module")
def table(spark, rows):
    return spark.createDataFrame(rows, "k int, t array<string>").repartition(7)


def test_ids_are_dense_and_in_order(spark, table, rows):
    want = {t: i for i, t in enumerate(sorted({t for _, ts in rows for t in ts or [] if t is not None}, key=lambda t: t.encode()))}
    made = vocabulary(table, "t")
    assert {r.token: r.id for r in made.collect()} == want
    assert made.count() == len(want)
    distinct = spark.range(100_000).select((F.col("id") * 7919 % 100_003).alias("v"))
    ids = dense_ids(distinct, "v")
    assert "Window" not in plan(ids)
    assert ids.agg(F.count("*"), F.count_distinct("id"), F.max("id")).first()[:] == (100_000, 100_000, 99_999)
    joined = ids.alias("a").join(ids.alias("b"), F.expr("a.id + 1 = b.id"))
    assert joined.where("a.v >= b.v").count() == 0
    assert dense_ids(distinct.where("false"), "v").count() == 0


@pytest.mark.parametrize("map_tokens", [10_000, 50, 1])
def test_encoding_in_the_row_and_by_join(spark, table, rows, map_tokens):
    vocab = vocabulary(table.where("k % 2 = 0"), "t")
    known = {r.token: r.id for r in vocab.collect()}
    got = encode_with_vocab(table, "t", vocab, ["k"], map_tokens)
    assert "Window" not in plan(got)
    assert {r.k: r.ids for r in got.collect()} == {k: [known.get(t) for t in ts] for k, ts in rows if ts}


def test_small_vocabulary_is_not_shuffled(spark, table):
    vocab = vocabulary(table, "t").where(F.length("token") < 10)
    assert "Exchange" not in encode_with_vocab(table, "t", vocab, ["k"])._jdf.queryExecution().executedPlan().toString().split("RoundRobin")[0].replace("Exchange ", "", 1)


def test_a_hot_token_meets_no_join(spark, table):
    """Tokens that are joined are the rarer ones: none holds a large share of the rows."""
    vocab = vocabulary(table, "t")
    first = encode_with_vocab(table, "t", vocab, ["k"], 5)
    total = sum(len(r.ids) for r in first.collect())
    joined = table.select(F.explode("t").alias("token")).groupBy("token").count().orderBy(F.col("count").desc(), "token").collect()
    assert joined[0].token == "hot" and all(r["count"] <= total / 5 for r in joined[5:])
