"""Ranked search by two trees: against brute force, in blocks, pruned, awkward rows."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from redline.llm import search as S

RUN = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, items, k=10):
    """Every pair scored: (item_id, rank, doc_id, score)."""
    bags = [(i, Counter(RUN.findall((t or "").translate(FOLD)))) for i, t in docs]
    bags = [(i, b, sum(b.values())) for i, b in bags if b]
    N, L = len(bags), sum(n for _, _, n in bags)
    df = Counter(t for _, b, _ in bags for t in b)
    out = []
    for item, text in items:
        own, scored = set(RUN.findall((text or "").translate(FOLD))), []
        for i, b, n in bags:
            s = sum(math.floor(1000 * math.log((2 * N + 2) / (2 * df[t] + 1))) * (10**9 * b[t] // (1000 * b[t] + 8 * (10 + 90 * n * N // L))) for t in own if t in b)
            if s > 0:
                scored.append((-s, math.inf if i is None else i, i))
        out += [(item, r, i, -s) for r, (s, _, i) in enumerate(sorted(scored, key=lambda x: x[:2])[:k], 1)]
    return out


def collected(df):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect()), key=str)


def pairs(df, key):
    return [(r[0], r[1]) for r in df.select(key, "text").collect()]


@pytest.fixture(scope="module")
def items(spark):
    return spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")


@pytest.fixture(scope="module")
def odd_items(spark):
    rows = [(1, "the quick BROWN fox"), (1, "the quick BROWN fox"), (None, "word"), (2, None), (3, ""), (4, " .,! "), (5, "Été привет 世界"),
            (6, "nowhere12"), (7, "the " * 500), (8, "quick"), (9, "x" * 60_000)]
    return spark.createDataFrame(rows, "item_id long, text string")


def test_equals_brute_force(spark, small, items):
    assert collected(S.query(small, items)) == sorted(brute(pairs(small, "doc_id"), pairs(items, "item_id")), key=str)


def test_blocks_do_not_change_the_result(spark, awkward, odd_items, small, items):
    whole = collected(S.query(small, items))
    assert collected(S.search(small, items, most_items=3)) == whole
    assert collected(S.search(small, items, most_terms=40)) == whole
    assert len(list(S.blocks(items, "item_id", most_terms=1))) == items.count()
    assert collected(S.search(awkward, odd_items, most_terms=2)) == collected(S.query(awkward, odd_items))


def test_awkward_rows(spark, awkward, crowded, empty, odd_items):
    want = sorted(brute(pairs(awkward, "doc_id"), pairs(odd_items, "item_id")), key=str)
    assert collected(S.query(awkward, odd_items)) == want
    wide = odd_items.select("*", F.lit(1).alias("rank"), F.lit(2).alias("doc_id"), F.lit("z").alias("terms"))
    assert collected(S.query(crowded, wide)) == want
    assert [f.dataType.simpleString() for f in S.query(awkward, odd_items).schema] == ["bigint", "int", "bigint", "bigint"]
    assert S.query(empty, odd_items).count() == 0
    assert S.query(awkward, odd_items.where("false")).count() == 0
    assert S.query(awkward.where("text is null"), odd_items).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_one_tree_pair_against_all_scores(seed):
    """Random points with many ties, searched chunk by chunk: the best of every item, and fewer exact scores than pairs."""
    rng = np.random.default_rng(seed)
    size, k = 300, 5
    w = rng.integers(1, 2000, size)
    own = [np.sort(rng.choice(size, rng.integers(1, 12), replace=False)) for _ in range(70)]
    search = S.Search(own, w, k, np.zeros(len(own), np.int64))
    scores = [[] for _ in own]
    for chunk in range(6):
        n = int(rng.integers(1, 400))
        ids = [None if rng.random() < 0.02 else chunk * 1000 + int(x) for x in rng.integers(0, 300, n)]
        doc = np.repeat(np.arange(n), rng.integers(1, 8, n))
        term = rng.integers(0, size, len(doc))
        doc, term = np.unique(np.stack([doc, term]), axis=1)
        value = rng.integers(1, 4, len(doc)) * 1000
        search.chunk(ids, doc, term, value)
        points = np.zeros((n, size), np.int64)
        points[doc, term] = value
        for i, o in enumerate(own):
            s = points[:, o] @ w[o]
            scores[i] += [(-int(x), math.inf if d is None else d) for x, d in zip(s, ids, strict=True) if x > 0]
    for place, i in enumerate(search.order):
        assert [x[:2] for x in search.best[place]] == sorted(scores[i])[:k]
    assert search.exact < 0.5 * search.pairs


def test_seeded_floors_keep_ties(spark):
    """Many documents of one score: the smallest ids rank, whichever set the first kth score."""
    docs = spark.createDataFrame([(i, "alpha beta") for i in range(2000, 0, -1)] + [(5000 + i, "gamma") for i in range(50)], "doc_id long, text string").repartition(8)
    items = spark.createDataFrame([(1, "alpha"), (2, "beta gamma")], "item_id long, text string")
    assert collected(S.query(docs, items)) == sorted(brute(pairs(docs, "doc_id"), pairs(items, "item_id")), key=str)
