"""X-02: rolling hashes, a bitmap of fixed size, and the join of what hits."""

import random

import pytest
from pyspark.sql import functions as F

from redline.operators.quality import ngram_hashes, ngram_overlap, overlap_candidates


def turned(x, by):
    by %= 64
    return ((x << by) | (x >> (64 - by))) & ((1 << 64) - 1)


@pytest.mark.parametrize("n", [1, 2, 3, 5, 7, 8, 13])
def test_rolling_hash_is_the_whole_polynomial(spark, n):
    rng = random.Random(n)
    rows = [(k, [rng.choice("abcdef") for _ in range(size)]) for k, size in enumerate((0, 1, n - 1, n, n + 1, 40))]
    df = spark.createDataFrame(rows, "k int, t array<string>")
    one = {r.w: r.h % (1 << 64) for r in spark.createDataFrame([(c,) for c in "abcdef"], "w string").select("w", F.xxhash64("w").alias("h")).collect()}
    for r in df.select("k", "t", ngram_hashes("t", n).alias("h")).collect():
        want = []
        for i in range(len(r.t) - n + 1):
            x = 0
            for k in range(n):
                x ^= turned(one[r.t[i + k]], 11 * k)
            want.append(x)
        assert [h % (1 << 64) for h in r.h] == want


def plain(items, docs, n):
    grams = {tuple(t[i:i + n]) for _, t in docs for i in range(len(t) - n + 1)}
    return sorted((k, max(0, len(t) - n + 1), sum(tuple(t[i:i + n]) in grams for i in range(len(t) - n + 1))) for k, t in items)


@pytest.mark.parametrize("bits", [24, 15])
def test_overlap_equals_plain_sets(spark, bits):
    rng = random.Random(3)
    words = [f"w{k}" for k in range(12)]
    docs = [(k, [rng.choice(words) for _ in range(rng.randint(0, 60))]) for k in range(120)]
    items = [(k, docs[k][1][3:20] if k % 2 else [rng.choice(words) for _ in range(15)]) for k in range(30)]
    d, i = spark.createDataFrame(docs, "d int, t array<string>"), spark.createDataFrame(items, "i int, t array<string>")
    for n in (2, 3, 8):
        got = sorted((r.i, r.n_grams, r.n_overlap) for r in ngram_overlap(i, "i", "t", d, "d", "t", n, bits).collect())
        assert got == plain(items, docs, n)


def test_what_moves_is_the_hits(spark):
    """Only places with an item's gram leave their document, for few items or many."""
    docs = [(k, [f"d{k}_{j}" for j in range(50)] + ["x", "y", "z", "u"]) for k in range(200)]
    d = spark.createDataFrame(docs, "d int, t array<string>")
    for many in (1, 2000):
        items = spark.createDataFrame([(0, ["x", "y", "z"])] + [(k, [f"i{k}_{j}" for j in range(20)]) for k in range(1, many)], "i int, t array<string>")
        hits = overlap_candidates(items, "t", d, "d", "t", 3)
        assert sorted((r._of, r._at) for r in hits.collect()) == [(k, 50) for k in range(200)]
