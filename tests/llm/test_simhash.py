import itertools
import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from redline.llm import simhash


def plain(text, n=3):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[k:k + n]) for k in range(len(words) - n + 1)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def smallest(ids, edges):
    root = {i: i for i in ids}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in edges:
        a, b = sorted((top(a), top(b)))
        root[b] = a
    return {i: top(i) for i in ids}


def test_code_is_perfect():
    words = simhash.hamming_words()
    assert len(words) == 16
    assert all(min(bin(v ^ int(w)).count("1") for w in words) <= 1 for v in range(128))
    assert min(bin(int(a) ^ int(b)).count("1") for a, b in itertools.combinations(words, 2)) == 3


def test_no_pair_is_lost():
    random.seed(2)
    for bits in (1, 2, 3, 4):
        pairs = []
        for _ in range(300 if bits < 3 else 30):
            a, b = random.getrandbits(64), 0
            for k in random.sample(range(64), random.randint(0, bits)):
                b |= 1 << k
            pairs += [a, a ^ b]
        prints = np.array(pairs, np.uint64).view(np.int64)
        row, anchor = simhash.anchors(prints, bits)
        own = [set(anchor[row == k].tolist()) for k in range(len(prints))] if bits < 3 else None
        if own is None:
            own = [set() for _ in prints]
            for r, a in zip(row.tolist(), anchor.tolist(), strict=True):
                own[r].add(a)
        assert all(own[k] & own[k + 1] for k in range(0, len(prints), 2)), bits


def test_fingerprints_and_components(small, medium):
    for docs in (small, medium):
        rows = docs.select("doc_id", "text").collect()
        want = {r.doc_id: plain(r.text) for r in rows}
        ids = sorted(want)
        edges = [(a, b) for a, b in itertools.combinations(ids, 2) if (want[a] ^ want[b]).bit_count() <= 2]
        roots = smallest(ids, edges)
        got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.query(docs).collect()}
        assert got == {i: (f"{want[i]:016x}", roots[i]) for i in ids}


def test_awkward(awkward, empty, crowded):
    rows = simhash.query(awkward).collect()
    assert len(rows) == awkward.count()
    assert {r.component_id for r in rows if r.fingerprint == "0" * 16} == {1}
    assert {r.component_id for r in rows if r.doc_id in (5, 6, 10)} == {5}
    assert simhash.query(empty).collect() == []
    out = simhash.keep(crowded)
    assert out.columns == crowded.columns
    ids = [r.doc_id for r in out.collect()]
    assert 5 in ids and 6 not in ids and None not in ids and len(ids) == len(set(ids))


def test_components_of_a_chain_and_a_star(spark):
    from redline.llm.components import components
    chain = [(k, k + 1) for k in range(40)]
    star = [(100, 100 + k) for k in range(1, 60)]
    got = {r.node: r.root for r in components(spark.createDataFrame(chain + star, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(41)} | {100 + k: 100 for k in range(60)}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_null_ids_only(spark):
    docs = spark.createDataFrame([(None, "a b c d"), (None, "a b c d")], "doc_id long, text string")
    assert [r.component_id for r in simhash.query(docs).collect()] == [None, None]
    assert simhash.keep(docs.withColumn("x", F.lit(1))).count() == 2


def test_repeated_rows_leave_one(spark):
    one, other, third = "a b c d e f", "one two three four five six", "red green blue black white grey"
    rows = [(1, one), (1, one), (2, one), (3, other), (2, other), (2, other), (None, one), (None, third), (4, third), (None, "all by itself in here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = sorted(((r.doc_id or 0, r.text) for r in simhash.keep(docs).collect()))
    assert out == [(0, "all by itself in here"), (1, one), (2, other), (4, third)]


def test_anchors_are_not_broadcast(spark):
    """Spark sizes the anchors by the fingerprints' file, so however few they look they are sorted and merged."""
    prints = spark.createDataFrame([(k,) for k in (0, 1, 3, 15, 255)], "fp long")
    found = simhash.links(prints, 2)
    assert {tuple(r) for r in found.collect()} == {(0, 1), (0, 3), (1, 3), (3, 15)}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" not in plan and "SortMergeJoin" in plan
