import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from redline.llm import suffixes
from redline.llm.suffixes import LENGTH


def plain(texts):
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[k:k + LENGTH] for r in raws for k in range(len(r) - LENGTH + 1))
    out = []
    for r in raws:
        mark = np.zeros(len(r) + 1, bool)
        for k in range(len(r) - LENGTH + 1):
            if seen[r[k:k + LENGTH]] > 1:
                mark[k:k + LENGTH] = True
        kept = bytes(b for b, m in zip(r, mark, strict=False) if not m)
        out.append((len(r), int(mark.sum()), int((np.diff(mark.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def compare(spark, rows, hot=suffixes.HOT, family=suffixes.FAMILY):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.deduplicate(docs, hot, family).collect())
    want = sorted((i, *w) for (i, _), w in zip(rows, plain([t for _, t in rows]), strict=True))
    assert got == want


@pytest.fixture(scope="module")
def passages():
    """Passages shared at many offsets and with single bytes changed, periodic and constant texts."""
    random.seed(9)

    def prose(n):
        return "".join(random.choice("abcdefgh é") for _ in range(n))
    shared = prose(700)
    out = []
    for k in range(60):
        a = random.randint(0, 400)
        b = random.randint(a, 700)
        part = list(shared[a:b])
        if part and k % 3 == 0:
            part[random.randrange(len(part))] = "#"
        out.append(prose(random.randint(0, 300)) + "".join(part) + prose(random.randint(0, 300)))
    out += ["x" * 450, "ab" * 300, shared, shared, shared[:199], shared[:200], prose(199), "Eaea " * 120, "x" * 199 + "y"]
    return list(enumerate(out))


@pytest.mark.parametrize("hot,family", [(suffixes.HOT, suffixes.FAMILY), (0, suffixes.FAMILY), (suffixes.HOT, 1), (suffixes.HOT, 500)])
def test_equals_brute_force(spark, passages, hot, family):
    compare(spark, passages, hot, family)


def test_families_end_between_grams(spark):
    """Rows of few and of many windows: a family takes whole grams, and every repeat is found at any size."""
    random.seed(4)
    rows = []
    for gram in range(40):
        shared = bytes(random.choices(b"abcdef ", k=260))
        rows += [(gram - 20, k, bytes(random.choices(b"xyz", k=random.randint(0, 90))) + shared) for k in range(random.randint(1, 9))]
    bodies = spark.createDataFrame(rows, "gram long, run long, body binary")
    found = [sorted((r.gram, r.run, tuple(r.ends)) for r in suffixes.matched(bodies, n).collect()) for n in (1, 300, 1 << 20)]
    assert found[0] == found[1] == found[2] and len(found[0]) == len(rows)
    alone = {g for g, n in Counter(g for g, _, _ in rows).items() if n == 1}
    assert all(bool(ends) == (g not in alone) for g, _, ends in found[0])


def test_text_longer_than_a_piece(spark):
    random.seed(5)
    words = ["".join(random.choices("abcdefghijklmnop", k=7)) for _ in range(5000)]
    text = " ".join(random.choices(words, k=150_000))
    assert len(text) > suffixes.PIECE + 100_000
    over = text[suffixes.PIECE - 300:suffixes.PIECE + 300]
    compare(spark, [(1, text), (2, "before " + over + " after"), (3, text[:400] + "#" + text[-400:])])


def test_long_texts_are_cut_into_pieces(spark, passages, monkeypatch):
    whole = suffixes.runs(np.frombuffer(passages[0][1].encode() * 9, np.uint8))
    assert whole[1].sum() == len(passages[0][1].encode()) * 9 - LENGTH + 1
    at = 0
    for first, piece in suffixes.pieces(b"x" * (suffixes.PIECE + 500)):
        assert first == at
        at += len(piece) - LENGTH + 1
    assert at == suffixes.PIECE + 500 - LENGTH + 1


def test_family_finds_every_repeat_and_merges_geometrically():
    rng = np.random.default_rng(0)
    keys = rng.integers(0, 4000, 9000, dtype=np.uint64)
    family = suffixes.Family()
    for k in range(0, 9000, 100):
        family.add(keys[k:k + 100])
        sizes = [len(level) for level, _ in family.levels]
        assert all(a >= 2 * b for a, b in zip(sizes, sizes[1:], strict=False)) and len(sizes) <= 8
    seen = Counter(keys.tolist())
    assert family.marks().tolist() == [seen[k] > 1 for k in keys.tolist()]


def test_sliding_least():
    rng = np.random.default_rng(1)
    for n, width in ((1, 1), (10, 3), (169, 169), (500, 169)):
        x = rng.integers(0, 100, n, dtype=np.uint64)
        assert suffixes.sliding_least(x, width).tolist() == [x[k:k + width].min() for k in range(n - width + 1)]


def test_small_table(spark, small):
    compare(spark, [(r.doc_id, r.text) for r in small.collect()])


def test_awkward(spark, awkward, empty):
    rows = [(r.doc_id if r.doc_id is not None else -k, r.text) for k, r in enumerate(awkward.collect()) if r.doc_id != 7]
    rows.append((7, "word " * 900))
    compare(spark, rows)
    assert suffixes.query(empty).collect() == []
    nulls = suffixes.query(awkward).where("doc_id is null").collect()
    assert sorted(r.n_bytes for r in nulls) == [0, 800] and {r.n_removed for r in nulls} == {0, 800}
