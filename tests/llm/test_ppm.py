import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from redline.llm import ppm
from redline.llm.common import fold


class Plain:
    """The same model, symbol by symbol, from dictionaries."""

    def __init__(self, texts):
        self.counts = [defaultdict(Counter) for _ in range(ppm.ORDER + 1)]
        for t in texts:
            data = bytes([ppm.END]) * ppm.ORDER + t.encode().lower() + bytes([ppm.END])
            for k in range(ppm.ORDER, len(data)):
                for n in range(ppm.ORDER + 1):
                    self.counts[n][data[k - n:k]][data[k]] += 1

    def probability(self, before, symbol):
        seen, left = set(), 1.0
        for n in range(ppm.ORDER, -1, -1):
            own = self.counts[n].get(before[len(before) - n:])
            if not own:
                continue
            new = {s: c for s, c in own.items() if s not in seen}
            if not new:
                continue
            total, kinds = sum(new.values()), len(new)
            if symbol in new:
                return left * new[symbol] / (total + kinds)
            left *= kinds / (total + kinds)
            seen |= set(new)
        return left / (256 - len(seen))

    def score(self, text):
        data = bytes([ppm.END]) * ppm.ORDER + text.encode().lower() + bytes([ppm.END])
        return sum(np.log10(self.probability(data[k - ppm.ORDER:k], data[k])) for k in range(ppm.ORDER, len(data)))


def test_equals_the_plain_model(spark, small):
    docs = small.where("doc_id < 60")
    rows = docs.collect()
    plain = Plain([r.text for r in rows if r.doc_id % 3])
    got = {r.doc_id: r.score for r in ppm.score(docs, F.col("doc_id") % 3 != 0).collect()}
    assert len(got) == len(rows)
    for r in rows[:25]:
        assert got[r.doc_id] == pytest.approx(plain.score(r.text), rel=1e-4)


@pytest.mark.parametrize("hot", [1 << 16, 300, 2])
def test_every_context_seen_counts(spark, small, monkeypatch, hot):
    """No context is too rare for the model, however few of them the tasks get as a trie or as common grams."""
    monkeypatch.setattr(ppm, "HOT", hot)
    monkeypatch.setattr(ppm, "COMMON", hot * 16)
    rows = sorted(small.collect(), key=lambda r: r.doc_id)
    plain = Plain([r.text for r in rows if r.doc_id % 3])
    assert sum(plain.counts[0][b""].values()) > 2 << 16
    got = {r.doc_id: r.score for r in ppm.score(small, F.col("doc_id") % 3 != 0).collect()}
    assert len(got) == len(rows)
    for r in rows[:40]:
        assert got[r.doc_id] == pytest.approx(plain.score(r.text), rel=1e-5)


def test_scores_do_not_depend_on_the_bounds(spark, small, monkeypatch):
    """What is sent to the tasks and what is joined give the same score, to the last digit."""
    def scores():
        return sorted((r.doc_id, r.score, r.base_score) for r in ppm.score(small, F.col("doc_id") % 3 != 0).collect())
    want = scores()
    for hot, common in ((2, 1), (2, 1 << 20), (300, 64), (1 << 16, 1)):
        monkeypatch.setattr(ppm, "HOT", hot)
        monkeypatch.setattr(ppm, "COMMON", common)
        got = scores()
        assert [g[:2] for g in got] == [w[:2] for w in want]


def test_probabilities_sum_to_one():
    grams = ppm.grams([b"abracadabra", b"abc", b""])
    levels = []
    for k in range(ppm.ORDER + 1):
        sums = Counter()
        for code, n in zip(*(g.tolist() for g in grams), strict=True):
            sums[(code >> 8) & ((1 << 8 * k) - 1), code & 255] += n
        levels.append(tuple(np.array(c, np.int64) for c in zip(*[(a, b, n) for (a, b), n in sorted(sums.items())], strict=True)))
    trie = ppm.Trie.of(levels)
    p = 10 ** (trie.log10() / ppm.UNIT)
    assert np.allclose(p[:, :-1].sum(1) + trie.unseen * p[:, -1], 1, atol=1e-5)


def test_grams_do_not_cross_texts():
    keys, counts = ppm.grams([b"ab", b"", b"c"])
    assert counts.sum() == 3 + 1 + 2
    end = ppm.END
    assert {int(k) & 0xFFFF for k in keys} == {end << 8 | 97, 97 << 8 | 98, 98 << 8 | end, end << 8 | end, end << 8 | 99, 99 << 8 | end}


def plain_base(rows, training):
    c, total = Counter(), 0
    for doc_id, text in rows:
        if training(doc_id):
            words = [*(text or "").encode().lower().split(), None]
            c.update(words)
            total += len(words)
    out = []
    for doc_id, text in rows:
        words = [*(text or "").encode().lower().split(), None]
        out.append((doc_id or 0, len(words), sum(c[w] > 0 for w in words), total, sum(np.log10((c[w] + 0.5) / (total + 0.5 * (len(c) + 1))) for w in words)))
    return sorted(out)


@pytest.mark.parametrize("heavy", [1 << 20, 40])
def test_base_equals_brute_force(spark, small, awkward, monkeypatch, heavy):
    monkeypatch.setattr(ppm, "HEAVY", heavy)
    for docs in (small, awkward):
        want = plain_base([(r.doc_id, r.text) for r in docs.collect()], lambda i: zlib.crc32(str("" if i is None else i).encode()) % 5 != 1)
        got = sorted((r.doc_id or 0, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in ppm.query(docs).collect())
        assert [g[:4] for g in got] == [w[:4] for w in want]
        assert [g[4] for g in got] == pytest.approx([w[4] for w in want])


def test_awkward(spark, awkward, empty, crowded):
    rows = ppm.query(crowded).collect()
    assert len(rows) == awkward.count() and all(r.score < 0 for r in rows)
    assert len({r.score for r in rows if r.doc_id in (5, 6)}) == 1
    assert ppm.query(empty).collect() == []
    none = ppm.score(awkward.where(fold(F.col("doc_id"), 5) == 1), F.lit(False)).collect()
    assert all(r.base_score == 0 and r.n_known == 0 and r.train_tokens == 0 for r in none)


def test_better_on_text_like_the_training(medium):
    rows = ppm.query(medium).join(medium.selectExpr("doc_id as of", "n_chars"), F.col("doc_id") == F.col("of")).where("held_out and n_chars > 200").toPandas()
    assert (-rows.score / np.log10(2) / rows.n_chars).median() < 3
