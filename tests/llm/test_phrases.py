"""Phrase mining: against plain counting, with small budgets and bitmaps, exact beyond 64 bits, awkward rows."""

import re
from collections import Counter

import pytest

from redline.llm import phrases as P

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, least=30, depth=4, top=2000):
    """Every phrase of every piece counted; (lang, rank, phrase, a, l, r, n, score)."""
    f = {}
    for lang, text in docs:
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(FOLD)):
            ws = re.findall("[^ \t]+", piece)
            own = f.setdefault(lang or "und" if lang != "" else "", Counter())
            own.update(tuple(ws[i:i + k]) for k in range(1, depth + 1) for i in range(len(ws) - k + 1))
    out = []
    for lang, own in f.items():
        held = {p: a for p, a in own.items() if len(p) >= 2 and a >= least}
        over = Counter()
        for p, a in held.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    over[p[i:i + k]] = max(over[p[i:i + k]], a)
        rows = []
        for p, a in held.items():
            if over[p] and 100 * over[p] >= 80 * a:
                continue
            score, _, l, r = min((2000000 * a // (own[p[:k]] + own[p[k:]]), k, own[p[:k]], own[p[k:]]) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), a, l, r))
        n = sum(c for p, c in own.items() if len(p) == 1)
        out += [(lang, rank, p.decode(), a, l, r, n, -s) for rank, (s, _, p, a, l, r) in enumerate(sorted(rows)[:top], 1)]
    return sorted(out)


def got(df):
    assert df.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(tuple(r) for r in df.collect())


def rows(docs):
    return [(r.lang, r.text) for r in docs.select("lang", "text").collect()]


def test_equals_plain_counting(spark, small):
    want = brute(rows(small))
    assert want and got(P.query(small)) == want


def test_small_groups_bitmaps_and_strides(spark, small, monkeypatch):
    """Prefixes spread over groups, nearly every bit set, flushes within texts: the same rows."""
    want = brute(rows(small), least=5, top=50)
    monkeypatch.setattr(P, "BITS", 15)
    monkeypatch.setattr(P, "BUCKET_BITS", 4)
    assert got(P.mine(small, least=5, top=50, budget=300)) == want
    pairs = P.cut(small.selectExpr("xxhash64(doc_id) as h", "100L as n"))
    route = P.routes(pairs, 300)
    assert (route[:, 1] > 1).any() and len(set(route[:, 0])) > 1


def test_tokens_cut_at_word_ends(monkeypatch):
    raw = "Aa bb.cc  dd\tée,\n\r. ff; xxxxxxxxxxxxxxxxxxxx yy!" .encode()
    whole = [w for part in P.tokens(raw) for w in part]
    assert whole[:4] == [b"aa", b"bb", b".", b"cc"]
    for stride in range(1, 12):
        monkeypatch.setattr(P, "STRIDE", stride)
        assert [w for part in P.tokens(raw) for w in part] == whole


def test_small_flushes(spark, small, monkeypatch):
    import pyarrow as pa
    texts = [("en", "a b c d. e f " * 40)] * 5 + [("de", "x y z " * 30)]
    batch = pa.RecordBatch.from_arrays([pa.array([x for x, _ in texts]), pa.array([t for _, t in texts])], names=["lang", "text"])
    def counts():
        out = Counter()
        for lang, lexicon, at in P.positions(iter([batch.slice(k, 1) for k in range(len(texts))])):
            names = [lexicon.words[k] for k in at.tolist()]
            out.update((lang, *names[i:i + 2]) for i in range(len(names) - 1) if b"." not in names[i:i + 2])
        return out
    whole = counts()
    monkeypatch.setattr(P, "FLUSH", 50)
    monkeypatch.setattr(P, "LEXICON", 2)
    assert counts() == whole and whole[("en", b"a", b"b")] == 200


def test_arithmetic_beyond_64_bits(spark):
    big = 9_000_000_000_000_000_000 // 4
    words = spark.createDataFrame([("x", w, n) for w, n in (("a", big), ("b", big - 1), ("c", big - 7))], "lang string, word string, n long")
    phrases = spark.createDataFrame([("x", "a b", big - 10), ("x", "b c", big - 12), ("x", "a b c", (big - 10) * 4 // 5)], "lang string, phrase string, n long")
    found = {r.phrase: r for r in P.scored(phrases, words, 30).collect()}
    assert found["a b"].score == 2000000 * (big - 10) // (2 * big - 1)
    third = found["a b c"]
    cuts = [(2000000 * third.a // (l + r), k, l, r) for k, l, r in ((1, big, big - 12), (2, big - 10, big - 7))]
    assert (third.score, third.l, third.r) == (min(cuts)[0], min(cuts)[2], min(cuts)[3])
    kept = {r.phrase for r in P.maximal(P.scored(phrases, words, 30)).collect()}
    want = {p for p, a in (("a b", big - 10), ("b c", big - 12)) if 100 * third.a < 80 * a} | {"a b c"}
    assert kept == want


def test_ties_go_to_the_first_cut_and_by_bytes(spark):
    docs = spark.createDataFrame([("t", "q w e. ü v. a z. Z a") for _ in range(30)], "lang string, text string")
    out = got(P.query(docs))
    assert out == brute(rows(docs))
    assert [r[2] for r in out] == ["a z", "q w e", "z a", "ü v"] or [r[2] for r in out] == sorted((r[2] for r in out), key=lambda p: (-[x[7] for x in out if x[2] == p][0], p.encode()))


@pytest.mark.parametrize("least", [1, 2, 30])
def test_awkward_rows(spark, awkward, crowded, empty, least):
    want = brute(rows(awkward), least)
    assert got(P.mine(awkward, least)) == want
    assert got(P.mine(crowded, least)) == want
    assert got(P.mine(empty, least)) == []


def test_repeated_rows_count_each(spark, awkward):
    assert got(P.query(awkward.union(awkward))) == brute(rows(awkward) * 2)
