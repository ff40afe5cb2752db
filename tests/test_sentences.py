"""Learned sentence ends: against a plain version, abbreviations no longer split."""

import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from redline.functions.text import words
from redline.operators import sentences as S

TEXTS = [
    "He saw Dr. Smith at approx. five. Then he left. (It was late.) It was no. 5, he said!",
    "Dr. Jones met Dr. Smith. They spoke. The five spoke, e.g. about it. He left. \"So late.\" Smith left? Yes.",
    "At five he left. At five they spoke. Then the doctor spoke about it... and left. At five.",
    "Dr. Smith lives here. Here he lives. He has approx. ten cats and approx. ten dogs. Ten dogs. Cats here.",
    "e.g. this", "", "   ", None, "no end", "!", ". . .", "Dr.", "ten. ten ten. ten",
] + ["Dr. Smith spoke, e.g. here. Smith left."] * 20


def bare(t):
    return re.sub(r"[\"')\]]+$", "", re.sub(r"^[\"'(\[]+", "", t)).lower()


def plain_learn(texts, threshold=0.3):
    stopped, plain, other = Counter(), Counter(), 0
    for text in texts:
        for t in (text or "").split():
            b = bare(t)
            stop = re.search(r"[^.]\.$", b) is not None
            kind = b[:-1] if stop else re.sub(r"[.,;:!?]+$", "", b)
            if not re.search(r"[^\W\d_]", kind):
                kind = None
            (stopped if stop else plain)[kind] += 1
    n, s = sum(stopped.values()) + sum(plain.values()), sum(stopped.values())
    p, out = s / n, {}
    for kind, a in stopped.items():
        if kind is None:
            continue
        b, size = plain[kind], len(kind.replace(".", ""))
        usual, sure = a * math.log(p) + b * math.log(1 - p), a * math.log(0.99) + b * math.log(1 - 0.99)
        score = -2 * (usual - sure) * (kind.count(".") + 1) * math.exp(-size - b * math.log(size))
        if score >= threshold:
            out[kind] = score
    return out


def plain_ends(text, known):
    ts = text.split()
    return [i + 1 for i, t in enumerate(ts) if i == len(ts) - 1 or re.search(r"[.!?][\"')\]]*$", t)
            and not (re.search(r"[^.]\.$", bare(t)) and bare(t)[:-1] in known)]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "k int, text string").select("k", "text", words("text").alias("w"))


def test_equals_the_plain_version(spark, table):
    known = plain_learn(TEXTS)
    learned = S.learn_abbreviations(table, "w")
    got = {r.type: r.score for r in learned.collect()}
    assert got.keys() == known.keys() and all(abs(got[t] - known[t]) < 1e-9 for t in got)
    assert {"dr", "e.g"} <= got.keys() and not {"left", "here", "five"} & got.keys()
    ends = {r.k: r.ends for r in S.sentence_ends(table, "w", learned, ["k"]).collect()}
    assert ends == {k: plain_ends(t, known) for k, t in enumerate(TEXTS) if (t or "").split()}


def test_abbreviations_no_longer_split(spark, table):
    first = S.sentence_ends(table, "w", S.learn_abbreviations(table, "w"), ["k"]).where("k = 20").first()
    assert [" ".join(first.w[a:b]) for a, b in zip([0, *first.ends], first.ends)] == ["Dr. Smith spoke, e.g. here.", "Smith left."]


def test_large_table_of_abbreviations_is_joined(spark, table, monkeypatch):
    from redline.operators import corpus
    learned = S.learn_abbreviations(table, "w")
    want = sorted((r.k, r.ends) for r in S.sentence_ends(table, "w", learned, ["k"]).collect())
    small = corpus.encode_with_vocab
    monkeypatch.setattr(S, "encode_with_vocab", lambda *a, **k: small(*a, map_tokens=1, **k))
    assert sorted((r.k, r.ends) for r in S.sentence_ends(table, "w", learned, ["k"]).collect()) == want


def test_texts_without_stops(spark):
    d = spark.createDataFrame([(1, "a b c"), (2, "d e")], "k int, text string")
    assert {r.k: r.n_sentences for r in S.count_sentences(d, "text", ["k"]).collect()} == {1: 1, 2: 1}
    assert S.count_sentences(d.where("false"), "text", ["k"]).count() == 0
    only = spark.createDataFrame([(1, "a. b. c.")], "k int, text string")
    assert S.learn_abbreviations(only.select(words("text").alias("w")), "w").count() == 0
    assert only.select(F.size(words("text"))).first()[0] == 3


def test_patterns_are_tried_on_distinct_tokens_and_final_marks_only(spark):
    table = spark.createDataFrame([(1, ["ca.", "two", "words", "(end.)"]), (2, ["Ca.", "no", "mark"]), (3, []), (4, ["Why?!", None, "x"])], "k long, w array<string>")
    plan = S.stop_counts(table, "w")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 2 and "Aggregate [t#" in plan and "Filter (size" not in plan
    learned = spark.createDataFrame([("ca",)], "type string")
    got = S.marked_ends(table, "w", learned, ["k"])
    assert sorted((r.k, r.ends, r.marks) for r in got.collect()) == [(1, [4], [1, 4]), (2, [3], [1, 3]), (4, [1, 3], [1, 3])]
    assert got.columns == ["k", "ends", "marks"]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1
