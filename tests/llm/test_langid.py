import itertools

import numpy as np
import pytest

from redline.llm import langid


def brute(score):
    best = None
    for path in itertools.product(range(score.shape[1]), repeat=len(score)):
        value = sum(score[k, p] for k, p in enumerate(path)) - langid.PENALTY * sum(a != b for a, b in zip(path, path[1:], strict=False))
        if best is None or value > best + 1e-12:
            best = value
    return best


def value(score, path):
    return sum(score[k, p] for k, p in enumerate(path)) - langid.PENALTY * sum(a != b for a, b in zip(path, path[1:], strict=False))


def test_path_is_the_best():
    rng = np.random.default_rng(4)
    model = langid.Model(["a", "b", "c"], np.zeros((3, 1)), np.zeros((1, 3), bool))
    for scale in (2, 8, 20, 40):
        for _ in range(40):
            score = rng.normal(size=(rng.integers(1, 8), 3)) * scale
            assert value(score, model.path(score)) == pytest.approx(brute(score))


@pytest.fixture(scope="module")
def model(medium):
    return langid.fit(medium)


def test_words_follow_the_text(model):
    texts = ["", "été naïve\n123 the-end", "世界 x", "\U0001F600", "ab"]
    got = [[t[a:b] for a, b in zip(s.tolist(), e.tolist(), strict=True)] for t, (s, e, _) in zip(texts, model.words(texts), strict=True)]
    assert got == [[], ["été", "naïve", "the", "end"], ["世界", "x"], [], ["ab"]]


def test_held_out_accuracy(medium):
    rows = langid.query(medium).join(medium.selectExpr("doc_id as of", "lang"), "doc_id = of" and langid.F.col("doc_id") == langid.F.col("of")).where("held_out").toPandas()
    assert len(rows) > 200 and (rows.lang_pred == rows.lang).mean() > 0.97
    assert rows.score.between(0, 1).all()


def test_mixed_text_gets_spans(medium, model):
    by = {}
    for r in medium.where("n_chars between 600 and 900").orderBy("doc_id").collect():
        (words,) = model.words([r.text])
        if len(model.label(*words)[2]) == 1:
            by[r.lang] = r.text
    text = by["en"] + "\n" + by["de"] + "\n" + by["es"]
    (words,) = model.words([text])
    top, share, spans = model.label(*words)
    assert [s[0] for s in spans] == ["en", "de", "es"] and share < 0.7
    cut = len(by["en"])
    assert abs(spans[0][2] - cut) < 60 and spans[-1][2] <= len(text)


def test_awkward(spark, awkward, empty, crowded):
    got = {r.doc_id: r for r in langid.query(awkward).where("doc_id is not null").collect()}
    assert langid.query(awkward).count() == awkward.count()
    assert all(got[i].lang_pred == "und" and got[i].score == 0 and got[i].spans == "" for i in (1, 2, 3, 11))
    assert got[7].lang_pred != "und"
    assert langid.query(empty).collect() == []
    nothing = langid.query(awkward.withColumn("lang", langid.F.lit(None).cast("string"))).collect()
    assert {r.lang_pred for r in nothing} == {"und"}
    assert langid.query(crowded).count() == crowded.count()
