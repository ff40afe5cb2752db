"""Quality by nearest neighbours: against a plain scorer, held-out rows, awkward texts."""

import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from redline.llm import neighbours as nb


def plain_terms(text):
    """Counts of class trigrams, one character at a time."""
    def kind(c):
        if "a" <= c <= "z" or ord(c) >= 0x80:
            return "a"
        if "A" <= c <= "Z":
            return "A"
        return "0" if "0" <= c <= "9" else " " if c in " \t" else "\n" if c in "\n\v\f\r" else "?" if ord(c) < 32 or ord(c) == 127 else c
    kinds, out = [kind(c) for c in text or ""], {}
    for three in zip(kinds, kinds[1:], kinds[2:]):
        out[three] = out.get(three, 0) + 1
    return out


@pytest.mark.parametrize("text", ["", None, "ab", "Ab c", "one two, two!\n\nthree\t4 éß\U0001F600x", "x\x00y\x7fz" * 5])
def test_trigrams_are_the_plain_ones(text):
    term, value = nb.terms(text)
    own = value[term < nb.EXTRA] ** 2
    plain = plain_terms(text)
    assert sorted(np.round(own, 9)) == sorted(np.round(np.array(list(plain.values())) / max(1, sum(plain.values())), 9))


def test_long_text_in_pieces_counts_the_same(monkeypatch):
    text = "Été one, TWO three\n" * 300 + "\U0001F600" * 50 + "end"
    whole = nb.terms(text)
    for stride in (1, 2, 3, 7, 64, 1000):
        monkeypatch.setattr(nb, "STRIDE", stride)
        part = nb.terms(text)
        assert (part[0] == whole[0]).all() and np.allclose(part[1], whole[1])


def test_nearest_takes_the_first_of_equal_values():
    rng = np.random.default_rng(3)
    near = np.round(rng.random((50, 40)), 1)
    got = np.sort(nb.nearest(near, 7), axis=1)
    want = np.sort(np.argsort(-near, axis=1, kind="stable")[:, :7], axis=1)
    assert (got == want).all()


def plain_score(model, term, value):
    """The votes for one document, one labelled vector at a time."""
    row = dict(zip(term.tolist(), value.tolist(), strict=True))
    x = np.array([row.get(t, 0.0) for t in model.kept.tolist()], np.float32)
    v = (x - model.mean) @ model.project
    size = math.sqrt(float((v * v).sum()))
    if size <= 1e-6:
        return model.share
    near = [(round(float(np.dot((v / size).astype(float), u.astype(float))), 6), -k) for k, u in enumerate(model.vectors)]
    best = sorted(near, reverse=True)[:nb.VOTERS]
    total = sum(max(0.0, c) * model.weights[-k] for c, k in best)
    return sum(max(0.0, c) * model.weights[-k] * model.labels[-k] for c, k in best) / total if total else model.share


def test_scores_equal_the_plain_scorer(spark, small, labels):
    model = nb.fit(small, labels)
    got = {r.doc_id: r.score for r in nb.score_documents(small, model).collect()}
    rows = small.select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for r in rows:
        assert abs(got[r.doc_id] - plain_score(model, *nb.terms(r.text))) < 1e-4


def test_held_out_rows_of_every_language(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = (nb.query(docs, labels).where("held_out").join(labels, "doc_id").join(docs.select("doc_id", "lang"), "doc_id")
            .groupBy("lang", "quality").agg(F.avg("predicted").alias("p"), F.count("*").alias("n")).collect())
    assert sum(r.n for r in rows) > 500
    for r in rows:
        assert r.p >= 0.95 if r.quality == 1 else r.p <= 0.1, r


def test_fold_is_not_learned_from(spark, small, labels):
    flipped = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (sorted((r.doc_id, r.score) for r in nb.query(small, x).collect()) for x in (labels, flipped))
    assert a == b
    held = {r.doc_id: r.held_out for r in nb.query(small, labels).collect()}
    assert all(v == (zlib.crc32(str(k).encode()) % 5 == 0) for k, v in held.items())


def test_awkward_rows(spark, awkward, crowded, empty, labels):
    marked = spark.createDataFrame([(k, k % 2, 0) for k in range(1, 11)] + [(None, 1, 0), (5, None, 1), (6, 7, 1)], "doc_id long, quality int, toxic int")
    for docs in (awkward, crowded):
        rows = nb.query(docs, marked).collect()
        assert len(rows) == awkward.count()
        assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
        assert len({r.score for r in rows if r.doc_id in (5, 6)}) == 1
    assert nb.query(empty, marked).count() == 0
    none = nb.query(awkward, marked.where("false")).collect()
    assert {r.score for r in none} == {0.0}
    one = nb.query(awkward, marked.where("quality = 1")).collect()
    assert {r.score for r in one} == {1.0}
