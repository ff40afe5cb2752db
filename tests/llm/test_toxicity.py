import pytest
from pyspark.sql import functions as F

from redline.llm import toxicity


def area(score, label):
    rank = score.rank()
    n, m = int((label == 1).sum()), int((label == 0).sum())
    return (rank[label == 1].sum() - n * (n + 1) / 2) / (n * m)


def test_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    marked = labels.selectExpr("doc_id as of", "toxic")
    own = docs.join(marked.select("of"), F.col("doc_id") == F.col("of"), "left_semi")
    rows = toxicity.query(own, labels).join(marked, F.col("doc_id") == F.col("of")).join(docs.selectExpr("doc_id as o", "lang"), F.col("of") == F.col("o")).where("held_out").toPandas()
    assert area(rows.score, rows.toxic) > 0.92
    assert rows[rows.toxic == 1].predicted.mean() > 0.7
    assert rows[rows.toxic == 0].predicted.mean() < 0.02
    for lang, least in (("en", 0.92), ("de", 0.92), ("fr", 0.92)):  # Spanish has six toxic rows held out
        own = rows[rows.lang == lang]
        assert area(own.score, own.toxic) > least
    assert rows.score.between(0, 1).all() and ((rows.score >= 0.5) == (rows.predicted == 1)).all()


def test_windows_cover_the_line():
    line = toxicity.normal("A  b\ncc " * 200)
    cut = toxicity.windows(line, 64)
    assert cut[0][:-1] + b"".join(w[:-1] for w in cut[1:]) + b" " == line
    assert toxicity.windows(toxicity.normal("")) in ([], [b"  "])


def test_dense_fragments():
    held, dense = toxicity.fragments(b" " + b"abcdefg " * 3 + b"xyzzy " + b"a " * 3000)
    assert {b"abcde", b"xyzzy"} <= held and not dense & {b"xyzzy"}
    assert toxicity.fragments(b" xyzzy ")[1] >= {b"xyzzy"}


def test_long_rows_are_sampled_from_the_whole():
    line = toxicity.normal(" ".join(f"w{k}" for k in range(40_000)))
    part = toxicity.sample_line(line.decode())
    words = part.split()
    assert len(part) <= toxicity.SAMPLE_BYTES and set(words) <= set(line.split())
    assert int(words[0][1:]) < 1000 and int(words[-1][1:]) > 36_000
    assert toxicity.sample_line("A  b") == b" a b "


def test_score_equals_a_plain_reckoning(spark, small, labels):
    """Each window's two lengths by fresh compressors, joined by the fitted weights."""
    import math
    import zstandard
    model = toxicity.fit(small, labels)
    if model.weights is None:
        pytest.skip("too few labels in the small table")

    def length(content, window):
        way = zstandard.ZstdCompressionParameters(strategy=zstandard.STRATEGY_FAST, target_length=1, min_match=toxicity.FRAGMENT, window_log=17,
                                                  hash_log=14, write_content_size=False, write_checksum=False, write_dict_id=False)
        data = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        return len(zstandard.ZstdCompressor(dict_data=data, compression_params=way).compress(window))
    for row in toxicity.query(small, labels).join(small.selectExpr("doc_id as of", "text"), F.col("doc_id") == F.col("of")).limit(25).collect():
        gain = [length(model.ordinary, w) - length(model.toxic, w) for w in toxicity.windows(toxicity.normal(row.text))] or [0]
        three, six = sum(g >= 3 for g in gain), sum(g >= 6 for g in gain)
        raw = [sum(gain) / len(gain), max(gain), three / len(gain), math.log1p(three), math.log1p(six), math.log1p(len(gain)), min(gain)]
        z = sum(w * (r - a) / b for w, r, a, b in zip(model.weights, raw, model.mean, model.scale)) + model.weights[-1]
        assert row.score == pytest.approx(1 / (1 + math.exp(-max(-30, min(30, z)))), abs=1e-9)


def test_trained_on_planted_words():
    import random
    random.seed(3)
    plain = ["".join(random.choice("abcdefgh") for _ in range(6)) for _ in range(400)]

    def text(bad):
        words = random.choices(plain, k=120)
        for _ in range(4 * bad):
            words[random.randrange(120)] = random.choice(["zzquux", "wwvorp", "yyblag"])
        return toxicity.normal(" ".join(words))
    model = toxicity.train([text(True) for _ in range(90)], [text(False) for _ in range(200)])
    score = model.scorer()
    got = [(score(text(b).decode()) >= 0.5) == b for b in [True, False] * 60]
    assert sum(got) / len(got) > 0.95


def test_awkward(spark, awkward, empty, crowded, labels, small):
    rows = toxicity.query(crowded, labels).collect()
    assert len(rows) == awkward.count() and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.query(empty, labels).collect() == []
    none = spark.createDataFrame([], labels.schema)
    assert {r.score for r in toxicity.query(awkward, none).collect()} == {0.0}
    model = toxicity.fit(small, labels)
    score = model.scorer()
    assert score(None) == score("") == pytest.approx(score(" \n"))
