import random
import re

import numpy as np
from pyspark.sql import functions as F

from redline.llm import rules


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    dup = sum(x in lines[:k] for k, x in enumerate(lines))
    grams = [tuple(words[k:k + 3]) for k in range(len(words) - 2)]
    marked = {k + j for k, g in enumerate(grams) if grams.count(g) > 1 for j in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(marked)


def test_counts():
    random.seed(5)
    texts = [None, "", " \n", "a", "a b c", "a a a a", "é|é\né|é\n\n \n"]
    texts += ["".join(random.choice("ab#\n  é") for _ in range(random.randint(0, 80))) for _ in range(300)]
    for t in texts:
        assert rules.text_stats(t)[:5] == plain(t), t


def test_learns_a_planted_list():
    rng = np.random.default_rng(1)
    x = {"a": rng.random(3000), "b": rng.random(3000), "c": rng.random(3000)}
    bad = (x["a"] > 0.8) | ((x["b"] < 0.2) & (x["c"] > 0.5))
    part = rng.random(3000) < 1 / 3
    found = rules.learn(x, bad, part)
    fired = np.zeros(3000, bool)
    for r in found:
        fired |= r.covers(x)
    assert 2 <= len(found) <= 8 and (fired == bad).mean() > 0.97
    assert rules.learn(x, np.zeros(3000, bool), part) == []


def test_expression_equals_the_list(small, labels):
    out, found = rules.judge(small, labels)
    rows = out.select("rule", *[rules.feature(n).alias("f_" + n) for n in rules.FEATURES]).toPandas()
    x = {n: rows["f_" + n].to_numpy(float) for n in rules.FEATURES}
    want = np.zeros(len(rows), int)
    for k, r in reversed(list(enumerate(found, 1))):
        want[r.covers(x)] = k
    assert (rows["rule"].to_numpy() == want).all()


def test_quality_on_labels(spark, medium):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    out = rules.query(medium, labels).join(labels.withColumnRenamed("doc_id", "of"), F.col("doc_id") == F.col("of")).where("not base_failed").toPandas()
    clean, poor = out[out.quality == 1], out[out.quality == 0]
    assert clean.kept.mean() > 0.99
    assert not len(poor) or poor.kept.mean() < 0.2


def test_awkward(spark, awkward, empty, crowded, labels):
    rows = rules.query(awkward, labels).collect()
    assert len(rows) == awkward.count()
    by = {r.doc_id: r for r in rows if r.doc_id}
    assert by[1].base_failed and not by[1].kept and by[2].n_words == 0 and by[7].n_words == 30_000 and by[7].base_failed
    assert rules.query(empty, labels).collect() == []
    none = spark.createDataFrame([], labels.schema)
    assert rules.query(awkward, none).where("rule <> 0").count() == 0
    out = rules.keep(crowded, none)
    assert out.columns == crowded.columns and out.count() == rules.query(awkward, none).where("kept").count()
