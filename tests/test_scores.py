"""Golden vectors (FIXTURES §3) and property checks against plain-Python
models of the formulas, written independently of the Spark code."""

from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from redline.functions.readability import flesch_kincaid_grade, flesch_reading_ease
from redline.functions.text import token_budget, truncate_overlong
from redline.functions.tokens import tokens
from redline.operators.scores import gleu, sari_f1, sari_recall, score_triples

GOLD = [
    ("He go to school every day .", "He goes to school each day .", "He goes to school every day .",
     13 / 22, 94.444444, 67.307692),
    ("a b c", "a b c", "a b c", 1.0, 100.0, 33.333333),
    ("the big red dog ran", "a dog ran fast", "the dog ran quickly", 0.3, 55.555556, 52.380952),
    ("a b", "", "a", 0.0, 66.666667, 33.333333),
]


def py_gleu(h, r):
    def grams(t):
        return Counter(tuple(t[i:i + n]) for n in range(1, 5) for i in range(len(t) - n + 1))
    gh, gr = grams(h), grams(r)
    n_all = max(sum(gh.values()), sum(gr.values()))
    return sum((gh & gr).values()) / n_all if n_all else 0.0


def py_sari_v1(s, p, r):
    s, p, r = set(s), set(p), set(r)
    def comp(hit, ref):
        return len(hit & ref) / len(ref) if ref else 1.0
    return (comp(p & s, r & s) + comp(p - s, r - s) + comp(s - p, s - r)) / 3 * 100


def _rows(spark, data):
    return spark.createDataFrame(data, "s string, p string, r string")


def test_golden_scores(spark):
    df = _rows(spark, [g[:3] for g in GOLD])
    out = df.select(gleu(tokens("p"), tokens("r")).alias("g"),
                    sari_recall(tokens("s"), tokens("p"), tokens("r")).alias("v1"),
                    sari_f1(tokens("s"), tokens("p"), F.array(tokens("r"))).alias("v3")).collect()
    for row, g in zip(out, GOLD):
        assert row.g == pytest.approx(g[3], abs=1e-6)
        assert row.v1 == pytest.approx(g[4], abs=1e-5)
        assert row.v3 == pytest.approx(g[5], abs=1e-5)


def test_multi_reference_v3(spark):
    df = _rows(spark, [("the big red dog ran", "a dog ran fast", "the dog ran quickly")])
    v = df.select(sari_f1(tokens("s"), tokens("p"), F.array(tokens("r"), tokens(F.lit("a dog ran"))))
                  .alias("v")).first().v
    assert v == pytest.approx(66.666667, abs=1e-5)


words_st = st.lists(st.sampled_from(["a", "b", "c", "the", "dog", ".", "ran"]), min_size=0, max_size=12)


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(words_st, words_st, words_st), min_size=1, max_size=8))
def test_property_matches_python_model(spark, triples):
    data = [(" ".join(s), " ".join(p), " ".join(r)) for s, p, r in triples]
    out = _rows(spark, data).select(gleu(tokens("p"), tokens("r")).alias("g"),
                                    sari_recall(tokens("s"), tokens("p"), tokens("r")).alias("v1")).collect()
    for (s, p, r), row in zip(triples, out):
        assert row.g == pytest.approx(py_gleu(p, r), abs=1e-9)
        assert row.v1 == pytest.approx(py_sari_v1(s, p, r), abs=1e-9)
        assert 0.0 <= row.g <= 1.0


def test_identity_triple(spark):
    out = _rows(spark, [("x y z .", "x y z .", "x y z .")]).select(
        gleu(tokens("p"), tokens("r")).alias("g"), sari_recall(tokens("s"), tokens("p"), tokens("r")).alias("v1")).first()
    assert out.g == 1.0 and out.v1 == 100.0


@pytest.mark.parametrize("policy,score,status,mean", [
    ("zero", 0.0, "null_input", 50.0), ("skip", None, "null_input", 100.0)])
def test_null_policies(spark, policy, score, status, mean):
    df = spark.createDataFrame([("a b c", None, "a b c"), ("a b c", "a b c", "a b c")],
                               "input_text string, prediction string, target_text string")
    s = score_triples(df, metrics=("sari_recall",), null_policy=policy)
    rows = s.orderBy(F.col("prediction").isNotNull()).collect()
    assert rows[0].sari_recall == score and rows[0].status == status
    assert s.agg(F.avg("sari_recall")).first()[0] == pytest.approx(mean)


def test_literal_nan_and_fail(spark):
    df = spark.createDataFrame([("a b c", None, "a b c")], "input_text string, prediction string, target_text string")
    r = score_triples(df, metrics=("sari_recall",), null_policy="literal_nan").first()
    assert r.status == "ok" and r.prediction == "nan"
    with pytest.raises(Exception):
        score_triples(df, metrics=("sari_recall",), null_policy="fail").collect()


def test_blank_prediction_rule(spark):
    df = spark.createDataFrame([("a b", "  ", "a")], "input_text string, prediction string, target_text string")
    r = score_triples(df, metrics=("gleu", "sari_f1"), blank_zero=True).first()
    assert r.status == "blank" and r.gleu == 0.0 and r.sari_f1 == 0.0


def test_flesch_golden(spark):
    r = spark.createDataFrame([("The cat sat on the mat. It was happy.",), ("",)], "t string").select(
        flesch_reading_ease("t").alias("fre"), flesch_kincaid_grade("t").alias("fk")).collect()
    assert r[0].fre == pytest.approx(108.2675, abs=1e-6)
    assert r[0].fk == pytest.approx(-0.723889, abs=1e-6)
    assert r[1].fre == 0.0 and r[1].fk == 0.0


def test_truncate_and_budget(spark):
    df = spark.createDataFrame([("One two three. Four five six seven", "a b c"), ("One two", "a b c"),
                                ("one two three four five six", "a b c")], "p string, s string")
    assert [r.x for r in df.select(truncate_overlong("p", "s").alias("x")).collect()] == [
        "One two three.", "One two", "one two three four five six."]
    n = spark.createDataFrame([(" ".join(["w"] * k),) for k in (0, 1, 10, 57, 58, 100)], "t string")
    assert [r.b for r in n.select(token_budget("t").alias("b")).collect()] == [0, 1, 10, 59, 60, 60]


def test_shared_readability_parts(spark, tmpdir_path):
    """Parts of equal texts are shared, those of others made, NULL texts kept NULL; each of
    the queries' target texts is counted once, before the models multiply the lines."""
    from redline.functions.readability import readability_parts, shared_parts
    from redline.plans import QUERIES
    rows = [("A b. C!", "A b. C!", "x"), ("rhythm", "one", "one"), (None, "one", "two"), ("eau", None, "a"), ("", "", ""), ("oh", None, None)]
    d = spark.createDataFrame(rows, "p string, s string, t string").select("*", readability_parts("s").alias("sp"), readability_parts("t").alias("tp"))
    got = d.select(shared_parts("p", {"s": "sp", "t": "tp"}).alias("got"), readability_parts("p").alias("want"))
    assert all(tuple(r.got) == tuple(r.want) for r in got.collect())
    spark.createDataFrame([(1, "a b", "en", "x")], "doc_id long, text string, lang string, source string").write.parquet(f"{tmpdir_path}/documents.parquet")
    plan = QUERIES["flesch_corpus"](spark, tmpdir_path)._jdf.queryExecution().optimizedPlan().toString()
    above, below = plan.split("Generate inline(", 1)
    assert above.count("[aeiouy") == 1 and below.count("[aeiouy") == 2


def test_one_reference_is_counted_not_collected(spark):
    """SARI of one reference from the sizes of what the sides share equals that from the sets,
    bit by bit, and a prediction that is its source takes the GLEU made for it, if there is one."""
    import random
    from redline.functions.tokens import ngram_overlap
    from redline.operators.scores import sari_f1, sari_f1_single, score_triples
    rng = random.Random(5)
    some = lambda: [rng.choice("abcde") for _ in range(rng.randint(0, 7))]
    rows = [(some(), some(), some()) for _ in range(300)]
    rows += [(s, s, r) for s, _, r in rows[:100]] + [(s, r, r) for s, _, r in rows[:100]] + [(s, s, s) for s, _, _ in rows[:50]] + [(None, ["a"], ["a"]), (["a"], None, ["a"])]
    d = spark.createDataFrame(rows, "s array<string>, p array<string>, r array<string>")
    got = d.select(sari_f1_single("s", "p", "r").alias("got"), sari_f1("s", "p", F.array("r")).alias("want")).collect()
    assert len(got) == 552 and all(r.got == r.want for r in got[:-2]) and all(r.got is None for r in got[-2:])
    t = spark.createDataFrame([("a b", "a b", "a c", 0.25), ("a b", "b", "a c", 0.25), ("a b", "a b", "a c", None)],
                              "input_text string, prediction string, target_text string, input_text__gleu double")
    scored = score_triples(t, metrics=("gleu",))
    assert [r.gleu for r in scored.collect()] == [0.25, 0.0, 1 / 3] and "input_text__gleu" not in scored.columns
    plan = d.select(ngram_overlap(F.col("s"), F.col("p")).alias("n"))._jdf.queryExecution().optimizedPlan().toString()
    assert "xxhash64(slice(" not in plan  # it copies the whole array for each gram
