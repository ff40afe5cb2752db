"""Steps that were rewritten to grow with the input: their results against plain counts, and what must not come back."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from redline.functions.readability import syllable_count
from redline.functions.tokens import tokens
from redline.operators import levenshtein as L
from redline.operators.edits import aligned_edits, with_aligned_edits
from redline.operators.scores import gleu, score_triples
from redline.session import shared_path
from redline.sinks import write_triples
from redline.sources.quoted import read_runs


def _matrix(a, b):
    ids = {}
    return L._align(np.array([ids.setdefault(x, len(ids)) for x in a], np.int64), np.array([ids.setdefault(x, len(ids)) for x in b], np.int64))


def test_few_operations_give_the_alignment_of_the_matrix():
    rnd, found = random.Random(3), 0
    for _ in range(600):
        a = [rnd.randrange(4) for _ in range(rnd.randrange(30))]
        b = list(a)
        for _ in range(rnd.randrange(5)):
            at = rnd.randrange(len(b) + 1)
            b[at:at + rnd.randrange(2)] = [rnd.randrange(4)] * rnd.randrange(2)
        ops = L.near_ops(a, b)
        if ops is not None:
            found += 1
            assert ops == _matrix(a, b)
    assert found > 400


def test_rows_without_alignment_reach_the_helper_empty(spark):
    """NULL arrays make Spark's Arrow writer go over the whole batch for each row."""
    rows = spark.createDataFrame([(["a", "b"], ["a", "b"]), (["a", "b"], ["a", "c"]), (["a"], ["b", "a"])], "s array<string>, t array<string>")
    got = rows.select(aligned_edits("s", "t").alias("e"))
    helper = got._jdf.queryExecution().optimizedPlan().toString()
    assert "coalesce(CASE WHEN" in helper.split("ArrowEvalPython")[1]
    assert [[tuple(x) for x in r.e] for r in got.collect()] == [[], [(1, 2, "c", "R")], [(0, 0, "b", "M")]]


def test_rows_that_wait_for_the_aligner_hold_no_tokens(spark):
    """Spark keeps the rows of a Python helper in a queue that goes to disk: their token arrays must not be in it."""
    rnd = random.Random(11)
    rows = [(k, [rnd.choice("abc") for _ in range(rnd.randrange(9))], [rnd.choice("abc") for _ in range(rnd.randrange(9))]) for k in range(300)]
    rows = spark.createDataFrame([*rows, (300, None, ["a"]), (301, ["a"], None)], "k long, s array<string>, t array<string>").select("k", "s", F.array_distinct("t").alias("t"))
    got = with_aligned_edits(rows, {"e": ("s", "t")}, ["k"])
    waiting = got._jdf.queryExecution().optimizedPlan().toString().split("ArrowEvalPython")[1].splitlines()[1]
    assert "k#" in waiting.split("CASE")[0] and not {" s#", " t#"} & {x.split("#")[0] + "#" for x in waiting[waiting.index("["):].split(",")}
    assert sorted(got.collect()) == sorted(rows.select("k", aligned_edits("s", "t").alias("e")).collect())


def _gleu(h, r):
    grams = lambda t: Counter(tuple(t[i:i + n]) for n in range(1, 5) for i in range(len(t) - n + 1))
    a, b = grams(h), grams(r)
    total = max(sum(a.values()), sum(b.values()))
    return sum((a & b).values()) / total if total else 0.0


def test_gleu_counts_as_all_ngrams_do(spark):
    rnd, pairs = random.Random(5), []
    for k in range(200):
        h = [rnd.choice("abc") for _ in range(rnd.randrange(12))]
        r = list(h) if k % 3 else [rnd.choice("abc") for _ in range(rnd.randrange(12))]
        for _ in range(rnd.randrange(4)):
            at = rnd.randrange(len(r) + 1)
            r[at:at + rnd.randrange(2)] = [rnd.choice("abc")] * rnd.randrange(2)
        pairs.append((k, h, r))
    got = spark.createDataFrame(pairs, "k int, h array<string>, r array<string>").select("k", gleu("h", "r").alias("g")).collect()
    want = {k: _gleu(h, r) for k, h, r in pairs}
    assert all(abs(x.g - want[x.k]) < 1e-12 for x in got)


def test_given_tokens_are_used_unless_null_is_a_word(spark):
    d = spark.createDataFrame([("a b", "a", None)], "input_text string, prediction string, target_text string")
    given = d.withColumn("input_text__tok", tokens("input_text")).withColumn("target_text__tok", tokens("target_text"))
    for policy in ("zero", "literal_nan"):
        one, two = (score_triples(x, metrics=("gleu", "sari_recall"), null_policy=policy).first() for x in (d, given))
        assert one == two
    marked = d.withColumn("target_text", F.lit("z")).withColumn("target_text__tok", F.array(F.lit("a")))
    assert score_triples(marked, metrics=("gleu",)).first().gleu == 1.0


def test_syllables_word_by_word(spark):
    texts = ["", "brr", "brr a", "aeon bc de", "  x\ty\nqueue ", "ÉCOLE rhythm!", "b-a-b c'd"]
    vowels = set("aeiouyàâäéèêëîïôöùûü")

    def count(text):
        out = 0
        for w in text.lower().split():
            groups = sum(c in vowels and (i == 0 or w[i - 1] not in vowels) for i, c in enumerate(w))
            out += max(groups, 1)
        return out
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", syllable_count("t").alias("n")).collect()
    assert {r.t: r.n for r in got} == {t: count(t) for t in texts}
    assert spark.range(1).select(syllable_count(F.lit(None).cast("string")).alias("n")).first().n is None


def test_runs_saved_gzipped_are_read_whole(spark):
    root = shared_path(spark, "gz-runs")
    rows = [(f"i{k}\n\"q\", x", f"t{k}", f"p{k}") for k in range(50)]
    d = spark.createDataFrame(rows, "input_text string, target_text string, prediction string").repartition(3)
    write_triples(d, f"{root}/grammar_x.csv", (), fmt="csv", compression="gzip")
    assert all(f.endswith(".csv.gz") for f in d.sparkSession.read.text(f"{root}/*").inputFiles())
    got, skipped = read_runs(spark, f"{root}/*")
    assert sorted((r.input_text, r.target_text, r.prediction) for r in got.collect()) == sorted(rows)
    assert skipped.count() == 0


def test_made_tokens_are_read_where_null_texts_count_as_nan(spark):
    """`literal_nan` takes the tokens that were made before; only a NULL text's are those of 'nan'."""
    d = spark.createDataFrame([("a b", "a b", "x"), (None, "nan", None)], "input_text string, prediction string, target_text string")
    made = d.withColumn("target_text__tok", F.when(F.col("target_text").isNotNull(), F.split(F.lit("a b"), " ")))
    assert [r.gleu for r in score_triples(made, metrics=("gleu",), null_policy="literal_nan").collect()] == [1.0, 1.0]


def test_gleu_of_a_shorter_text_that_differs_in_places(spark):
    """Arrays of two lengths: held place by place, by what prefix and suffix leave, or one the start of the other."""
    a = [f"w{i}" for i in range(40)]
    pairs = [(a, [*a[:3], "x", *a[4:30], "y", *a[31:-1]]), (a, ["x", *a]), (a, ["x", *a[:9], *a[10:], "y", "z"]), (a, a[:-1]), (a, [])]
    rows = spark.createDataFrame([(k, *p) for k, p in enumerate([*pairs, *[(r, h) for h, r in pairs]])], "k long, h array<string>, r array<string>")
    assert [round(x.g, 12) for x in rows.select("k", gleu("h", "r").alias("g")).orderBy("k").collect()] == [
        round(_gleu(h, r), 12) for h, r in [*pairs, *[(r, h) for h, r in pairs]]]


def test_tokens_become_rows_after_the_exchange(spark):
    """A paragraph goes through the exchange as the lengths of its tokens, not as a row of each."""
    from redline.operators.essays import place_edits

    edits = spark.createDataFrame([("e", 0, 1, 0, 2, 3)], "essay_id string, para_no int, coder int, ord int, start int, end int")
    placed = place_edits(edits, edits.selectExpr("essay_id", "para_no", "'a bc  d' as para"))
    plan = placed._jdf.queryExecution().executedPlan().toString()
    assert plan.index("posexplode") < plan.index("Exchange hashpartitioning(essay_id") and plan.count("Exchange hashpartitioning") == 1
    assert [(r.start, r.end, r.t_start, r.t_end, r.c_start, r.c_end) for r in placed.collect()] == [(2, 3, 1, 2, 2, 4)]


@pytest.mark.parametrize("sizes, exchanged", [((40,) * 8, False), ((320,), True), ((5, 5, 300, 5, 5), True), ((), True)])
def test_one_file_that_is_split_evenly_is_not_exchanged(spark, tmp_path, sizes, exchanged):
    """A scan whose row groups fall to all cores: the exchange that spreads a small table would put the whole input on disk."""
    from redline.plans.q_edits import edit_prf_micro

    rnd, n = random.Random(9), 320 if sizes else 0
    texts = ["\n".join(" ".join(rnd.choices(["the", "and", "or", "a", "cat"], k=12)) for _ in range(3)) for _ in range(n)]
    table = pa.table({"doc_id": pa.array(range(n), pa.int64()), "text": pa.array(texts, pa.string()), "lang": pa.array(["en"] * n, pa.string()), "source": pa.array([None] * n, pa.string())})
    with pq.ParquetWriter(f"{tmp_path}/documents.parquet", table.schema) as out:
        for k, rows in enumerate(sizes):
            out.write_table(table.slice(sum(sizes[:k]), rows))
    whole = spark.createDataFrame(table.to_pandas(), "doc_id long, text string, lang string, source string")
    whole.repartition(5).write.parquet(f"{tmp_path}/many/documents.parquet")  # more files than cores
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        got = edit_prf_micro(spark, str(tmp_path))
        assert ("RoundRobinPartitioning" in got._jdf.queryExecution().executedPlan().toString()) == exchanged
        assert sorted(got.collect()) == sorted(edit_prf_micro(spark, f"{tmp_path}/many").collect()) and got.count() == (4 if n else 0)
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
