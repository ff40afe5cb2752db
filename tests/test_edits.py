"""Edit algebra goldens (FIXTURES §3)."""

import pytest
from pyspark.sql import functions as F

from redline.operators.edits import (
    apply_edits,
    edit_confusion_counts,
    edit_pr,
    m2_to_pairs,
    span_edit,
    split_m2_blocks,
)
from redline.operators.metrics import f_beta

EDIT = "struct<o_start:int,o_end:int,c_str:string,type:string>"


def test_apply_edits_reference_mode(spark):
    df = spark.createDataFrame([("a b c d e",)], "s string")
    edits = F.array(*[F.struct(F.lit(s).alias("o_start"), F.lit(e).alias("o_end"), F.lit(c).alias("c_str"),
                               F.lit(i).alias("ord")) for i, (s, e, c) in enumerate([(2, 2, "x"), (2, 3, "y"),
                                                                                      (4, 5, "-NONE-")])])
    assert df.select(apply_edits("s", edits).alias("t")).first().t == "a b y c d"


def test_m2_blocks_and_pairs(spark):
    text = ("S a b c d e\nA 2 2|||M|||x|||REQUIRED|||-NONE-|||0\nA 2 3|||R|||y|||REQUIRED|||-NONE-|||0\n"
            "A 4 5|||U|||-NONE-|||REQUIRED|||-NONE-|||0\n\nS f g\nA -1 -1|||noop|||-NONE-|||REQUIRED|||-NONE-|||0\n\n\n"
            "S h i j\nA 0 1|||R|||p q|||REQUIRED|||-NONE-|||0\nS k\n")
    blocks = spark.createDataFrame([(text,)], "t string").select(F.explode(split_m2_blocks("t")).alias("block"))
    out = [(r.input_text, r.target_text) for r in m2_to_pairs(blocks, "block").collect()]
    assert out == [("a b c d e", "a b y c d"), ("f g", "f g"), ("h i j", "p q i j"), ("k", "k")]


def test_span_edit(spark):
    df = spark.createDataFrame([("a b c", "a x c"), ("a b", "a b"), ("a b", "a b c"), ("a b c", "a c")],
                               "s string, t string")
    r = df.select(span_edit(F.split("s", " "), F.split("t", " ")).alias("e")).collect()
    assert tuple(r[0].e) == (1, 2, "x", "R") and r[1].e is None
    assert tuple(r[2].e) == (2, 2, "c", "M") and tuple(r[3].e) == (1, 2, "", "U")


def _edits(lst):
    return F.array(*[F.struct(F.lit(s).alias("o_start"), F.lit(e).alias("o_end"), F.lit(c).alias("c_str"),
                              F.lit(t).alias("type")) for s, e, c, t in lst]) if lst else F.array().cast(f"array<{EDIT}>")


def test_micro_and_macro_goldens(spark):
    hyp = [[(1, 2, "goes", "R:VERB:SVA"), (4, 5, "each", "R:DET")], [], [(0, 1, "x", "R")], []]
    ref = [[(1, 2, "goes", "R:VERB:SVA")], [], [], [(2, 2, "the", "M:DET")]]
    df = spark.range(1).select(*[F.struct(_edits(h).alias("h"), _edits(r).alias("r")).alias(f"s{i}")
                                 for i, (h, r) in enumerate(zip(hyp, ref))])
    rows = df.select(F.explode(F.array(*[F.col(f"s{i}") for i in range(4)])).alias("x")).select("x.h", "x.r")
    tp, fp, fn = edit_confusion_counts("h", "r")
    p, r = edit_pr("h", "r")
    agg = rows.agg(F.sum(tp).alias("tp"), F.sum(fp).alias("fp"), F.sum(fn).alias("fn"),
                   (F.avg(p) * 100).alias("mp"), (F.avg(r) * 100).alias("mr")).first()
    assert (agg.tp, agg.fp, agg.fn) == (1, 2, 1)
    assert agg.mp == pytest.approx(37.5) and agg.mr == pytest.approx(50.0)
    f = spark.range(1).select(f_beta(F.lit(agg.mp), F.lit(agg.mr)).alias("f")).first().f
    assert f == pytest.approx(39.473684, abs=1e-5)
    fm = spark.range(1).select((f_beta(F.lit(1 / 3), F.lit(0.5)) * 100).alias("f")).first().f
    assert fm == pytest.approx(35.714286, abs=1e-5)


def _placed(spark, cases):
    """{(para, start, end): placed row} of spans in paragraphs."""
    from redline.operators.essays import place_edits
    paras = sorted({p for p, _, _ in cases})
    df = spark.createDataFrame([(0, paras.index(p), 0, k, s, e) for k, (p, s, e) in enumerate(cases)], "essay_id int, para_no int, coder int, ord int, start int, end int")
    text = spark.createDataFrame([(0, k, p) for k, p in enumerate(paras)], "essay_id int, para_no int, para string")
    return {cases[r.ord]: r for r in place_edits(df, text).collect()}


def test_clean_paragraph_offsets(spark):
    from redline.operators.essays import clean_text
    got = _placed(spark, [("a   b c", k, k) for k in range(8)] + [(" x  y", 3, 5)])
    assert [got["a   b c", k, k].start for k in range(8)] == [0, 1, 1, 1, 2, 3, 4, 5]
    assert spark.sql("select 'a   b c' as p").select(clean_text("p")).first()[0] == "a b c"
    r = got[" x  y", 3, 5]
    assert (r.start, r.end) == (2, 3)  # loop: (2,4) -> lstrip (1,3) -> edge blank (2,3)


def test_sentence_assignment_rules(spark):
    from redline.operators.edits import assign_to_sentences, sentence_spans
    toks = spark.createDataFrame([(1, "A b . C d .".split())], "id int, t array<string>")
    sents = toks.select("id", F.explode(sentence_spans("t")).alias("s")).select("id", "s.*")
    assert [(r.s_start, r.s_end, r.is_last) for r in sents.orderBy("sent_no").collect()] == [(0, 3, False), (3, 6, True)]
    edits = spark.createDataFrame([(1, 1, 2, "B"), (1, 3, 3, "!"), (1, 3, 3, "z"), (1, 2, 4, "q"), (1, 6, 6, "w")],
                                  "id int, o_start int, o_end int, c_str string")
    got = sorted((r.c_str, r.sent_no, r.o_start, r.o_end) for r in
                 assign_to_sentences(edits, sents, ["id"]).collect())
    assert got == [("!", 0, 3, 3), ("B", 0, 1, 2), ("w", 1, 3, 3), ("z", 1, 0, 0)]


def test_blank_lines_are_one_empty_sentence(spark, tmpdir_path):
    """A line without words is a sentence of no tokens: insertions at its end belong to it."""
    import duckdb
    from redline.plans import ORACLE, QUERIES
    rows = [(1, "A b the c. D e\n\nx y"), (2, ""), (3, " \t "), (4, None)]
    spark.createDataFrame([(k, t, "en", "a") for k, t in rows], "doc_id long, text string, lang string, source string").coalesce(1).write.parquet(f"{tmpdir_path}/documents.parquet")
    got = sorted(tuple(r) for r in QUERIES["sentence_assign"](spark, tmpdir_path).collect())
    assert [r for r in got if r[:2] in ((1, 1), (2, 0), (3, 0))] == [(*k, 0, 0, 0, c) for k in ((1, 1), (2, 0), (3, 0)) for c in (".", "x")]
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmpdir_path}/documents.parquet/*.parquet'")
    assert got == sorted(db.sql(ORACLE["sentence_assign"]).fetchall())


def _brute_distance(a, b):
    from functools import lru_cache

    @lru_cache(None)
    def d(i, j):
        if i == 0 or j == 0:
            return i + j
        return min(d(i - 1, j - 1) + (a[i - 1] != b[j - 1]), d(i - 1, j) + 1, d(i, j - 1) + 1)
    return d(len(a), len(b))


def test_levenshtein_edits(spark):
    import random

    from redline.operators.levenshtein import align_ops, levenshtein_edits
    rnd = random.Random(7)
    for _ in range(200):
        a = [rnd.choice("abc") for _ in range(rnd.randint(0, 6))]
        b = [rnd.choice("abc") for _ in range(rnd.randint(0, 6))]
        ops = align_ops(a, b)
        assert sum(op != "M" for op, _, _ in ops) == _brute_distance(tuple(a), tuple(b))
    df = spark.createDataFrame([("a b c d".split(), "a x c d".split()), ("a b c".split(), "a b c".split()),
                                ("a b c d e".split(), "a e".split()), ("a b".split(), "a b c d".split()),
                                ("a b c d".split(), "x b y d".split())], "s array<string>, t array<string>")
    split = [[tuple(e) for e in r.e] for r in df.select(levenshtein_edits("s", "t", "all-split").alias("e")).collect()]
    merged = [[tuple(e) for e in r.e] for r in df.select(levenshtein_edits("s", "t", "all-merge").alias("e")).collect()]
    assert split[0] == [(1, 2, "x", "R")] and split[1] == []
    assert merged[2] == [(1, 4, "", "U")] and merged[3] == [(2, 2, "c d", "M")]
    assert split[4] == [(0, 1, "x", "R"), (2, 3, "y", "R")]


def test_char_to_token_span_rules(spark):
    cases = [((2, 5), (1, 2, None, None)), ((3, 5), (1, 2, 2, 5)), ((2, 2), (1, 1, None, None)),
             ((5, 5), (2, 2, None, None)), ((0, 0), (0, 0, None, None)), ((11, 11), (4, 4, None, None)),
             ((3, 3), (1, 2, 2, 5)), ((6, 10), (2, 4, 6, 11)), ((9, 12), (3, 4, 8, 11))]
    got = _placed(spark, [("I has a dog ", s, e) for (s, e), _ in cases])
    for (s, e), want in cases:
        r = got["I has a dog ", s, e]
        assert (r.t_start, r.t_end, r.c_start, r.c_end) == (want if (s, e) != (9, 12) else (3, 4, 8, 11)), (s, e)


def _plain_place(para, start, end):
    """C-05 and J-06 by steps: blanks removed one at a time, spans looked up in lists."""
    import re
    from bisect import bisect_left, bisect_right
    text, a, b = re.sub(r"\s", " ", para), start, end
    k = 0
    while k < len(text) - 1:
        if text[k] == text[k + 1] == " ":
            text = text[:k + 1] + text[k + 2:]
            a, b = (x - (x > k) for x in (a, b))
        else:
            k += 1
    if text.startswith(" "):
        text, a, b = text[1:], max(a - 1, 0), max(b - 1, 0)
    if a != b:
        a += text[a:a + 1] == " "
        b -= b > 0 and text[b - 1:b] == " "
    starts = [m.start() for m in re.finditer(r"[^ ]+", text)]
    ends = [m.end() for m in re.finditer(r"[^ ]+", text)]
    n = len(starts)
    if not n:
        return a, b, None, None, None, None
    if a == b:
        if a <= starts[0]:
            return a, b, 0, 0, None, None
        if a >= ends[-1]:
            return a, b, n, n, None, None
        if a in starts:
            return a, b, starts.index(a), starts.index(a), None, None
        if a in ends:
            return a, b, ends.index(a) + 1, ends.index(a) + 1, None, None
    first = starts.index(a) if a in starts else bisect_right(starts, a) - 1
    last = ends.index(b) if b in ends else min(bisect_left(ends, b), n - 1)
    exact = a != b and a in starts and b in ends
    return a, b, first, last + 1, None if exact else starts[first], None if exact else ends[last]


def test_placing_equals_plain_steps(spark):
    """Every span of short paragraphs, blanks of any kind in any place."""
    import itertools
    paras = ["".join(p) for n in range(1, 7) for p in itertools.product("a ", repeat=n)][::3] + ["ab  cd e", " a\t b", "  ", "abc"]
    cases = [(p, s, e) for p in sorted(set(paras)) for s in range(len(p) + 1) for e in range(s, len(p) + 1)]
    for (p, s, e), r in _placed(spark, cases).items():
        assert (r.start, r.end, r.t_start, r.t_end, r.c_start, r.c_end) == _plain_place(p, s, e), (p, s, e)


def test_placing_plan_has_one_exchange_and_no_python(spark):
    from redline.operators.essays import place_edits
    df = spark.range(10).selectExpr("id as essay_id", "0 as para_no", "0 as coder", "0 as ord", "1 as start", "2 as end")
    plan = place_edits(df, df.selectExpr("essay_id", "para_no", "'a b' as para"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Python" not in plan and "Arrow" not in plan


def test_align_splits_long_pairs(monkeypatch):
    """Halved alignments cost as little as whole ones, and lead from source to target."""
    import random

    from redline.operators import levenshtein as L
    random.seed(8)
    for _ in range(60):
        a, b = ([random.choice("abcd") for _ in range(random.randint(0, 14))] for _ in range(2))
        monkeypatch.setattr(L, "CELLS", 1 << 20)
        whole = L.align_ops(a, b)
        monkeypatch.setattr(L, "CELLS", 8)
        halved = L.align_ops(a, b)
        for ops in (whole, halved):
            assert [b[j] for op, _, j in ops if op != "D"] == b and [a[i] for op, i, _ in ops if op != "I"] == a
        assert sum(op[0] != "M" for op in whole) == sum(op[0] != "M" for op in halved)


def test_diagonals_cost_as_little_as_the_matrix(monkeypatch):
    """The same distance as the whole matrix, and a path of matches and operations that leads from source to target."""
    import random

    import numpy as np

    from redline.operators import levenshtein as L
    random.seed(11)
    for far in (4096, 9):
        for _ in range(300):
            a, b = (np.array([random.randrange(random.choice((2, 5, 40))) for _ in range(random.randint(0, 40))], np.int64) for _ in range(2))
            whole = L._align(a, b)
            ops = L.diagonal_ops(a, b, far)
            cost = sum(op != "M" for op, _, _ in whole)
            assert (ops is None) == (cost > far)
            if ops is None:
                continue
            assert sum(op != "M" for op, _, _ in ops) == cost
            i = j = 0
            for op, x, y in ops:
                assert (x, y) == (i, j) and (op == "M") == (op not in "SDI") and (op != "M" or a[i] == b[j])
                i, j = i + (op != "I"), j + (op != "D")
            assert (i, j) == (len(a), len(b))
    monkeypatch.setattr(L, "CELLS", 8)
    monkeypatch.setattr(L, "FAR", 2)
    for _ in range(60):
        a, b = ([random.choice("abcd") for _ in range(random.randint(0, 14))] for _ in range(2))
        assert sum(op != "M" for op, _, _ in L.align_ops(a, b)) == _brute_distance(tuple(a), tuple(b))


def test_long_middles_with_few_edits_are_quick():
    import random
    import time

    from redline.operators.levenshtein import align_ops
    random.seed(5)
    a = [f"w{random.randrange(5000)}" for _ in range(100_000)]
    b = list(a)
    for _ in range(17):
        at = random.randrange(len(b))
        b[at] = "changed"
        del b[random.randrange(len(b))]
        b.insert(random.randrange(len(b)), "new")
    start = time.process_time()
    ops = align_ops(a, b)
    assert time.process_time() - start < 1
    assert 40 <= sum(op != "M" for op, _, _ in ops) <= 51
    assert [b[j] for op, _, j in ops if op != "D"] == b


def test_running_starts(spark):
    from redline.functions.offsets import running_starts
    df = spark.createDataFrame([([3, 1, 2],), ([],), (None,), ([5],)], "s array<int>")
    assert [r.x for r in df.select(running_starts("s").alias("x")).collect()] == [[0, 3, 4], [], None, [0]]


def test_aligned_edits_are_those_of_the_alignment(spark):
    """Random pairs over few words, against the helper on whole pairs; a moved word is one deletion and one insertion."""
    import random

    from redline.operators.edits import aligned_edits
    from redline.operators.levenshtein import levenshtein_edits
    random.seed(11)
    pairs = [("a b c d".split(), "b c d a".split()), (["a"], ["a"]), ([], ["x"]), (["x"], []), ([], [])]
    for _ in range(600):
        a = random.choices("abcde"[:random.randint(1, 5)], k=random.randint(0, 8))
        b = list(a)
        for _ in range(random.randint(0, 4)):
            at = random.randrange(len(b) + 1)
            b[at:at + random.randint(0, 1)] = random.choices("abcdef", k=random.randint(0, 2))
        pairs.append((a, b))
    rows = spark.createDataFrame(pairs + [(None, ["a"])], "a array<string>, b array<string>").select(
        "a", "b", aligned_edits("a", "b").alias("got"), levenshtein_edits("a", "b").alias("want")).collect()
    for r in rows:
        assert r.got == (r.want or []), (r.a, r.b)
    moved = next(r for r in rows if r.a == list("abcd"))
    assert [(e.o_start, e.o_end, e.c_str, e.type) for e in moved.got] == [(0, 1, "", "U"), (4, 4, "a", "M")]


def test_grammar_record_takes_what_is_made(spark):
    """The parts of source and target that are made before the models multiply the lines give
    the record that each row's own give; the reference edits are made below that step."""
    from redline.operators.metrics import grammar_parts, grammar_record
    lines = [("a b the c d", "a b a c d"), ("x y", "x y"), ("p q r s", "q r s p"), ("", ""), ("The the a", "The a"), ("a a b", "b a a b")]
    preds = ["a b the c d", "a b a c d", "x y z", "", "q r s p", None]
    d = spark.createDataFrame(lines, "line string, target_text string")
    made = d
    for n, c in grammar_parts().items():
        made = made.withColumn(n, c)
    each = F.explode(F.array(*[F.lit(p) for p in preds])).alias("prediction")
    plain = d.select(F.col("line").alias("input_text"), "target_text", each)
    ready = made.select(F.col("line").alias("input_text"), *[c for c in made.columns if c != "line"], each)
    got, want = grammar_record(ready, ["prediction"]), grammar_record(plain, ["prediction"])
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    above, below = got._jdf.queryExecution().optimizedPlan().toString().split("Generate explode(", 1)
    assert "_pair__re" in below and "_pair__re" not in want._jdf.queryExecution().optimizedPlan().toString().split("Generate explode(", 1)[1]
