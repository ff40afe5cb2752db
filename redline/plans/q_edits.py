"""Registered queries: token edits, edit scores, M2 formatting and parsing
(R-08..R-10, M-03, M-04, M-10 grammar, C-01, C-02, C-07, W-01, K-05, S-02, S-03, J-08)."""

from __future__ import annotations

from pyspark.sql import functions as F

from redline.functions import patterns as pt
from redline.functions.text import words
from redline.operators import metrics as M
from redline.operators.edits import (
    PUNCTUATION,
    assign_to_sentences,
    apply_edits,
    as_edit_array,
    corrected_sentence,
    corrected_spans,
    edit_confusion as edit_counts,
    edit_key_strings,
    edit_pr,
    m2_block,
    m2_to_pairs,
    sentence_spans,
    span_edit,
    with_aligned_edits,
)
from redline.plans import sql as S
from redline.plans.fixtures import EDIT_MODELS, rule_prediction, triples
from redline.plans.registry import register


def r6(c):
    return F.round(c, 6)


def edit_rows(spark, sf_dir, models=EDIT_MODELS):
    """The key, the input's words joined by blanks (src) and the aligned hypothesis (input ->
    prediction) and reference (input -> target) edits. What a line's models share is made
    before they multiply it; a prediction that is the input or the target has its tokens."""
    t = triples(spark, sf_dir, models=models, made={"a": words("line"), "t": words("target_text")})
    own = F.when(F.col("prediction") == F.col("input_text"), F.col("a")).when(F.col("prediction") == F.col("target_text"), F.col("t"))
    t = t.select("doc_id", "line_no", "model", "a", own.otherwise(words("prediction")).alias("p"), "t")
    return with_aligned_edits(t, {"hyp": ("a", "p"), "ref": ("a", "t")}, ["doc_id", "line_no", "model", F.array_join("a", " ").alias("src")])


def counted(e):
    """`e` with the columns tp, fp and fn of its edits, counted once a row."""
    return e.withColumn("n", edit_counts("hyp", "ref")).select("*", "n.tp", "n.fp", "n.fn")


_EDIT_SQL_BASE = f"""WITH {S.triples_cte(EDIT_MODELS)},
w AS (SELECT doc_id, line_no, model, {S.words('input_text')} AS a, {S.words('prediction')} AS p,
             {S.words('target_text')} AS t FROM triples),
e AS (SELECT doc_id, line_no, model, a, p, t, list_distinct({S.aligned_edit_keys('a', 'p')}) AS hyp,
             list_distinct({S.aligned_edit_keys('a', 't')}) AS ref,
             {S.aligned_edit_keys('a', 'p')} AS hyp_list FROM w),
c AS (SELECT doc_id, line_no, model, hyp, ref, hyp_list,
             len(list_filter(hyp, lambda k: list_contains(ref, k))) AS tp,
             len(list_filter(hyp, lambda k: NOT list_contains(ref, k))) AS fp,
             len(list_filter(ref, lambda k: NOT list_contains(hyp, k))) AS fn FROM e)"""


@register("span_edits", f"""WITH {S.triples_cte(EDIT_MODELS)},
w AS (SELECT doc_id, line_no, model, {S.words('input_text')} AS a, {S.words('prediction')} AS p FROM triples)
SELECT doc_id, line_no, model, ({S.span_edit_key('a', 'p')})[1] AS edit FROM w""")
def span_edits(spark, sf_dir):
    """R-08: the single trimmed span edit input -> prediction (NULL if equal)."""
    t = triples(spark, sf_dir, models=EDIT_MODELS).select(
        "doc_id", "line_no", "model", words("input_text").alias("a"), words("prediction").alias("p"))
    e = span_edit("a", "p")
    return t.select("doc_id", "line_no", "model",
                    F.when(e.isNull(), F.lit(None).cast("string"))
                    .otherwise(F.format_string("%d|%d|%s|%s", e["o_start"], e["o_end"], e["c_str"], e["type"]))
                    .alias("edit"))


@register("edit_confusion", _EDIT_SQL_BASE + """
SELECT doc_id, line_no, model, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn FROM c""")
def edit_confusion(spark, sf_dir):
    """R-09: per-sentence TP/FP/FN of hypothesis vs reference edit sets."""
    e = edit_rows(spark, sf_dir)
    return counted(e).select("doc_id", "line_no", "model", "tp", "fp", "fn")


def _moves_sql():
    """Edits by construction. Append: the places of target and input side by side, with one
    more for the added word. Move: the first word x of a line leaves its place and comes in
    at the end (after like words are trimmed), but two differing places are replaced, and
    words that alternate come in before and leave at the end."""
    def key(st, en, c, t):
        return f"({st})::VARCHAR || '|' || ({en})::VARCHAR || '|' || {c} || '|' || '{t}'"
    f = "list_transform(range(1, len(sl) + 1), lambda i: sl[i] IS DISTINCT FROM tl[i])"
    return f"""WITH {S.triples_cte(('identity',))},
w AS (SELECT doc_id, line_no, {S.words('input_text')} AS a, {S.words('target_text')} AS t FROM triples),
ins AS (SELECT doc_id, line_no, a, t, list_append(a, NULL) AS sl, list_append(t, 'also') AS tl FROM w),
fl AS (SELECT *, {f} AS f FROM ins),
se AS (SELECT *, list_filter(range(1, len(f) + 1), lambda i: f[i] AND (i = 1 OR NOT f[i - 1])) AS st,
              list_filter(range(1, len(f) + 1), lambda i: f[i] AND (i = len(f) OR NOT f[i + 1])) AS en FROM fl),
ie AS (SELECT doc_id, line_no, 'append' AS model, a, t, list_transform(range(1, len(st) + 1), lambda r:
         list_count(sl[1:st[r] - 1])::VARCHAR || '|' || list_count(sl[1:en[r]])::VARCHAR || '|' || array_to_string(tl[st[r]:en[r]], ' ') || '|'
         || (CASE WHEN list_count(sl[1:st[r] - 1]) = list_count(sl[1:en[r]]) THEN 'M' ELSE 'R' END)) AS hyp FROM se),
mv AS (SELECT doc_id, line_no, a, t, a[2:] || a[1:1] AS v FROM w),
md AS (SELECT *, list_filter(range(1, len(a) + 1), lambda i: a[i] <> v[i]) AS d FROM mv),
pe AS (SELECT *, d[1] AS p0, d[-1] AS e0 FROM md),
me AS (SELECT doc_id, line_no, 'move' AS model, a, t, CASE WHEN len(d) = 0 THEN []::VARCHAR[]
         WHEN len(d) = 2 AND e0 = p0 + 1 THEN [{key('p0 - 1', 'e0', "v[p0] || ' ' || v[e0]", 'R')}]
         WHEN len(d) = 2 THEN [{key('p0 - 1', 'p0', 'v[p0]', 'R')}, {key('e0 - 1', 'e0', 'v[e0]', 'R')}]
         WHEN len(list_filter(range(p0, e0 - 1), lambda i: a[i] <> a[i + 2])) = 0
           THEN [{key('p0 - 1', 'p0 - 1', 'v[p0]', 'M')}, {key('e0 - 1', 'e0', "''", 'U')}]
         ELSE [{key('p0 - 1', 'p0', "''", 'U')}, {key('e0', 'e0', 'a[1]', 'M')}] END AS hyp FROM pe),
e AS (SELECT *, {S.aligned_edit_keys('a', 't')} AS ref FROM (SELECT * FROM ie UNION ALL SELECT * FROM me))
SELECT doc_id, line_no, model, md5(array_to_string(hyp, ';')) AS edits_md5, CAST(len({S.linter('hyp', 'ref')}) AS BIGINT) AS tp,
  CAST(len({S.lminus('hyp', 'ref')}) AS BIGINT) AS fp, CAST(len({S.lminus('ref', 'hyp')}) AS BIGINT) AS fn FROM e"""


@register("edit_confusion_moves", _moves_sql())
def edit_confusion_moves(spark, sf_dir):
    """R-09 where words are added and moved: the target with a word more at its end, and
    the input with its first word last."""
    t = triples(spark, sf_dir, models=("identity",)).select(
        "doc_id", "line_no", words("input_text").alias("a"), words("target_text").alias("t"))
    put = F.concat("t", F.array(F.lit("also")))
    move = F.concat(F.slice("a", 2, F.size("a") + 1), F.slice("a", 1, 1))
    made = t.select("*", F.inline(F.array(*[F.struct(F.lit(m).alias("model"), p.alias("p")) for m, p in (("append", put), ("move", move))])))
    e = with_aligned_edits(made, {"hyp": ("a", "p"), "ref": ("a", "t")}, ["doc_id", "line_no", "model"])
    return counted(e).select("doc_id", "line_no", "model", F.md5(F.array_join(edit_key_strings("hyp"), ";")).alias("edits_md5"),
                             "tp", "fp", "fn")


def _micro_sql():
    p = "coalesce(sum(tp) / nullif(sum(tp) + sum(fp), 0), 0.0)"
    r = "coalesce(sum(tp) / nullif(sum(tp) + sum(fn), 0), 0.0)"
    f = f"(CASE WHEN {p} + {r} > 0 THEN 1.25 * {p} * {r} / (0.25 * {p} + {r}) ELSE 0.0 END)"
    return (f"CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn, "
            f"round({p} * 100, 6) AS m2_precision, round({r} * 100, 6) AS m2_recall, "
            f"round({f} * 100, 6) AS m2_f0_5")


@register("edit_prf_micro", _EDIT_SQL_BASE + f"\nSELECT model, {_micro_sql()} FROM c GROUP BY model")
def edit_prf_micro(spark, sf_dir):
    """M-03: corpus P/R/F0.5 from summed TP/FP/FN per model."""
    e = edit_rows(spark, sf_dir)
    a = counted(e).groupBy("model").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    prf = M.micro_prf(F.col("tp"), F.col("fp"), F.col("fn"))
    return a.select("model", "tp", "fp", "fn", *[r6(c).alias(n) for c, n in zip(
        prf, ["m2_precision", "m2_recall", "m2_f0_5"])])


def _macro_sql():
    nh, nr = "len(hyp_list)", "len(ref_l)"
    tp = "len(list_filter(hyp_list, lambda k: list_contains(ref_l, k)))"
    p = f"(CASE WHEN {nh} = 0 THEN (CASE WHEN {nr} = 0 THEN 1.0 ELSE 0.0 END) ELSE {tp} / {nh} END)"
    r = (f"(CASE WHEN {nh} = 0 THEN (CASE WHEN {nr} = 0 THEN 1.0 ELSE 0.0 END) "
         f"WHEN {nr} = 0 THEN 0.0 ELSE {tp} / {nr} END)")
    return p, r


_MP, _MR = _macro_sql()


@register("edit_prf_macro", _EDIT_SQL_BASE + f""",
pr AS (SELECT model, {_MP} AS p, {_MR} AS r FROM (SELECT model, hyp_list,
        {S.aligned_edit_keys('a', 't')} AS ref_l FROM e)),
av AS (SELECT model, avg(p) * 100 AS ap, avg(r) * 100 AS ar FROM pr GROUP BY model)
SELECT model, round(ap, 6) AS m2_precision, round(ar, 6) AS m2_recall,
       round(CASE WHEN ap + ar > 0 THEN 1.25 * ap * ar / (0.25 * ap + ar) ELSE 0.0 END, 6) AS m2_f0_5 FROM av""")
def edit_prf_macro(spark, sf_dir):
    """M-04 / R-10: mean per-sentence P and R (list membership), then F0.5 of the means."""
    e = edit_rows(spark, sf_dir)
    p, r = edit_pr("hyp", "ref")
    e = e.select("model", "hyp", "ref")
    a = e.groupBy("model").agg((F.avg(p) * 100).alias("ap"), (F.avg(r) * 100).alias("ar"))
    return a.select("model", *[r6(c).alias(n) for c, n in zip(
        M.macro_prf(F.col("ap"), F.col("ar")), ["m2_precision", "m2_recall", "m2_f0_5"])])


@register("grammar_record", _EDIT_SQL_BASE.replace(
    "w AS (SELECT doc_id, line_no, model,", "w AS (SELECT doc_id, line_no, model, input_text, prediction, target_text,")
    .replace("e AS (SELECT doc_id, line_no, model, a, p, t,", "e AS (SELECT doc_id, line_no, model, input_text, prediction, target_text, a, p, t,")
    .replace("c AS (SELECT doc_id, line_no, model, hyp,", "c AS (SELECT doc_id, line_no, model, input_text, prediction, target_text, hyp,")
    + ",\n" + S.gleu_rows_sql("src AS (SELECT * FROM triples)", ["doc_id", "line_no", "model"])
    + f"""
SELECT c.model, count(*) AS total_examples,
  count(*) FILTER (WHERE c.prediction = c.target_text) AS exact_matches,
  round(count(*) FILTER (WHERE c.prediction = c.target_text) * 100.0 / count(*), 6) AS exact_match_accuracy,
  round(coalesce(avg(g.gleu), 0.0) * 100, 6) AS gleu_score,
  {_micro_sql().replace('sum(tp)', 'sum(c.tp)').replace('sum(fp)', 'sum(c.fp)').replace('sum(fn)', 'sum(c.fn)')}
FROM c JOIN scored g USING (doc_id, line_no, model) GROUP BY c.model""")
def grammar_record(spark, sf_dir):
    """M-10 (grammar): exact match, GLEU x100 and micro edit P/R/F0.5 per model."""
    r = M.grammar_record(triples(spark, sf_dir, models=EDIT_MODELS, made=M.grammar_parts()), ["model"])
    return r.select("model", "total_examples", "exact_matches",
                    *[r6(c).alias(c) for c in ("exact_match_accuracy", "gleu_score", "m2_precision",
                                               "m2_recall", "m2_f0_5")], "_tp", "_fp", "_fn") \
        .withColumnRenamed("_tp", "tp").withColumnRenamed("_fp", "fp").withColumnRenamed("_fn", "fn")


@register("apply_edits_roundtrip", f"""WITH {S.triples_cte(('identity',))}
SELECT doc_id, line_no, array_to_string({S.words('target_text')}, ' ') AS applied FROM triples""")
def apply_edits_roundtrip(spark, sf_dir):
    """C-01: applying the reference edits (input -> target) to the input
    reproduces the (blank-normalised) target."""
    e = edit_rows(spark, sf_dir, models=("identity",))
    with_ord = F.transform("ref", lambda x, i: x.withField("ord", i))
    return e.select("doc_id", "line_no", apply_edits("src", with_ord).alias("applied"))


_M2_HYP = S.aligned_edit_keys("a", "p", S.m2_line_fmt(0))
_M2_REF = S.aligned_edit_keys("a", "t", S.m2_line_fmt(1))


@register("m2_format", f"""WITH {S.triples_cte(EDIT_MODELS)},
w AS (SELECT doc_id, line_no, model, {S.words('input_text')} AS a, {S.words('prediction')} AS p,
             {S.words('target_text')} AS t FROM triples),
l AS (SELECT doc_id, line_no, model, a, {_M2_HYP} AS h, {_M2_REF} AS r FROM w)
SELECT doc_id, line_no, model,
  'S ' || array_to_string(a, ' ') || chr(10)
  || (CASE WHEN len(h) = 0 THEN '{pt.M2_NOOP_PREFIX}0' ELSE array_to_string(h, chr(10)) END) || chr(10)
  || (CASE WHEN len(r) = 0 THEN '{pt.M2_NOOP_PREFIX}1' ELSE array_to_string(r, chr(10)) END) AS block
FROM l""")
def m2_format(spark, sf_dir):
    """K-05 / J-08: M2 block per sentence, coder 0 = hypothesis edits, coder 1 =
    reference edits, explicit noop for a coder without edits."""
    e = edit_rows(spark, sf_dir)
    coders = F.array(F.struct(F.lit(0).alias("coder"), F.col("hyp").alias("edits")),
                     F.struct(F.lit(1).alias("coder"), F.col("ref").alias("edits")))
    return e.select("doc_id", "line_no", "model", m2_block(F.array("src"), coders).alias("block"))


def _m2_single_sql():
    blk = (f"'S ' || array_to_string(a, ' ') || chr(10) || (CASE WHEN len(r) = 0 THEN '{pt.M2_NOOP_PREFIX}0' "
           f"ELSE r[1] END)")
    line2 = f"string_split({blk}, chr(10))[2]"
    st = f"TRY_CAST(regexp_extract({line2}, {S.q(pt.M2_EDIT_RE)}, 1) AS INTEGER)"
    en = f"TRY_CAST(regexp_extract({line2}, {S.q(pt.M2_EDIT_RE)}, 2) AS INTEGER)"
    rp = f"trim(regexp_extract({line2}, {S.q(pt.M2_EDIT_RE)}, 3))"
    rtoks = f"(CASE WHEN {rp} IN ('', '-NONE-') THEN []::VARCHAR[] ELSE {S.words(rp)} END)"
    applied = (f"(CASE WHEN {st} IS NULL THEN array_to_string(a, ' ') ELSE array_to_string("
               f"list_concat(a[1:{st}], {rtoks}, a[{en} + 1:len(a)]), ' ') END)")
    return f"""WITH {S.triples_cte(('identity',))},
w AS (SELECT doc_id, line_no, {S.words('input_text')} AS a, {S.words('target_text')} AS t FROM triples),
l AS (SELECT doc_id, line_no, a, {S.span_edit_key('a', 't', S.m2_line_fmt(0))} AS r FROM w)
SELECT doc_id, line_no, array_to_string(a, ' ') AS input_text, {applied} AS target_text FROM l"""


@register("m2_roundtrip", _m2_single_sql())
def m2_roundtrip(spark, sf_dir):
    """S-02 / S-03 / C-02: format the span edit input -> target as M2 text,
    split the text into blocks, parse the annotation lines back (try_cast, noop
    lines ignored) and apply them: M2 -> (input_text, target_text) pairs."""
    t = triples(spark, sf_dir, models=("identity",)).select(
        "doc_id", "line_no", words("input_text").alias("a"), words("target_text").alias("t"))
    blocks = t.select("doc_id", "line_no", m2_block("a", F.array(F.struct(
        F.lit(0).alias("coder"), as_edit_array(span_edit("a", "t")).alias("edits")))).alias("block"))
    return m2_to_pairs(blocks, "block").select("doc_id", "line_no", "input_text", "target_text")


def _corrected_sql():
    """The last edit but one position at a time: every source token stays, goes or is
    replaced, by the aligned edits towards the target."""
    return f"""WITH {S.triples_cte(('identity',))},
w AS (SELECT doc_id, line_no, {S.words('input_text')} AS a, {S.words('target_text')} AS t FROM triples)
SELECT doc_id, line_no, md5(array_to_string(t[1:greatest(len(t) - 1, 0)], ' ')) AS corrected_md5 FROM w"""


@register("corrected_sentence", _corrected_sql())
def corrected_sentence_q(spark, sf_dir):
    """C-07: the corrected sentence of the reference substitutions and the deletion
    of the last token: the target without its last word."""
    e = edit_rows(spark, sf_dir, models=("identity",)).withColumn("a", words("src"))
    n = F.size("a")
    keep = F.filter("ref", lambda x: x["o_start"] < n - 1)  # the last word goes, corrected or not
    last = F.when(n > 0, F.array(F.struct((n - 1).alias("o_start"), n.alias("o_end"), F.lit("").alias("c_str"), F.lit("U").alias("type"))))
    both = F.concat(keep, F.coalesce(last, F.slice("ref", 1, 0)))
    return e.select("doc_id", "line_no", F.md5(corrected_sentence("a", both)).alias("corrected_md5"))


@register("edit_running_offset", f"""WITH {S.triples_cte(('identity',))},
w AS (SELECT doc_id, line_no, {S.words('input_text')} AS a, {S.words('target_text')} AS t FROM triples),
k AS (SELECT doc_id, line_no, unnest(list_concat({S.aligned_edit_keys('a', 't')},
        {S.span_edit_key('a', f"a[1:len(a) - 1]")})) AS key FROM w),
x AS (SELECT doc_id, line_no, CAST(split_part(key, '|', 1) AS INTEGER) AS o_start,
        CAST(split_part(key, '|', 2) AS INTEGER) AS o_end, split_part(key, '|', 3) AS c_str FROM k),
d AS (SELECT *, len({S.words('c_str')}) - (o_end - o_start) AS delta FROM x)
SELECT doc_id, line_no, o_start, o_end,
  CAST(o_start + coalesce(sum(delta) OVER (PARTITION BY doc_id, line_no ORDER BY o_start, o_end
       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS cor_start,
  CAST(o_start + coalesce(sum(delta) OVER (PARTITION BY doc_id, line_no ORDER BY o_start, o_end
       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + len({S.words('c_str')}) AS INTEGER) AS cor_end
FROM d""")
def edit_running_offset(spark, sf_dir):
    """W-01 / C-07: edit spans in the corrected sentence (running offset of
    the preceding edits), for the reference substitutions plus the deletion
    of the last token."""
    e = edit_rows(spark, sf_dir, models=("identity",)).withColumn("a", words("src"))
    last_del = as_edit_array(span_edit("a", F.slice("a", 1, F.greatest(F.size("a") - 1, F.lit(0)))))
    rows = e.select("doc_id", "line_no", F.posexplode(F.concat("ref", last_del)).alias("ord", "e")).select("doc_id", "line_no", "ord", "e.*")
    x = corrected_spans(rows, ["doc_id", "line_no"])
    return x.select("doc_id", "line_no", "o_start", "o_end", "cor_start", "cor_end")


def _sentence_sql():
    ends = (f"list_transform(list_filter(range(1, len(a) + 1), lambda i: regexp_matches(a[i], '[.!?]$')), "
            f"lambda i: i)")
    return f"""WITH {S.triples_cte(('identity',))},
w AS (SELECT doc_id, line_no, {S.words('input_text')} AS a, {S.words('target_text')} AS t FROM triples),
b AS (SELECT doc_id, line_no, a, t,
        CASE WHEN len({ends}) = 0 OR {ends}[-1] < len(a) THEN list_concat({ends}, [len(a)]) ELSE {ends} END AS en
      FROM w),
sents AS (SELECT doc_id, line_no, CAST(generate_subscripts(en, 1) - 1 AS INTEGER) AS sent_no,
            unnest(list_concat([0], en[1:len(en) - 1])) AS s_start, unnest(en) AS s_end, len(en) AS n_sent FROM b),
k AS (SELECT doc_id, line_no, en[1] AS k0,
        list_concat({S.aligned_edit_keys('a', 't')},
          [en[1]::VARCHAR || '|' || en[1]::VARCHAR || '|.|M', en[1]::VARCHAR || '|' || en[1]::VARCHAR || '|x|M',
           (en[1] - 1)::VARCHAR || '|' || (en[1] + 1)::VARCHAR || '|y|R']) AS keys FROM b),
e AS (SELECT doc_id, line_no, CAST(split_part(key, '|', 1) AS INTEGER) AS o_start,
        CAST(split_part(key, '|', 2) AS INTEGER) AS o_end, split_part(key, '|', 3) AS c_str
      FROM (SELECT doc_id, line_no, unnest(keys) AS key FROM k)),
j AS (SELECT e.doc_id, e.line_no, s.sent_no, e.o_start - s.s_start AS o_start, e.o_end - s.s_start AS o_end, e.c_str
      FROM e JOIN sents s ON s.doc_id = e.doc_id AND s.line_no = e.line_no
      WHERE (e.o_start >= s.s_start AND e.o_start < s.s_end AND e.o_end <= s.s_end
             AND NOT (e.o_start = e.o_end AND e.o_start = s.s_start AND s.sent_no > 0
                      AND (e.c_str = '' OR contains({S.q(PUNCTUATION)}, right(e.c_str, 1)))))
         OR (e.o_start = e.o_end AND e.o_start = s.s_end
             AND (s.sent_no = s.n_sent - 1 OR e.c_str = '' OR contains({S.q(PUNCTUATION)}, right(e.c_str, 1)))))
SELECT doc_id, line_no, sent_no, CAST(o_start AS INTEGER) AS o_start, CAST(o_end AS INTEGER) AS o_end, c_str FROM j"""


@register("sentence_assign", _sentence_sql())
def sentence_assign(spark, sf_dir):
    """C-06 / J-07: split each line into sentences (tokens ending in . ! ?) and
    assign token edits to sentences: the reference substitutions, plus an
    insertion of '.' and of 'x' at the end of the first sentence and an edit
    crossing that boundary (dropped)."""
    e = edit_rows(spark, sf_dir, models=("identity",)).withColumn("a", words("src")).select(
        "doc_id", "line_no", "a", "ref", sentence_spans("a").alias("sents"))
    k = F.element_at("sents", 1)["s_end"]

    def mk(s, en, c, t):
        return F.struct(s.cast("int").alias("o_start"), en.cast("int").alias("o_end"),
                        F.lit(c).alias("c_str"), F.lit(t).alias("type"))
    extra = F.array(mk(k, k, ".", "M"), mk(k, k, "x", "M"), mk(k - 1, k + 1, "y", "R"))
    edits = e.select("doc_id", "line_no", F.explode(F.concat("ref", extra)).alias("x")).select(
        "doc_id", "line_no", "x.o_start", "x.o_end", "x.c_str")
    sents = e.select("doc_id", "line_no", F.explode("sents").alias("s")).select(
        "doc_id", "line_no", "s.sent_no", "s.s_start", "s.s_end", "s.is_last")
    a = assign_to_sentences(edits, sents, ["doc_id", "line_no"])
    return a.select("doc_id", "line_no", "sent_no", F.col("o_start").cast("int").alias("o_start"),
                    F.col("o_end").cast("int").alias("o_end"), "c_str")


def _levenshtein_sql():
    """Every rule model changes words one by one or drops the last: the distance
    is the number of places that differ, or one; applying the edits gives the prediction."""
    a, p = S.words("input_text"), S.words("prediction")
    return f"""WITH {S.triples_cte(EDIT_MODELS)},
w AS (SELECT doc_id, line_no, model, {a} AS a, {p} AS p FROM triples)
SELECT doc_id, line_no, model, md5(array_to_string(p, ' ')) AS applied_md5,
  CAST(CASE WHEN len(a) <> len(p) THEN 1 ELSE len(list_filter(range(1, len(a) + 1), lambda i: a[i] <> p[i])) END AS INTEGER) AS cost,
  (len(a) <> len(p) OR a <> p) AS changed FROM w"""


@register("levenshtein_edits", _levenshtein_sql())
def levenshtein_edits_q(spark, sf_dir):
    """R-07: Levenshtein-aligned edits of input -> prediction for every rule
    model: one edit per operation counts the distance, merged edits applied to
    the input give the prediction."""
    t = triples(spark, sf_dir, models=EDIT_MODELS).select(
        "doc_id", "line_no", "model", "input_text", words("input_text").alias("a"), words("prediction").alias("p"))
    return _aligned(t)


def _aligned(t):
    """(doc_id, line_no, model) with the digest of the merged edits applied, the cost and whether anything changed."""
    from redline.operators.levenshtein import levenshtein_edits
    e = t.select("doc_id", "line_no", "model", "input_text", levenshtein_edits("a", "p", "all-split").alias("ops"),
                 levenshtein_edits("a", "p").alias("edits"))
    numbered = F.transform("edits", lambda x, i: F.struct(x["o_start"].alias("o_start"), x["o_end"].alias("o_end"),
                                                          x["c_str"].alias("c_str"), x["type"].alias("type"), i.alias("ord")))
    return e.select("doc_id", "line_no", "model", F.md5(apply_edits("input_text", numbered, "safe")).alias("applied_md5"),
                    F.size("ops").alias("cost"), (F.size("edits") > 0).alias("changed"))


@register("levenshtein_moves", f"""WITH {S.triples_cte(('identity',))},
w AS (SELECT doc_id, line_no, {S.words('input_text')} AS a FROM triples),
m AS (SELECT doc_id, line_no, a, 'insert' AS model, list_concat(list_concat(a[1:3], ['also']), a[4:]) AS p, 1 AS cost FROM w
  UNION ALL SELECT doc_id, line_no, a, 'move', list_concat(a[2:], a[1:1]), CASE WHEN list_concat(a[2:], a[1:1]) = a THEN 0 ELSE 2 END FROM w
  UNION ALL SELECT doc_id, line_no, a, 'cut', a[1:2] || a[5:], CAST(greatest(least(len(a), 4) - 2, 0) AS INTEGER) FROM w)
SELECT doc_id, line_no, model, md5(array_to_string(p, ' ')) AS applied_md5, cost, cost > 0 AS changed FROM m""")
def levenshtein_moves(spark, sf_dir):
    """R-07 where words are inserted, moved and cut: an insertion costs one, a
    word moved to the end a deletion and an insertion, cut words one each."""
    a = words("input_text")
    put = F.concat(F.slice("a", 1, 3), F.array(F.lit("also")), F.slice("a", 4, F.size("a") + 1))
    move = F.concat(F.slice("a", 2, F.size("a") + 1), F.slice("a", 1, 1))
    cut = F.concat(F.slice("a", 1, 2), F.slice("a", 5, F.size("a") + 1))
    t = triples(spark, sf_dir, models=("identity",)).select("doc_id", "line_no", "input_text", a.alias("a"))
    made = F.array(*[F.struct(F.lit(m).alias("model"), p.alias("p")) for m, p in (("insert", put), ("move", move), ("cut", cut))])
    return _aligned(t.select("doc_id", "line_no", "input_text", "a", F.inline(made)))
