"""Registered queries: row scorers and metric tables (R-*, M-*, P-20..P-26)."""

from __future__ import annotations

from pyspark.sql import functions as F

from redline.functions.readability import fkgl_from_parts, flesch_kincaid_grade, flesch_reading_ease, fre_from_parts, readability_parts, shared_parts
from redline.functions.text import exact_match, word_count
from redline.functions.tokens import TREEBANK_RULES, ngrams, tokens
from redline.operators import metrics as M
from redline.operators.scores import gleu, sari_f1, sari_recall, score_triples
from redline.plans import sql as S
from redline.plans.fixtures import rule_prediction, scored_triples, triples, turn_triples
from redline.plans.registry import register


def r6(c):
    return F.round(c, 6)


# --------------------------------------------------------------------------
# Flagship: per (lang, model) exact match, lengths, compression, SARI V1
# --------------------------------------------------------------------------

def lang_model_summary(spark, sf_dir):
    t = triples(spark, sf_dir, with_tokens=True)  # input and target are tokenised once, not once per model
    rows = t.select("lang", "model", exact_match("prediction", "target_text").alias("em"),
                    "wi", word_count("prediction").alias("wp"), "wt",
                    sari_recall("s_tok", tokens("prediction"), "r_tok").alias("sari"))
    agg = rows.groupBy("lang", "model").agg(
        F.count(F.lit(1)).alias("total_examples"), F.count_if("em").alias("exact_matches"),
        F.avg("wi").alias("avg_input_length"), F.avg("wp").alias("avg_prediction_length"),
        F.avg("wt").alias("avg_target_length"), F.coalesce(F.avg("sari"), F.lit(0.0)).alias("sari"))
    return agg.select(
        "lang", "model", "total_examples", "exact_matches",
        r6(F.col("exact_matches") * 100.0 / F.col("total_examples")).alias("exact_match_accuracy"),
        r6("avg_input_length").alias("avg_input_length"),
        r6("avg_prediction_length").alias("avg_prediction_length"),
        r6("avg_target_length").alias("avg_target_length"),
        r6((1 - F.col("avg_prediction_length") / F.col("avg_input_length")) * 100)
        .alias("prediction_compression_rate"),
        r6((1 - F.col("avg_target_length") / F.col("avg_input_length")) * 100)
        .alias("target_compression_rate"),
        r6("sari").alias("sari_score"))


_TOK = {k: S.tokens(k) for k in ("input_text", "prediction", "target_text")}

_T = ("input_text", "prediction", "target_text")
_V1_ALL = S.sari_v1_ctes("triples", ["doc_id", "line_no", "lang", "model", *_T],
                         S.tokens("input_text"), S.tokens("prediction"), S.tokens("target_text"))

LANG_MODEL_SUMMARY_SQL = f"""WITH {S.triples_cte()},
{_V1_ALL}
SELECT lang, model, count(*) AS total_examples,
       count(*) FILTER (WHERE prediction = target_text) AS exact_matches,
       round(count(*) FILTER (WHERE prediction = target_text) * 100.0 / count(*), 6) AS exact_match_accuracy,
       round(avg({S.word_count('input_text')}), 6) AS avg_input_length,
       round(avg({S.word_count('prediction')}), 6) AS avg_prediction_length,
       round(avg({S.word_count('target_text')}), 6) AS avg_target_length,
       round((1 - avg({S.word_count('prediction')}) / avg({S.word_count('input_text')})) * 100, 6)
         AS prediction_compression_rate,
       round((1 - avg({S.word_count('target_text')}) / avg({S.word_count('input_text')})) * 100, 6)
         AS target_compression_rate,
       round(coalesce(avg(sari), 0.0), 6) AS sari_score
FROM v1 GROUP BY lang, model"""

register("lang_model_summary", LANG_MODEL_SUMMARY_SQL)(lang_model_summary)


@register("exact_match_by_lang", f"""WITH {S.triples_cte()}
SELECT lang, model, count(*) AS total_examples,
       count(*) FILTER (WHERE prediction = target_text) AS exact_matches,
       round(count(*) FILTER (WHERE prediction = target_text) * 100.0 / count(*), 6) AS exact_match_accuracy
FROM triples GROUP BY lang, model""")
def exact_match_by_lang(spark, sf_dir):
    r = M.exact_match_stats(triples(spark, sf_dir), ["lang", "model"])
    return r.select("lang", "model", "total_examples", "exact_matches",
                    r6("exact_match_accuracy").alias("exact_match_accuracy"))


@register("length_compression", f"""WITH {S.triples_cte()}
SELECT model, round(avg({S.word_count('input_text')}), 6) AS avg_input_length,
       round(avg({S.word_count('prediction')}), 6) AS avg_prediction_length,
       round((1 - avg({S.word_count('prediction')}) / avg({S.word_count('input_text')})) * 100, 6)
         AS prediction_compression_rate
FROM triples GROUP BY model""")
def length_compression(spark, sf_dir):
    t = triples(spark, sf_dir).select("model", word_count("input_text").alias("wi"),
                                      word_count("prediction").alias("wp"))
    a = t.groupBy("model").agg(F.avg("wi").alias("ai"), F.avg("wp").alias("ap"))
    return a.select("model", r6("ai").alias("avg_input_length"), r6("ap").alias("avg_prediction_length"),
                    r6((1 - F.col("ap") / F.col("ai")) * 100).alias("prediction_compression_rate"))


@register("sari_recall_rows", f"""WITH {S.triples_cte()},
{_V1_ALL}
SELECT doc_id, line_no, model, round(sari, 6) AS sari FROM v1""")
def sari_recall_rows(spark, sf_dir):
    s = score_triples(scored_triples(spark, sf_dir), metrics=("sari_recall",))
    return s.select("doc_id", "line_no", "model", r6("sari_recall").alias("sari"))


@register("sari_recall_corpus", f"""WITH {S.triples_cte()},
{_V1_ALL}
SELECT model, count(*) AS n, round(coalesce(avg(sari), 0.0), 6) AS sari_score
FROM v1 GROUP BY model""")
def sari_recall_corpus(spark, sf_dir):
    s = score_triples(scored_triples(spark, sf_dir), metrics=("sari_recall",))
    return s.groupBy("model").agg(F.count(F.lit(1)).alias("n"),
                                  r6(F.coalesce(F.avg("sari_recall"), F.lit(0.0))).alias("sari_score"))


@register("sari_f1_rows", f"""WITH {S.triples_cte()},
{S.sari_v3_ctes("triples", ["doc_id", "line_no", "model"], S.tokens("input_text"), S.tokens("prediction"),
                [S.tokens("target_text")])}
SELECT doc_id, line_no, model, round(sari_f1, 6) AS sari_f1 FROM v3""")
def sari_f1_rows(spark, sf_dir):
    s = score_triples(scored_triples(spark, sf_dir), metrics=("sari_f1",))
    return s.select("doc_id", "line_no", "model", r6("sari_f1").alias("sari_f1"))


_REF2 = S.tokens(S.rule_prediction("swap", "input_text"))


@register("sari_f1_multiref", f"""WITH {S.triples_cte(('drop_last',))},
{S.sari_v3_ctes("triples", ["doc_id", "line_no"], S.tokens("input_text"), S.tokens("prediction"),
                [S.tokens("target_text"), _REF2])}
SELECT doc_id, line_no, round(sari_f1, 6) AS sari_f1 FROM v3""")
def sari_f1_multiref(spark, sf_dir):
    """Two references per row: the target and the `swap` rewrite of the input."""
    t = triples(spark, sf_dir, models=("drop_last",))
    refs = F.array(tokens("target_text"), tokens(rule_prediction("swap", "input_text")))
    return t.select("doc_id", "line_no",
                    r6(sari_f1(tokens("input_text"), tokens("prediction"), refs)).alias("sari_f1"))


@register("gleu_rows", S.gleu_rows_sql("WITH " + S.triples_cte() + ",\nsrc AS (SELECT * FROM triples)",
                                       ["doc_id", "line_no", "model"])
          + "\nSELECT doc_id, line_no, model, round(gleu, 6) AS gleu FROM scored")
def gleu_rows(spark, sf_dir):
    s = score_triples(scored_triples(spark, sf_dir), metrics=("gleu",))
    return s.select("doc_id", "line_no", "model", r6("gleu").alias("gleu"))


@register("gleu_corpus", S.gleu_rows_sql("WITH " + S.triples_cte() + ",\nsrc AS (SELECT * FROM triples)",
                                         ["doc_id", "line_no", "model"])
          + "\nSELECT model, count(*) AS n, round(coalesce(avg(gleu), 0.0) * 100, 6) AS gleu_score "
            "FROM scored GROUP BY model")
def gleu_corpus(spark, sf_dir):
    s = score_triples(scored_triples(spark, sf_dir), metrics=("gleu",))
    return s.groupBy("model").agg(F.count(F.lit(1)).alias("n"),
                                  r6(F.coalesce(F.avg("gleu"), F.lit(0.0)) * 100).alias("gleu_score"))


@register("gleu_turns", S.gleu_rows_sql("WITH " + S.TURN_TRIPLES + ",\nsrc AS (SELECT * FROM turn_triples)",
                                        ["conv_id", "turn"])
          + "\nSELECT conv_id, turn, round(gleu, 6) AS gleu FROM scored")
def gleu_turns(spark, sf_dir):
    t = turn_triples(spark, sf_dir)
    return t.select("conv_id", "turn", r6(gleu(tokens("prediction"), tokens("target_text"))).alias("gleu"))


def _treebank_sql(x):
    """The rewrite rules on a lower-cased line between blanks."""
    x = f"' ' || lower({x}) || ' '"
    for pattern, put in TREEBANK_RULES:
        x = f"regexp_replace({x}, {S.q(pattern)}, {S.q(put.replace('$', chr(92)))}, 'g')"
    return S.words(x)


@register("treebank_tokens", f"""WITH {S.LINES}, t AS (SELECT doc_id, line_no, {_treebank_sql("replace(line, ' the ', ' can''t \"cannot\" ')")} AS t FROM lines)
SELECT doc_id, line_no, CAST(len(t) AS INTEGER) AS n_tokens, md5(array_to_string(t, ' ')) AS tokens_md5 FROM t""")
def treebank_tokens(spark, sf_dir):
    """P-21: Treebank-style tokens of every line, quotes and clitics put in."""
    from redline.plans.fixtures import lines
    from redline.session import read_table
    line = F.replace("line", F.lit(" the "), F.lit(" can't \"cannot\" "))
    d = lines(read_table(spark, sf_dir, "documents")).select("doc_id", "line_no", tokens(line, "treebank").alias("t"))
    return d.select("doc_id", "line_no", F.size("t").alias("n_tokens"), F.md5(F.array_join("t", " ")).alias("tokens_md5"))


@register("ngram_counts", f"""WITH {S.LINES},
g AS (SELECT doc_id, line_no, {S.tokens('line')} AS t FROM lines),
x AS (SELECT doc_id, line_no, unnest(list_transform(range(1, 5), lambda n:
        {{'n': n, 'cnt': greatest(len(t) - n + 1, 0),
          'nd': len(list_distinct(list_transform(range(1, len(t) - n + 2),
                    lambda i: array_to_string(t[i:i + n - 1], ' '))))}})) AS s FROM g)
SELECT doc_id, line_no, s.n AS n, CAST(s.cnt AS BIGINT) AS n_grams, CAST(s.nd AS BIGINT) AS distinct_grams
FROM x WHERE s.cnt > 0""")
def ngram_counts(spark, sf_dir):
    """P-22: per line and order n, the number of n-grams and distinct n-grams."""
    from redline.plans.fixtures import lines
    from redline.session import read_table
    base = lines(read_table(spark, sf_dir, "documents")).select(
        "doc_id", "line_no", tokens("line").alias("t"))
    per = F.array(*[F.struct(F.lit(n).alias("n"), ngrams("t", n, n).alias("g")) for n in range(1, 5)])
    x = base.select("doc_id", "line_no", F.inline(per))
    return x.where(F.size("g") > 0).select(
        "doc_id", "line_no", "n", F.size("g").cast("long").alias("n_grams"),
        F.size(F.array_distinct("g")).cast("long").alias("distinct_grams"))


_FRE_P, _FKGL_P = S.readability("prediction")
_FRE_T, _FKGL_T = S.readability("target_text")


@register("flesch_rows", f"""WITH {S.triples_cte(('drop_last',))}
SELECT doc_id, line_no, round({_FRE_P}, 6) AS fre, round({_FKGL_P}, 6) AS fkgl FROM triples""")
def flesch_rows(spark, sf_dir):
    t = triples(spark, sf_dir, models=("drop_last",))
    return t.select("doc_id", "line_no", r6(flesch_reading_ease("prediction")).alias("fre"),
                    r6(flesch_kincaid_grade("prediction")).alias("fkgl"))


@register("flesch_corpus", f"""WITH {S.triples_cte()}
SELECT model, round(avg({_FRE_P}), 6) AS prediction_fre, round(avg({_FKGL_P}), 6) AS prediction_fkgl,
       round(avg({_FRE_T}), 6) AS target_fre, round(avg({_FKGL_T}), 6) AS target_fkgl
FROM triples GROUP BY model""")
def flesch_corpus(spark, sf_dir):
    """M-07: words, sentences and syllables are counted once a text: those of a line and its
    target before the models multiply them, those of a prediction where it differs from both."""
    made = {"line_parts": readability_parts("line"), "target_parts": shared_parts("target_text", {"line": "line_parts"})}
    t = triples(spark, sf_dir, made=made)
    own = shared_parts("prediction", {"input_text": "line_parts", "target_text": "target_parts"})
    t = t.select("model", own.alias("p"), F.col("target_parts").alias("t"))
    t = t.select("model", *[f(F.col(c)).alias(n) for n, f, c in (
        ("prediction_fre", fre_from_parts, "p"), ("prediction_fkgl", fkgl_from_parts, "p"),
        ("target_fre", fre_from_parts, "t"), ("target_fkgl", fkgl_from_parts, "t"))])
    return t.groupBy("model").agg(*[r6(F.avg(c)).alias(c) for c in t.columns[1:]])


def _round_doubles(df, keep=()):
    return df.select(*[r6(c).alias(c) if t == "double" and c not in keep else F.col(c)
                       for c, t in df.dtypes])


@register("readability_record", f"""WITH {S.triples_cte()},
{_V1_ALL}
SELECT model, count(*) AS total_examples,
  count(*) FILTER (WHERE prediction = target_text) AS exact_matches,
  round(count(*) FILTER (WHERE prediction = target_text) * 100.0 / count(*), 6) AS exact_match_accuracy,
  round(avg({S.word_count('input_text')}), 6) AS avg_input_length,
  round(avg({S.word_count('prediction')}), 6) AS avg_prediction_length,
  round(avg({S.word_count('target_text')}), 6) AS avg_target_length,
  round((1 - avg({S.word_count('prediction')}) / avg({S.word_count('input_text')})) * 100, 6) AS prediction_compression_rate,
  round((1 - avg({S.word_count('target_text')}) / avg({S.word_count('input_text')})) * 100, 6) AS target_compression_rate,
  round(coalesce(avg(sari), 0.0), 6) AS sari_score,
  round(avg({_FRE_P}), 6) AS prediction_flesch_reading_ease,
  round(avg({_FRE_T}), 6) AS target_flesch_reading_ease,
  round(avg({_FKGL_P}), 6) AS prediction_flesch_kincaid_grade_level,
  round(avg({_FKGL_T}), 6) AS target_flesch_kincaid_grade_level
FROM v1 GROUP BY model""")
def readability_record(spark, sf_dir):
    return _round_doubles(M.readability_record(triples(spark, sf_dir), ["model"]))


_V2_ALL = S.sari_v1_ctes("triples", ["doc_id", "line_no", "model"], S.tokens("input_text"), S.tokens("prediction"),
                         S.tokens("target_text"), out="v2", scale=1.0)


@register("sari_v2_rows", f"""WITH {S.triples_cte()},
{_V2_ALL}
SELECT doc_id, line_no, model, round(sari, 6) AS sari_v2 FROM v2""")
def sari_v2_rows(spark, sf_dir):
    """R-04: the recall-average SARI on a 0..1 scale, NULL text fails the job
    (null_policy='fail') instead of scoring 0."""
    s = score_triples(scored_triples(spark, sf_dir), metrics=("sari_recall",), null_policy="fail", sari_scale=1.0)
    return s.select("doc_id", "line_no", "model", r6("sari_recall").alias("sari_v2"))
