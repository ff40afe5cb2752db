"""Derived inputs built from the driver tables (FIXTURES §2).

Every registered query starts from these, so its work grows with the tables:
`lines` explodes every document (whole texts, every line), `triples` adds a
target and the prediction of each rule model in ONE scan (explode of an
array of structs instead of a union of three scans).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from redline.functions.hof import let
from redline.functions.text import word_count, words
from redline.functions.tokens import tokens
from redline.session import read_table, spread

RULE_MODELS = ("identity", "drop_last", "swap")
EDIT_MODELS = ("identity", "drop_last", "swap", "fix_first")


def rule_prediction(model: str, col) -> Column:
    """Deterministic stand-ins for a rewriting model (literal replaces only)."""
    c = F.col(col) if isinstance(col, str) else col
    if model == "identity":
        return c
    if model == "drop_last":
        return F.array_join(let(words(c), lambda w: F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0)))), " ")
    if model == "swap":
        return F.replace(c, F.lit(" and "), F.lit(" or "))
    if model == "fix_first":
        pos = F.instr(c, " the ")
        return F.when(pos > 0, F.concat(c.substr(F.lit(1), pos - 1), F.lit(" a "),
                                        F.substr(c, pos + 5))).otherwise(c)
    raise ValueError(f"unknown rule model {model!r}")


def reference_target(col) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.replace(c, F.lit(" the "), F.lit(" a "))


def lines(docs: DataFrame) -> DataFrame:
    """`documents` split on newlines with a 0-based ordinal: every line, blank
    and one-word ones included. Key (doc_id, line_no)."""
    exploded = docs.select("doc_id", "lang", "source",
                           F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return spread(exploded, docs)


def triples(spark: SparkSession, sf_dir: str, models=RULE_MODELS, with_tokens: bool = False, made: dict[str, Column] | None = None) -> DataFrame:
    """(doc_id, line_no, lang, source, model, input_text, target_text, prediction);
    `with_tokens` adds the tokens and word counts of input and target (s_tok,
    r_tok, wi, wt), and `made` named columns of `line`, `target_text` and those named
    before, made before the rows are multiplied by the models."""
    base = lines(read_table(spark, sf_dir, "documents"))
    preds = F.array(*[F.struct(F.lit(m).alias("model"), rule_prediction(m, "line").alias("prediction"))
                      for m in models])
    base = base.withColumn("target_text", reference_target("line"))
    extra = list(made or {})
    for n, c in (made or {}).items():
        base = base.withColumn(n, c)
    if with_tokens:
        extra += ["s_tok", "r_tok", "wi", "wt"]
        base = base.select("*", tokens("line").alias("s_tok"), tokens("target_text").alias("r_tok"),
                           word_count("line").alias("wi"), word_count("target_text").alias("wt"))
    return base.select("doc_id", "line_no", "lang", "source", F.col("line").alias("input_text"), "target_text", *extra, F.inline(preds))


def scored_triples(spark: SparkSession, sf_dir: str, models=RULE_MODELS) -> DataFrame:
    """`triples` with the tokens of input and target under the names that `score_triples` reads."""
    return triples(spark, sf_dir, models, made={"input_text__tok": tokens("line"), "target_text__tok": tokens("target_text")})


def turn_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consecutive conversation turns t, t+1, t+2 as (input, prediction, target).

    One shuffle keyed by (conv_id, anchor turn): each turn is sent to the
    three anchors it serves, so a single huge conversation is still spread
    over many tasks (the key is the turn, not the conversation).
    """
    conv = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    roles = F.array(*[F.struct(F.lit(k).alias("k"), (F.col("turn") - k).alias("anchor"))
                      for k in range(3)])
    tagged = conv.select("conv_id", "text", F.inline(roles))
    grouped = tagged.groupBy("conv_id", "anchor").agg(
        *[F.max(F.when(F.col("k") == k, F.col("text"))).alias(name)
          for k, name in enumerate(("input_text", "prediction", "target_text"))])
    return (grouped.where(F.col("input_text").isNotNull() & F.col("prediction").isNotNull()
                          & F.col("target_text").isNotNull())
            .withColumnRenamed("anchor", "turn"))
