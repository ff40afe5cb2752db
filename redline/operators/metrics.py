"""Metric tables.

Every record is ONE `groupBy(...).agg(...)`: row scores are computed in-row
first, the aggregation is partial (map-side) then final, so the shuffle
carries one small row per group and partition whatever the input size or
skew. Ratios are taken AFTER aggregation (ratio of means, SURVEY F10).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from redline.functions import patterns as pt
from redline.functions.readability import fkgl_from_parts, fre_from_parts, readability_parts
from redline.functions.text import exact_match, word_count, words
from redline.operators.scores import gleu, sari_recall, tokens


def _mean0(col) -> Column:
    """M-02: corpus mean, 0 for an empty corpus."""
    return F.coalesce(F.avg(col), F.lit(0.0))


def f_beta(p: Column, r: Column, beta: float = pt.EDIT_BETA) -> Column:
    b2 = F.lit(beta * beta)
    return F.when(p + r > 0, (F.lit(1.0) + b2) * p * r / (b2 * p + r)).otherwise(F.lit(0.0))


def _group(df: DataFrame, group_cols):
    return df.groupBy(*group_cols) if group_cols else df.groupBy()


def exact_match_stats(df: DataFrame, group_cols=(), prediction="prediction",
                      target="target_text") -> DataFrame:
    """M-01: total, exact matches and accuracy in percent."""
    agg = _group(df, group_cols).agg(
        F.count(F.lit(1)).alias("total_examples"),
        F.count_if(exact_match(prediction, target)).alias("exact_matches"))
    return agg.withColumn("exact_match_accuracy",
                          F.try_divide(F.col("exact_matches") * F.lit(100.0), F.col("total_examples")))


def readability_record(df: DataFrame, group_cols=(), source="input_text",
                       prediction="prediction", target="target_text",
                       tokenizer: str = "portable") -> DataFrame:
    """M-10 (simplification): the 13-field record per group.

    Lengths average only non-NULL texts (pandas semantics, M-05); compression
    is (1 - mean_x / mean_input) x 100 (M-06); SARI is V1 (recall, x100);
    FRE/FKGL rows that cannot be scored count as 0 (M-07).
    """
    rows = df.select(
        *group_cols,
        exact_match(prediction, target).alias("_em"),
        word_count(source).alias("_wi"), word_count(prediction).alias("_wp"),
        word_count(target).alias("_wt"),
        tokens(source, tokenizer).alias("_s"), tokens(prediction, tokenizer).alias("_p"),
        tokens(target, tokenizer).alias("_r"),
        readability_parts(prediction).alias("_rp"), readability_parts(target).alias("_rt"))
    null_any = F.col("_s").isNull() | F.col("_p").isNull() | F.col("_r").isNull()
    sari_row = F.when(null_any, F.lit(0.0)).otherwise(sari_recall("_s", "_p", "_r", 100.0))
    agg = _group(rows, group_cols).agg(
        F.count(F.lit(1)).alias("total_examples"),
        F.count_if("_em").alias("exact_matches"),
        F.avg("_wi").alias("avg_input_length"),
        F.avg("_wp").alias("avg_prediction_length"),
        F.avg("_wt").alias("avg_target_length"),
        _mean0(sari_row).alias("sari_score"),
        _mean0(fre_from_parts(F.col("_rp"))).alias("prediction_flesch_reading_ease"),
        _mean0(fre_from_parts(F.col("_rt"))).alias("target_flesch_reading_ease"),
        _mean0(fkgl_from_parts(F.col("_rp"))).alias("prediction_flesch_kincaid_grade_level"),
        _mean0(fkgl_from_parts(F.col("_rt"))).alias("target_flesch_kincaid_grade_level"),
    )
    comp = lambda x: (F.lit(1.0) - F.try_divide(F.col(x), F.col("avg_input_length"))) * F.lit(100.0)
    return agg.select(
        *group_cols, "total_examples", "exact_matches",
        F.try_divide(F.col("exact_matches") * F.lit(100.0), F.col("total_examples"))
        .alias("exact_match_accuracy"),
        "avg_input_length", "avg_prediction_length", "avg_target_length",
        comp("avg_prediction_length").alias("prediction_compression_rate"),
        comp("avg_target_length").alias("target_compression_rate"),
        "sari_score", "prediction_flesch_reading_ease", "target_flesch_reading_ease",
        "prediction_flesch_kincaid_grade_level", "target_flesch_kincaid_grade_level")


def micro_prf(tp, fp, fn) -> list[Column]:
    """M-03: corpus P/R/F0.5 from summed TP/FP/FN, x100, zero-safe."""
    p = F.coalesce(F.try_divide(tp.cast("double"), (tp + fp).cast("double")), F.lit(0.0))
    r = F.coalesce(F.try_divide(tp.cast("double"), (tp + fn).cast("double")), F.lit(0.0))
    return [(p * 100).alias("m2_precision"), (r * 100).alias("m2_recall"),
            (f_beta(p, r) * 100).alias("m2_f0_5")]


def macro_prf(p_avg: Column, r_avg: Column) -> list[Column]:
    """M-04: F0.5 of the averaged (x100) per-sentence P and R."""
    return [p_avg.alias("m2_precision"), r_avg.alias("m2_recall"),
            f_beta(p_avg, r_avg).alias("m2_f0_5")]


def grammar_parts(line: str = "line", source: str = "input_text", target: str = "target_text") -> dict[str, Column]:
    """What `grammar_record` needs of source (the column `line`) and target alone, by the names
    that it looks for, each made from those before: tokens, words, their GLEU and the reference edits."""
    from redline.operators.edits import aligned_parts

    def both(kind: str, make) -> dict[str, Column]:
        return {source + kind: make(line), target + kind: F.when(F.col(target) == F.col(line), F.col(source + kind)).otherwise(make(target))}

    return {**both("__tok", tokens), **both("__words", words), source + "__gleu": gleu(source + "__tok", target + "__tok"),
            **aligned_parts("_re", source + "__words", target + "__words")}


def grammar_record(df: DataFrame, group_cols=(), source="input_text",
                   prediction="prediction", target="target_text",
                   tokenizer: str = "portable") -> DataFrame:
    """M-10 (grammar): total, exact matches, accuracy, GLEU x100 and micro edit
    P/R/F0.5 (edits = aligned token edits of each side vs the source, R-08/R-09). What
    `grammar_parts` makes of source and target is taken where it is there, and a prediction
    that is one of them takes theirs."""
    from redline.operators.edits import edit_confusion, with_aligned_edits

    shared = tokenizer == "portable" and grammar_parts(source, source, target).keys() <= set(df.columns)

    def of(col: str, kind: str, make) -> Column:
        if not shared:
            return make(col)
        if col != prediction:
            return F.col(col + kind)
        return F.when(F.col(col) == F.col(source), F.col(source + kind)).when(F.col(col) == F.col(target), F.col(target + kind)).otherwise(make(col))

    tok = lambda c: tokens(c, tokenizer)
    valid = F.col(source).isNotNull() & F.col(prediction).isNotNull() & F.col(target).isNotNull()
    ready = [F.when(F.col(prediction) == F.col(source), F.col(source + "__gleu")).alias("_g0"), "_pair__re", "_plain__re"] if shared else [F.lit(None).cast("double").alias("_g0")]
    rows = df.select(
        *group_cols, exact_match(prediction, target).alias("_em"), valid.alias("_ok"), *ready,
        of(prediction, "__tok", tok).alias("_p"), of(target, "__tok", tok).alias("_r"),
        of(source, "__words", words).alias("_a"), of(prediction, "__words", words).alias("_b"), of(target, "__words", words).alias("_t"))
    gleu_row = F.when(F.col("_p").isNull() | F.col("_r").isNull(), F.lit(0.0)) \
                .when(F.col("_g0").isNotNull(), F.col("_g0")).otherwise(gleu("_p", "_r"))
    rows = with_aligned_edits(rows, {"_he": ("_a", "_b"), "_re": ("_a", "_t")}, ["_em", *group_cols, "_ok", gleu_row.alias("_g")])
    rows = rows.select("_em", *group_cols, "_g", F.when(F.col("_ok"), edit_confusion("_he", "_re")).alias("_c"))
    agg = _group(rows, group_cols).agg(
        F.count(F.lit(1)).alias("total_examples"),
        F.count_if("_em").alias("exact_matches"),
        (_mean0("_g") * F.lit(100.0)).alias("gleu_score"),
        *[F.coalesce(F.sum(f"_c.{c}"), F.lit(0)).alias(f"_{c}") for c in ("tp", "fp", "fn")],
    )
    return agg.select(
        *group_cols, "total_examples", "exact_matches",
        F.try_divide(F.col("exact_matches") * F.lit(100.0), F.col("total_examples"))
        .alias("exact_match_accuracy"),
        "gleu_score", *micro_prf(F.col("_tp"), F.col("_fp"), F.col("_fn")), "_tp", "_fp", "_fn")


def stage_improvement(stage_metrics: DataFrame, metrics, partition_cols=(), order_col: str = "stage") -> DataFrame:
    """W-02: per stage, the step delta (lag) and the cascade's total
    improvement = last - first, for each metric; NULL for a single stage."""
    from pyspark.sql import Window
    w = Window.partitionBy(*partition_cols).orderBy(order_col)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    n = F.count(F.lit(1)).over(whole)
    cols = []
    for m in metrics:
        cols.append((F.col(m) - F.lag(m).over(w)).alias(f"{m}_step"))
        cols.append(F.when(n > 1, F.last(m).over(whole) - F.first(m).over(whole)).alias(f"{m}_improvement"))
    return stage_metrics.select("*", *cols)


def cascade_report(stage_metrics: DataFrame, metrics, carry=(), order_col: str = "stage") -> DataFrame:
    """K-04: one row, nested JSON {all_stages, final_metrics, improvement}; `carry`
    names what each stage shows besides its metrics (its model, its counts)."""
    stages = F.sort_array(F.collect_list(F.struct(order_col, *carry, *metrics)))
    rep = stage_metrics.groupBy().agg(stages.alias("all_stages"))
    last = F.element_at("all_stages", -1)
    first = F.element_at("all_stages", 1)
    improvement = F.when(F.size("all_stages") > 1, F.struct(
        *[(last[m] - first[m]).alias(f"{m}_improvement") for m in metrics]))
    return rep.select(F.size("all_stages").alias("n_stages"), last[order_col].alias("final_stage"),
                      F.to_json(F.struct("all_stages", last.alias("final_metrics"),
                                         improvement.alias("improvement"))).alias("report_json"))


def leaderboard(metrics_table: DataFrame, dataset_col: str, score_col: str) -> DataFrame:
    """I-04: rank models within each dataset by a score (the input is the
    small per-(model, dataset) metrics table)."""
    from pyspark.sql import Window
    w = Window.partitionBy(dataset_col).orderBy(F.col(score_col).desc(), F.col("model"))
    return metrics_table.withColumn("rank", F.rank().over(w))
