"""Row-level scorers.

All scorers are in-row array expressions: no shuffle, no Python. Token
arrays are projected once (`with_tokens`) and then shared by every scorer.

Three SARI definitions exist under one name in the reference; they are kept
apart here: `sari_recall` (V1 x100, V2 x1) and `sari_f1` (V3, single or
multiple references).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from redline.functions.hof import let
from redline.functions.text import strip
from redline.functions.tokens import ngram_overlap, ngram_total, tokens

NULL_POLICIES = ("zero", "skip", "literal_nan", "fail")


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def _n(arr: Column) -> Column:
    return F.size(arr).cast("double")


# --------------------------------------------------------------------------
# Column-level formulas over token arrays
# --------------------------------------------------------------------------

def gleu(hyp_tok, ref_tok, max_n: int = 4) -> Column:
    """R-01 sentence GLEU for one reference, orders 1..max_n:
    sum_g min(c_hyp(g), c_ref(g)) / max(|ngrams(hyp)|, |ngrams(ref)|); 0 if both empty.

    In-row and in the JVM: equal sentences score 1 without counting; for the others
    `ngram_overlap` counts the n-grams that touch a difference, the rest are shared."""
    h, r = _c(hyp_tok), _c(ref_tok)

    def counted(x: Column, y: Column) -> Column:
        n_all = F.greatest(ngram_total(x, 1, max_n), ngram_total(y, 1, max_n))
        return F.when(n_all > 0, ngram_overlap(x, y, max_n) / n_all.cast("double")).otherwise(F.lit(0.0))

    return F.when(h == r, F.when(F.size(h) > 0, F.lit(1.0)).otherwise(F.lit(0.0))).when(
        h.isNotNull() & r.isNotNull(), let(h, lambda x: let(r, lambda y: counted(x, y))))


def _ratio(num: Column, den: Column, empty) -> Column:
    return F.when(den > 0, num / den).otherwise(F.lit(float(empty)))


def _distinct3(a, b, c, body) -> Column:
    """Bind array_distinct(a), array_distinct(b) and c (or its distinct) once."""
    c = _c(c)
    return let(F.array_distinct(_c(a)), lambda x: let(
        F.array_distinct(_c(b)), lambda y: let(c, lambda z: body(x, y, z))))


def sari_recall(src_tok, pred_tok, ref_tok, scale: float = 100.0) -> Column:
    """R-03/R-04: mean of keep, add and delete *recalls*; an empty reference
    set for a component scores 1."""
    def body(s, p, r):
        keep_ref = F.array_intersect(r, s)
        add_ref = F.array_except(r, s)
        del_ref = F.array_except(s, r)
        keep = _ratio(_n(F.array_intersect(F.array_intersect(p, s), keep_ref)), _n(keep_ref), 1.0)
        add = _ratio(_n(F.array_intersect(F.array_except(p, s), add_ref)), _n(add_ref), 1.0)
        dele = _ratio(_n(F.array_intersect(F.array_except(s, p), del_ref)), _n(del_ref), 1.0)
        return (keep + add + dele) / F.lit(3.0) * F.lit(float(scale))

    # a prediction that is its reference keeps, adds and deletes all there is
    s, p, r = _c(src_tok), _c(pred_tok), _c(ref_tok)
    return F.when((p == r) & s.isNotNull(), F.lit(3.0) / F.lit(3.0) * F.lit(float(scale))).otherwise(_distinct3(s, p, F.array_distinct(r), body))


def _f1(p: Column, r: Column) -> Column:
    return F.when(p + r > 0, F.lit(2.0) * p * r / (p + r)).otherwise(F.lit(0.0))


def sari_f1(src_tok, pred_tok, refs_tok) -> Column:
    """R-05/R-06: F1(keep), F1(add), recall(delete), x100.

    `refs_tok` is an ARRAY<ARRAY<STRING>> (one token array per reference).
    keep = source ∩ every reference; add = ∪(reference − source);
    delete = source − ∪references. Precision denominators are *all*
    distinct prediction tokens; empty sets score 0.
    """
    def body(s, p, refs):
        keep_set = F.aggregate(refs, s, lambda acc, x: F.array_intersect(acc, x))
        add_set = F.array_distinct(F.flatten(F.transform(refs, lambda x: F.array_except(x, s))))
        del_set = F.array_except(s, F.array_distinct(F.flatten(refs)))

        def sets(k, a, d):
            n_p = _n(p)
            keep_hit = _n(F.array_intersect(p, k))
            add_hit = _n(F.array_intersect(p, a))
            keep_f1 = _f1(_ratio(keep_hit, n_p, 0.0), _ratio(keep_hit, _n(k), 0.0))
            add_f1 = _f1(_ratio(add_hit, n_p, 0.0), _ratio(add_hit, _n(a), 0.0))
            dele = _ratio(_n(F.array_intersect(F.array_except(s, p), d)), _n(d), 0.0)
            return (keep_f1 + add_f1 + dele) / F.lit(3.0) * F.lit(100.0)

        return let(keep_set, lambda k: let(add_set, lambda a: let(del_set, lambda d: sets(k, a, d))))

    refs = F.transform(_c(refs_tok), lambda x: F.array_distinct(x))
    return _distinct3(src_tok, pred_tok, refs, body)


def sari_f1_single(src_tok, pred_tok, ref_tok) -> Column:
    """`sari_f1` with one reference, from the numbers of distinct tokens that the sides share:
    what is added or deleted follows from them, so no set but source ∩ reference is built.
    A prediction that is its source adds and deletes nothing."""
    s, p, r = _c(src_tok), _c(pred_tok), _c(ref_tok)
    zero, one = F.lit(0.0), F.lit(1.0)

    def mean(keep: Column, add: Column, dele: Column) -> Column:
        return (keep + add + dele) / F.lit(3.0) * F.lit(100.0)

    def copied(n_s: Column, k: Column) -> Column:
        return mean(_f1(_ratio(k, n_s, 0.0), _ratio(k, k, 0.0)), zero, zero)

    def counted(c: Column) -> Column:
        n_s, n_p, n_r, k, pk, pr, sp = (c[i] for i in range(7))
        added = pr - pk
        keep = _f1(_ratio(pk, n_p, 0.0), _ratio(pk, k, 0.0))
        add = _f1(_ratio(added, n_p, 0.0), _ratio(added, n_r - k, 0.0))
        return mean(keep, add, _ratio(n_s - sp - k + pk, n_s - k, 0.0))

    def distinct(x: Column) -> Column:
        return _n(F.array_distinct(x))

    both = F.array_intersect(s, r)
    counts = let(both, lambda k: F.array(distinct(s), distinct(p), distinct(r), _n(k), _n(F.array_intersect(p, k)),
                                         _n(F.array_intersect(p, r)), _n(F.array_intersect(s, p))))
    same = F.when(s == r, F.when(F.size(s) > 0, mean(one, zero, zero)).otherwise(zero)).otherwise(
        let(F.array(distinct(s), _n(both)), lambda c: copied(c[0], c[1])))
    return F.when(s.isNotNull() & p.isNotNull() & r.isNotNull(), F.when(p == s, same).otherwise(let(counts, counted)))


# --------------------------------------------------------------------------
# DataFrame-level scoring with a null policy and a status column
# --------------------------------------------------------------------------

def apply_null_policy(df: DataFrame, cols, policy: str = "zero") -> DataFrame:
    """P-13 / R-11: `literal_nan` turns NULL text into the token 'nan' (what
    `str(NaN)` does); `fail` raises on a NULL; `zero`/`skip` keep NULLs and let
    `score_status` mark them."""
    if policy not in NULL_POLICIES:
        raise ValueError(f"null_policy must be one of {NULL_POLICIES}")
    if policy == "literal_nan":
        return df.select(*[F.coalesce(F.col(c), F.lit("nan")).alias(c) if c in cols else F.col(c)
                           for c in df.columns])
    if policy == "fail":
        any_null = F.lit(False)
        for c in cols:
            any_null = any_null | F.col(c).isNull()
        guard = F.when(any_null, F.raise_error(F.lit("NULL text under null_policy='fail'")))
        return df.where(guard.isNull())
    return df


def score_status(cols, prediction=None, blank_zero: bool = False, error=None) -> Column:
    """R-11: ok | error | null_input | blank. `error` is the column that holds
    the text of a failed prediction, if the rows have one."""
    any_null = F.lit(False)
    for c in cols:
        any_null = any_null | _c(c).isNull()
    st = F.when(F.lit(False) if error is None else _c(error).isNotNull(), F.lit("error")).when(any_null, F.lit("null_input"))
    if blank_zero and prediction is not None:
        st = st.when(strip(_c(prediction)) == "", F.lit("blank"))
    return st.otherwise(F.lit("ok"))


def valid_triples(df: DataFrame, cols=("input_text", "prediction", "target_text")) -> DataFrame:
    """P-11: the rows whose text columns are all present (pushed below any scorer)."""
    return df.dropna(subset=list(cols))


def count_valid(df: DataFrame, group_cols=(), cols=("input_text", "prediction", "target_text")) -> DataFrame:
    """M-12: rows kept and skipped by `valid_triples`, per group."""
    ok = F.lit(True)
    for c in cols:
        ok = ok & F.col(c).isNotNull()
    return df.groupBy(*group_cols).agg(F.count_if(ok).alias("n_valid"), F.count_if(~ok).alias("n_skipped"))


def head_rows(df: DataFrame, n: int, order_cols) -> DataFrame:
    """P-10 / W-07: the first `n` rows by a total order (the limit is the feature)."""
    return df.orderBy(*order_cols).limit(n)


def with_tokens(df: DataFrame, cols=("input_text", "prediction", "target_text"),
                mode: str = "portable", suffix: str = "_tok") -> DataFrame:
    """Tokenise each text column once, as its own projection (shared by all
    scorers downstream; Catalyst does not collapse it into multiple copies). Columns
    that are there already stay; a text that equals an earlier one shares its tokens."""
    have, out = [c for c in cols if c + suffix in df.columns], df
    for c in cols:
        if c + suffix not in df.columns:
            made = F.when(F.lit(False), F.array().cast("array<string>"))
            for e in have:
                made = made.when(F.col(c) == F.col(e), F.col(e + suffix))
            out = out.withColumn(c + suffix, (made.otherwise(tokens(c, mode)) if have else tokens(c, mode)))
    return out


def finalize_score(score: Column, status: Column, policy: str) -> Column:
    """Apply the policy outcome for non-ok rows: zero -> 0.0, skip -> NULL."""
    bad = status != "ok"
    if policy == "skip":
        return F.when(status.isin("null_input", "error"), F.lit(None).cast("double")) \
                .when(bad, F.lit(0.0)).otherwise(score)
    return F.when(bad, F.lit(0.0)).otherwise(score)


def score_triples(df: DataFrame, source: str = "input_text", prediction: str = "prediction",
                  target: str = "target_text", metrics=("gleu", "sari_recall"),
                  null_policy: str = "zero", blank_zero: bool = False,
                  tokenizer: str = "portable", gleu_scale: float = 1.0,
                  sari_scale: float = 100.0) -> DataFrame:
    """Add one DOUBLE column per requested metric plus `status`.

    metrics: any of gleu, sari_recall, sari_f1. `blank_zero` is the
    re-scoring rule P-12 (blank prediction -> every score 0).
    """
    cols = (source, prediction, target)
    texts = df.columns
    made = [c + "__tok" for c in cols if c + "__tok" in df.columns]
    if tokenizer != "portable":  # tokens that were made before aren't those
        df = df.drop(*made, source + "__gleu")
    elif null_policy == "literal_nan":  # nor are those of a NULL text
        df = df.select(*[F.coalesce(c, tokens(F.lit("nan"))).alias(c) if c in made else F.col(c) for c in df.columns])
    df = with_tokens(apply_null_policy(df, cols, null_policy), cols, tokenizer, suffix="__tok")
    st = score_status(cols, prediction, blank_zero, "error" if "error" in df.columns else None)
    s, p, r = (F.col(c + "__tok") for c in cols)
    copied = F.col(source + "__gleu") if source + "__gleu" in df.columns else None  # of source and target: that of a prediction which is its source
    out = []
    for m in metrics:
        if m == "gleu":
            expr = (gleu(p, r) if copied is None else F.when((F.col(prediction) == F.col(source)) & copied.isNotNull(), copied).otherwise(gleu(p, r))) * F.lit(float(gleu_scale))
        elif m == "sari_recall":
            expr = sari_recall(s, p, r, sari_scale)
        elif m == "sari_f1":
            expr = sari_f1_single(s, p, r)
        else:
            raise ValueError(f"unknown metric {m!r}")
        out.append(finalize_score(expr, st, null_policy).alias(m))
    return df.select(*[c for c in texts if not c.endswith(("__tok", "__gleu"))], *out, st.alias("status"))
