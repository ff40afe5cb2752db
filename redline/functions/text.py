"""Scalar text functions (SURVEY P-*): pure Column -> Column built-ins.

Nothing here leaves the JVM: every function is a composition of Spark SQL
expressions, so it runs inside whole-stage codegen (HOF lambdas excepted)
and works unchanged on batch and streaming DataFrames.
"""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from redline.functions import patterns as pt


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def strip(col) -> Column:
    """Python-style strip of edge whitespace (Spark `trim` strips spaces only)."""
    return F.regexp_replace(_c(col), rf"^{pt.WS}+|{pt.WS}+$", "")


def clean_spaced_hyphens(col) -> Column:
    """P-01: ' - ' -> '-' (null in, null out)."""
    return F.replace(_c(col), F.lit(" - "), F.lit("-"))


def first_reference(col) -> Column:
    """P-02: first element of a reference list; NULL on empty (ANSI-safe)."""
    return F.get(_c(col), 0)


def words(col) -> Column:
    """Whitespace words (Python `str.split()` on ASCII blanks)."""
    return F.array_remove(F.split(_c(col), pt.WS_RUN), "")


def word_count(col) -> Column:
    """P-20: number of whitespace-separated words; NULL for NULL."""
    return F.size(words(col))


def normalize_ws(col) -> Column:
    """P-14: `" ".join(x.split())`."""
    return F.trim(F.regexp_replace(_c(col), pt.WS_RUN, " "))


def normalize_punct(col) -> Column:
    """P-16: one-to-one punctuation table; offsets are preserved."""
    return F.translate(_c(col), pt.PUNCT_FROM, pt.PUNCT_TO)


def extract_answer(col, marker: str) -> Column:
    """P-06: text after the last `marker` if present, else all; stripped."""
    return strip(F.substring_index(_c(col), marker, -1))


def truncate_overlong(pred, source, ratio: float = pt.OVERLONG_RATIO) -> Column:
    """P-07: if the prediction has more than ratio x the source's words, keep
    the text before the first '. ' and make sure it ends with '.'."""
    pred, source = _c(pred), _c(source)
    first = F.substring_index(pred, ". ", 1)
    cut = F.when(first.endswith("."), first).otherwise(F.concat(first, F.lit(".")))
    too_long = word_count(pred) > word_count(source) * F.lit(float(ratio))
    return F.when(too_long, cut).otherwise(pred)


def token_budget(col) -> Column:
    """P-08: `min(int(words * 0.8 * 1.3), 60)` in double arithmetic."""
    n = word_count(col).cast("double")
    raw = F.floor(n * F.lit(pt.BUDGET_WORD_FACTOR) * F.lit(pt.BUDGET_TOKENS_PER_WORD))
    return F.least(raw.cast("int"), F.lit(pt.BUDGET_CAP))


def with_fallback(pred, source) -> Column:
    """P-09: the input when the model produced nothing (error / NULL)."""
    return F.coalesce(_c(pred), _c(source))


def exact_match(pred, target) -> Column:
    """P-26: case-sensitive equality; NULL never matches."""
    return F.coalesce(_c(pred) == _c(target), F.lit(False))


def route_doc_type(path) -> Column:
    """P-17: document type from the (compressed) file extension."""
    p = F.lower(_c(path))
    return (F.when(p.rlike(r"\.pdf(\.gz)?$"), "pdf")
            .when(p.rlike(r"\.html?(\.gz)?$"), "html")
            .when(p.rlike(r"\.txt(\.gz)?$"), "txt")
            .otherwise("unsupported"))


@F.pandas_udf(T.StringType())
def _unescape(texts: pd.Series) -> pd.Series:
    return texts.map(html.unescape, na_action="ignore")


def unescape(col) -> Column:
    """Named and numeric character references of HTML decoded, once, by the
    standard library's table; only texts with an ampersand leave the JVM's path
    (others are passed as NULL and kept as they are)."""
    c = _c(col)
    return F.coalesce(_unescape(F.when(c.contains("&"), c)), c)


def html_tokens(drop_script: bool = True, possessive: bool = True) -> str:
    """One pattern for all markup, read from left to right as a tokenizer does: a comment, an
    element of raw text with all it holds (script and style, if they go), a tag with quoted
    values, and, where a quote isn't closed, a tag up to its first `>`. A `<` that begins
    none of these is text. `possessive` quantifiers keep Java's stack flat on long tags; without
    them, as RE2 needs it, the pattern matches the same."""
    p = "+" if possessive else ""
    inside = rf"""(?:[^>"']+{p}|"[^"]*{p}"|'[^']*{p}')*{p}"""  # quoted values may hold `>`
    raw = [rf"(?i:<{name}(?:\s{inside})?>[\s\S]*?(?:</{name}\b[^>]*>|\z))" for name in ("script", "style")] if drop_script else []
    return "|".join([r"<!--[\s\S]*?(?:-->|\z)", *raw, rf"</?[a-zA-Z!?]{inside}>", r"</?[a-zA-Z!?][^>]*>"])


def html_text(col, drop_script: bool = True) -> Column:
    """P-18: markup removed, text kept (see `html_tokens`); then character references;
    whitespace collapsed (no-break spaces count as blanks)."""
    x = F.regexp_replace(_c(col), html_tokens(drop_script), " ")
    return normalize_ws(F.translate(unescape(x), "\u00a0", " "))


def model_slug(col) -> Column:
    """K-06: file-safe model id: '/' -> '_', '.' -> '-'."""
    return F.translate(_c(col), "/.", "_-")


def model_slug_underscore(col) -> Column:
    """K-06 (second rule): '/' and '-' -> '_'."""
    return F.translate(_c(col), "/-", "__")


def dataset_name(path) -> Column:
    """K-06: dataset name = file name without directory and extension."""
    base = F.element_at(F.split(_c(path), "/"), -1)
    return F.regexp_replace(base, r"\.[^.]*$", "")


def mask_patterns(col) -> Column:
    """X-03: mask e-mail addresses, phone numbers and UK-style postcodes with
    placeholder tokens (e-mails first, so their digits are not read as phones)."""
    x = F.regexp_replace(_c(col), pt.EMAIL_RE, "<EMAIL>")
    x = F.regexp_replace(x, pt.PHONE_RE, "<PHONE>")
    return F.regexp_replace(x, pt.POSTCODE_RE, "<POSTCODE>")
