"""Readability functions.

Syllables are vowel groups (at least one per word) and sentences are runs of
terminal punctuation (at least one when the text has words): deterministic
and SQL-checkable approximations of a dictionary-based syllable counter.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from redline.functions import patterns as pt
from redline.functions.text import words


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def sentence_count(col) -> Column:
    n_words = F.size(words(col))
    n_ends = F.size(F.regexp_extract_all(_c(col), F.lit(pt.SENT_END_RE), 0))
    return F.when(n_words == 0, F.lit(0)).otherwise(F.greatest(n_ends, F.lit(1)))


def syllable_count(col) -> Column:
    """Vowel groups, which never reach over a blank, and the words without a vowel: one pass."""
    return F.size(F.regexp_extract_all(F.lower(_c(col)), F.lit(pt.SYLLABLE_RE), 0))


def readability_parts(col) -> Column:
    """struct(words, sentences, syllables), computed once per text."""
    return F.struct(F.size(words(col)).alias("w"), sentence_count(col).alias("s"),
                    syllable_count(col).alias("y"))


def shared_parts(col, known: dict) -> Column:
    """`readability_parts` of a text column: those of the first column of `known` (text ->
    its parts) that holds the same text, made only where none does."""
    x = _c(col)
    same = [(F.coalesce(x == _c(text), F.lit(False)), _c(parts)) for text, parts in known.items()]
    other = F.lit(True)
    for equal, _ in same:
        other = other & ~equal
    own = readability_parts(F.when(other, x))  # of a NULL nothing is counted
    out = F.when(other, own)
    for equal, parts in same:
        out = out.when(equal, parts)
    return out


def _fre(p: Column) -> Column:
    w, s, y = p["w"].cast("double"), p["s"].cast("double"), p["y"].cast("double")
    return F.when(p["w"] > 0, F.lit(pt.FRE_BASE) - F.lit(pt.FRE_WPS) * (w / s)
                  - F.lit(pt.FRE_SPW) * (y / w)).otherwise(F.lit(0.0))


def _fkgl(p: Column) -> Column:
    w, s, y = p["w"].cast("double"), p["s"].cast("double"), p["y"].cast("double")
    return F.when(p["w"] > 0, F.lit(pt.FKGL_WPS) * (w / s) + F.lit(pt.FKGL_SPW) * (y / w)
                  - F.lit(pt.FKGL_BASE)).otherwise(F.lit(0.0))


def flesch_reading_ease(col) -> Column:
    """P-24: 206.835 - 1.015 words/sentence - 84.6 syllables/word; 0 for no words
    and for NULL (error rows count as 0, SURVEY M-07)."""
    return F.coalesce(_fre(readability_parts(col)), F.lit(0.0))


def flesch_kincaid_grade(col) -> Column:
    """P-25: 0.39 words/sentence + 11.8 syllables/word - 15.59."""
    return F.coalesce(_fkgl(readability_parts(col)), F.lit(0.0))


def fre_from_parts(p: Column) -> Column:
    return F.coalesce(_fre(p), F.lit(0.0))


def fkgl_from_parts(p: Column) -> Column:
    return F.coalesce(_fkgl(p), F.lit(0.0))
