"""Learned sentence ends (C-06, P-23): which full stops belong to abbreviations.

An abbreviation is a short word that hardly ever stands without its full stop. Spark
counts how often every word has one, and the log-likelihood ratio of "this word always
has a full stop" against "as often as any word" is weighed by the word's length, its
inner full stops and how often it stands without one (the type-based step of
unsupervised sentence boundary detection by Kiss and Strunk, 2006). A full stop after a
learned abbreviation ends no sentence; other full stops, `!` and `?` do, closing quotes
and brackets after them included, and so does the end of the text.

The counts are one aggregation over all tokens, with partial sums. Tokens that end in a
full stop, one or two a sentence, are looked up in the learned table as in
`encode_with_vocab`: in the row while the table is small, by a join beyond that."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from redline.functions.hof import let
from redline.functions.text import words
from redline.operators.corpus import encode_with_vocab
from redline.session import written

#: Score from which a word is taken as an abbreviation.
THRESHOLD = 0.3
#: Share of full stops that an abbreviation is supposed to have.
SURE = 0.99

_OPENING, _CLOSING = r"^[\"'(\[]+", r"[\"')\]]+$"
FINAL = r"[.!?][\"')\]]*$"
_STOPPED = r"[^.]\.$"


def bare(token: Column) -> Column:
    """A token in lower case without the quotes and brackets around it."""
    return F.lower(F.regexp_replace(F.regexp_replace(token, _OPENING, ""), _CLOSING, ""))


def has_stop(token: Column) -> Column:
    """Whether a bare token ends in one full stop (not in dots)."""
    return token.rlike(_STOPPED)


def word_type(token: Column) -> Column:
    """The word of a bare token: without its full stop, or without other marks at its end."""
    return F.when(has_stop(token), F.substr(token, F.lit(1), F.length(token) - 1)).otherwise(F.regexp_replace(token, r"[.,;:!?]+$", ""))


def stop_counts(df: DataFrame, col: str) -> DataFrame:
    """(type, stopped, plain): how often each word with a letter stands with a full stop and
    without one in the token arrays `col`; the row of type NULL counts all other tokens.
    Tokens are counted as they stand first; patterns are tried on each distinct one. (For a plain
    explode Spark asks the array's size before, and so makes the tokens twice.)"""
    t = df.select(F.explode_outer(col).alias("t")).where("t is not null").groupBy("t").agg(F.count(F.lit(1)).alias("n")).select(bare(F.col("t")).alias("t"), "n")
    kind = F.when(word_type(F.col("t")).rlike(r"\p{L}"), word_type(F.col("t")))
    times = lambda some: F.coalesce(F.sum(F.when(some, F.col("n"))), F.lit(0))
    return t.select(kind.alias("type"), has_stop(F.col("t")).alias("s"), "n").groupBy("type").agg(
        times(F.col("s")).alias("stopped"), times(~F.col("s")).alias("plain"))


def abbreviation_scores(counts: DataFrame) -> DataFrame:
    """`counts` of `stop_counts` with the score of every word that has a full stop somewhere."""
    counts = written(counts)
    whole = counts.agg(F.sum("stopped").alias("s"), F.sum(F.col("stopped") + F.col("plain")).alias("n")).first()
    share = (whole.s or 0) / (whole.n or 1)
    if not 0 < share < 1:
        return counts.where("type is not null").where("stopped > 0").withColumn("score", F.lit(0.0))
    some, none = F.col("stopped").cast("double"), F.col("plain").cast("double")
    usual = some * F.ln(F.lit(share)) + none * F.ln(F.lit(1 - share))
    always = some * F.ln(F.lit(SURE)) + none * F.ln(F.lit(1 - SURE))
    size = F.length(F.replace("type", F.lit("."), F.lit(""))).cast("double")
    dots = F.length("type") - size + 1
    score = -2 * (usual - always) * dots * F.exp(-size - none * F.ln(size))
    return counts.where("type is not null").where("stopped > 0").withColumn("score", score)


def learn_abbreviations(df: DataFrame, col: str, threshold: float = THRESHOLD) -> DataFrame:
    """(type, stopped, plain, score) of the abbreviations in the token arrays `col`."""
    return written(abbreviation_scores(stop_counts(df, col)).where(F.col("score") >= threshold))


def final_marks(col) -> Column:
    """The tokens of an array that end in a final mark, as (at, w): their place from 1 and
    their text. Most tokens hold none of the marks, which is cheaper to ask than the pattern."""
    some = lambda t: t.contains(".") | t.contains("!") | t.contains("?")
    return F.filter(F.transform(col, lambda t, i: F.when(some(t), F.when(t.rlike(FINAL), F.struct((i + 1).alias("at"), t.alias("w"))))), lambda x: x.isNotNull())


def sentence_ends(df: DataFrame, col: str, abbreviations: DataFrame, key_cols) -> DataFrame:
    """(key_cols, col, ends): for every row with tokens the offsets after the tokens that end
    a sentence, the last one being the number of tokens; key_cols name a row."""
    return marked_ends(df, col, abbreviations, key_cols, (col,)).select(*key_cols, col, "ends")


def marked_ends(df: DataFrame, col: str, abbreviations: DataFrame, key_cols, carry=()) -> DataFrame:
    """(key_cols, carry, ends, marks): `ends` as `sentence_ends` gives them and, as `marks`, those
    that all final marks would give. Only the tokens that end in one are looked up, and a NULL
    for the end of a row, so that rows with tokens have one."""
    def stopped(t: Column) -> Column:
        return let(bare(t), lambda b: F.when(has_stop(b), F.substr(b, F.lit(1), F.length(b) - 1)))

    n = F.size(col)
    d = df.select(*key_cols, *carry, n.cast("int").alias("_n"), final_marks(col).alias("_final"))
    d = d.withColumn("_at", F.transform("_final", lambda x: x["at"])).withColumn("_stopped", F.concat(
        F.transform("_final", lambda x: stopped(x["w"])), F.when(F.col("_n") > 0, F.array(F.lit(None).cast("string"))).otherwise(F.array().cast("array<string>"))))
    table = abbreviations.select(F.col("type").alias("token"), F.lit(0).cast("long").alias("id"))
    known = encode_with_vocab(d.select(*key_cols, *carry, "_n", "_at", "_stopped"), "_stopped", table, key_cols, carry=(*carry, "_n", "_at"))
    inner = lambda at: F.concat(F.filter(at, lambda e: e < F.col("_n")), F.array("_n"))
    open_ = F.transform(F.filter(F.zip_with("_at", F.slice("ids", 1, F.size("_at")), lambda e, a: F.struct(e.alias("e"), a.alias("a"))), lambda x: x["a"].isNull()), lambda x: x["e"])
    return known.select(*key_cols, *carry, inner(open_).alias("ends"), inner(F.col("_at")).alias("marks"))


def count_sentences(df: DataFrame, text_col: str, key_cols, threshold: float = THRESHOLD) -> DataFrame:
    """P-23 with learned ends: (key_cols, n_sentences) of texts that have words."""
    d = df.select(*key_cols, words(text_col).alias("_tokens_of_text"))
    found = sentence_ends(d, "_tokens_of_text", learn_abbreviations(d, "_tokens_of_text", threshold), key_cols)
    return found.select(*key_cols, F.size("ends").alias("n_sentences"))
