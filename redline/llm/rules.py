"""Quality rules as a learned decision list.

Sequential covering: a conjunction of thresholds is grown on two thirds of the
labelled statistics by information gain, pruned on the last third, kept if it is
precise there, and its rows are removed; the next rule covers what is left. The
list is emitted as one ordered Spark conditional expression.

Defined results: a null or empty text has no words, all counts 0, base_failed true
and kept false; without labelled rows the list is empty and only the base decides. Of rules
of equal worth the longer one, of thresholds of equal gain the first is taken. Rows of the
same id are judged each by its own text. Only doc_id, text and quality are read, so other
columns may have any name; the stage keeps them. An empty table gives an empty result."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from redline.llm.common import cut, map_rows

STATS = ("doc_id long,n_words long,word_chars long,n_symbols long,n_dup_lines long,n_repeat_words long,"
         "n_lines long,n_upper long,n_letters long,n_digits long,n_marks long")

#: Labelled rows the list is learned from, at most (expected; drawn by hash of the id).
TRAIN_ROWS = 40_000


CONTINUATION = bytes(range(0x80, 0xC0))  # UTF-8 bytes that start no code point


def text_stats(text: str | None) -> tuple[int, ...]:
    """The counts of one whole text, in the order of STATS after doc_id."""
    raw = (text or "").encode("utf-8", "strict")
    words = raw.split()  # ASCII white space: blank, \t \n \v \f \r
    n = len(words)
    if not n:
        return (0,) * 10
    joined = b"".join(words)
    points = len(joined.translate(None, CONTINUATION))
    symbols = len(joined) - len(joined.translate(None, b"#*$%&|<>"))
    lines = [x for x in raw.split(b"\n") if x.split()]
    ids: dict[bytes, int] = {}
    code = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    repeated = 0
    if n >= 4:
        # windows as dense ids of pairs, then of (pair, third word)
        pair = np.unique(code[:-1] * len(ids) + code[1:], return_inverse=True)[1]
        _, inv, cnt = np.unique(pair[:-1] * len(ids) + code[2:], return_inverse=True, return_counts=True)
        hit = np.flatnonzero(cnt[inv] >= 2)
        mark = np.zeros(n, bool)
        for k in range(3):
            mark[hit + k] = True
        repeated = int(mark.sum())
    upper = len(joined) - len(joined.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    lower = len(joined) - len(joined.translate(None, b"abcdefghijklmnopqrstuvwxyz"))
    digits = len(joined) - len(joined.translate(None, b"0123456789"))
    return (n, points, symbols, len(lines) - len(set(lines)), repeated,
            len(lines), upper, upper + lower, digits, joined.count(b"!"))


def statistics(docs: DataFrame) -> DataFrame:
    return map_rows(docs.select("doc_id", "text"), STATS, lambda: lambda doc_id, text: (doc_id, *text_stats(text)))


#: Features of the rules: name -> (numerator, denominator or None).
FEATURES = {
    "n_words": ("n_words", None),
    "word_length": ("word_chars", "n_words"),
    "symbols_per_word": ("n_symbols", "n_words"),
    "dup_line_share": ("n_dup_lines", "n_lines"),
    "repeat_share": ("n_repeat_words", "n_words"),
    "upper_share": ("n_upper", "n_letters"),
    "digits_per_word": ("n_digits", "n_words"),
    "marks_per_word": ("n_marks", "n_words"),
    "words_per_line": ("n_words", "n_lines"),
}


def feature(name: str) -> Column:
    top, bottom = FEATURES[name]
    if bottom is None:
        return F.col(top).cast("double")
    return F.when(F.col(bottom) > 0, F.col(top) / F.col(bottom)).otherwise(F.lit(0.0))


@dataclass
class Rule:
    tests: list[tuple[str, str, float]] = field(default_factory=list)

    def covers(self, x: dict[str, np.ndarray]) -> np.ndarray:
        out = np.ones(len(next(iter(x.values()))), bool)
        for name, op, at in self.tests:
            out &= x[name] <= at if op == "<=" else x[name] > at
        return out

    def column(self) -> Column:
        cond = F.lit(True)
        for name, op, at in self.tests:
            cond = cond & (feature(name) <= F.lit(at) if op == "<=" else feature(name) > F.lit(at))
        return cond


def gain(p0: int, n0: int, p: np.ndarray, n: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        bits = np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0))
        return np.where(p > 0, p * bits, -np.inf)


def grow(x: dict[str, np.ndarray], bad: np.ndarray, most: int = 4) -> Rule:
    rule, on = Rule(), np.ones(len(bad), bool)
    while len(rule.tests) < most and bad[on].any() and (~bad[on]).any():
        best = (1e-9, None)
        p0, n0 = int(bad[on].sum()), int((~bad[on]).sum())
        for name, values in x.items():
            v, y = values[on], bad[on]
            order = np.argsort(v, kind="stable")
            v, y = v[order], y[order]
            ends = np.flatnonzero(v[:-1] < v[1:])
            if not len(ends):
                continue
            p, n = np.cumsum(y)[ends], np.cumsum(~y)[ends]
            middle = (v[ends] + v[ends + 1]) / 2
            for op, pp, nn in (("<=", p, n), (">", p0 - p, n0 - n)):
                g = gain(p0, n0, pp, nn)
                at = int(np.argmax(g))
                if g[at] > best[0]:
                    best = (g[at], (name, op, float(middle[at])))
        if best[1] is None:
            break
        rule.tests.append(best[1])
        on = rule.covers(x)
    return rule


def prune(rule: Rule, x: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    def worth(r: Rule) -> float:
        on = r.covers(x)
        p, n = int(bad[on].sum()), int((~bad[on]).sum())
        return (p - n) / (p + n) if p + n else -1.0

    cuts = [Rule(rule.tests[:k]) for k in range(len(rule.tests), 0, -1)]
    return max(cuts, key=worth) if cuts else rule  # ties: the longer rule


def learn(x: dict[str, np.ndarray], bad: np.ndarray, part: np.ndarray, precision: float = 0.9, least: int = 3, most: int = 16) -> list[Rule]:
    """`bad` marks rows to reject, `part` (bool) the pruning third."""
    rules: list[Rule] = []
    left = np.ones(len(bad), bool)
    for _ in range(2 * most):
        g, h = left & ~part, left & part
        if bad[g].sum() < least or len(rules) == most:
            break
        rule = prune(grow({k: v[g] for k, v in x.items()}, bad[g]), {k: v[h] for k, v in x.items()}, bad[h])
        on = rule.covers(x) & left
        p, n = int(bad[on].sum()), int((~bad[on]).sum())
        if not rule.tests or not on.any():
            break
        if p >= least and (p + 1) / (p + n + 2) >= precision:
            rules.append(rule)
        left &= ~on  # what an imprecise rule covers is left to the default: keep
    return rules


BASE_FAILED = "n_words < 50 or 100 * n_repeat_words > 50 * n_words"


def sample(labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """(of, quality) of about `train_rows` labelled rows at most, drawn by hash of the id."""
    marked = labels.select(F.col("doc_id").alias("of"), "quality").where("of is not null and quality is not null")
    total = marked.count()
    if total > train_rows:
        marked = marked.where(F.pmod(F.xxhash64("of"), F.lit(1 << 20)) < int((1 << 20) * train_rows / total))
    return marked


def fit(stats: DataFrame, marked: DataFrame) -> list[Rule]:
    """Learn the list from the rows of `stats` that `marked`, a bounded sample, labels,
    and that the base lets pass: the list decides on no others."""
    names = list(FEATURES)
    rows = (stats.join(F.broadcast(marked), F.col("doc_id") == F.col("of")).where(f"not ({BASE_FAILED})")
            .select(*[feature(n).alias(n) for n in names], F.col("quality").alias("_q"), F.pmod(F.xxhash64("of", F.lit(3)), F.lit(3)).alias("_part"))
            .toPandas().sort_values(["_part", "_q", *names]))
    x = {n: rows[n].to_numpy(float) for n in names}
    return learn(x, rows["_q"].to_numpy() == 0, rows["_part"].to_numpy() == 0)


def verdict(rules: list[Rule]) -> Column:
    """The number of the first rule that fires, 0 if none: one ordered conditional expression."""
    if not rules:
        return F.lit(0)
    expr = F.when(rules[0].column(), F.lit(1))
    for k, rule in enumerate(rules[1:], 2):
        expr = expr.when(rule.column(), F.lit(k))
    return expr.otherwise(F.lit(0))


def judge(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> tuple[DataFrame, list[Rule]]:
    """(doc_id, counts, base_failed, rule, kept) of every row, and the learned list.
    Texts are read once: the counts are written to the shared folder and learned from there."""
    stats = cut(statistics(docs))
    rules = fit(stats, sample(labels, train_rows))
    out = stats.withColumn("base_failed", F.expr(BASE_FAILED)).withColumn("rule", verdict(rules))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0)), rules


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return judge(docs, labels)[0].select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def keep(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """Stage: the rows of `docs` that pass, all columns. The list is learned from the
    labelled sample alone and applied to counts of each row's own text, without a join."""
    marked = sample(labels, train_rows)
    own = docs.select("doc_id", "text").join(F.broadcast(marked.select("of")), F.col("doc_id") == F.col("of"), "left_semi")
    rules = fit(statistics(own), marked)

    @F.pandas_udf("struct<" + STATS.split(",", 1)[1].replace(" ", ":") + ">")
    def counts(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([text_stats(t) for t in texts], columns=[c.split()[0] for c in STATS.split(",")[1:]])

    packed = docs.select(F.struct("*").alias("row"), counts("text").alias("s")).select("row", "s.*")
    return packed.where(f"not ({BASE_FAILED})").where(verdict(rules) == 0).select("row.*")
