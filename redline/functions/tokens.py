"""Tokenisation, n-grams and token-set algebra."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from redline.functions import patterns as pt
from redline.functions.hof import let


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


# The public Penn Treebank tokenisation rules (R. MacIntyre, 1995), as ordered regex rewrites, then split on blanks.
# Quotes, ellipsis, punctuation, brackets, double dashes and clitics are split off.
TREEBANK_RULES = [
    (r'^"', "`` "),
    (r"(``)", " $1 "),
    (r'([ (\[{<])"', "$1 `` "),
    (r"\.\.\.", " ... "),
    (r"([;@#$%&?!])", " $1 "),
    (r"([^.])(\.)([\]\)}>\"']*)[ \t]*$", "$1 $2$3 "),
    (r",([^0-9])", " , $1"),
    (r":([^0-9])", " : $1"),
    (r"([\]\[\(\)\{\}<>])", " $1 "),
    (r"--", " -- "),
    (r'"', " '' "),
    (r"([^' ])('[sS]|'[mM]|'[dD]|') ", "$1 $2 "),
    (r"([^' ])('ll|'LL|'re|'RE|'ve|'VE|n't|N'T) ", "$1 $2 "),
    (r"(?i)\b(can)(not)\b", "$1 $2"),
    (r"(?i)\b(gon)(na)\b", "$1 $2"),
]


def tokens(col, mode: str = "portable", lower: bool = True) -> Column:
    """P-21: lower-cased word tokens.

    portable: regex word runs / single symbols (identical in Java and RE2).
    treebank: ordered rewrite chain in the style of the Penn Treebank rules.
    """
    x = F.lower(_c(col)) if lower else _c(col)
    if mode == "portable":
        return F.regexp_extract_all(x, F.lit(pt.WORD_RE), 0)
    if mode == "treebank":
        x = F.concat(F.lit(" "), x, F.lit(" "))
        for pat, rep in TREEBANK_RULES:
            x = F.regexp_replace(x, pat, rep)
        return F.array_remove(F.split(F.trim(x), pt.WS_RUN), "")
    raise ValueError(f"unknown tokenizer mode {mode!r}")


def ngrams(tok, min_n: int = 1, max_n: int = 4) -> Column:
    """P-22: every n-gram of order min_n..max_n, tokens joined by a blank.

    Order k+1 is built from order k by `zip_with` against the token array
    shifted by k; each order is bound once with `let`, and no lambda refers to
    an outer expression. Tokens never contain blanks, so grams of different
    orders cannot collide.
    """
    def build(t: Column) -> Column:
        n_tok = F.size(t)

        def order(n: int, cur: Column, acc: list) -> Column:
            keep = acc + ([F.when(n_tok >= n, cur).otherwise(F.array().cast("array<string>"))]
                          if n >= min_n else [])
            if n == max_n:
                return F.flatten(F.array(*keep))
            shifted = F.slice(t, n + 1, F.greatest(n_tok - n, F.lit(0)))
            nxt = F.zip_with(F.slice(cur, 1, F.greatest(n_tok - n, F.lit(0))), shifted,
                             lambda a, b: F.concat(a, F.lit(" "), b))
            return let(nxt, lambda c: order(n + 1, c, keep))

        return order(1, t, [])

    return let(_c(tok), build)


def hashed_ngrams(tok, max_n: int = 4) -> Column:
    """The n-grams of orders 1..max_n as 64-bit hashes, an array per order: the hash
    of order k+1 combines that of order k with the next token's."""
    def build(t: Column) -> Column:
        n_tok = F.size(t)

        def order(n: int, cur: Column, acc: list) -> Column:
            if n == max_n:
                return F.array(*acc, cur)
            size = F.greatest(n_tok - n, F.lit(0))
            nxt = F.zip_with(F.slice(cur, 1, size), F.slice(t, n + 1, size), lambda a, b: F.xxhash64(a, b))
            return let(nxt, lambda c: order(n + 1, c, [*acc, cur]))

        return order(1, t, [])

    return let(F.transform(_c(tok), lambda w: F.xxhash64(w)), build)


def value_counts(arr) -> Column:
    """Sorted distinct values with their counts: ARRAY<STRUCT<v, c>>.

    Sort, flag run starts by comparing with the array shifted by one, keep
    the start positions, and take differences of consecutive starts. Every
    step is linear after the native sort, and every intermediate is bound
    once (`let`)."""
    def counted(x: Column) -> Column:
        n = F.size(x)
        prev = F.concat(F.transform(F.slice(x, 1, 1), lambda v: F.nullif(v, v)), F.slice(x, 1, F.greatest(n - 1, F.lit(0))))
        starts = F.filter(
            F.zip_with(F.zip_with(x, prev, lambda cur, p: p.isNull() | (cur != p)),
                       F.sequence(F.lit(1), F.greatest(n, F.lit(1))),
                       lambda flag, i: F.when(flag, i)),
            lambda i: i.isNotNull())

        def with_starts(st: Column) -> Column:
            ends = F.concat(F.slice(st, 2, F.greatest(F.size(st) - 1, F.lit(0))), F.array(n + 1))
            counts = F.zip_with(st, ends, lambda a, b: b - a)
            return F.zip_with(F.array_distinct(x), counts,
                              lambda v, c: F.struct(v.alias("v"), c.cast("int").alias("c")))

        none = F.transform(x, lambda v: F.struct(v.alias("v"), F.lit(0).alias("c")))
        return F.when(n == 0, none).otherwise(let(starts, with_starts))

    return let(F.sort_array(_c(arr)), counted)


def _repeats(x: Column) -> Column:
    """Every occurrence of a value but one: the elements of the sorted array that equal the one before."""
    def pick(s: Column) -> Column:
        n = F.size(s) - 1
        same = F.zip_with(F.slice(s, 2, n), F.slice(s, 1, n), lambda cur, prev: F.when(cur == prev, cur))
        return F.filter(same, lambda v: v.isNotNull())
    return let(F.sort_array(x), pick)


def overlap(a: Column, b: Column) -> Column:
    """Sum over distinct values g of min(count_a(g), count_b(g)), for bound arrays:
    each value in both counts once, by the native intersection, and once more for
    every further occurrence on both sides. Only rows that repeat values on both
    sides have any."""
    repeated = (F.size(F.array_distinct(a)) < F.size(a)) & (F.size(F.array_distinct(b)) < F.size(b))
    more = F.when(repeated, multiset_overlap(_repeats(a), _repeats(b))).otherwise(F.lit(0).cast("long"))
    return F.size(F.array_intersect(a, b)) + more


def _common_start(x: Column, y: Column) -> Column:
    """Length of the common prefix of two arrays of one length that differ."""
    eq = F.zip_with(x, y, lambda i, j: F.coalesce(i == j, F.lit(False)))
    return (F.array_position(eq, False) - 1).cast("int")


def ngram_overlap(x: Column, y: Column, max_n: int = 4) -> Column:
    """Sum over the n-grams g of orders 1..max_n of min(count_x(g), count_y(g)), for bound
    token arrays that differ. Grams that stand in both are shared: taking as many of each from
    both sides takes as many from the smaller count. So only those that touch a difference
    are counted, as 64-bit hashes. Arrays are held against each other place by place (what
    the longer has beyond the shorter's end differs); where one is moved against the
    other, so that more places differ than common prefix and suffix leave, by those. The
    hashes of all orders are one array: those of different orders differ."""
    none = F.array().cast("array<int>")
    least, most = F.least(F.size(x), F.size(y)), F.greatest(F.size(x), F.size(y))

    def span(first: Column, last: Column) -> Column:
        return F.when(first <= last, F.sequence(first, F.greatest(first, last))).otherwise(none)

    def near(t: Column, n: Column, w: Column) -> Column:
        """Starts of the grams of `t` that touch a differing place, each once: those of a place begin after the last of the one before."""
        before = F.concat(F.array(F.lit(-1)), w["d"])
        return F.flatten(F.zip_with(w["d"], F.slice(before, 1, F.size(w["d"])), lambda i, j: span(F.greatest(i - n + 1, j + 1, F.lit(0)), F.least(i, F.size(t) - n))))

    def starts(t: Column, n: Column, w: Column) -> Column:
        return F.when(w["d"].isNotNull(), near(t, n, w)).otherwise(span(F.greatest(w["p"] - n + 1, F.lit(0)), F.least(F.size(t) - n, F.size(t) - w["q"] - 1)))

    def grams(t: Column, n: int, w: Column) -> Column:
        # token by token: for a slice Spark copies the whole array, and does so for each gram
        return F.transform(starts(t, F.lit(n), w), lambda i: F.xxhash64(*[F.get(t, i + k) for k in range(n)]))

    def all_grams(t: Column, w: Column) -> Column:
        return F.flatten(F.array(*[grams(t, n, w) for n in range(1, max_n + 1)]))

    def counted(w: Column) -> Column:
        return let(all_grams(x, w), lambda u: let(all_grams(y, w), lambda v: ngram_total(x, 1, max_n) - F.size(u) + overlap(u, v)))

    def prefix(u: Column, v: Column) -> Column:
        return let(F.slice(u, 1, least), lambda a: let(F.slice(v, 1, least), lambda b: F.when(a == b, least).otherwise(_common_start(a, b))))

    def edges(d: Column, p: Column) -> Column:
        """Common prefix `p` and suffix where they leave fewer places than `d`, else `d`."""
        rest = let(F.least(prefix(F.reverse(x), F.reverse(y)), least - p), lambda q: F.struct(
            F.when(F.size(d) <= most - p - q, d).alias("d"), p.alias("p"), q.alias("q")))
        return F.when((F.size(x) == F.size(y)) | (F.size(d) <= most - least + 2), F.struct(d.alias("d"), F.lit(0).alias("p"), F.lit(0).alias("q"))).otherwise(rest)
    longer, shorter = F.when(F.size(x) < F.size(y), y).otherwise(x), F.when(F.size(x) < F.size(y), x).otherwise(y)
    places = let(shorter, lambda s: F.array_remove(F.transform(longer, lambda w, i: F.when(w == F.get(s, i), F.lit(-1)).otherwise(i)), -1))

    def of_places(d: Column) -> Column:
        p = F.coalesce(F.least(F.get(d, F.lit(0)), least), least)
        begins = F.least(ngram_total(x, 1, max_n), ngram_total(y, 1, max_n))  # where one begins with the whole other
        return let(p, lambda p: F.when(p == least, begins.cast("long")).otherwise(let(edges(d, p), counted).cast("long")))
    return let(places, of_places)


def multiset_overlap(a, b) -> Column:
    """Sum over distinct values g of min(count_a(g), count_b(g)).

    In-row and shuffle-free (used by GLEU, R-01): count values on each side,
    merge the two sorted (value, count) lists with one more sort, so equal
    values of the two sides become neighbours, and add min(count) over
    neighbouring pairs with the same value."""
    def total(merged: Column) -> Column:
        nxt = F.slice(merged, 2, F.greatest(F.size(merged) - 1, F.lit(0)))
        pair_min = F.zip_with(merged, nxt, lambda x, y: F.when(
            y.isNotNull() & (x["v"] == y["v"]), F.least(x["c"], y["c"])).otherwise(F.lit(0)))
        return F.aggregate(pair_min, F.lit(0).cast("long"), lambda acc, v: acc + v)

    return let(F.sort_array(F.concat(value_counts(a), value_counts(b))), total)


def ngram_total(tok, min_n: int = 1, max_n: int = 4) -> Column:
    """Number of n-grams of orders min_n..max_n: sum of max(L - n + 1, 0)."""
    n_tok = F.size(_c(tok))
    total = F.lit(0)
    for n in range(min_n, max_n + 1):
        total = total + F.greatest(n_tok - n + 1, F.lit(0))
    return total
