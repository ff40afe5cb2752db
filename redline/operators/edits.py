"""Token-edit algebra.

An edit is STRUCT<o_start INT, o_end INT, c_str STRING, type STRING>
(plus `coder`/`ord` where they matter). Edit sets of one sentence live in one
row as an array, so comparing, applying and offsetting edits is in-row work
with no shuffle; only readers and the coder alignment need keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from redline.functions import patterns as pt
from redline.functions.hof import let as _let
from redline.functions.text import words

EDIT_DDL = "struct<o_start:int,o_end:int,c_str:string,type:string>"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def common_prefix_len(a, b) -> Column:
    """Length of the common prefix of two token arrays. Where one begins with the whole
    other, one comparison tells; else the tokens are walked up to the shorter's end."""
    def walk(x: Column, y: Column, n: Column) -> Column:
        eq = F.zip_with(x, y, lambda p, q: F.coalesce(p == q, F.lit(False)))
        return _let(F.array_position(eq, False), lambda pos: F.when(pos == 0, n).otherwise(pos - 1))

    def of(x: Column, y: Column, n: Column) -> Column:
        return _let(F.slice(x, 1, n), lambda u: _let(F.slice(y, 1, n), lambda v: F.when(u == v, n).otherwise(walk(u, v, n)))).cast("int")
    return _let(_c(a), lambda x: _let(_c(b), lambda y: _let(F.least(F.size(x), F.size(y)), lambda n: F.when(x.isNotNull() & y.isNotNull(), of(x, y, n)))))


def common_suffix_len(a, b, skip) -> Column:
    """Common suffix length, at most min(|a|,|b|) - skip (skip = prefix)."""
    a, b = _c(a), _c(b)
    cap = F.least(F.size(a), F.size(b)) - skip
    return F.when(cap == 0, F.lit(0)).otherwise(F.least(common_prefix_len(F.reverse(a), F.reverse(b)), cap)).cast("int")


def edit_type(o_start: Column, o_end: Column, c_str: Column) -> Column:
    """M (missing: insertion), U (unnecessary: deletion), R (replacement)."""
    return F.when(o_start == o_end, F.lit("M")).when(c_str == "", F.lit("U")).otherwise(F.lit("R"))


def span_edit(src_tok, tgt_tok) -> Column:
    """R-08: the single edit left after trimming the common prefix and suffix
    of two token arrays; NULL when the arrays are equal. The prefix length,
    suffix length and correction text are each bound once (`let`)."""
    def with_arrays(s: Column, t: Column) -> Column:
        def with_p(p: Column) -> Column:
            def with_q(q: Column) -> Column:
                o_end = (F.size(s) - q).cast("int")
                c_str = F.array_join(F.slice(t, p + 1, F.greatest(F.size(t) - q - p, F.lit(0))), " ")
                edit = _let(c_str, lambda c: F.struct(p.alias("o_start"), o_end.alias("o_end"), c.alias("c_str"),
                                                      edit_type(p, o_end, c).alias("type")))
                same = (p == F.size(s)) & (p == F.size(t))
                return F.when(same, F.lit(None).cast(EDIT_DDL)).otherwise(edit)
            return _let(common_suffix_len(s, t, p), with_q)
        return F.when(s.isNull() | t.isNull(), F.lit(None).cast(EDIT_DDL)).otherwise(
            _let(common_prefix_len(s, t), with_p))
    return _let(_c(src_tok), lambda s: _let(_c(tgt_tok), lambda t: with_arrays(s, t)))


def differing_places(s: Column, t: Column) -> Column:
    """The places (from 0) where two bound token arrays of one length differ."""
    return F.array_remove(F.transform(s, lambda x, i: F.when(x != F.get(t, i), i).otherwise(F.lit(-1))), -1)


def substitution_edits(src_tok, tgt_tok) -> Column:
    """Replacement edits where two equal-length token arrays differ, neighbours merged."""
    def runs(d: Column, t: Column) -> Column:
        first = F.filter(d, lambda x, k: F.coalesce(F.get(d, k - 1) != x - 1, F.lit(True)))
        last = F.filter(d, lambda x, k: F.coalesce(F.get(d, k + 1) != x + 1, F.lit(True)))
        return F.zip_with(first, last, lambda i, j: F.struct(
            i.cast("int").alias("o_start"), (j + 1).cast("int").alias("o_end"),
            F.array_join(F.slice(t, i + 1, j + 1 - i), " ").alias("c_str"), F.lit("R").alias("type")))
    return _let(_c(src_tok), lambda s: _let(_c(tgt_tok), lambda t: _let(differing_places(s, t), lambda d: runs(d, t))))


def pairs_to_align(src_tok, tgt_tok) -> Column:
    """STRUCT<s, t> of two token arrays where only an alignment can tell the edits, else
    NULL. Arrays that differ by one inserted or deleted stretch don't need one; nor do those
    of one length that differ in two places, or hold no token in both sides' differing
    places, as no alignment costs less than place by place. No lambda refers to another's
    variable: Spark doesn't find a Python helper whose argument nests them."""
    s, t = _c(src_tok), _c(tgt_tok)

    def walked(x: Column, y: Column) -> Column:
        pos = F.array_position(F.zip_with(x, y, lambda p, q: F.coalesce(p == q, F.lit(False))), False)
        return F.when(pos == 0, F.size(x)).otherwise(pos - 1)
    left, right = F.filter(s, lambda x, i: x != F.get(t, i)), F.filter(t, lambda x, i: x != F.get(s, i))
    crossed = (F.size(left) > 2) & F.arrays_overlap(left, right)
    least = F.least(F.size(s), F.size(t))
    begins = F.slice(s, 1, least) == F.slice(t, 1, least)
    rest = F.when(begins, F.lit(False)).otherwise(least > walked(s, t) + walked(F.reverse(s), F.reverse(t)))
    return F.when(F.when(s != t, F.when(F.size(s) == F.size(t), crossed).otherwise(rest)), F.struct(s.alias("s"), t.alias("t")))


def _unaligned_edits(s: Column, t: Column) -> Column:
    """The edits of rows that `pairs_to_align` leaves out."""
    none = F.array().cast(f"array<{EDIT_DDL}>")
    return F.when(s == t, none).when(F.size(s) == F.size(t), substitution_edits(s, t)).otherwise(as_edit_array(span_edit(s, t)))


def _or_empty(pair: Column) -> Column:
    """Empty arrays where there is no pair: of rows with NULL arrays, Spark's Arrow writer
    goes over a batch again for each row."""
    empty = F.array().cast("array<string>")
    return F.coalesce(pair, F.struct(empty.alias("s"), empty.alias("t")))


def aligned_edits(src_tok, tgt_tok) -> Column:
    """Token edits of src -> tgt by Levenshtein alignment, neighbours merged (R-07,
    'all-merge'). Only rows whose edits the place-wise comparison and the trimmed span
    (R-08) can't tell are aligned by the Python helper; the others reach it as empty arrays.
    Over many rows `with_aligned_edits` gives the same and holds less."""
    from redline.operators.levenshtein import pair_edits

    s, t = _c(src_tok), _c(tgt_tok)
    return F.coalesce(pair_edits(_or_empty(pairs_to_align(s, t))), _unaligned_edits(s, t))


def aligned_parts(name: str, src_tok, tgt_tok) -> dict[str, Column]:
    """What `with_aligned_edits` makes in the JVM for the edits `name`, by column: the pair to be
    aligned, and where there is none (which it asks of the column before) the edits."""
    return {f"_pair_{name}": pairs_to_align(src_tok, tgt_tok),
            f"_plain_{name}": F.when(F.col(f"_pair_{name}").isNull(), _unaligned_edits(_c(src_tok), _c(tgt_tok)))}


def with_aligned_edits(df: DataFrame, pairs: dict, keep) -> DataFrame:
    """The columns `keep` of `df` and, by name, the `aligned_edits` of pairs (src, tgt) of its
    token columns.

    Spark holds the rows that wait for a Python helper, on disk where memory is short. So what
    the pairs' arrays tell is made before, and the rows that wait have `keep`, their edits
    and, of those to be aligned, the pair. `pair` and `plain` are asked twice: Spark merges
    a projection of columns that are asked once into the next, and the arrays would wait too.
    Columns of `aligned_parts` that are there already are taken."""
    from redline.operators.levenshtein import pair_edits

    pair, plain = {n: f"_pair_{n}" for n in pairs}, {n: f"_plain_{n}" for n in pairs}
    made = {k: c for n, (s, t) in pairs.items() for k, c in aligned_parts(n, s, t).items() if k not in df.columns}
    d = df.select("*", *[made[c].alias(c) for c in pair.values() if c in made])
    d = d.select(*keep, *pair.values(), *[made[c].alias(c) if c in made else F.col(c) for c in plain.values()])
    kept = [c for c in d.columns if c not in (*pair.values(), *plain.values())]
    return d.select(*kept, *[F.when(F.col(pair[n]).isNull(), F.col(plain[n])).otherwise(
        F.coalesce(pair_edits(_or_empty(F.col(pair[n]))), F.col(plain[n]))).alias(n) for n in pairs])


def edit_key_strings(edits) -> Column:
    """'start|end|c_str|type' per edit (for display and SQL comparison)."""
    return F.transform(_c(edits), lambda e: F.format_string(
        "%d|%d|%s|%s", e["o_start"], e["o_end"], e["c_str"], e["type"]))


def as_edit_array(edit) -> Column:
    """Single (nullable) edit -> array of 0 or 1 edits."""
    e = _c(edit)
    return F.when(e.isNull(), F.array().cast(f"array<{EDIT_DDL}>")).otherwise(F.array(e))


def edit_key(edits) -> Column:
    """The 4-field comparison key of each edit (drops coder/ordinal fields)."""
    return F.transform(_c(edits), lambda e: F.struct(
        e["o_start"].alias("o_start"), e["o_end"].alias("o_end"),
        e["c_str"].alias("c_str"), e["type"].alias("type")))


def edit_confusion(hyp_arr, ref_arr) -> Column:
    """R-09: STRUCT<tp, fp, fn> of two edit arrays, set semantics on the 4-field key
    (NULL arrays count as empty). Wrap single edits with `as_edit_array`. Both key
    sets are built once; what is not in common is the rest of either."""
    empty = F.array().cast(f"array<{EDIT_DDL}>")

    def keyed(x):
        return F.array_distinct(edit_key(F.coalesce(_c(x), empty)))

    def counts(h, r):
        return _let(F.size(F.array_intersect(h, r)).cast("long"), lambda tp: F.struct(
            tp.alias("tp"), (F.size(h) - tp).alias("fp"), (F.size(r) - tp).alias("fn")))
    return _let(keyed(hyp_arr), lambda h: _let(keyed(ref_arr), lambda r: counts(h, r)))


def edit_confusion_counts(hyp_arr, ref_arr) -> tuple[Column, Column, Column]:
    """R-09 as three columns."""
    c = edit_confusion(hyp_arr, ref_arr)
    return c["tp"], c["fp"], c["fn"]


def edit_pr(hyp_arr, ref_arr) -> tuple[Column, Column]:
    """R-10: per-sentence precision and recall with list membership.
    No hypothesis edits -> both 1 if there are no reference edits, else 0."""
    def calc(h: Column, r: Column, want_p: bool) -> Column:
        tp = F.size(F.filter(h, lambda e: F.array_contains(r, e))).cast("double")
        nh, nr = F.size(h), F.size(r)
        none = F.when(nr == 0, F.lit(1.0)).otherwise(F.lit(0.0))
        if want_p:
            return F.when(nh == 0, none).otherwise(tp / nh)
        return F.when(nh == 0, none).when(nr == 0, F.lit(0.0)).otherwise(tp / nr)

    def both(want_p):
        return _let(edit_key(_c(hyp_arr)), lambda h: _let(edit_key(_c(ref_arr)), lambda r: calc(h, r, want_p)))
    return both(True), both(False)


def apply_edits(src, edits, mode: str = "reference") -> Column:
    """C-01: apply token edits right to left and join with blanks.

    mode='reference': order by start only, descending, stable on `ord`
    (an insertion and a replacement at the same start: the replacement, applied
    last, overwrites the insertion; SURVEY F6).
    mode='safe': order by (start, end, ord) descending.
    '' and '-NONE-' replacements delete.
    """
    toks = words(src)
    if mode == "reference":
        keyed = F.transform(_c(edits), lambda e: F.struct(
            (-e["o_start"]).alias("k1"), F.lit(0).alias("k2"), e["ord"].alias("k3"), e.alias("e")))
    elif mode == "safe":
        keyed = F.transform(_c(edits), lambda e: F.struct(
            (-e["o_start"]).alias("k1"), (-e["o_end"]).alias("k2"), (-e["ord"]).alias("k3"),
            e.alias("e")))
    else:
        raise ValueError("mode must be 'reference' or 'safe'")
    ordered = F.transform(F.sort_array(keyed), lambda x: x["e"])

    def step(t, e):
        repl = F.when(e["c_str"].isin(*pt.M2_DELETE_MARKERS), F.array().cast("array<string>")) \
                .otherwise(words(e["c_str"]))
        head = F.when(e["o_start"] > 0, F.slice(t, 1, e["o_start"])) \
                .otherwise(F.array().cast("array<string>"))
        tail = F.slice(t, e["o_end"] + 1, F.greatest(F.size(t) - e["o_end"], F.lit(0)))
        return F.concat(head, repl, tail)

    return F.array_join(F.aggregate(ordered, toks, step), " ")


def corrected_spans(edits: DataFrame, keys, ord_col: str = "ord") -> DataFrame:
    """W-01 / C-07: add cor_start / cor_end (token offsets in the corrected
    sentence) to edit rows (keys, ord, o_start, o_end, c_str): the running sum of
    len(cor) - (o_end - o_start) over the edits listed before in the sentence."""
    n = F.size(words(F.coalesce("c_str", F.lit(""))))
    before = Window.partitionBy(*keys).orderBy(ord_col).rowsBetween(Window.unboundedPreceding, -1)
    moved = F.coalesce(F.sum("_delta").over(before), F.lit(0))
    d = edits.withColumn("_n", n).withColumn("_delta", F.col("_n") - (F.col("o_end") - F.col("o_start")))
    d = d.withColumn("cor_start", (F.col("o_start") + moved).cast("int"))
    return d.withColumn("cor_end", (F.col("cor_start") + F.col("_n")).cast("int")).drop("_n", "_delta")


def corrected_sentence(src_tok, edits) -> Column:
    """C-07: the corrected sentence, blank-joined, from edits listed in order of
    position: what stands before each edit, its correction, and the rest."""
    t, e = _c(src_tok), _c(edits)
    before = F.concat(F.array(F.lit(0)), F.transform(e, lambda x: x["o_end"]))
    kept = F.zip_with(F.slice(before, 1, F.size(e)), e, lambda at, x: F.concat(
        F.slice(t, at + 1, F.greatest(x["o_start"] - at, F.lit(0))), words(F.coalesce(x["c_str"], F.lit("")))))
    rest = F.slice(t, F.element_at(before, -1) + 1, F.greatest(F.size(t) - F.element_at(before, -1), F.lit(0)))
    return F.array_join(F.concat(F.flatten(kept), rest), " ")


def drop_empty_edits(edits) -> Column:
    """C-08: drop edits minimised to nothing (o_start == o_end and empty c_str)."""
    return F.filter(_c(edits), lambda e: ~((e["o_start"] == e["o_end"]) & (F.coalesce(e["c_str"], F.lit("")) == "")))


def m2_edit_line(edit: Column, coder) -> Column:
    """One M2 annotation line for an edit."""
    return F.format_string("A %d %d|||%s|||%s|||REQUIRED|||-NONE-|||%s",
                           edit["o_start"], edit["o_end"], edit["type"],
                           F.coalesce(edit["c_str"], F.lit("")), _c(coder).cast("string"))


def m2_block(src_tok, coder_edits) -> Column:
    """K-05 / J-08: an M2 block: `S` line, the A lines of every coder in coder
    order (an explicit noop for a coder without edits), no trailing blank.

    coder_edits: ARRAY<STRUCT<coder INT, edits ARRAY<EDIT>>>."""
    per_coder = F.transform(
        F.sort_array(_c(coder_edits)),
        lambda ce: F.when(F.size(ce["edits"]) == 0,
                          F.concat(F.lit(pt.M2_NOOP_PREFIX), ce["coder"].cast("string")))
        .otherwise(F.array_join(F.transform(ce["edits"], lambda e: m2_edit_line(e, ce["coder"])), "\n")))
    return F.concat(F.lit("S "), F.array_join(_c(src_tok), " "), F.lit("\n"),
                    F.array_join(per_coder, "\n"))


def parse_m2_edits(a_lines) -> Column:
    """S-03: parse annotation lines into edits (start, end, replacement, ord);
    non-matching lines (e.g. the -1 -1 noop) are dropped. Uses try_cast: under
    ANSI mode a plain cast of '' fails."""
    parsed = F.transform(_c(a_lines), lambda ln, i: F.struct(
        F.regexp_extract(ln, pt.M2_EDIT_RE, 1).try_cast("int").alias("o_start"),
        F.regexp_extract(ln, pt.M2_EDIT_RE, 2).try_cast("int").alias("o_end"),
        F.trim(F.regexp_extract(ln, pt.M2_EDIT_RE, 3)).alias("c_str"),
        F.regexp_extract(ln, r"^A -?\d+ -?\d+\|\|\|([^|]*)\|\|\|", 1).alias("type"),
        F.regexp_extract(ln, r"\|\|\|([^|]*)$", 1).try_cast("int").alias("coder"),
        i.alias("ord")))
    return F.filter(parsed, lambda e: e["o_start"].isNotNull() & e["o_end"].isNotNull())


def m2_to_pairs(blocks: DataFrame, block_col: str = "block", mode: str = "reference") -> DataFrame:
    """C-02: M2 blocks -> (input_text, target_text). All annotators' edits are
    applied together (as the reference does) unless mode='safe'."""
    lines = F.split(F.col(block_col), "\n")
    src = F.substr(F.element_at(lines, 1), F.lit(3))
    a_lines = F.filter(lines, lambda ln: ln.startswith("A "))
    edits = parse_m2_edits(a_lines)
    return blocks.select("*", src.alias("input_text"), edits.alias("_edits")) \
        .select(*[c for c in blocks.columns], "input_text",
                apply_edits(F.col("input_text"), F.col("_edits"), mode).alias("target_text"))


def split_m2_blocks(text) -> Column:
    """S-02: a chunk of M2 text -> blocks; a block starts at every `S ` line,
    so an `S` line directly after another one still starts a new block, and
    blank-line runs of any length separate blocks."""
    parts = F.split(_c(text), r"\n(?=S )|\n{2,}")
    return F.filter(F.transform(parts, lambda p: F.regexp_replace(p, r"^\n+|\n+$", "")),
                    lambda p: p.startswith("S "))


# Fixed value: characters that count as sentence-final / correction-final punctuation.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_SENT_END_TOKEN = r"[.!?]$"


def sentence_spans(tok) -> Column:
    """C-06: split a token array into sentences at tokens ending in . ! or ?
    (the paragraph end closes the last one, which is empty in a text without
    tokens): ARRAY<STRUCT<sent_no, s_start, s_end, is_last>> with token offsets
    [s_start, s_end)."""
    def spans(t: Column) -> Column:
        n = F.size(t)
        ends = F.filter(F.transform(t, lambda x, i: F.when(x.rlike(_SENT_END_TOKEN), i + 1)),
                        lambda e: e.isNotNull())
        ends = F.when((F.size(ends) == 0) | (F.element_at(ends, -1) < n), F.concat(ends, F.array(n))) \
                .otherwise(ends)

        def build(en: Column) -> Column:
            starts = F.concat(F.array(F.lit(0)), F.slice(en, 1, F.greatest(F.size(en) - 1, F.lit(0))))
            return F.zip_with(starts, en, lambda s, e: F.struct(s.alias("s_start"), e.alias("s_end")))
        return _let(_let(ends, build), lambda ps: F.transform(ps, lambda p, i: F.struct(
            i.cast("int").alias("sent_no"), p["s_start"].cast("int").alias("s_start"),
            p["s_end"].cast("int").alias("s_end"), (i == F.size(ps) - 1).alias("is_last"))))
    return _let(_c(tok), spans)


def assign_to_sentences(edits: DataFrame, sents: DataFrame, keys, closes: Column | None = None) -> DataFrame:
    """J-07: token edits -> the sentence they belong to, offsets rebased.

    Inside [s_start, s_end) and ending by s_end: that sentence. Starting
    inside but ending past s_end: dropped (cross-boundary). An insertion at
    s_end belongs to that sentence if it is the last one, or if it `closes` a
    sentence (the correction is empty or ends in punctuation, if not given);
    otherwise to the next sentence.

    Sentences and edits pass by in order of place within the keys; an edit meets
    the last sentence that starts at or before it, and the one before that."""
    keys = list(keys)
    if closes is None:
        cor = F.coalesce("c_str", F.lit(""))
        closes = (cor == "") | F.substring(cor, -1, 1).isin(*list(PUNCTUATION))
    carried = [c for c in edits.columns if c not in keys]
    e = edits.select(*keys, F.col("o_start").alias("_at"), F.lit(1).alias("_kind"), F.struct(*carried, closes.alias("_closes")).alias("_e"))
    s = sents.select(*keys, F.col("s_start").alias("_at"), F.lit(0).alias("_kind"), F.struct("s_start", "s_end", "sent_no").alias("_s"))
    w = Window.partitionBy(*keys).orderBy("_at", "_kind")
    both = e.unionByName(s, allowMissingColumns=True)
    both = both.withColumn("_p", F.last("_s", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    pair = F.when(F.col("_s").isNotNull(), F.struct(F.col("_s").alias("own"), F.col("_p").alias("before")))
    met = both.withColumn("_m", F.last(pair, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))).where("_e is not null and _m is not null")
    insertion = F.col("_e.o_start") == F.col("_e.o_end")
    back = insertion & (F.col("_e.o_start") == F.col("_m.own.s_start")) & F.col("_m.before").isNotNull() & F.col("_e._closes")
    to = F.when(back, F.col("_m.before")).otherwise(F.col("_m.own"))
    met = met.withColumn("_to", to).where((F.col("_e.o_end") <= F.col("_to.s_end")) & ((F.col("_e.o_start") < F.col("_to.s_end")) | insertion))
    keep = [F.col(f"_e.{c}").alias(c) for c in carried if c not in ("o_start", "o_end")]
    return met.select(*keys, *keep, F.col("_to.sent_no").alias("sent_no"), (F.col("_e.o_start") - F.col("_to.s_start")).alias("o_start"),
                      (F.col("_e.o_end") - F.col("_to.s_start")).alias("o_end"))
