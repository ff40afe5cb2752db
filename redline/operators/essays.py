"""Essay conversion: character edits on raw essays -> paragraph-level edits -> M2
(SURVEY C-04..C-06, C-09, S-11, J-02, J-04..J-08, W-04).

Everything is keyed by essay, then by paragraph, then by sentence. Paragraphs and
edits meet in ordered passes over the essay's positions, never pair by pair.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from redline.functions import patterns as pt
from redline.functions.hof import let
from redline.functions.offsets import running_starts
from redline.functions.text import normalize_punct, words
from redline.operators.edits import PUNCTUATION, apply_edits, assign_to_sentences, common_prefix_len, common_suffix_len
from redline.session import written


def paragraphs(df: DataFrame, id_col: str = "essay_id", text_col: str = "text") -> DataFrame:
    """C-04: maximal runs of non-newline characters with their character
    offsets: (id, para_no, p_start, p_end, para). Offsets are a running sum
    over the lengths of the newline-separated parts (in-row, no shuffle)."""
    parts = df.select(id_col, F.split(F.col(text_col), "\n", -1).alias("parts"))
    located = parts.select(id_col, "parts", running_starts(F.transform("parts", lambda p: F.length(p) + 1)).alias("starts"))
    pairs = F.zip_with("starts", "parts", lambda s, p: F.struct(s.alias("p_start"), p.alias("para")))
    nonempty = F.filter(pairs, lambda x: F.length(x["para"]) > 0)
    x = located.select(id_col, F.posexplode(nonempty).alias("para_no", "p"))
    return x.select(id_col, F.col("para_no").cast("int").alias("para_no"), F.col("p.p_start").alias("p_start"),
                    (F.col("p.p_start") + F.length("p.para")).cast("int").alias("p_end"),
                    F.col("p.para").alias("para"))


def classify_edits(edits: DataFrame) -> DataFrame:
    """S-11: a NULL correction is a detection edit (kind 'D'); otherwise the
    given type, or 'C'. Correction text is punctuation-normalised."""
    return edits.withColumn("kind", F.when(F.col("cor").isNull(), F.lit("D"))
                            .otherwise(F.coalesce(F.col("type"), F.lit("C")))) \
                .withColumn("cor", F.when(F.col("cor").isNotNull(), normalize_punct("cor")))


def edits_to_paragraphs(edits: DataFrame, paras: DataFrame, id_col: str = "essay_id") -> DataFrame:
    """J-04: keep edits that lie inside one paragraph (start >= p_start and
    end <= p_end), offsets rebased to the paragraph; the others are dropped.

    Paragraphs don't overlap, so the one that can hold an edit is the last that
    starts at or before it: one pass over both in order of position within the
    essay, instead of every paragraph with every edit."""
    carried = [c for c in edits.columns if c not in (id_col, "start", "end")]
    e = edits.select(id_col, F.col("start").alias("_at"), F.lit(1).alias("_kind"), F.lit(None).cast(
        "struct<para_no:int,p_start:int,p_end:int>").alias("_p"), F.struct("start", "end", *carried).alias("_e"))
    p = paras.select(id_col, F.col("p_start").alias("_at"), F.lit(0).alias("_kind"), F.struct("para_no", "p_start", "p_end").alias("_p"),
                     F.lit(None).cast(e.schema["_e"].dataType).alias("_e"))
    w = Window.partitionBy(id_col).orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    met = e.unionByName(p).withColumn("_p", F.last("_p", ignorenulls=True).over(w)).where(F.col("_e").isNotNull())
    inside = met.where((F.col("_p").isNotNull()) & (F.col("_e.end") <= F.col("_p.p_end")))
    return inside.select(id_col, *[F.col(f"_e.{c}").alias(c) for c in carried], F.col("_p.para_no").alias("para_no"),
                         (F.col("_e.start") - F.col("_p.p_start")).alias("start"), (F.col("_e.end") - F.col("_p.p_start")).alias("end"))


def drop_covering_detections(edits: DataFrame, id_col: str = "essay_id") -> DataFrame:
    """J-05: drop a detection edit when a correction of the same coder and
    paragraph lies inside it (a non-empty correction span within it, or an
    insertion strictly inside it): the smallest end of the corrections that
    start no earlier, and of the insertions that start later, in one ordered pass."""
    w = Window.partitionBy(id_col, "coder", "para_no").orderBy(-F.col("start"))
    change, empty = F.col("kind") != "D", F.col("start") == F.col("end")
    held = F.min(F.when(change & ~empty, F.col("end"))).over(w.rangeBetween(Window.unboundedPreceding, 0))
    inserted = F.min(F.when(change & empty, F.col("end"))).over(w.rangeBetween(Window.unboundedPreceding, -1))
    covering = F.coalesce(held <= F.col("end"), F.lit(False)) | F.coalesce(inserted < F.col("end"), F.lit(False))
    return edits.withColumn("_covers", ~change & covering).where(~F.col("_covers")).drop("_covers")


def align_coders(paras: DataFrame, edits: DataFrame, coders: DataFrame, id_col: str = "essay_id") -> DataFrame:
    """J-02 / J-08: every paragraph of the essay (the first coder supplies the
    text) with the edit count of each coder, 0 (an explicit noop) when a
    coder has no edits there. `coders` are the raw rows (id, coder): a coder
    whose edits were all dropped is still one."""
    coders = coders.select(id_col, "coder").distinct()
    grid = paras.select(id_col, "para_no").join(coders, id_col)
    counts = edits.groupBy(id_col, "coder", "para_no").agg(F.count(F.lit(1)).alias("n_edits"))
    return grid.join(counts, [id_col, "coder", "para_no"], "left").select(
        id_col, "para_no", "coder", F.coalesce("n_edits", F.lit(0)).alias("n_edits"))


def clean_text(para) -> Column:
    """C-05: blanks -> ' ', blank runs collapsed to one, one leading blank removed."""
    return F.ltrim(F.regexp_replace(F.regexp_replace(para, pt.WS, " "), " {2,}", " "))


def place_edits(edits: DataFrame, paras: DataFrame, id_col: str = "essay_id", by=("coder", "ord")) -> DataFrame:
    """C-05 / J-06: the edits (id, para_no, start, end, ...) of paragraphs (id, para_no, para),
    offsets in the raw paragraph, with `start` and `end` moved to the cleaned paragraph (see
    `clean_text`; a span loses an edge blank) and their token span: t_start, t_end, and
    c_start, c_end, the widened characters, where the span cuts a token (else NULL). An
    insertion takes the token boundary it touches. All four are NULL without tokens.
    `by` names an edit within its paragraph.

    One ordered stream of tokens and edit ends per paragraph: running sums over the tokens
    give their raw and their cleaned places, and each end meets the last token that starts at
    or before it, from which everything follows. One exchange; no row holds a text or an
    array, so a long paragraph costs a sort, not a row that grows with it."""
    key = [id_col, "para_no"]
    carried = [c for c in edits.columns if c not in (*key, "start", "end")]
    word = F.split(F.regexp_replace("para", pt.WS, " "), " ", -1)
    lens = paras.where("para is not null").select(*key, F.lit(0).alias("_kind"), F.transform(word, lambda w: F.length(w)).alias("_lens"))
    ends = F.array(F.struct(F.lit(0).alias("side"), F.col("start").cast("int").alias("x")), F.struct(F.lit(1).alias("side"), F.col("end").cast("int").alias("x")))
    marks = edits.select(*key, F.lit(1).alias("_kind"), F.struct(*carried).alias("_e"), F.inline(ends).alias("_side", "_x"))
    both = lens.unionByName(marks, allowMissingColumns=True).repartition(*key)
    both = both.select(*[c for c in both.columns if c != "_lens"], F.posexplode_outer("_lens").alias("_k", "_len"))
    earlier = Window.partitionBy(*key).orderBy("_kind", "_k").rowsBetween(Window.unboundedPreceding, -1)
    total = lambda c: F.coalesce(F.sum(c).over(earlier), F.lit(0)).cast("int")
    solid = F.col("_len") > 0
    # of a token: its raw place, number and cleaned place; of an edit, after all tokens: those of the paragraph's end
    both = both.select("*", total(F.col("_len") + 1).alias("_raw"), total(F.when(solid, 1)).alias("_i"), total(F.when(solid, F.col("_len") + 1)).alias("_s"))
    token = F.when(solid, F.struct(F.col("_i").alias("i"), F.col("_s").alias("s"), (F.col("_s") + F.col("_len")).alias("e"), F.col("_raw").alias("raw")))
    so_far = Window.partitionBy(*key).orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    both = both.select("*", F.coalesce("_x", "_raw").alias("_at"), token.alias("_tok")).withColumn("_tok", F.last("_tok", ignorenulls=True).over(so_far))
    t = F.coalesce("_tok", F.struct(F.lit(0).alias("i"), F.lit(0).alias("s"), F.lit(-1).alias("e"), F.lit(0).alias("raw")))
    into = F.col("_x") - F.col("_t.raw")
    place = (F.when(F.col("_tok").isNull(), 0).when(into <= F.col("_t.e") - F.col("_t.s"), F.col("_t.s") + into)
             .when(F.col("_x") == F.col("_raw") - 1, F.col("_t.e") + 1).otherwise(F.col("_t.e")))
    met = both.where("_kind = 1").withColumn("_t", t)
    met = met.select(*key, *[F.col(f"_e.{c}").alias(c) for c in carried], "_side", F.struct(place.alias("v"), "_t.i", "_t.s", "_t.e").alias("_p"), F.col("_i").alias("_n"), (F.col("_s") - 1).alias("_last"))
    rest = [c for c in carried if c not in by]
    met = met.groupBy(*key, *by).agg(*[F.first(c).alias(c) for c in (*rest, "_n", "_last")], *[F.max(F.when(F.col("_side") == k, F.col("_p"))).alias(n) for k, n in ((0, "_a"), (1, "_b"))])
    return _token_span(met).select(*key, *carried, "start", "end", "t_start", "t_end", "c_start", "c_end")


def _token_span(met: DataFrame) -> DataFrame:
    """The rules of J-06 on `_a` and `_b`, the places of an edit's ends with the last token at
    or before them, in a paragraph of `_n` tokens that end at `_last`."""
    a, b, n, last = F.col("_a"), F.col("_b"), F.col("_n"), F.col("_last")
    is_span = a["v"] != b["v"]
    # a span that starts at a blank starts with the next token; one that ends after a blank ends with the token before
    late = is_span & (a["v"] == a["e"])
    early = is_span & (b["v"] > 0) & (((b["v"] == b["s"]) & (b["i"] > 0)) | (b["v"] == b["e"] + 1))
    before = early & (b["v"] == b["s"])
    d = met.select("*", (a["v"] + late.cast("int")).alias("start"), (b["v"] - early.cast("int")).alias("end"),
                   F.when(late & (a["i"] < n - 1), a["i"] + 1).otherwise(a["i"]).alias("_first"),
                   ((late & (a["i"] < n - 1)) | (~late & (a["v"] == a["s"]))).alias("_on_start"),
                   F.when(before, b["i"] - 1).otherwise(b["i"]).alias("_final"), (early | (b["v"] == b["e"])).alias("_on_end"))
    exact = F.col("_on_start") & F.col("_on_end")
    v = a["v"]
    at = (F.when(v <= 0, 0).when(v >= last, n).when(v == a["s"], a["i"]).when(v == a["e"], a["i"] + 1))
    inside = at.isNull()
    null, some = F.lit(None).cast("int"), n > 0
    is_span = F.col("start") != F.col("end")
    return d.select(
        "*",
        F.when(some, F.when(is_span, F.col("_first")).otherwise(F.coalesce(at, a["i"]))).alias("t_start"),
        F.when(some, F.when(is_span, F.col("_final") + 1).otherwise(F.coalesce(at, a["i"] + 1))).alias("t_end"),
        F.when(some, F.when(is_span, F.when(exact, null).otherwise(F.when(F.col("_on_start"), F.col("start")).otherwise(a["s"])))
               .when(inside, a["s"])).alias("c_start"),
        F.when(some, F.when(is_span, F.when(exact, null).otherwise(F.when(F.col("_on_end"), F.col("end")).otherwise(b["e"])))
               .when(inside, a["e"])).alias("c_end"))


def drop_overlapping(placed: DataFrame, id_col: str = "essay_id") -> DataFrame:
    """J-06: of each coder's edits in a paragraph, in the order of `ord`, those go that were
    widened and start before the end of the coder's last one that stays. What stays depends on
    what stayed before, so a coder's list is walked, with the end reached as the state."""
    key = [id_col, "para_no", "coder"]
    per = placed.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("ord", *[c for c in placed.columns if c not in (*key, "ord")]))).alias("l"))
    state = F.struct(F.lit(0).alias("reached"), F.array().cast("array<boolean>").alias("stays"))

    def step(acc: Column, x: Column) -> Column:
        return let(~(x["c_start"].isNotNull() & (x["t_start"] < acc["reached"])), lambda stays: F.struct(
            F.when(stays, x["t_end"]).otherwise(acc["reached"]).alias("reached"), F.concat(acc["stays"], F.array(stays)).alias("stays")))

    walked = per.select(*key, F.explode(F.arrays_zip("l", F.aggregate("l", state, step)["stays"].alias("stays"))).alias("x")).where("x.stays")
    return walked.select(*key, "x.l.*").select(*placed.columns)


def paragraph_tokens(paras: DataFrame, id_col: str = "essay_id", pre_split: bool = False) -> DataFrame:
    """C-05 / C-06 on (id, para_no, p_start, p_end, para): the cleaned paragraph, its
    tokens and the token ends of its sentences (one sentence if the text is
    `pre_split`). Paragraphs of blanks only go."""
    d = paras.withColumn("clean_para", clean_text("para")).where(F.trim("clean_para") != "")
    d = d.select(id_col, "para_no", "p_start", "p_end", "para", "clean_para", words("clean_para").alias("toks"))
    n = F.size("toks")
    closing = F.filter(F.transform("toks", lambda x, i: F.when(x.rlike(r"[.!?]$") | (i == n - 1), i + 1)), lambda i: i.isNotNull())
    return d.withColumn("sent_ends", F.array(n) if pre_split else closing)


def essays_to_m2(essays_df: DataFrame, edits: DataFrame, id_col: str = "essay_id", edit_mode: str = "gold",
                 pre_split: bool = False, merge: str = "all-merge") -> DataFrame:
    """C-09: essays + character edits per coder -> one M2 block per sentence.

    Text is normalised (P-16); paragraphs are cut and cleaned once and written to
    the shared folder with the ends of their sentences (C-04..C-06), and their tokens, a split
    of the cleaned text, are made again where they are read; edits find their paragraph and lose
    covering detections in ordered passes (J-04, J-05), and so they meet tokens and
    sentences (C-05, J-06, J-07); the placed edits of a paragraph then take its tokens'
    texts in one row; corrections are minimised and empty ones dropped (C-08),
    ordered by end, then start (W-04). Paragraphs meet their edits and their lines by the
    same key, so that their text is exchanged once, and are cut into sentences last; every coder of the essay gets lines or an
    explicit noop (J-02, J-08, K-05).

    edit_mode='auto' replaces the coder's edits by those of aligning the sentence
    with its corrected form (R-07, `merge`)."""
    if edit_mode not in ("gold", "auto"):
        raise ValueError("edit_mode must be 'gold' or 'auto'")
    key = [id_col, "para_no"]
    es = essays_df.select(id_col, normalize_punct("text").alias("text"))
    body = paragraph_tokens(paragraphs(es, id_col), id_col, pre_split).drop("toks")
    body = written(body.withColumn("clean_para", F.nullif("clean_para", "para")))  # mostly the paragraph as it is
    text = body.select(*key, F.coalesce("clean_para", "para").alias("clean_para"), "sent_ends")
    real = classify_edits(edits.select(id_col, "coder", "ord", "start", "end", "cor", "type").where("start is not null"))
    kept = drop_covering_detections(edits_to_paragraphs(real, body.select(*key, "p_start", "p_end"), id_col), id_col)
    cor = F.coalesce("cor", F.lit(""))
    closes = (F.col("kind") == "D") | (F.trim(cor) == "") | F.substring(F.rtrim(cor), -1, 1).isin(*PUNCTUATION)
    own = kept.select(*key, "coder", "ord", "start", "end", cor.alias("cor"), "kind", closes.alias("closes"))
    placed = drop_overlapping(place_edits(own, body.select(*key, "para"), id_col), id_col)
    bounds = F.transform("sent_ends", lambda e, i: F.struct(i.cast("int").alias("sent_no"), F.when(i == 0, 0).otherwise(F.get("sent_ends", i - 1)).alias("s_start"),
                                                            e.alias("s_end"), (i == F.size("sent_ends") - 1).alias("is_last")))
    sentences = body.select(*key, F.inline(bounds))
    assigned = assign_to_sentences(placed.withColumnsRenamed({"t_start": "o_start", "t_end": "o_end"}), sentences, key, F.col("closes"))
    per = assigned.groupBy(*key).agg(F.collect_list(F.struct(*[c for c in assigned.columns if c not in key])).alias("e"))
    met = text.join(per, key).withColumn("toks", words("clean_para"))
    char = lambda a, b: F.substr("clean_para", a + 1, F.greatest(b - a, F.lit(0)))

    def token_edit(x):
        wide = F.concat(char(x["c_start"], x["start"]), x["cor"], char(x["end"], x["c_end"]))
        base = F.when(x["sent_no"] == 0, 0).otherwise(F.get("sent_ends", x["sent_no"] - 1))
        own = F.slice("toks", base + x["o_start"] + 1, F.greatest(x["o_end"] - x["o_start"], F.lit(0)))
        new = F.when(x["kind"] == "D", own).otherwise(words(F.when(x["c_start"].isNotNull(), wide).otherwise(x["cor"])))
        return F.struct(x["sent_no"].alias("sent_no"), x["coder"].alias("coder"), x["ord"].alias("ord"), x["kind"].alias("type"),
                        x["o_start"].alias("o_start"), x["o_end"].alias("o_end"), own.alias("o"), new.alias("c"))

    rows = met.select(*key, F.explode(F.transform("e", token_edit)).alias("x")).select(*key, "x.*")
    at = [*key, "sent_no"]
    starts = F.concat(F.array(F.lit(0)), F.slice("sent_ends", 1, F.greatest(F.size("sent_ends") - 1, F.lit(0))))
    cut = F.zip_with(starts, "sent_ends", lambda s, e: F.array_join(F.slice("toks", s + 1, e - s), " "))
    if edit_mode == "gold":
        lines = _gold_lines(rows, at)
    else:
        lines = _auto_lines(rows, text.withColumn("toks", words("clean_para")).select(*key, F.posexplode(cut).alias("sent_no", "src")), at, merge)
    per_sent = lines.groupBy(*at).agg(F.sort_array(F.collect_list(F.struct("coder", "o_end", "o_start", "ord", "line"))).alias("lines"))
    coders = edits.groupBy(id_col).agg(F.sort_array(F.collect_set(F.col("coder").cast("int"))).alias("coders"))
    per_para = per_sent.groupBy(*key).agg(F.collect_list(F.struct("sent_no", "lines")).alias("per"))
    named = body.select(*key).distinct().join(coders, id_col)
    full = text.join(named, key).join(per_para, key, "left").withColumn("toks", words("clean_para"))
    own_lines = let(F.transform("per", lambda x: x["sent_no"]), lambda nos: F.transform(cut, lambda src, i: F.struct(
        src.alias("src"), F.get("per", F.array_position(nos, i).cast("int") - 1)["lines"].alias("lines"))))
    full = full.select(*key, "coders", F.posexplode_outer(own_lines).alias("sent_no", "x")).where("sent_no is not null").select(*at, "coders", "x.src", "x.lines")
    none = F.array().cast(full.schema["lines"].dataType)

    def of_coder(c):
        return let(F.filter(F.coalesce("lines", none), lambda x: x["coder"] == c), lambda own: F.when(
            F.size(own) == 0, F.concat(F.lit(pt.M2_NOOP_PREFIX), c.cast("string"))).otherwise(F.array_join(F.transform(own, lambda x: x["line"]), "\n")))

    block = F.concat(F.lit("S "), F.col("src"), F.lit("\n"), F.array_join(F.transform("coders", of_coder), "\n"))
    return full.select(*at, block.alias("block"))


def _line(start, end, c_str) -> Column:
    return F.format_string("A %d %d|||%s|||%s|||REQUIRED|||-NONE-|||%d", start, end, F.col("type"), c_str, F.col("coder"))


def _gold_lines(rows: DataFrame, at: list) -> DataFrame:
    """C-08 / W-04: the coder's own edits; corrections lose the tokens that both
    sides share at either end, and go if nothing is left."""
    det = F.col("type") == "D"
    d = rows.withColumn("p", F.when(det, 0).otherwise(common_prefix_len("o", "c")))
    d = d.withColumn("q", F.when(det, 0).otherwise(common_suffix_len("o", "c", F.col("p"))))
    d = d.select(*at, "coder", "ord", "type", (F.col("o_start") + F.col("p")).alias("o_start"), (F.col("o_end") - F.col("q")).alias("o_end"),
                 F.array_join(F.slice("c", F.col("p") + 1, F.greatest(F.size("c") - F.col("p") - F.col("q"), F.lit(0))), " ").alias("c_str"))
    d = d.where(~((F.col("type") != "D") & (F.col("o_start") == F.col("o_end")) & (F.col("c_str") == "")))
    return d.select(*at, "coder", "ord", "o_start", "o_end", _line(F.col("o_start"), F.col("o_end"), F.col("c_str")).alias("line"))


def _auto_lines(rows: DataFrame, sents: DataFrame, at: list, merge: str) -> DataFrame:
    """The edits of aligning each sentence with what the coder's edits make of it."""
    from redline.operators.levenshtein import levenshtein_edits

    own = rows.where(F.col("type") != "D").groupBy(*at, "coder").agg(F.collect_list(F.struct(
        "o_start", "o_end", F.array_join("c", " ").alias("c_str"), "type", "ord")).alias("e"))
    d = sents.join(own, at).select(*at, "coder", words("src").alias("a"), words(apply_edits("src", "e", "safe")).alias("b"))
    d = d.select(*at, "coder", F.posexplode(levenshtein_edits("a", "b", merge)).alias("ord", "x")).select(*at, "coder", "ord", "x.*")
    return d.select(*at, "coder", "ord", "o_start", "o_end", _line(F.col("o_start"), F.col("o_end"), F.col("c_str")).alias("line"))
