"""Registered queries: essay conversion (C-04..C-09, S-11, J-02, J-04..J-06).

Essays are the driver's `documents` (punctuation-normalised). Three coders' edits
are derived from the whole essay: coder 0 corrects each ' the ' and marks the
first 20 characters as a detection; coder 1 marks each ' and ' and replaces the
whole essay (which crosses paragraphs whenever there are several, so J-04 drops
it); coder 2 corrects each ' of ', inserts inside the same word (J-06 drops the
widened edit that overlaps) and marks a detection around both (J-05)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from redline.functions import patterns as pt
from redline.functions.offsets import running_starts
from redline.functions.text import normalize_punct
from redline.operators.edits import PUNCTUATION
from redline.operators.essays import (
    align_coders,
    classify_edits,
    clean_text,
    drop_covering_detections,
    edits_to_paragraphs,
    paragraphs,
    place_edits,
)
from redline.plans import sql as S
from redline.plans.registry import register
from redline.session import read_table, spread, written


def essays(spark, sf_dir):
    d = spread(read_table(spark, sf_dir, "documents"))
    return d.select(F.col("doc_id").alias("essay_id"), normalize_punct("text").alias("text"))


#: What each occurrence of a literal gives: (literal, coder, first, last, correction); offsets from the blank before the word.
MARKS = ((" the ", 0, 1, 4, "a"), (" and ", 1, 1, 4, None), (" of ", 2, 1, 3, "off"), (" of ", 2, 2, 2, "x"), (" of ", 2, -3, 6, None))


#: Edits that each essay has once: (coder, end, correction, type); they start at 0.
ONCE = ((0, 20, None, None), (1, 2**31 - 1, "’x’", "R:OTHER"))


def essay_edits(es):
    """All coders' edits, numbered per essay and coder, from one pass over the texts."""
    found, rules = [], []
    for k, (word, coder, a, b, cor) in enumerate(MARKS):
        parts = F.split("text", word, -1)
        found.append(F.struct(F.lit(k).alias("k"), F.transform(F.slice(parts, 1, F.size(parts) - 1), lambda p: F.length(p)).alias("lens")))
        rules.append((len(word), coder, a, b, cor, None))
    for k, (coder, end, cor, kind) in enumerate(ONCE, len(MARKS)):
        found.append(F.struct(F.lit(k).alias("k"), F.array(F.lit(0)).alias("lens")))
        rules.append((0, coder, 0, end, cor, kind))
    marks = es.select("essay_id", F.length("text").alias("n"), F.inline(F.array(*found)))
    marks = marks.select("essay_id", "n", "k", F.posexplode(F.zip_with("lens", running_starts("lens"), lambda a, b: a + b)).alias("i", "before"))
    rule = F.array(*[F.struct(*[F.lit(v).cast(t).alias(c) for v, t, c in zip(
        r, ("int", "int", "int", "int", "string", "string"), ("len", "coder", "a", "b", "cor", "type"), strict=True)]) for r in rules])
    m = marks.select("essay_id", "n", "k", "i", F.element_at(rule, F.col("k") + 1).alias("r"),
                     (F.col("before") + F.col("i") * F.element_at(rule, F.col("k") + 1)["len"]).alias("at"))
    each = m.select("essay_id", "r.coder", "k", "i", F.greatest(F.col("at") + F.col("r.a"), F.lit(0)).cast("int").alias("start"),
                    F.least(F.col("at").cast("long") + F.col("r.b"), F.col("n")).cast("int").alias("end"), "r.cor", "r.type")
    w = Window.partitionBy("essay_id", "coder").orderBy("i", "k")
    return each.select("essay_id", "coder", (F.row_number().over(w) - 1).alias("ord"), "start", "end", "cor", "type")


_ESSAYS = f"""es AS (SELECT doc_id AS essay_id, translate(text, {S.q(pt.PUNCT_FROM)}, {S.q(pt.PUNCT_TO)}) AS text
               FROM documents)"""


def _marks_sql():
    out = []
    for k, (word, coder, a, b, cor) in enumerate(MARKS):
        c = "NULL::VARCHAR" if cor is None else S.q(cor)
        parts = f"string_split(text, {S.q(word)})"
        out.append(f"""SELECT essay_id, {coder} AS coder, {k} AS k, i, greatest(o + {a}, 0) AS start, least(o + {b}, n) AS "end", {c} AS cor, NULL::VARCHAR AS type
  FROM (SELECT essay_id, n, i - 1 AS i, m, sum(len) OVER (PARTITION BY essay_id ORDER BY i) + (i - 1) * {len(word)} AS o FROM (
    SELECT essay_id, length(text) AS n, len({parts}) AS m, generate_subscripts({parts}, 1) AS i, length(unnest({parts})) AS len FROM es)) WHERE i < m - 1""")
    return "\nUNION ALL ".join(out)


_EDITS = f"""{_ESSAYS},
mk AS ({_marks_sql()}
  UNION ALL SELECT essay_id, 0, 9, 0, 0, least(length(text), 20), NULL, NULL FROM es
  UNION ALL SELECT essay_id, 1, 9, 0, 0, length(text), '’x’', 'R:OTHER' FROM es),
ed AS (SELECT essay_id, coder, CAST(row_number() OVER (PARTITION BY essay_id, coder ORDER BY i, k) - 1 AS INTEGER) AS ord,
         CAST(start AS INTEGER) AS start, CAST("end" AS INTEGER) AS "end", cor, type FROM mk),
cl AS (SELECT essay_id, coder, ord, start, "end", type,
         CASE WHEN cor IS NULL THEN 'D' ELSE coalesce(type, 'C') END AS kind,
         translate(cor, {S.q(pt.PUNCT_FROM)}, {S.q(pt.PUNCT_TO)}) AS cor FROM ed)"""
EDITS_SQL = _EDITS
_PARAS = """parts AS (SELECT essay_id, unnest(string_split(text, chr(10))) AS para,
                 generate_subscripts(string_split(text, chr(10)), 1) AS idx FROM es),
pos AS (SELECT essay_id, idx, para, CAST(coalesce(sum(length(para) + 1) OVER (PARTITION BY essay_id ORDER BY idx
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS p_start FROM parts),
paras AS (SELECT essay_id, CAST(row_number() OVER (PARTITION BY essay_id ORDER BY idx) - 1 AS INTEGER) AS para_no,
          p_start, CAST(p_start + length(para) AS INTEGER) AS p_end, para FROM pos WHERE length(para) > 0)"""
_JOINED = """pe AS (SELECT cl.essay_id, cl.coder, cl.ord, cl.kind, cl.cor, p.para_no,
         cl.start - p.p_start AS start, cl."end" - p.p_start AS "end"
       FROM cl JOIN paras p ON p.essay_id = cl.essay_id AND cl.start >= p.p_start AND cl."end" <= p.p_end)"""


_KEPT = """kept AS (
  SELECT * FROM pe WHERE kind <> 'D'
  UNION ALL
  SELECT d.* FROM pe d WHERE d.kind = 'D' AND NOT EXISTS (
    SELECT 1 FROM pe c WHERE c.kind <> 'D' AND c.essay_id = d.essay_id AND c.coder = d.coder AND c.para_no = d.para_no
      AND ((c.start <> c."end" AND c.start >= d.start AND c."end" <= d."end")
           OR (c.start = c."end" AND c.start > d.start AND c."end" < d."end"))))"""


def _joined(spark, sf_dir):
    es = essays(spark, sf_dir)
    e = classify_edits(essay_edits(es))
    return edits_to_paragraphs(e, paragraphs(es)), es


@register("paragraph_split", f"""WITH {_ESSAYS}, {_PARAS}
SELECT essay_id, para_no, p_start, p_end, md5(para) AS para_md5 FROM paras""")
def paragraph_split(spark, sf_dir):
    """C-04: paragraphs (maximal non-newline runs) with character offsets."""
    p = paragraphs(essays(spark, sf_dir))
    return p.select("essay_id", "para_no", "p_start", "p_end", F.md5("para").alias("para_md5"))


@register("classify_edits", f"""WITH {_EDITS}
SELECT essay_id, coder, ord, kind, cor FROM cl""")
def classify_edits_q(spark, sf_dir):
    """S-11: detection vs correction (or the given type), normalised text."""
    e = classify_edits(essay_edits(essays(spark, sf_dir)))
    return e.select("essay_id", "coder", "ord", "kind", "cor")


@register("edit_paragraph_join", f"""WITH {_EDITS}, {_PARAS}, {_JOINED}
SELECT essay_id, coder, ord, kind, para_no, CAST(start AS INTEGER) AS start, CAST("end" AS INTEGER) AS "end" FROM pe""")
def edit_paragraph_join(spark, sf_dir):
    """J-04: edits assigned to the paragraph that contains them (interval join
    inside the essay key), offsets rebased; cross-paragraph edits dropped."""
    j, _ = _joined(spark, sf_dir)
    return j.select("essay_id", "coder", "ord", "kind", "para_no", F.col("start").cast("int").alias("start"),
                    F.col("end").cast("int").alias("end"))


@register("detection_overlap_anti", f"""WITH {_EDITS}, {_PARAS}, {_JOINED},
{_KEPT}
SELECT essay_id, coder, ord, kind, para_no FROM kept""")
def detection_overlap_anti(spark, sf_dir):
    """J-05: detection edits containing a correction are removed (anti-join)."""
    j, _ = _joined(spark, sf_dir)
    return drop_covering_detections(j).select("essay_id", "coder", "ord", "kind", "para_no")


@register("coder_align", f"""WITH {_EDITS}, {_PARAS}, {_JOINED},
coders AS (SELECT DISTINCT essay_id, coder FROM ed),
cnt AS (SELECT essay_id, coder, para_no, count(*) AS n FROM pe GROUP BY ALL)
SELECT p.essay_id, p.para_no, c.coder, coalesce(cnt.n, 0) AS n_edits
FROM paras p JOIN coders c ON c.essay_id = p.essay_id
LEFT JOIN cnt ON cnt.essay_id = p.essay_id AND cnt.coder = c.coder AND cnt.para_no = p.para_no""")
def coder_align(spark, sf_dir):
    """J-02 / J-08: paragraphs x coders with edit counts (0 = noop)."""
    es = essays(spark, sf_dir)
    raw = essay_edits(es)
    paras = paragraphs(es)
    return align_coders(paras, edits_to_paragraphs(classify_edits(raw), paras), raw)


_CLEAN = f"""x AS (SELECT pe.essay_id, pe.coder, pe.ord, pe.para_no, pe.start, pe."end",
             regexp_replace(p.para, {S.q(pt.WS)}, ' ', 'g') AS p1
      FROM pe JOIN paras p USING (essay_id, para_no)),
y AS (SELECT *, regexp_replace(p1, ' {{2,}}', ' ', 'g') AS collapsed FROM x),
z AS (SELECT essay_id, coder, ord, para_no, starts_with(collapsed, ' ') AS lead,
        CASE WHEN starts_with(collapsed, ' ') THEN substring(collapsed, 2) ELSE collapsed END AS clean_para,
        length(regexp_replace(substring(p1, 1, start), ' {{2,}}', ' ', 'g'))
          - (CASE WHEN start > 0 AND substring(p1, start, 1) = ' ' AND substring(p1, start + 1, 1) = ' ' THEN 1 ELSE 0 END) AS s0,
        length(regexp_replace(substring(p1, 1, "end"), ' {{2,}}', ' ', 'g'))
          - (CASE WHEN "end" > 0 AND substring(p1, "end", 1) = ' ' AND substring(p1, "end" + 1, 1) = ' ' THEN 1 ELSE 0 END) AS e0
      FROM y),
w AS (SELECT *, CASE WHEN lead THEN greatest(s0 - 1, 0) ELSE s0 END AS s1,
        CASE WHEN lead THEN greatest(e0 - 1, 0) ELSE e0 END AS e1 FROM z),
cp AS (SELECT essay_id, coder, ord, para_no, clean_para,
  CAST(CASE WHEN s1 <> e1 AND substring(clean_para, s1 + 1, 1) = ' ' THEN s1 + 1 ELSE s1 END AS INTEGER) AS start,
  CAST(CASE WHEN s1 <> e1 AND e1 > 0 AND substring(clean_para, e1, 1) = ' ' THEN e1 - 1 ELSE e1 END AS INTEGER) AS "end"
FROM w)"""


@register("clean_paragraph", f"""WITH {_EDITS}, {_PARAS}, {_JOINED}, {_CLEAN}
SELECT essay_id, coder, ord, para_no, start, "end", md5(clean_para) AS para_md5 FROM cp""")
def clean_paragraph_q(spark, sf_dir):
    """C-05: paragraph whitespace cleaned and the paragraph-relative edit
    offsets remapped accordingly."""
    j, es = _joined(spark, sf_dir)
    p = paragraphs(es).select("essay_id", "para_no", "para")
    c = place_edits(j.select("essay_id", "para_no", "coder", "ord", "start", "end"), p)
    return c.join(p.select("essay_id", "para_no", F.md5(clean_text("para")).alias("para_md5")), ["essay_id", "para_no"]).select(
        "essay_id", "coder", "ord", "para_no", "start", "end", "para_md5")


def _tok_span_ctes(source="pe"):
    parts = "string_split(clean_para, ' ')"
    pref = f"coalesce(list_sum(list_transform(({parts})[1:i - 1], lambda w: length(w) + 1)), 0)"
    bounds = (f"list_filter(list_transform(range(1, len({parts}) + 1), lambda i: {{'s': {pref}, "
              f"'e': {pref} + length(({parts})[i]), 'l': length(({parts})[i])}}), lambda x: x.l > 0)")
    return f"""{_CLEAN.replace("FROM pe JOIN", f"FROM {source} pe JOIN")},
pb AS (SELECT essay_id, para_no, {bounds} AS b FROM (SELECT DISTINCT essay_id, para_no, clean_para FROM cp)),
tb AS (SELECT cp.essay_id, coder, ord, cp.para_no, start, "end", b FROM cp JOIN pb USING (essay_id, para_no)),
se AS (SELECT essay_id, coder, ord, para_no, start, "end", list_transform(b, lambda x: x.s) AS ss,
         list_transform(b, lambda x: x.e) AS es FROM tb),
k AS (SELECT *, len(ss) AS n,
        len(list_filter(ss, lambda v: v <= start)) AS bs, len(list_filter(es, lambda v: v <= "end")) AS be,
        list_contains(ss, start) AS s_in, list_contains(es, "end") AS e_in FROM se),
xx AS (SELECT *, CASE WHEN s_in THEN start ELSE ss[CASE WHEN bs = 0 THEN -1 ELSE bs END] END AS xs,
        CASE WHEN e_in THEN "end" ELSE es[be + 1] END AS xe_ins,
        CASE WHEN e_in THEN "end" WHEN be >= n THEN es[-1] ELSE es[be + 1] END AS xe FROM k),
r AS (SELECT essay_id, coder, ord, para_no, start, "end", CASE
   WHEN n = 0 THEN NULL
   WHEN start = "end" THEN CASE
     WHEN start = 0 OR start <= ss[1] THEN {{'t_start': 0, 't_end': 0, 'c_start': NULL::INTEGER, 'c_end': NULL::INTEGER}}
     WHEN start >= es[-1] THEN {{'t_start': n, 't_end': n, 'c_start': NULL::INTEGER, 'c_end': NULL::INTEGER}}
     WHEN s_in THEN {{'t_start': list_position(ss, start) - 1, 't_end': list_position(ss, start) - 1, 'c_start': NULL::INTEGER, 'c_end': NULL::INTEGER}}
     WHEN list_contains(es, start) THEN {{'t_start': list_position(es, start), 't_end': list_position(es, start), 'c_start': NULL::INTEGER, 'c_end': NULL::INTEGER}}
     ELSE {{'t_start': list_position(ss, xs) - 1, 't_end': list_position(es, xe_ins), 'c_start': xs, 'c_end': xe_ins}} END
   WHEN s_in AND e_in THEN {{'t_start': list_position(ss, start) - 1, 't_end': list_position(es, "end"), 'c_start': NULL::INTEGER, 'c_end': NULL::INTEGER}}
   ELSE {{'t_start': list_position(ss, xs) - 1, 't_end': list_position(es, xe), 'c_start': xs, 'c_end': xe}} END AS sp
 FROM xx)"""


@register("char_to_token_span", f"""WITH {_EDITS}, {_PARAS}, {_JOINED}, {_tok_span_ctes()}
SELECT essay_id, coder, ord, para_no, CAST(sp.t_start AS INTEGER) AS t_start, CAST(sp.t_end AS INTEGER) AS t_end,
  CAST(sp.c_start AS INTEGER) AS c_start, CAST(sp.c_end AS INTEGER) AS c_end FROM r""")
def char_to_token_span_q(spark, sf_dir):
    """J-06: cleaned character edit spans -> token spans (blank-separated
    tokens), expanded to token boundaries where they cut a token."""
    j, es = _joined(spark, sf_dir)
    p = paragraphs(es).select("essay_id", "para_no", "para")
    c = place_edits(j.select("essay_id", "para_no", "coder", "ord", "start", "end"), p)
    return c.select("essay_id", "coder", "ord", "para_no", "t_start", "t_end", "c_start", "c_end")


def _m2_sql():
    """The whole conversion from the steps above: spans of the kept edits, the
    order-dependent overlap drop (one recursion step per edit of a coder), sentences
    by position, minimised corrections, lines in order, noops."""
    text = f"regexp_replace(regexp_replace(para, {S.q(pt.WS)}, ' ', 'g'), ' {{2,}}', ' ', 'g')"
    noop = S.q(pt.M2_NOOP_PREFIX)
    return f"""WITH RECURSIVE {_EDITS}, {_PARAS}, {_JOINED}, {_KEPT}, {_tok_span_ctes("kept")},
seq AS (SELECT r.essay_id, r.coder, r.ord, r.para_no, r.start, r."end", CAST(sp AS STRUCT(t_start INTEGER, t_end INTEGER, c_start INTEGER, c_end INTEGER)) AS sp, cp.clean_para, kept.kind, kept.cor,
          row_number() OVER (PARTITION BY r.essay_id, r.para_no, r.coder ORDER BY r.ord) AS k
        FROM r JOIN cp USING (essay_id, coder, ord, para_no) JOIN kept USING (essay_id, coder, ord, para_no)),
walk AS (
  SELECT essay_id, para_no, coder, ord, k, true AS stays, sp.t_end AS reached FROM seq WHERE k = 1
  UNION ALL
  SELECT s.essay_id, s.para_no, s.coder, s.ord, s.k, NOT (s.sp.c_start IS NOT NULL AND s.sp.t_start < w.reached),
         CASE WHEN s.sp.c_start IS NOT NULL AND s.sp.t_start < w.reached THEN w.reached ELSE s.sp.t_end END
  FROM walk w JOIN seq s ON s.essay_id = w.essay_id AND s.para_no = w.para_no AND s.coder = w.coder AND s.k = w.k + 1),
body AS (SELECT essay_id, para_no, {S.words(text)} AS toks FROM paras WHERE {S.strip('para')} <> ''),
te AS (SELECT seq.essay_id, seq.para_no, seq.coder, seq.ord, sp.t_start AS t0, sp.t_end AS t1, kind, toks[sp.t_start + 1:sp.t_end] AS o,
         CASE WHEN kind = 'D' THEN toks[sp.t_start + 1:sp.t_end]
              WHEN sp.c_start IS NULL THEN {S.words('cor')}
              ELSE {S.words("(substring(clean_para, sp.c_start + 1, start - sp.c_start) || cor || substring(clean_para, \"end\" + 1, sp.c_end - \"end\"))")} END AS c,
         (kind = 'D' OR trim(cor) = '' OR contains({S.q(PUNCTUATION)}, right(rtrim(cor), 1))) AS closes
       FROM seq JOIN walk USING (essay_id, para_no, coder, ord) JOIN body USING (essay_id, para_no) WHERE stays),
tok AS (SELECT essay_id, para_no, toks, unnest(toks) AS t, generate_subscripts(toks, 1) AS i FROM body),
ends AS (SELECT essay_id, para_no, toks, i AS s_end, row_number() OVER w - 1 AS sent_no, coalesce(lag(i) OVER w, 0) AS s_start
         FROM tok WHERE regexp_matches(t, '[.!?]$') OR i = len(toks) WINDOW w AS (PARTITION BY essay_id, para_no ORDER BY i)),
placed AS (SELECT te.*, e.sent_no, t0 - e.s_start AS a, t1 - e.s_start AS b FROM te JOIN ends e USING (essay_id, para_no)
  WHERE CASE WHEN t0 = t1 AND t0 = e.s_end THEN e.s_end = len(e.toks) OR closes
             WHEN t0 = t1 AND t0 = e.s_start AND e.sent_no > 0 THEN NOT closes
             ELSE t0 >= e.s_start AND t0 < e.s_end END AND t1 <= e.s_end),
cut AS (SELECT *, CASE WHEN kind = 'D' THEN 0 ELSE coalesce(list_position(list_transform(range(1, least(len(o), len(c)) + 1), lambda i: o[i] = c[i]), false) - 1, least(len(o), len(c))) END AS p FROM placed),
cut2 AS (SELECT *, CASE WHEN kind = 'D' THEN 0 ELSE least(least(len(o), len(c)) - p, coalesce(list_position(list_transform(range(1, least(len(o), len(c)) + 1),
           lambda i: list_reverse(o)[i] = list_reverse(c)[i]), false) - 1, least(len(o), len(c)))) END AS q FROM cut),
ln AS (SELECT essay_id, para_no, sent_no, coder, ord, a + p AS a, b - q AS b, kind, array_to_string(c[p + 1:len(c) - q], ' ') AS cs FROM cut2),
per AS (SELECT essay_id, para_no, sent_no, coder, string_agg('A ' || a || ' ' || b || '|||' || kind || '|||' || cs || '|||REQUIRED|||-NONE-|||' || coder,
          chr(10) ORDER BY b, a, ord) AS lines FROM ln WHERE NOT (kind <> 'D' AND a = b AND cs = '') GROUP BY ALL),
cods AS (SELECT DISTINCT essay_id, coder FROM ed)
SELECT e.essay_id, e.para_no, CAST(e.sent_no AS INTEGER) AS sent_no, md5('S ' || array_to_string(any_value(e.toks[e.s_start + 1:e.s_end]), ' ') || chr(10)
    || string_agg(coalesce(per.lines, {noop} || c.coder), chr(10) ORDER BY c.coder)) AS block_md5
FROM ends e JOIN cods c USING (essay_id) LEFT JOIN per USING (essay_id, para_no, sent_no, coder) GROUP BY e.essay_id, e.para_no, e.sent_no"""


@register("essays_to_m2", _m2_sql())
def essays_to_m2_q(spark, sf_dir):
    """C-09: whole essays with three coders' character edits -> M2 blocks per sentence (digests)."""
    from redline.operators.essays import essays_to_m2
    es = essays(spark, sf_dir)
    m = essays_to_m2(es, written(essay_edits(es)))
    return m.select("essay_id", "para_no", "sent_no", F.md5("block").alias("block_md5"))


@register("essays_to_m2_pre_split", _m2_sql().replace("WHERE regexp_matches(t, '[.!?]$') OR i = len(toks)", "WHERE i = len(toks)"))
def essays_to_m2_pre_split(spark, sf_dir):
    """C-09 on text that is split already: every paragraph is one sentence."""
    from redline.operators.essays import essays_to_m2
    es = essays(spark, sf_dir)
    m = essays_to_m2(es, written(essay_edits(es)), pre_split=True)
    return m.select("essay_id", "para_no", "sent_no", F.md5("block").alias("block_md5"))
