"""DuckDB oracle SQL: independent relational formulations of each query.

The oracle is deliberately written differently from the Spark side where a
relational form exists (e.g. GLEU counts n-grams with UNNEST + GROUP BY
while Spark folds sorted arrays in-row), so agreement is evidence, not an
echo. Fragments are plain SQL text; DuckDB 2 lambda syntax (`lambda x: ...`).
"""

from __future__ import annotations

from redline.functions import patterns as pt

WS = pt.WS
WS_RUN = pt.WS_RUN


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def words(x: str) -> str:
    return f"list_filter(string_split_regex({x}, {q(WS_RUN)}), lambda w: w <> '')"


def word_count(x: str) -> str:
    return f"len({words(x)})"


def tokens(x: str) -> str:
    return f"regexp_extract_all(lower({x}), {q(pt.WORD_RE)})"


def r6(x: str) -> str:
    return f"round({x}, 6)"


def ldistinct(x: str) -> str:
    return f"list_distinct({x})"


def lminus(a: str, b: str) -> str:
    return f"list_filter({a}, lambda z: NOT list_contains({b}, z))"


def linter(a: str, b: str) -> str:
    return f"list_filter({a}, lambda z: list_contains({b}, z))"


def strip(x: str) -> str:
    return f"regexp_replace({x}, {q('^' + WS + '+|' + WS + '+$')}, '', 'g')"


def rule_prediction(model: str, x: str = "line") -> str:
    if model == "identity":
        return x
    if model == "drop_last":
        w = words(x)
        return f"array_to_string(({w})[1:greatest(len({w}) - 1, 0)], ' ')"
    if model == "swap":
        return f"replace({x}, ' and ', ' or ')"
    if model == "fix_first":
        pos = f"strpos({x}, ' the ')"
        return (f"(CASE WHEN {pos} > 0 THEN substring({x}, 1, {pos} - 1) || ' a ' || substring({x}, {pos} + 5) "
                f"ELSE {x} END)")
    raise ValueError(model)


LINES = """lines AS (
  SELECT doc_id, lang, source, unnest(parts) AS line, generate_subscripts(parts, 1) - 1 AS line_no
  FROM (SELECT doc_id, lang, source, string_split(text, chr(10)) AS parts FROM documents))"""


def triples_cte(models=("identity", "drop_last", "swap")) -> str:
    parts = [f"SELECT doc_id, line_no, lang, source, {q(m)} AS model, line AS input_text, "
             f"replace(line, ' the ', ' a ') AS target_text, {rule_prediction(m)} AS prediction "
             f"FROM lines" for m in models]
    return LINES + ",\ntriples AS (\n  " + "\n  UNION ALL ".join(parts) + ")"


TURN_TRIPLES = """turn_triples AS (
  SELECT a.conv_id, a.turn, a.text AS input_text, b.text AS prediction, c.text AS target_text
  FROM conversations a
  JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1
  JOIN conversations c ON c.conv_id = a.conv_id AND c.turn = a.turn + 2)"""


def sari_v1_ctes(src: str, carry: list[str], s: str, p: str, r: str, out: str = "v1",
                 scale: float = 100.0) -> str:
    """CTEs ending in table `out` (carry..., sari): tokens, then the six sets
    as columns, then the three recalls (empty reference set -> 1)."""
    c = ", ".join(carry)
    return f"""{out}_tok AS (SELECT {c}, list_distinct({s}) AS s, list_distinct({p}) AS p,
      list_distinct({r}) AS r FROM {src}),
{out}_sets AS (SELECT {c}, {linter('r', 's')} AS keep_ref, {lminus('r', 's')} AS add_ref,
      {lminus('s', 'r')} AS del_ref, {linter('p', 's')} AS p_keep, {lminus('p', 's')} AS p_add,
      {lminus('s', 'p')} AS p_del FROM {out}_tok),
{out} AS (SELECT {c}, ((CASE WHEN len(keep_ref) > 0 THEN len({linter('p_keep', 'keep_ref')}) / len(keep_ref) ELSE 1.0 END)
      + (CASE WHEN len(add_ref) > 0 THEN len({linter('p_add', 'add_ref')}) / len(add_ref) ELSE 1.0 END)
      + (CASE WHEN len(del_ref) > 0 THEN len({linter('p_del', 'del_ref')}) / len(del_ref) ELSE 1.0 END))
      / 3.0 * {scale} AS sari FROM {out}_sets)"""


def sari_v3_ctes(src: str, carry: list[str], s: str, p: str, refs: list[str], out: str = "v3") -> str:
    """CTEs ending in table `out` (carry..., sari_f1): F1 keep, F1 add, delete
    recall over a list of reference token expressions."""
    c = ", ".join(carry)
    ref_cols = ", ".join(f"list_distinct({r}) AS r{i}" for i, r in enumerate(refs))
    keep = "s"
    for i in range(len(refs)):
        keep = linter(keep, f"r{i}")
    add = "list_distinct(flatten([" + ", ".join(lminus(f"r{i}", "s") for i in range(len(refs))) + "]))"
    union = "list_distinct(flatten([" + ", ".join(f"r{i}" for i in range(len(refs))) + "]))"

    def ratio(a, b):
        return f"(CASE WHEN len({b}) > 0 THEN len({a}) / len({b}) ELSE 0.0 END)"

    def f1(pp, rr):
        return f"(CASE WHEN {pp} + {rr} > 0 THEN 2.0 * {pp} * {rr} / ({pp} + {rr}) ELSE 0.0 END)"
    return f"""{out}_tok AS (SELECT {c}, list_distinct({s}) AS s, list_distinct({p}) AS p, {ref_cols} FROM {src}),
{out}_sets AS (SELECT {c}, s, p, {keep} AS k, {add} AS a, {lminus('s', union)} AS d FROM {out}_tok),
{out}_hits AS (SELECT {c}, p, k, a, d, {linter('p', 'k')} AS kh, {linter('p', 'a')} AS ah,
      {linter(lminus('s', 'p'), 'd')} AS dh FROM {out}_sets),
{out}_parts AS (SELECT {c}, {ratio('kh', 'p')} AS kp, {ratio('kh', 'k')} AS kr, {ratio('ah', 'p')} AS ap,
      {ratio('ah', 'a')} AS ar, {ratio('dh', 'd')} AS dr FROM {out}_hits),
{out} AS (SELECT {c}, ({f1('kp', 'kr')} + {f1('ap', 'ar')} + dr) / 3.0 * 100.0 AS sari_f1 FROM {out}_parts)"""


def ngram_list(t: str, n: int) -> str:
    return f"list_transform(range(1, len({t}) - {n} + 2), lambda i: array_to_string({t}[i:i + {n - 1}], ' '))"


def ngram_total(t: str) -> str:
    return "(" + " + ".join(f"greatest(len({t}) - {n - 1}, 0)" for n in range(1, 5)) + ")"


def gleu_rows_sql(src_cte: str, key_cols: list[str], hyp: str = "prediction",
                  ref: str = "target_text") -> str:
    """Relational GLEU: UNNEST n-grams per side, GROUP BY (key, ngram)."""
    keys = ", ".join(key_cols)
    ng = lambda t: "flatten([" + ", ".join(f"list_transform({ngram_list(t, n)}, lambda g: {n} || '|' || g)"
                                           for n in range(1, 5)) + "])"
    return f"""{src_cte},
toks AS (SELECT {keys}, {tokens(hyp)} AS ht, {tokens(ref)} AS rt FROM src),
grams AS (
  SELECT {keys}, 'h' AS side, unnest({ng('ht')}) AS g FROM toks
  UNION ALL
  SELECT {keys}, 'r' AS side, unnest({ng('rt')}) AS g FROM toks),
per_gram AS (
  SELECT {keys}, g, count(*) FILTER (WHERE side = 'h') AS ch, count(*) FILTER (WHERE side = 'r') AS cr
  FROM grams GROUP BY ALL),
overlap AS (SELECT {keys}, sum(least(ch, cr)) AS tp FROM per_gram GROUP BY ALL),
scored AS (
  SELECT {", ".join('t.' + k for k in key_cols)},
         CASE WHEN greatest({ngram_total('t.ht')}, {ngram_total('t.rt')}) > 0
              THEN coalesce(o.tp, 0) / greatest({ngram_total('t.ht')}, {ngram_total('t.rt')})
              ELSE 0.0 END AS gleu
  FROM toks t LEFT JOIN overlap o USING ({keys}))"""


def readability(x: str) -> tuple[str, str]:
    """(FRE, FKGL) SQL for text x; 0 for no words / NULL."""
    w = f"len({words(x)})"
    s = f"greatest(len(regexp_extract_all({x}, {q(pt.SENT_END_RE)})), 1)"
    y = (f"list_sum(list_transform({words('lower(' + x + ')')}, "
         f"lambda wd: greatest(len(regexp_extract_all(wd, {q(pt.VOWEL_RE)})), 1)))")
    fre = (f"coalesce(CASE WHEN {w} > 0 THEN {pt.FRE_BASE}::DOUBLE - {pt.FRE_WPS}::DOUBLE * ({w} / {s}) "
           f"- {pt.FRE_SPW}::DOUBLE * ({y} / {w}) ELSE 0.0 END, 0.0)")
    fkgl = (f"coalesce(CASE WHEN {w} > 0 THEN {pt.FKGL_WPS}::DOUBLE * ({w} / {s}) + {pt.FKGL_SPW}::DOUBLE * ({y} / {w}) "
            f"- {pt.FKGL_BASE}::DOUBLE ELSE 0.0 END, 0.0)")
    return fre, fkgl


def _edit_fmt_key(st, en, c, t):
    return f"{st}::VARCHAR || '|' || {en}::VARCHAR || '|' || {c} || '|' || {t}"


def m2_line_fmt(coder: int):
    def fmt(st, en, c, t):
        return (f"'A ' || {st}::VARCHAR || ' ' || {en}::VARCHAR || '|||' || {t} || '|||' || {c} "
                f"|| '|||REQUIRED|||-NONE-|||{coder}'")
    return fmt


def span_edit_key(a: str, b: str, fmt=_edit_fmt_key) -> str:
    """List with the single trimmed span edit of token lists a -> b (columns),
    rendered by `fmt` (default 'start|end|c_str|type'); empty when equal."""
    m = f"least(len({a}), len({b}))"
    p = (f"coalesce(list_position(list_transform(range(1, {m} + 1), lambda i: {a}[i] = {b}[i]), false) - 1, {m})")
    ra, rb = f"list_reverse({a})", f"list_reverse({b})"
    sfx = (f"coalesce(list_position(list_transform(range(1, {m} + 1), lambda i: {ra}[i] = {rb}[i]), false) - 1, {m})")
    q_ = f"least({sfx}, {m} - {p})"
    c_str = f"array_to_string({b}[{p} + 1:len({b}) - {q_}], ' ')"
    o_end = f"(len({a}) - {q_})"
    typ = f"(CASE WHEN {p} = {o_end} THEN 'M' WHEN {c_str} = '' THEN 'U' ELSE 'R' END)"
    return f"(CASE WHEN {p} = len({a}) AND {p} = len({b}) THEN []::VARCHAR[] ELSE [{fmt(p, o_end, c_str, typ)}] END)"


def aligned_edit_keys(a: str, b: str, fmt=_edit_fmt_key) -> str:
    """Substitution edits where lengths agree, else the span edit."""
    subs = (f"list_transform(list_filter(range(1, len({a}) + 1), lambda i: {a}[i] <> {b}[i]), "
            f"lambda i: {fmt('(i - 1)', 'i', f'{b}[i]', chr(39) + 'R' + chr(39))})")
    return f"(CASE WHEN len({a}) = len({b}) THEN {subs} ELSE {span_edit_key(a, b, fmt)} END)"
