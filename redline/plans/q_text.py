"""Registered queries: scalar text functions and projections
(P-01, P-03..P-09, P-11, P-14, P-16..P-18, P-27, K-06, W-07, W-08, X-03, J-01)."""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import functions as F

from redline.functions import patterns as pt
from redline.functions.prompts import chat_messages, prompt, training_text
from redline.functions.text import (
    clean_spaced_hyphens,
    dataset_name,
    extract_answer,
    html_text,
    html_tokens,
    mask_patterns,
    model_slug,
    model_slug_underscore,
    normalize_punct,
    normalize_ws,
    route_doc_type,
    token_budget,
    truncate_overlong,
    with_fallback,
    word_count,
)
from redline.functions.tokens import tokens
from redline.operators.scores import count_valid, head_rows, score_triples
from redline.plans import sql as S
from redline.plans.fixtures import lines, triples, turn_triples
from redline.plans.registry import register
from redline.session import read_table

NL = "chr(10)"


def _lines(spark, sf_dir):
    return lines(read_table(spark, sf_dir, "documents"))


@register("clean_hyphens", f"""WITH {S.LINES}
SELECT doc_id, line_no, replace(line, ' - ', '-') AS text FROM lines""")
def clean_hyphens(spark, sf_dir):
    """P-01 on every line."""
    return _lines(spark, sf_dir).select("doc_id", "line_no", clean_spaced_hyphens("line").alias("text"))


@register("normalize_ws", f"""SELECT doc_id, trim(regexp_replace(text, {S.q(pt.WS_RUN)}, ' ', 'g')) AS text
FROM documents""")
def normalize_ws_q(spark, sf_dir):
    """P-14 on whole documents."""
    return read_table(spark, sf_dir, "documents").select("doc_id", normalize_ws("text").alias("text"))


@register("normalize_punct", f"""SELECT doc_id, translate(text, {S.q(pt.PUNCT_FROM)}, {S.q(pt.PUNCT_TO)}) AS text,
  length(text) = length(translate(text, {S.q(pt.PUNCT_FROM)}, {S.q(pt.PUNCT_TO)})) AS same_length
FROM documents""")
def normalize_punct_q(spark, sf_dir):
    """P-16: punctuation table on whole documents; the length is preserved."""
    d = read_table(spark, sf_dir, "documents").select("doc_id", "text", normalize_punct("text").alias("t2"))
    return d.select("doc_id", F.col("t2").alias("text"), (F.length("text") == F.length("t2")).alias("same_length"))


def _prompt_sql(prefix, mark, src):
    return f"{S.q(prefix)} || {src} || {NL} || {S.q(mark)}"


@register("training_text", f"""WITH {S.triples_cte(('identity',))}
SELECT doc_id, line_no,
  {_prompt_sql(pt.GRAMMAR_PROMPT_PREFIX, pt.GRAMMAR_MARKER, 'input_text')} || ' ' || target_text || {S.q(pt.END_OF_TEXT)} AS grammar_text,
  {_prompt_sql(pt.READABILITY_PROMPT_PREFIX, pt.READABILITY_MARKER, 'input_text')} || ' ' || target_text || {S.q(pt.END_OF_TEXT)} AS readability_text
FROM triples""")
def training_text_q(spark, sf_dir):
    """P-03: training strings for both tasks."""
    t = triples(spark, sf_dir, models=("identity",))
    return t.select("doc_id", "line_no", training_text("grammar").alias("grammar_text"),
                    training_text("readability").alias("readability_text"))


@register("prompt_text", f"""WITH {S.triples_cte(('identity',))}
SELECT doc_id, line_no, {_prompt_sql(pt.GRAMMAR_PROMPT_PREFIX, pt.GRAMMAR_MARKER, 'input_text')} AS grammar_prompt,
  {_prompt_sql(pt.READABILITY_PROMPT_PREFIX, pt.READABILITY_MARKER, 'input_text')} AS readability_prompt
FROM triples""")
def prompt_text(spark, sf_dir):
    """P-04: local-model inference prompts for both tasks."""
    t = triples(spark, sf_dir, models=("identity",))
    return t.select("doc_id", "line_no", prompt("grammar").alias("grammar_prompt"),
                    prompt("readability").alias("readability_prompt"))


@register("chat_messages", f"""SELECT conv_id, turn, 0 AS msg_no, 'system' AS role, {S.q(pt.GRAMMAR_SYSTEM_PROMPT)} AS content
FROM conversations
UNION ALL
SELECT conv_id, turn, 1 AS msg_no, 'user' AS role, replace({S.q(pt.GRAMMAR_USER_TEMPLATE)}, '{{input_text}}', text) AS content
FROM conversations""")
def chat_messages_q(spark, sf_dir):
    """P-05: system + user message per conversation turn (template filled by
    literal replacement)."""
    c = read_table(spark, sf_dir, "conversations")
    m = c.select("conv_id", "turn", F.posexplode(chat_messages("grammar", "text")).alias("msg_no", "msg"))
    return m.select("conv_id", "turn", "msg_no", "msg.role", "msg.content")


@register("extract_answer", f"""WITH {S.TURN_TRIPLES},
raw AS (SELECT conv_id, turn, {_prompt_sql(pt.GRAMMAR_PROMPT_PREFIX, pt.GRAMMAR_MARKER, 'input_text')} || ' ' || prediction AS generated, prediction
        FROM turn_triples)
SELECT conv_id, turn, {S.strip(f"string_split(generated, {S.q(pt.GRAMMAR_MARKER)})[-1]")} AS answer,
  {S.strip(f"string_split(replace(generated, {S.q(pt.GRAMMAR_MARKER)}, {S.q(pt.READABILITY_MARKER)}), {S.q(pt.READABILITY_MARKER)})[-1]")} AS simplified,
  {S.strip('prediction')} AS unmarked FROM raw""")
def extract_answer_q(spark, sf_dir):
    """P-06: the answer after the last marker of a generated continuation, for
    both tasks' markers, and of a text without one."""
    t = turn_triples(spark, sf_dir)
    gen = F.concat(prompt("grammar"), F.lit(" "), F.col("prediction"))
    other = F.replace(gen, F.lit(pt.GRAMMAR_MARKER), F.lit(pt.READABILITY_MARKER))
    return t.select("conv_id", "turn", extract_answer(gen, pt.GRAMMAR_MARKER).alias("answer"),
                    extract_answer(other, pt.READABILITY_MARKER).alias("simplified"),
                    extract_answer("prediction", pt.GRAMMAR_MARKER).alias("unmarked"))


def _truncate_sql(pred, src):
    first = f"split_part({pred}, '. ', 1)"
    return (f"(CASE WHEN {S.word_count(pred)} > {S.word_count(src)} * 1.5::DOUBLE THEN "
            f"(CASE WHEN ends_with({first}, '.') THEN {first} ELSE {first} || '.' END) ELSE {pred} END)")


@register("truncate_overlong", f"""WITH {S.TURN_TRIPLES}
SELECT conv_id, turn, {_truncate_sql('prediction', 'input_text')} AS prediction FROM turn_triples""")
def truncate_overlong_q(spark, sf_dir):
    """P-07: over-length guard on consecutive conversation turns."""
    t = turn_triples(spark, sf_dir)
    return t.select("conv_id", "turn", truncate_overlong("prediction", "input_text").alias("prediction"))


@register("token_budget", f"""WITH {S.LINES}
SELECT doc_id, line_no, least(CAST(floor({S.word_count('line')} * 0.8::DOUBLE * 1.3::DOUBLE) AS INTEGER), 60)
  AS budget FROM lines""")
def token_budget_q(spark, sf_dir):
    """P-08: generation budget per input line."""
    return _lines(spark, sf_dir).select("doc_id", "line_no", token_budget("line").alias("budget"))


@register("fallback_prediction", f"""WITH {S.triples_cte(('swap',))}
SELECT doc_id, line_no, coalesce(CASE WHEN source = 'src0' THEN NULL ELSE prediction END, input_text) AS prediction,
  source = 'src0' AS used_fallback FROM triples""")
def fallback_prediction(spark, sf_dir):
    """P-09: a model that fails for one source (NULL) falls back to the input."""
    t = triples(spark, sf_dir, models=("swap",))
    failed = F.when(F.col("source") == "src0", F.lit(None).cast("string")).otherwise(F.col("prediction"))
    return t.select("doc_id", "line_no", with_fallback(failed, "input_text").alias("prediction"),
                    (F.col("source") == "src0").alias("used_fallback"))


@register("valid_triples", """SELECT d.lang, count(*) FILTER (WHERE l.doc_id IS NOT NULL) AS n_valid,
  count(*) FILTER (WHERE l.doc_id IS NULL) AS n_skipped
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY d.lang""")
def valid_triples(spark, sf_dir):
    """P-11 / M-12 / J-01: triples keyed by doc_id (label present -> target);
    rows with any NULL text are skipped and counted."""
    d = read_table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    lab = read_table(spark, sf_dir, "labels").select("doc_id", F.lit(True).alias("_has"))
    t = d.join(lab, "doc_id", "left").select(
        "lang", F.col("text").alias("input_text"), F.col("text").alias("prediction"),
        F.when(F.col("_has"), F.col("text")).alias("target_text"))
    return count_valid(t, ["lang"])


@register("model_slug", f"""SELECT page_id, translate(url, '/.', '_-') AS slug,
  regexp_replace(string_split(url, '/')[-1], '\\.[^.]*$', '') AS dataset FROM pages""")
def model_slug_q(spark, sf_dir):
    """K-06: file-safe identifiers and dataset names from paths/URLs."""
    p = read_table(spark, sf_dir, "pages")
    return p.select("page_id", model_slug("url").alias("slug"), dataset_name("url").alias("dataset"))


@register("model_slug_underscore", "SELECT page_id, replace(replace(url, '/', '_'), '-', '_') AS slug FROM pages")
def model_slug_underscore_q(spark, sf_dir):
    """K-06, second rule: slashes and hyphens become underscores."""
    return read_table(spark, sf_dir, "pages").select("page_id", model_slug_underscore("url").alias("slug"))


@register("chat_messages_simplify", f"""SELECT conv_id, turn,
  md5({S.q(pt.READABILITY_SYSTEM_PROMPT)}) AS system_md5,
  md5(replace({S.q(pt.READABILITY_USER_TEMPLATE)}, '{{input_text}}', text)) AS user_md5
FROM conversations""")
def chat_messages_simplify(spark, sf_dir):
    """P-05 for the second task (digests of both messages)."""
    m = chat_messages("readability", "text")
    return read_table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.md5(m[0]["content"]).alias("system_md5"), F.md5(m[1]["content"]).alias("user_md5"))


def _entities_sql(x):
    """Character references decoded piece by piece after each ampersand, from a
    table of all named ones (those that end in a semicolon) and by number."""
    names = {k[:-1]: v for k, v in html5.items() if k.endswith(";")}
    table = f"map([{', '.join(S.q(k) for k in names)}], [{', '.join(S.q(v) for v in names.values())}])"
    name = "regexp_extract(p, '^([A-Za-z][A-Za-z0-9]*);', 1)"
    piece = (f"CASE WHEN i = 1 THEN p WHEN {name} <> '' AND names[{name}] IS NOT NULL THEN names[{name}] || substring(p, length({name}) + 2) "
             f"WHEN regexp_matches(p, '^#[0-9]+;') THEN chr(regexp_extract(p, '^#([0-9]+);', 1)::INTEGER) || regexp_replace(p, '^#[0-9]+;', '') "
             f"ELSE '&' || p END")
    return f"""ents AS (SELECT {table} AS names),
pieces AS (SELECT page_id, unnest(string_split(x, '&')) AS p, generate_subscripts(string_split(x, '&'), 1) AS i FROM ({x})),
decoded AS (SELECT page_id, string_agg({piece}, '' ORDER BY i) AS x FROM pieces, ents GROUP BY page_id)"""


def _html_sql(x):
    return f"regexp_replace({x}, {S.q(html_tokens(possessive=False))}, ' ', 'g')"


_ODD_PAGE = [("<p>", '<p title="a > b" data-x=\'1 > "2"\'>1 < 2 '), ("</script>", "</script >"), ("<body", "<STYLE media=\"x>y\">p > a {}</STYLE\n><!-- > <b> --><body")]


def _odd_page(x):
    for old, new in _ODD_PAGE:
        x = F.replace(x, F.lit(old), F.lit(new))
    return F.concat(x, F.lit("<script>unclosed > code"))


def _odd_page_sql(x):
    for old, new in _ODD_PAGE:
        x = f"replace({x}, {S.q(old)}, {S.q(new)})"
    return f"({x} || '<script>unclosed > code')"


@register("html_text_quoted", f"""WITH {_entities_sql(f"SELECT page_id, {_html_sql(_odd_page_sql('html'))} AS x FROM pages")}
SELECT page_id, trim(regexp_replace(translate(x, chr(160), ' '), {S.q(pt.WS_RUN)}, ' ', 'g')) AS text FROM decoded""")
def html_text_quoted(spark, sf_dir):
    """P-18 on pages with `>` in quoted values, blanks in end tags, markup in
    comments and a script that isn't closed."""
    return read_table(spark, sf_dir, "pages").select("page_id", html_text(_odd_page(F.col("html"))).alias("text"))


@register("html_text", f"""WITH {_entities_sql(f"SELECT page_id, {_html_sql('html')} AS x FROM pages")}
SELECT page_id, trim(regexp_replace(translate(x, chr(160), ' '), {S.q(pt.WS_RUN)}, ' ', 'g')) AS text FROM decoded""")
def html_text_q(spark, sf_dir):
    """P-18: visible text of every page."""
    return read_table(spark, sf_dir, "pages").select("page_id", html_text("html").alias("text"))


@register("doc_type_route", """SELECT page_id, CASE
  WHEN regexp_matches(lower(url), '\\.pdf(\\.gz)?$') THEN 'pdf'
  WHEN regexp_matches(lower(url), '\\.html?(\\.gz)?$') THEN 'html'
  WHEN regexp_matches(lower(url), '\\.txt(\\.gz)?$') THEN 'txt'
  ELSE 'unsupported' END AS doc_type FROM pages""")
def doc_type_route(spark, sf_dir):
    """P-17: extractor routing by extension."""
    return read_table(spark, sf_dir, "pages").select("page_id", route_doc_type("url").alias("doc_type"))


def _mask_sql(x):
    y = f"regexp_replace({x}, {S.q(pt.EMAIL_RE)}, '<EMAIL>', 'g')"
    y = f"regexp_replace({y}, {S.q(pt.PHONE_RE)}, '<PHONE>', 'g')"
    return f"regexp_replace({y}, {S.q(pt.POSTCODE_RE)}, '<POSTCODE>', 'g')"


@register("mask_patterns", f"""SELECT doc_id, md5({_mask_sql('text')}) AS masked_md5,
  CAST(len(regexp_extract_all(text, {S.q(pt.EMAIL_RE)})) AS INTEGER) AS n_email FROM documents""")
def mask_patterns_q(spark, sf_dir):
    """X-03: personal data masked in whole documents (digest of the masked text)."""
    d = read_table(spark, sf_dir, "documents")
    return d.select("doc_id", F.md5(mask_patterns("text")).alias("masked_md5"),
                    F.size(F.regexp_extract_all("text", F.lit(pt.EMAIL_RE), 0)).alias("n_email"))


@register("preview_topn", f"""WITH {S.triples_cte(('drop_last',))},
{S.sari_v3_ctes("triples", ["doc_id", "line_no", "input_text", "prediction"], S.tokens("input_text"),
                S.tokens("prediction"), [S.tokens("target_text")])}
SELECT doc_id, line_no, CAST(len({S.tokens('input_text')}) AS INTEGER) AS n_tokens, round(sari_f1, 6) AS sari_f1
FROM v3 ORDER BY doc_id, line_no LIMIT 20""")
def preview_topn(spark, sf_dir):
    """P-27 / W-07: the first 20 rows (by key) with token counts and scores;
    the limit is the feature (TakeOrderedAndProject, no global sort)."""
    first = head_rows(triples(spark, sf_dir, models=("drop_last",)), 20, ["doc_id", "line_no"])
    s = score_triples(first, metrics=("sari_f1",))  # scored after the rows are taken
    return s.select("doc_id", "line_no", F.size(tokens("input_text")).alias("n_tokens"), F.round("sari_f1", 6).alias("sari_f1"))


@register("hash_shuffle", f"""WITH {S.LINES}
SELECT doc_id, line_no, md5('42|' || doc_id::VARCHAR || '|' || line_no::VARCHAR) AS shuffle_key FROM lines""")
def hash_shuffle(spark, sf_dir):
    """W-08: reproducible random order of training rows = order by a seeded
    hash of the key (a distributed range sort; no single-partition rank)."""
    l_ = _lines(spark, sf_dir)
    key = F.md5(F.concat_ws("|", F.lit("42"), F.col("doc_id").cast("string"), F.col("line_no").cast("string")))
    return l_.select("doc_id", "line_no", key.alias("shuffle_key")).orderBy("shuffle_key")


@register("word_count_rows", f"""WITH {S.triples_cte(('drop_last',))}
SELECT doc_id, line_no, CAST({S.word_count('input_text')} AS INTEGER) AS n_input,
  CAST({S.word_count('prediction')} AS INTEGER) AS n_prediction, prediction = target_text AS exact
FROM triples""")
def word_count_rows(spark, sf_dir):
    """P-20 / P-26 per row."""
    t = triples(spark, sf_dir, models=("drop_last",))
    return t.select("doc_id", "line_no", word_count("input_text").alias("n_input"),
                    word_count("prediction").alias("n_prediction"),
                    F.coalesce(F.col("prediction") == F.col("target_text"), F.lit(False)).alias("exact"))

