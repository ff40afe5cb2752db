"""Registered queries: corpus preparation and quality checks
(C-10..C-14, J-09, M-11, X-01, X-02, U-01)."""

from __future__ import annotations

from pyspark.sql import functions as F

from redline.functions import patterns as pt
from redline.functions.prompts import training_text
from redline.functions.text import normalize_ws, words
from redline.functions.tokens import tokens
from redline.operators.corpus import (
    batch_id,
    causal_pairs,
    chunk_tokens,
    encode_fixed,
    pad_batch,
    encode_with_vocab,
    vocabulary,
)
from redline.operators.sentences import learn_abbreviations, marked_ends
from redline.operators.quality import dedup_exact, duplicate_groups, ngram_overlap
from redline.plans import sql as S
from redline.plans.fixtures import lines, turn_triples
from redline.plans.registry import register
from redline.session import read_table, shared_path, spread

_DOC_WORDS = f"SELECT doc_id, {S.words('text')} AS w FROM documents"


def _md5(tokens_col):
    """Digest of a whole token array."""
    return F.md5(F.array_join(tokens_col, " "))


def _doc_chunks(spark, sf_dir):
    d = spread(read_table(spark, sf_dir, "documents"))
    return chunk_tokens(d.select("doc_id", words(normalize_ws("text")).alias("toks")), "toks",
                        pt.CHUNK_MAX_LENGTH, pt.CHUNK_STRIDE, pt.CHUNK_MIN_TOKENS)


_CHUNKS_SQL = f"""t AS ({_DOC_WORDS}),
c AS (SELECT doc_id, unnest(range(0, len(w), {pt.CHUNK_STRIDE})) AS i, w FROM t),
k AS (SELECT doc_id, CAST(i // {pt.CHUNK_STRIDE} AS INTEGER) AS chunk_no, w[i + 1:i + {pt.CHUNK_MAX_LENGTH}] AS toks
      FROM c WHERE len(w[i + 1:i + {pt.CHUNK_MAX_LENGTH}]) >= {pt.CHUNK_MIN_TOKENS})"""


@register("chunk_tokens", f"""WITH {_CHUNKS_SQL}
SELECT doc_id, chunk_no, CAST(len(toks) AS INTEGER) AS n_tokens, md5(array_to_string(toks, ' ')) AS tokens_md5 FROM k""")
def chunk_tokens_q(spark, sf_dir):
    """C-10: overlapping 512/256 token windows over whole documents; windows
    under 5 tokens dropped, windows contained in the previous one kept."""
    c = _doc_chunks(spark, sf_dir)
    return c.select("doc_id", "chunk_no", F.size("tokens").alias("n_tokens"), _md5("tokens").alias("tokens_md5"))


@register("chunk_tokens_lean", f"""WITH {_CHUNKS_SQL}
SELECT doc_id, chunk_no, md5(array_to_string(toks, ' ')) AS tokens_md5 FROM k
WHERE chunk_no = 0 OR len(toks) > {pt.CHUNK_MAX_LENGTH - pt.CHUNK_STRIDE}""")
def chunk_tokens_lean(spark, sf_dir):
    """C-10 without the windows that lie inside the previous one."""
    d = spread(read_table(spark, sf_dir, "documents"))
    c = chunk_tokens(d.select("doc_id", words(normalize_ws("text")).alias("toks")), "toks",
                     pt.CHUNK_MAX_LENGTH, pt.CHUNK_STRIDE, pt.CHUNK_MIN_TOKENS, drop_contained=True)
    return c.select("doc_id", "chunk_no", _md5("tokens").alias("tokens_md5"))


@register("causal_pairs", f"""WITH {_CHUNKS_SQL}
SELECT doc_id, chunk_no, CAST(len(toks) - 1 AS INTEGER) AS n_pairs, md5(array_to_string(toks[1:len(toks) - 1], ' ')) AS inputs_md5,
  md5(array_to_string(toks[2:], ' ')) AS labels_md5 FROM k""")
def causal_pairs_q(spark, sf_dir):
    """C-13: next-token (input, label) arrays of every chunk."""
    c = causal_pairs(_doc_chunks(spark, sf_dir), "tokens")
    return c.select("doc_id", "chunk_no", F.size("inputs").alias("n_pairs"), _md5("inputs").alias("inputs_md5"), _md5("labels").alias("labels_md5"))


@register("encode_fixed", f"""WITH {S.TURN_TRIPLES},
x AS (SELECT conv_id, turn, {S.words("'Correct this text: ' || input_text || chr(10) || 'Corrected: ' || target_text || '<|endoftext|>'")} AS w
      FROM turn_triples)
SELECT conv_id, turn, len(w) > 512 AS was_truncated,
  md5(array_to_string(list_concat(w[1:512], list_transform(range(0, greatest(512 - len(w), 0)), lambda i: '<pad>')), ' ')) AS ids_md5,
  md5(repeat('1', least(len(w), 512)::BIGINT) || repeat('0', greatest(512 - len(w), 0)::BIGINT)) AS mask_md5 FROM x""")
def encode_fixed_q(spark, sf_dir):
    """C-11: training strings truncated / right-padded to 512 with a mask."""
    t = turn_triples(spark, sf_dir).select("conv_id", "turn", words(training_text("grammar")).alias("w"))
    e = encode_fixed(t, "w", 512, pad="<pad>")
    mask = F.md5(F.array_join(F.transform("attention_mask", lambda x: x.cast("string")), ""))
    return e.select("conv_id", "turn", "was_truncated", _md5("input_ids").alias("ids_md5"), mask.alias("mask_md5"))


_PADS = "list_transform(range(0, batch_len - len(t)), lambda i: '<pad>')"


@register("pad_batch", f"""WITH {S.LINES},
x AS (SELECT doc_id, line_no, CAST(line_no // 8 AS BIGINT) AS batch_id, {S.tokens('line')} AS t FROM lines),
y AS (SELECT *, max(len(t)) OVER (PARTITION BY doc_id, batch_id) AS batch_len FROM x)
SELECT doc_id, line_no, batch_id, CAST(batch_len AS INTEGER) AS batch_len, CAST(batch_len - len(t) AS INTEGER) AS pad_count,
  md5(array_to_string(list_concat({_PADS}, t), ' ')) AS left_md5, md5(array_to_string(list_concat(t, {_PADS}), ' ')) AS right_md5,
  md5(array_to_string(list_concat(t, list_transform(range(0, batch_len - len(t)), lambda i: '-100')), ' ')) AS labels_md5,
  md5(repeat('0', (batch_len - len(t))::BIGINT) || repeat('1', len(t)::BIGINT)) AS left_mask_md5 FROM y""")
def pad_batch_q(spark, sf_dir):
    """C-12 / C-14: batches of 8 lines per document (key = (doc, line_no div 8),
    so groups are bounded), padded on either side to the longest in the batch."""
    ln = lines(read_table(spark, sf_dir, "documents")).select(
        "doc_id", "line_no", batch_id("line_no", 8).alias("batch_id"), tokens("line").alias("t"))
    key = ["doc_id", "batch_id"]
    left = pad_batch(ln, "t", key, side="left", pad="<pad>").withColumnsRenamed({"padded": "left", "mask": "left_mask"})
    both = pad_batch(left.drop("batch_len", "pad_count"), "t", key, side="right", pad="<pad>", label_pad="-100")
    mask = F.array_join(F.transform("left_mask", lambda x: x.cast("string")), "")
    return both.select("doc_id", "line_no", "batch_id", "batch_len", "pad_count", _md5("left").alias("left_md5"),
                       _md5("padded").alias("right_md5"), _md5("labels").alias("labels_md5"), F.md5(mask).alias("left_mask_md5"))


@register("vocab_encode", f"""WITH {S.LINES},
v AS (SELECT token, dense_rank() OVER (ORDER BY token) - 1 AS id FROM
       (SELECT DISTINCT unnest({S.tokens('text')}) AS token FROM benchmark)),
y AS (SELECT doc_id, line_no, {S.tokens('line')} AS t FROM lines),
x AS (SELECT doc_id, line_no, unnest(t) AS token, generate_subscripts(t, 1) AS pos FROM y)
SELECT doc_id, line_no, CAST(count(*) AS INTEGER) AS n_tokens, CAST(count(v.id) AS INTEGER) AS n_known,
  md5(string_agg(coalesce(v.id::VARCHAR, '-'), ',' ORDER BY pos)) AS ids_md5
FROM x LEFT JOIN v USING (token) GROUP BY doc_id, line_no""")
def vocab_encode(spark, sf_dir):
    """J-09: token -> id lookup against a vocabulary table (built from the
    benchmark texts with dense ids in token order), in the row up to a size of
    the vocabulary and by a join of the rarer tokens beyond it."""
    vocab = vocabulary(read_table(spark, sf_dir, "benchmark").select(tokens("text").alias("t")), "t")
    ln = lines(read_table(spark, sf_dir, "documents")).select("doc_id", "line_no", tokens("line").alias("t"))
    e = encode_with_vocab(ln, "t", vocab, ["doc_id", "line_no"])
    shown = F.array_join(F.transform("ids", lambda i: F.coalesce(i.cast("string"), F.lit("-"))), ",")
    return e.select("doc_id", "line_no", F.size("ids").alias("n_tokens"),
                    F.size(F.filter("ids", lambda i: i.isNotNull())).alias("n_known"), F.md5(shown).alias("ids_md5"))


@register("vocab_encode_documents", f"""WITH y AS (SELECT doc_id, {S.tokens('text')} AS t FROM documents),
v AS (SELECT token, dense_rank() OVER (ORDER BY token) - 1 AS id FROM (SELECT DISTINCT unnest(t) AS token FROM y)),
x AS (SELECT doc_id, unnest(t) AS token, generate_subscripts(t, 1) AS pos FROM y)
SELECT doc_id, CAST(count(*) AS INTEGER) AS n_tokens, md5(string_agg(v.id::VARCHAR, ',' ORDER BY pos)) AS ids_md5
FROM x JOIN v USING (token) GROUP BY doc_id""")
def vocab_encode_documents(spark, sf_dir):
    """J-09 with a large vocabulary, that of the documents themselves: the
    commonest tokens are looked up in the row, the others joined."""
    d = spread(read_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", tokens("text").alias("t"))
    e = encode_with_vocab(d, "t", vocabulary(d, "t"), ["doc_id"], map_tokens=4_096)
    return e.select("doc_id", F.size("ids").alias("n_tokens"), F.md5(F.array_join(F.transform("ids", lambda i: i.cast("string")), ",")).alias("ids_md5"))


def _abbreviated(text):
    """Documents with abbreviations put in: some short words become `ca.` and `e.g.`."""
    return F.regexp_replace(F.regexp_replace(text, " (of|de|der|la) ", " ca. "), " (and|und|et|y) ", " e.g. ")


_STOPS_SQL = rf"""src AS (SELECT doc_id, regexp_replace(regexp_replace(text, ' (of|de|der|la) ', ' ca. ', 'g'), ' (and|und|et|y) ', ' e.g. ', 'g') AS text FROM documents),
wd AS (SELECT doc_id, {S.words('text')} AS w FROM src),
tk AS (SELECT doc_id, unnest(w) AS w, generate_subscripts(w, 1) AS i, len(w) AS n FROM wd),
br AS (SELECT *, lower(regexp_replace(regexp_replace(w, '^["''(\[]+', ''), '["'')\]]+$', '')) AS t FROM tk),
st AS (SELECT *, regexp_matches(t, '[^.]\.$') AS s FROM br),
ty AS (SELECT *, CASE WHEN s THEN left(t, length(t) - 1) ELSE regexp_replace(t, '[.,;:!?]+$', '') END AS type FROM st),
cn AS (SELECT CASE WHEN regexp_matches(type, '\pL') THEN type END AS type, count(*) FILTER (WHERE s) AS stopped, count(*) FILTER (WHERE NOT s) AS plain FROM ty GROUP BY 1),
al AS (SELECT sum(stopped)::DOUBLE / sum(stopped + plain)::DOUBLE AS p FROM cn),
sz AS (SELECT *, length(replace(type, '.', ''))::DOUBLE AS z, p FROM cn, al WHERE type IS NOT NULL AND stopped > 0),
ab AS (SELECT type, stopped, plain, -2 * ((stopped * ln(p) + plain * ln(1 - p)) - (stopped * ln(0.99::DOUBLE) + plain * ln(1 - 0.99::DOUBLE)))
    * (length(type) - z + 1) * exp(-z - plain * ln(z)) AS score FROM sz),
learned AS (SELECT * FROM ab WHERE score >= 0.3)"""


@register("abbreviations_learned", f"""WITH {_STOPS_SQL}
SELECT type, stopped, plain, round(score, 4) AS score FROM learned""")
def abbreviations_learned(spark, sf_dir):
    """C-06: the abbreviations of the whole corpus, from how often each word
    stands with and without a full stop."""
    d = spread(read_table(spark, sf_dir, "documents").select("text")).select(words(_abbreviated(F.col("text"))).alias("w"))
    return learn_abbreviations(d, "w").select("type", "stopped", "plain", F.round("score", 4).alias("score"))


@register("learned_sentences", rf"""WITH {_STOPS_SQL}
SELECT doc_id, count(*) FILTER (WHERE i = n OR (regexp_matches(w, '[.!?]["'')\]]*$') AND NOT (s AND type IN (SELECT type FROM learned)))) AS n_sentences,
  count(*) FILTER (WHERE i = n OR regexp_matches(w, '[.!?]["'')\]]*$')) AS n_stops
FROM ty GROUP BY doc_id""")
def learned_sentences(spark, sf_dir):
    """C-06 / P-23: sentences of every document, full stops of learned
    abbreviations left out, beside all of its final marks."""
    d = spread(read_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", words(_abbreviated(F.col("text"))).alias("w"))
    e = marked_ends(d, "w", learn_abbreviations(d, "w"), ["doc_id"])
    return e.select("doc_id", F.size("ends").cast("long").alias("n_sentences"), F.size("marks").cast("long").alias("n_stops"))


def _sent_sql(x):
    return (f"(CASE WHEN {S.word_count(x)} = 0 THEN 0 ELSE greatest(len(regexp_extract_all({x}, "
            f"{S.q(pt.SENT_END_RE)})), 1) END)")


@register("corpus_stats_cube", f"""SELECT lang, source, count(*) AS n_texts,
  CAST(sum({_sent_sql('text')}) AS BIGINT) AS n_sentences, CAST(sum({S.word_count('text')}) AS BIGINT) AS n_tokens,
  CAST(grouping(lang, source) AS BIGINT) AS gid
FROM documents GROUP BY CUBE (lang, source)""")
def corpus_stats_cube(spark, sf_dir):
    """M-11: texts, sentences and tokens by language x source with subtotals
    and the grand total (grouping sets via cube)."""
    from redline.functions.readability import sentence_count
    from redline.functions.text import word_count
    d = read_table(spark, sf_dir, "documents").select(
        "lang", "source", sentence_count("text").alias("s"), word_count("text").alias("w"))
    return d.cube("lang", "source").agg(
        F.count(F.lit(1)).alias("n_texts"), F.sum("s").cast("long").alias("n_sentences"),
        F.sum("w").cast("long").alias("n_tokens"), F.grouping_id().cast("long").alias("gid"))


def _norm_hash_sql(x):
    return f"sha256(trim(regexp_replace(lower({x}), {S.q(pt.WS_RUN)}, ' ', 'g')))"


@register("duplicate_audit", f"""SELECT {_norm_hash_sql('text')} AS text_hash, count(*) AS n_copies,
  min(doc_id) AS first_doc_id FROM documents GROUP BY 1 HAVING count(*) > 1""")
def duplicate_audit(spark, sf_dir):
    """X-01: groups of exact duplicates after case and blank normalisation."""
    d = read_table(spark, sf_dir, "documents")
    return duplicate_groups(d, "text", "doc_id").where(F.col("n_copies") > 1)


@register("dedup_exact", f"""WITH h AS (SELECT doc_id, lang, {_norm_hash_sql('text')} AS k FROM documents),
f AS (SELECT k, min(doc_id) AS doc_id FROM h GROUP BY k)
SELECT lang, count(*) AS n_docs, count(*) FILTER (WHERE h.doc_id IN (SELECT doc_id FROM f)) AS n_kept
FROM h GROUP BY lang""")
def dedup_exact_q(spark, sf_dir):
    """X-01: keep the first copy of each duplicate group (per language: all vs kept)."""
    d = read_table(spark, sf_dir, "documents")
    kept = dedup_exact(d, "text", "doc_id").select("doc_id", F.lit(True).alias("_kept"))
    j = d.select("doc_id", "lang").join(kept, "doc_id", "left")
    return j.groupBy("lang").agg(F.count(F.lit(1)).alias("n_docs"), F.count_if(F.col("_kept")).alias("n_kept"))


def _grams_sql(src, key, n=8):
    """8-grams of (key, t) by position: each token with the next seven."""
    nxt = " || ' ' || ".join(f"lead(tok, {k}) OVER w" for k in range(1, n))
    return (f"SELECT {key}, g FROM (SELECT {key}, tok || ' ' || {nxt} AS g FROM "
            f"(SELECT {key}, unnest(t) AS tok, generate_subscripts(t, 1) AS pos FROM {src}) "
            f"WINDOW w AS (PARTITION BY {key} ORDER BY pos)) WHERE g IS NOT NULL")


@register("split_overlap", f"""WITH b AS (SELECT item_id, {S.tokens('text')} AS t FROM benchmark),
d AS (SELECT doc_id, {S.tokens('text')} AS t FROM documents),
bg AS ({_grams_sql('b', 'item_id')}),
dg AS (SELECT DISTINCT g FROM ({_grams_sql('d', 'doc_id')})),
hits AS (SELECT bg.item_id, bg.g, dg.g IS NOT NULL AS hit FROM bg LEFT JOIN dg ON dg.g = bg.g)
SELECT b.item_id, count(hits.g) AS n_grams, count(*) FILTER (WHERE hits.hit) AS n_overlap
FROM b LEFT JOIN hits ON hits.item_id = b.item_id GROUP BY b.item_id""")
def split_overlap(spark, sf_dir):
    """X-02: for every evaluation item, how many of its 8-grams occur in the
    training documents. Document grams are semi-joined against the (small)
    item grams map-side before anything is shuffled."""
    bench = read_table(spark, sf_dir, "benchmark").select("item_id", tokens("text").alias("t"))
    docs = spread(read_table(spark, sf_dir, "documents")).select("doc_id", tokens("text").alias("t"))
    return ngram_overlap(bench, "item_id", "t", docs, "doc_id", "t", n=8)


@register("union_runs", f"""WITH {S.LINES},
u AS (SELECT doc_id, line_no, line AS text FROM lines
      UNION ALL BY NAME SELECT conv_id, turn, text FROM conversations)
SELECT CASE WHEN doc_id IS NOT NULL THEN 'documents' ELSE 'conversations' END AS origin,
  count(*) AS n_rows, CAST(sum({S.word_count('text')}) AS BIGINT) AS n_words FROM u GROUP BY 1""")
def union_runs(spark, sf_dir):
    """U-01: bag union of runs with different columns (missing -> NULL)."""
    a = lines(read_table(spark, sf_dir, "documents")).select("doc_id", "line_no", F.col("line").alias("text"))
    b = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    u = a.unionByName(b, allowMissingColumns=True)
    return u.groupBy(F.when(F.col("doc_id").isNotNull(), "documents").otherwise("conversations").alias("origin")) \
        .agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.size(words("text"))).cast("long").alias("n_words"))



@register("build_corpus", f"""WITH {S.triples_cte(('identity',))}, {S.TURN_TRIPLES},
u AS (
  SELECT 'm2_lines' AS dataset, array_to_string({S.words('input_text')}, ' ') AS input_text,
         array_to_string({S.words('target_text')}, ' ') AS target_text FROM triples
  UNION ALL
  SELECT 'nested_refs', input_text, [target_text, replace(input_text, ' and ', ' or ')][1] FROM triples
  UNION ALL
  SELECT 'aligned_turns', input_text, prediction FROM turn_triples),
c AS (SELECT dataset, input_text, target_text, replace(input_text, ' - ', '-') AS ci,
        replace(target_text, ' - ', '-') AS ct FROM u)
SELECT dataset, CASE WHEN length(input_text) % 10 = 0 THEN 'dev' ELSE 'train' END AS split, count(*) AS n_pairs, count(*) FILTER (WHERE ci <> input_text OR ct <> target_text) AS n_changed,
  CAST(sum(length(ct)) AS BIGINT) AS n_target_chars FROM c GROUP BY dataset, split""")
def build_corpus(spark, sf_dir):
    """C-03: several corpora -> one pair table: M2 sentences (formatted and
    parsed back), a nested-reference set (first reference, P-02) and aligned
    conversation turns; spaced hyphens cleaned (P-01), routed to train or dev by
    file name, written by dataset and split (K-01), read back and counted."""
    from redline.functions.text import clean_spaced_hyphens
    from redline.plans.fixtures import rule_prediction, triples
    from redline.plans.q_edits import m2_roundtrip
    from redline.sinks import write_triples
    from redline.sources.readers import nested_to_pairs, route_files
    m2 = m2_roundtrip(spark, sf_dir).select(F.lit("m2_lines").alias("dataset"), "input_text", "target_text")
    t = triples(spark, sf_dir, models=("identity",)).select(
        "input_text", F.array("target_text", rule_prediction("swap", "input_text")).alias("refs"))
    nested = nested_to_pairs(t, "input_text", "refs").select(
        F.lit("nested_refs").alias("dataset"), "input_text", "target_text")
    turns = turn_triples(spark, sf_dir).select(F.lit("aligned_turns").alias("dataset"), "input_text",
                                               F.col("prediction").alias("target_text"))
    u = m2.unionByName(nested).unionByName(turns)
    name = F.concat(F.col("dataset"), F.when(F.length("input_text") % 10 == 0, "_dev.m2").otherwise("_train.m2"))
    c = route_files(u.withColumn("file", name)).select(
        "dataset", "split", clean_spaced_hyphens("input_text").alias("input_text"), clean_spaced_hyphens("target_text").alias("target_text"),
        ((clean_spaced_hyphens("input_text") != F.col("input_text")) | (clean_spaced_hyphens("target_text") != F.col("target_text"))).alias("changed"))
    root = shared_path(spark, "corpus")
    write_triples(c, root, ("dataset", "split"))
    return spark.read.parquet(root).groupBy("dataset", "split").agg(
        F.count(F.lit(1)).alias("n_pairs"), F.count_if("changed").alias("n_changed"), F.sum(F.length("target_text")).cast("long").alias("n_target_chars"))
