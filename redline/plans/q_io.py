"""Registered queries: every reader and writer on files written from the given
tables into the session's shared folder (S-01..S-08, S-10, K-01..K-03, K-05,
P-15, P-19, C-15, X-04)."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F
from pyspark.sql import types as T

from redline.functions.text import word_count, words
from redline.operators.edits import m2_block, with_aligned_edits
from redline.operators.predict import cascade
from redline.operators.scores import score_triples
from redline.plans import sql as S
from redline.plans.fixtures import lines, reference_target, rule_prediction, triples
from redline.plans.q_essays import essay_edits, essays
from redline.plans.q_essays import EDITS_SQL as _EDITS
from redline.plans.q_edits import grammar_record
from redline.plans.q_scores import readability_record
from redline.plans.q_text import html_text_q  # noqa: F401  (its SQL is reused)
from redline.plans.registry import ORACLE, register
from redline.session import read_table, shared_path
from redline.sinks import write_m2, write_metrics, write_stage, write_triples
from redline.sources.quoted import read_quoted_csv, read_runs
from redline.sources.readers import nested_to_pairs, read_documents, read_essays, read_m2, read_nested_refs, read_rejected_essays, read_sentences
from redline.streaming import run_to_path, running_metrics, stream_triples_metrics


@register("triples_csv_files", f"""WITH {S.triples_cte(('swap',))},
f AS (SELECT unnest(['grammar_swap.csv', 'readability_swap.csv']) AS file)
SELECT file, CASE WHEN file LIKE 'grammar%' THEN 'grammar' ELSE 'readability' END AS task, count(*) AS n_rows,
  CAST(sum(length(input_text)) AS BIGINT) AS n_input, CAST(sum(length(prediction)) AS BIGINT) AS n_prediction,
  count(*) FILTER (WHERE prediction = input_text) AS n_same,
  'notes_swap.csv: no task in its name; readability_broken.csv: missing prediction' AS skipped
FROM triples, f GROUP BY file""")
def triples_csv_files(spark, sf_dir):
    """S-01 / S-08 / S-10: runs saved as CSV, found, routed by name and read
    back; a file of no task and one without a column are skipped and reported."""
    root = shared_path(spark, "runs-csv")
    t = triples(spark, sf_dir, models=("swap",)).select("input_text", "target_text", "prediction")
    names = ["readability_swap.csv", "grammar_swap.csv", "notes_swap.csv", "readability_broken.csv"]
    for name in names:
        write_triples(t.drop("prediction") if "broken" in name else t, f"{root}/{name}", (), fmt="csv", compression="gzip")
    got, skipped = read_runs(spark, f"{root}/*")
    told = "; ".join(sorted(f"{r.file}: {r.why}" for r in skipped.collect()))
    return got.groupBy("file", "task").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum(F.length("input_text")).alias("n_input"), F.sum(F.length("prediction")).alias("n_prediction"),
        F.count_if(F.col("prediction") == F.col("input_text")).alias("n_same"), F.lit(told).alias("skipped"))


@register("quoted_csv_file", """SELECT doc_id, CAST(length(text) AS INTEGER) AS n_chars, md5(text) AS text_md5, md5(concat(source, ', "', lang, '"')) AS note_md5
FROM documents WHERE text <> ''""")
def quoted_csv_file(spark, sf_dir):
    """S-01: whole documents, line ends and quotes included, as quoted CSV
    files, written by as many tasks as the table has and read back by as many as
    they have splits."""
    root = shared_path(spark, "documents-csv")
    d = read_table(spark, sf_dir, "documents").where("text <> ''")
    texts = d.select(F.col("doc_id").cast("string"), "text", F.concat("source", F.lit(', "'), "lang", F.lit('"')).alias("note"))
    write_triples(texts, root, (), fmt="csv")
    schema = T.StructType([T.StructField(c, T.StringType()) for c in ("doc_id", "text", "note")])
    return read_quoted_csv(spark, root, schema).select(F.col("doc_id").cast("long").alias("doc_id"), F.length("text").alias("n_chars"),
                                                       F.md5("text").alias("text_md5"), F.md5("note").alias("note_md5"))


@register("saved_runs", f"""WITH {S.triples_cte(('swap', 'drop_last'))}
SELECT 'grammar' AS task, model, lang AS dataset, count(*) AS n_rows, CAST(sum(length(prediction)) AS BIGINT) AS n_chars
FROM triples GROUP BY model, lang""")
def saved_runs_q(spark, sf_dir):
    """K-01: two models saved to one path, the first one twice: both are there, once."""
    root = shared_path(spark, "runs")
    for model in ("swap", "drop_last", "swap"):
        t = triples(spark, sf_dir, models=(model,)).withColumn("task", F.lit("grammar")).withColumnRenamed("lang", "dataset")
        write_triples(t.select("task", "model", "dataset", "input_text", "target_text", "prediction"), root)
    return spark.read.parquet(root).groupBy("task", "model", "dataset").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum(F.length("prediction")).alias("n_chars"))


@register("m2_files", f"""WITH {S.triples_cte(('swap',))},
p AS (SELECT array_to_string({S.words('input_text')}, ' ') AS input_text, array_to_string({S.words('prediction')}, ' ') AS target_text FROM triples)
SELECT md5(input_text) AS input_md5, md5(target_text) AS target_md5, count(*) AS n FROM p GROUP BY ALL""")
def m2_files(spark, sf_dir):
    """S-02 / K-05: sentences and edits written as M2 text, read back through
    the block splitter and applied."""
    root = shared_path(spark, "m2")
    t = triples(spark, sf_dir, models=("swap",)).select(words("input_text").alias("a"), words("prediction").alias("b"))
    t = with_aligned_edits(t, {"e": ("a", "b")}, [F.array_join("a", " ").alias("src")])
    coder = F.array(F.struct(F.lit(0).alias("coder"), F.col("e").alias("edits")))
    write_m2(t.select(m2_block(F.array("src"), coder).alias("block")), root)
    return read_m2(spark, root).groupBy(F.md5("input_text").alias("input_md5"), F.md5("target_text").alias("target_md5")).agg(
        F.count(F.lit(1)).alias("n"))


@register("nested_refs_files", f"""WITH {S.LINES}
SELECT md5(line) AS input_md5, md5(replace(line, ' the ', ' a ')) AS target_md5, CAST(2 AS INTEGER) AS n_refs, count(*) AS n FROM lines GROUP BY ALL""")
def nested_refs_files(spark, sf_dir):
    """S-04 / P-02: a table with a list of references per source, written and read as pairs."""
    root = shared_path(spark, "refs")
    ln = lines(read_table(spark, sf_dir, "documents"))
    ln.select(F.col("line").alias("sentence"), F.array(reference_target("line"), rule_prediction("swap", "line")).alias("corrections")).write.parquet(root)
    r = read_nested_refs(spark, root, "sentence", "corrections")
    return r.groupBy(F.md5("input_text").alias("input_md5"), F.md5("target_text").alias("target_md5"), F.size("references").alias("n_refs")).agg(
        F.count(F.lit(1)).alias("n"))


@register("essay_json_files", f"""WITH {_EDITS}
SELECT CAST(essay_id AS VARCHAR) AS id, coder, ord, CAST(start AS INTEGER) AS start, CAST("end" AS INTEGER) AS "end", cor, type,
  md5(text) AS text_md5 FROM ed JOIN es USING (essay_id)""")
def essay_json_files(spark, sf_dir):
    """S-05: essays with nested edit lists of mixed types as JSON lines, read back."""
    root = shared_path(spark, "essays")
    es = essays(spark, sf_dir)
    one = lambda c: F.regexp_replace(F.to_json(F.array(c), {"ignoreNullFields": "false"}), r"^\[|\]$", "")
    edit = F.concat(F.lit("["), F.col("start"), F.lit(","), F.col("end"), F.lit(","), F.coalesce(one(F.col("cor")), F.lit("null")),
                    F.when(F.col("type").isNotNull(), F.concat(F.lit(","), one(F.col("type")))).otherwise(F.lit("")), F.lit("]"))
    per = essay_edits(es).select("essay_id", "coder", "ord", edit.alias("e")).groupBy("essay_id", "coder").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "e"))), lambda x: x["e"]), ",").alias("es"))
    per = per.groupBy("essay_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("coder", "es"))), lambda x: F.concat(
        F.lit("["), x["coder"], F.lit(",["), x["es"], F.lit("]]"))), ",").alias("edits"))
    text = es.join(per, "essay_id").select(F.concat(F.lit('{"id":"'), F.col("essay_id"), F.lit('","text":'), one(F.col("text")),
                                                    F.lit(',"edits":['), F.col("edits"), F.lit("]}")).alias("value"))
    text.write.text(root)
    got = read_essays(spark, root)
    return got.select("id", "coder", "ord", "start", "end", "cor", "type", F.md5("text").alias("text_md5"))


@register("sentence_files", f"""WITH {S.LINES}
SELECT md5(line) AS sentence_md5, count(*) AS n FROM lines GROUP BY 1""")
def sentence_files(spark, sf_dir):
    """S-06: tokenised sentences, one per line, written and read back."""
    root = shared_path(spark, "sentences")
    lines(read_table(spark, sf_dir, "documents")).select("line").write.text(root)
    return read_sentences(spark, root).groupBy(F.md5("sentence").alias("sentence_md5")).agg(F.count(F.lit(1)).alias("n"))


@register("gzip_documents", """SELECT lang, 'txt' AS doc_type, 'ok' AS status, CAST(sum(length(text) + 1) AS BIGINT) AS n_chars
FROM documents GROUP BY lang""")
def gzip_documents(spark, sf_dir):
    """S-07 / P-15 / P-17 / P-19 / C-15: compressed files found below a folder,
    routed, unpacked and decoded; files of blanks only are dropped."""
    root = shared_path(spark, "gz")
    d = read_table(spark, sf_dir, "documents")
    d.select("lang", "text").write.option("compression", "gzip").partitionBy("lang").text(root)
    blank = d.select(F.lit("zz").alias("lang"), F.lit(" \t ").alias("text"))
    blank.write.mode("append").option("compression", "gzip").partitionBy("lang").text(root)
    r = read_documents(spark, root)
    return r.groupBy(F.regexp_extract("path", "lang=([^/]*)/", 1).alias("lang"), "doc_type", "status").agg(
        F.sum(F.length("text")).alias("n_chars"))


@register("stage_files", f"""WITH {S.triples_cte(('identity',))}
SELECT CAST(k AS INTEGER) AS stage, CASE k WHEN 1 THEN 'swap' ELSE 'drop_last' END AS stage_model, count(*) AS n_rows,
  CAST(sum({S.word_count('input_text')}) AS BIGINT) - CASE k WHEN 2 THEN count(*) FILTER (WHERE {S.word_count('input_text')} > 0) ELSE 0 END AS n_words
FROM triples, (SELECT unnest([1, 2]) AS k) GROUP BY k""")
def stage_files(spark, sf_dir):
    """K-03: each cascade stage written, one of them twice, and read back."""
    root = shared_path(spark, "stages")
    base = triples(spark, sf_dir, models=("identity",)).select("doc_id", "line_no", "input_text")
    out = cascade(base, (("swap", partial(rule_prediction, "swap")), ("drop_last", partial(rule_prediction, "drop_last"))))
    for k in (1, 2, 1):
        write_stage(out.where(F.col("stage") == k), root)
    return spark.read.parquet(root).groupBy("stage", "stage_model").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum(word_count("prediction")).alias("n_words"))


def _written_record(spark, sf_dir, record, name):
    root = shared_path(spark, name)
    m = record(spark, sf_dir)
    write_metrics(m, root)
    return spark.read.schema(m.schema).json(root)


@register("metrics_files", ORACLE["grammar_record"])
def metrics_files(spark, sf_dir):
    """K-02: the whole grammar record of every model as JSON, read back."""
    return _written_record(spark, sf_dir, grammar_record, "grammar-metrics")


@register("metrics_files_readability", ORACLE["readability_record"])
def metrics_files_readability(spark, sf_dir):
    """K-02: the whole readability record of every model as JSON, read back."""
    return _written_record(spark, sf_dir, readability_record, "readability-metrics")


@register("gzip_pages", ORACLE["html_text"].replace("FROM pages", "FROM (SELECT page_id, translate(html, chr(10) || chr(13), '  ') AS html FROM pages)") + " WHERE text <> ''")
def gzip_pages(spark, sf_dir):
    """C-15 / P-18: every page as a compressed HTML file, found, unpacked and read as text."""
    root = shared_path(spark, "pages-gz")
    p = read_table(spark, sf_dir, "pages").select("page_id", F.translate("html", "\n\r", "  ").alias("html"))
    w = p.write.option("compression", "gzip").option("extension", "htm").option("sep", "\u0001").option("quote", "\u0000").option("escapeQuotes", False)
    w.partitionBy("page_id").csv(root)
    return read_documents(spark, root).where("doc_type = 'html'").select(F.regexp_extract("path", "page_id=([0-9]+)/", 1).cast("long").alias("page_id"), "text")


_BROKEN = {"de": "not JSON", "fr": "no text", "es": "edits are no list"}


@register("rejected_essays", f"""SELECT coalesce(e.error, 'unreadable edit') AS error, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS n_chars
FROM documents LEFT JOIN (VALUES {", ".join(f"({S.q(k)}, {S.q(v)})" for k, v in _BROKEN.items())}) e(lang, error) USING (lang) GROUP BY 1
UNION ALL SELECT 'ok', 2 * count(*), CAST(2 * sum(length(text)) AS BIGINT) FROM documents WHERE lang NOT IN ('de', 'fr', 'es')""")
def rejected_essays_q(spark, sf_dir):
    """S-05: essays as JSON lines, some cut off, some without text or with edits that
    are no list, the others with an edit that can't be read: what is read and
    what is set aside, with its error."""
    root = shared_path(spark, "broken-essays")
    d = read_table(spark, sf_dir, "documents")
    text = F.regexp_replace(F.to_json(F.struct(F.col("text").alias("t"))), r'^\{"t":|\}$', "")
    name = F.when(F.col("lang") == "fr", F.lit("txt")).otherwise(F.lit("text"))
    edits = F.when(F.col("lang") == "es", F.lit("7")).otherwise(F.lit('[[0,[[0,1,"x"],[1,"to"],[2,3,null,"M"]]]]'))
    end = F.when(F.col("lang") == "de", F.lit("")).otherwise(F.lit("}"))
    line = F.concat(F.lit('{"id":"'), "doc_id", F.lit('","'), name, F.lit('":'), text, F.lit(',"edits":'), edits, end)
    d.select(line.alias("value")).write.text(root)
    sizes = d.select(F.col("doc_id").cast("string").alias("of"), F.length("text").alias("n"))
    bad = read_rejected_essays(spark, root)
    # an essay that isn't JSON has no id: it is found in its line
    bad = bad.select(F.coalesce("id", F.regexp_extract("raw", '"id":"([0-9]+)"', 1)).alias("id"), "error")
    good = read_essays(spark, root).select("id", F.lit("ok").alias("error"))
    return good.unionByName(bad).join(sizes, F.col("id") == F.col("of")).groupBy("error").agg(F.count(F.lit(1)).alias("n"), F.sum("n").alias("n_chars"))


_STREAM_V1 = S.sari_v1_ctes("triples", ["doc_id", "line_no", "model"], S.tokens("input_text"), S.tokens("prediction"), S.tokens("target_text"))


@register("stream_scores", S.gleu_rows_sql("WITH " + S.triples_cte() + ",\nsrc AS (SELECT * FROM triples)", ["doc_id", "line_no", "model"]) + f""",
{_STREAM_V1}
SELECT model, count(*) AS n, round(avg(v1.sari), 6) AS sari_score, round(avg(scored.gleu), 6) AS gleu_score
FROM v1 JOIN scored USING (doc_id, line_no, model) GROUP BY model""")
def stream_scores(spark, sf_dir):
    """X-04: triples read as a file stream, scored, and the running metrics
    written to a path after every batch."""
    root = shared_path(spark, "stream")
    triples(spark, sf_dir).select("model", "input_text", "prediction", "target_text").write.parquet(f"{root}/in")
    schema = T.StructType([T.StructField(c, T.StringType()) for c in ("model", "input_text", "prediction", "target_text")])
    stream = spark.readStream.schema(schema).parquet(f"{root}/in")
    got = run_to_path(spark, stream_triples_metrics(stream), f"{root}/out", f"{root}/state")
    return got.select("model", "n", F.round("sari_score", 6).alias("sari_score"), F.round("gleu_score", 6).alias("gleu_score"))
