"""Readers and writers on small files written by the test (formats of FIXTURES §1)."""

import gzip
import os

import pandas as pd
from pyspark.sql import functions as F

from redline.sinks import write_m2, write_metrics, write_stage, write_triples
from redline.sources import (
    PANDAS_NA,
    nonblank,
    parse_essays,
    read_documents,
    read_m2,
    read_nested_refs,
    read_triples,
    require_columns,
    route_files,
)


def test_read_triples_pandas_csv(spark, tmpdir_path):
    pdf = pd.DataFrame({"input_text": ['He said "hi", then\nleft', "a b", "x"],
                        "target_text": ["t1", "", "NA"], "prediction": ["p1", "p2", None]})
    path = os.path.join(tmpdir_path, "grammar_model_public_test.csv")
    pdf.to_csv(path, index=False)
    df = read_triples(spark, path)
    rows = sorted(df.collect(), key=lambda r: r.input_text)
    assert rows[0].input_text == 'He said "hi", then\nleft'
    assert rows[1].target_text is None and rows[2].prediction is None
    assert rows[2].target_text == "NA"
    assert read_triples(spark, path, na_values=PANDAS_NA).where("input_text = 'x'").first().target_text is None
    assert require_columns(df, ["input_text", "target_text", "prediction"])
    r = route_files(df).select("split", "task").first()
    assert (r.split, r.task) == ("test", "grammar")


def test_read_m2_file(spark, tmpdir_path):
    path = os.path.join(tmpdir_path, "x.m2")
    with open(path, "w") as f:
        f.write("S a b c d e\nA 2 2|||M|||x|||REQUIRED|||-NONE-|||0\nA 2 3|||R|||y|||REQUIRED|||-NONE-|||0\n"
                "A 4 5|||U|||-NONE-|||REQUIRED|||-NONE-|||0\n\nS f g\nA -1 -1|||noop|||-NONE-|||REQUIRED|||-NONE-|||0\n"
                "\n\nS h i j\nA 0 1|||R|||p q|||REQUIRED|||-NONE-|||0\nS k\n")
    out = sorted((r.input_text, r.target_text) for r in read_m2(spark, path).collect())
    assert out == [("a b c d e", "a b y c d"), ("f g", "f g"), ("h i j", "p q i j"), ("k", "k")]


def test_parse_essays_heterogeneous(spark):
    line = ('{"id":"1","text":"I has a  dog","edits":[[0,[[2,5,"have"],[6,7,null],[8,8,"big","M:ADJ"]]],'
            '[1,[]]]}')
    df = parse_essays(spark.createDataFrame([(line,)], "value string"))
    got = [(r.id, r.coder, r.ord, r.start, r.end, r.cor, r.type) for r in df.orderBy("coder", "ord").collect()]
    assert got == [("1", 0, 0, 2, 5, "have", None), ("1", 0, 1, 6, 7, None, None),
                   ("1", 0, 2, 8, 8, "big", "M:ADJ"), ("1", 1, None, None, None, None, None)]


def test_read_documents(spark, tmpdir_path):
    d = os.path.join(tmpdir_path, "docs", "sub")
    os.makedirs(d)
    with gzip.open(os.path.join(d, "a.html.gz"), "wb") as f:
        f.write(b"<html><script>x=1</script><p>Hello &amp; bye</p></html>")
    with gzip.open(os.path.join(d, "b.txt.gz"), "wb") as f:
        f.write(b"plain \xff text")
    with gzip.open(os.path.join(d, "c.pdf.gz"), "wb") as f:
        f.write(b"%PDF")
    with open(os.path.join(d, "d.txt.gz"), "wb") as f:
        f.write(b"\x1f\x8bbroken")
    rows = {os.path.basename(r.path): r for r in read_documents(spark, os.path.join(tmpdir_path, "docs"), keep_blank=True).collect()}
    assert rows["a.html.gz"].text == "Hello & bye" and rows["a.html.gz"].status == "ok"
    assert rows["b.txt.gz"].text == "plain  text"
    assert rows["c.pdf.gz"].status == "unsupported"
    assert rows["d.txt.gz"].status == "error"
    assert read_documents(spark, os.path.join(tmpdir_path, "docs")).count() == 2
    blanks = spark.createDataFrame([("\n\t ",), ("x",), ("",), (None,)], "text string")
    assert [r.text for r in nonblank(blanks).collect()] == ["x"]


def test_writers(spark, tmpdir_path):
    df = spark.createDataFrame([("grammar", "m/x.1", "d", "a", "b", "c")],
                               "task string, model string, dataset string, input_text string, target_text string, prediction string")
    write_triples(df, os.path.join(tmpdir_path, "t"))
    assert spark.read.parquet(os.path.join(tmpdir_path, "t")).count() == 1
    write_metrics(df.select(F.lit(1).alias("total_examples")), os.path.join(tmpdir_path, "m"))
    assert spark.read.json(os.path.join(tmpdir_path, "m")).first().total_examples == 1
    write_m2(spark.createDataFrame([("S a b\nA -1 -1|||noop|||-NONE-|||REQUIRED|||-NONE-|||0",)], "block string"),
             os.path.join(tmpdir_path, "m2"))
    assert read_m2(spark, os.path.join(tmpdir_path, "m2")).first().target_text == "a b"


def test_runs_survive_side_by_side(spark, tmpdir_path):
    root = os.path.join(tmpdir_path, "runs")
    one = spark.createDataFrame([("grammar", "m1", "d", "x")], "task string, model string, dataset string, prediction string")
    two = one.withColumn("model", F.lit("m2"))
    for df in (one, two, one):
        write_triples(df, root)
    assert sorted(r.model for r in spark.read.parquet(root).collect()) == ["m1", "m2"]
    stages = os.path.join(tmpdir_path, "stages")
    for k in (1, 2, 1):
        write_stage(spark.createDataFrame([("p", k)], "prediction string, stage int"), stages)
    assert sorted(r.stage for r in spark.read.parquet(stages).collect()) == [1, 2]


def _blocks(spark, text, edits, **options):
    from redline.operators.essays import essays_to_m2
    rows = [("1", coder, k, *e) for coder, own in edits.items() for k, e in enumerate(own)] or [("1", 0, None, None, None, None, None)]
    e = spark.createDataFrame(rows, "essay_id string, coder int, ord int, start int, end int, cor string, type string")
    essays = spark.createDataFrame([("1", text)], "essay_id string, text string")
    return [r.block.split("\n") for r in essays_to_m2(essays, e, **options).orderBy("para_no", "sent_no").collect()]


def test_m2_order_overlap_and_normalised_text(spark):
    # ordered by end, then start
    (got,) = _blocks(spark, "one two three four", {0: [(0, 7, "x", None), (4, 5, "w", None)]})
    assert [ln.split("|||")[0] for ln in got] == ["S one two three four", "A 0 2"]
    (got,) = _blocks(spark, "one two three four", {0: [(0, 7, "x y z", None), (0, 3, "q", None)]})
    assert [ln.split("|||")[0] for ln in got[1:]] == ["A 0 1", "A 0 2"]
    # two edits inside one word: the first one stays
    (got,) = _blocks(spark, "hello", {0: [(1, 2, "X", None), (3, 4, "Y", None)]})
    assert len(got) == 2 and got[1].split("|||")[2] == "hXllo"
    # text is normalised, corrections are minimised, an unchanged one goes
    (got,) = _blocks(spark, "It\u2019s a dog", {0: [(0, 10, "It's a cat", None), (0, 4, "It's", None)]})
    assert got[0] == "S It's a dog" and got[1].startswith("A 2 3|||C|||cat") and len(got) == 2
    # a coder whose edits all go still has a line
    (got,) = _blocks(spark, "one two", {0: [], 1: [(0, 3, "one", None)]})
    assert got[1:] == ["A -1 -1|||noop|||-NONE-|||REQUIRED|||-NONE-|||1"]


def test_m2_auto_edits_and_pre_split_text(spark):
    edits = {0: [(0, 3, "a b", None), (8, 13, "", None)]}
    assert _blocks(spark, "one two three.", edits, edit_mode="auto")[0][1:] == [
        "A 0 1|||R|||a b|||REQUIRED|||-NONE-|||0", "A 2 3|||R|||.|||REQUIRED|||-NONE-|||0"]
    assert len(_blocks(spark, "One. Two.", {0: [(0, 3, "x", None)]})) == 2
    assert len(_blocks(spark, "One. Two.", {0: [(0, 3, "x", None)]}, pre_split=True)) == 1


def test_essays_to_m2_end_to_end(spark):
    from redline.operators.essays import essays_to_m2
    line = ('{"id":"7","text":"I has a  dog. It run fast.\\nOk.","edits":[[0,[[2,5,"have"],[17,20,"runs"]]],[1,[]]]}')
    e = parse_essays(spark.createDataFrame([(line,)], "value string")).withColumnRenamed("id", "essay_id")
    essays = e.select("essay_id", "text").distinct()
    got = {(r.para_no, r.sent_no): r.block for r in essays_to_m2(essays, e).collect()}
    noop = "A -1 -1|||noop|||-NONE-|||REQUIRED|||-NONE-|||"
    assert got[(0, 0)] == "S I has a dog.\nA 1 2|||C|||have|||REQUIRED|||-NONE-|||0\n" + noop + "1"
    assert got[(0, 1)] == "S It run fast.\nA 1 2|||C|||runs|||REQUIRED|||-NONE-|||0\n" + noop + "1"
    assert got[(1, 0)] == "S Ok.\n" + noop + "0\n" + noop + "1"


def test_read_nested_refs(spark, tmpdir_path):
    path = os.path.join(tmpdir_path, "refs")
    spark.createDataFrame([("a b", ["a c", "x"]), ("d", [])], "sentence string, corrections array<string>") \
        .write.parquet(path)
    rows = {r.input_text: r for r in read_nested_refs(spark, path, "sentence", "corrections").collect()}
    assert rows["a b"].target_text == "a c" and rows["a b"].references == ["a c", "x"]
    assert rows["d"].target_text is None


def test_treebank_tokens(spark):
    from redline.functions.tokens import tokens
    r = spark.createDataFrame([("I can't go, he said.",)], "t string").select(tokens("t", "treebank").alias("x")).first()
    assert r.x == ["i", "ca", "n't", "go", ",", "he", "said", "."]


def test_drop_empty_edits(spark):
    from redline.operators.edits import drop_empty_edits
    df = spark.createDataFrame([([(1, 1, ""), (1, 2, ""), (2, 2, "x")],)],
                               "e array<struct<o_start:int,o_end:int,c_str:string>>")
    assert [tuple(x) for x in df.select(drop_empty_edits("e").alias("k")).first().k] == [(1, 2, ""), (2, 2, "x")]


def test_rejected_essays(spark):
    from redline.sources import rejected_essays
    lines = ['{"id":"2","text":"x"', "[1]", '{"id":"3","text":"no edits"}', '{"id":"4","edits":[]}', '{"id":"5","text":"t","edits":7}',
             '{"id":"6","text":"t","edits":[[0,[["a",5,"have"],[6],[0,1,"y"]]],[1],["x",[]],[2,[]]]}', '{"id":"7","text":"t","edits":null}', "", "  ", None]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(lines)], "line int, value string")
    good = sorted(((r.id, r.coder, r.ord, r.start, r.end, r.cor) for r in parse_essays(df).collect()), key=str)
    assert good == sorted([("3", None, None, None, None, None), ("6", 0, 2, 0, 1, "y"), ("6", 2, None, None, None, None), ("7", None, None, None, None, None)], key=str)
    bad = sorted((r.line, r.id or "", r.error, r.raw) for r in rejected_essays(df).collect())
    assert bad == [(0, "", "not JSON", lines[0]), (1, "", "not an object", "[1]"), (3, "4", "no text", lines[3]), (4, "5", "edits are no list", lines[4]),
                   (5, "6", "unreadable coder", '["x",[]]'), (5, "6", "unreadable coder", "[1]"),
                   (5, "6", "unreadable edit", '["a",5,"have"]'), (5, "6", "unreadable edit", "[6]")]


def test_inflate_pieces():
    from redline.sources.readers import inflate, text_pieces
    text = "".join(f"line {k} é世\n" for k in range(5000)) + "end"
    raw = gzip.compress(text[:3000].encode()) + gzip.compress(b"") + gzip.compress(text[3000:].encode()) + b"\0" * 512
    for block in (1, 100, 1 << 20):
        pieces = list(inflate(raw, block)) if block > 1 else list(inflate(gzip.compress(text[:200].encode()), block))
        assert all(len(p) <= block for p in pieces)
        assert b"".join(pieces).decode() == (text if block > 1 else text[:200])
    parts = list(text_pieces(raw, 1000))
    assert "".join(parts) == text and len(parts) > 10 and all(p.endswith("\n") for p in parts[:-1])
    assert "".join(text_pieces(text.encode() + b"\xff\xc3")) == text


def test_inflating_holds_a_piece_at_a_time():
    import tracemalloc

    from redline.sources.readers import text_pieces
    raw = gzip.compress(b"a line of a very long file\n" * 8_000_000)  # 216 MB
    tracemalloc.start()
    total = sum(len(p) for p in text_pieces(raw))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert total == 27 * 8_000_000 and peak < 30 << 20


def test_read_text_parts(spark, tmpdir_path):
    from redline.sources import read_text_parts
    text = "".join(f"{k} line\n" for k in range(20_000))
    whole = gzip.compress(text.encode())
    for name, raw in (("a.txt.gz", whole), ("b.txt.gz", whole[:len(whole) // 2]), ("c.txt.gz", b"plain\n")):
        with open(os.path.join(tmpdir_path, name), "wb") as f:
            f.write(raw)
    rows = read_text_parts(spark, tmpdir_path, size=10_000).orderBy("path", "part").collect()
    of = lambda n: [r for r in rows if r.path.endswith(n)]
    assert "".join(r.text for r in of("a.txt.gz")) == text and [r.part for r in of("a.txt.gz")] == list(range(len(of("a.txt.gz")))) and len(of("a.txt.gz")) > 5
    assert [r.status for r in of("b.txt.gz")][-1] == "error" and {r.status for r in of("b.txt.gz")[:-1]} <= {"ok"}
    assert [(r.text, r.status) for r in of("c.txt.gz")] == [("plain\n", "ok")]


def test_documents_are_decoded_file_by_file(spark, tmpdir_path):
    """The texts of large files don't wait for each other, small ones go together, and only
    HTML reaches the patterns of markup."""
    import pyarrow as pa
    from redline.sources import readers
    texts = ["é" * readers.INFLATED, "a", "b&amp;", "x\n" * readers.INFLATED, "c"]
    raw = [gzip.compress(t.encode()) for t in texts]
    raw[2] = raw[2][:-9]  # cut off
    names = [f"{k}.txt.gz" for k in range(5)]
    batch = pa.RecordBatch.from_arrays([pa.array(names), pa.array(["txt"] * 4 + ["pdf"]), pa.array(raw, pa.binary())], names=["path", "doc_type", "content"])
    out = list(readers._decode_files(iter([batch])))
    assert [o.num_rows for o in out] == [1, 3, 1]
    rows = [tuple(r.values()) for o in out for r in o.to_pylist()]
    assert rows == [(n, k, t, s) for n, k, t, s in zip(names, ["txt"] * 4 + ["pdf"], [*texts[:2], "", texts[3], ""], ["ok", "ok", "error", "ok", "unsupported"], strict=True)]
    with gzip.open(os.path.join(tmpdir_path, "a.txt.gz"), "wb") as f:
        f.write(b"<p>1 &amp; 2")
    got = read_documents(spark, tmpdir_path)
    assert [r.text for r in got.collect()] == ["<p>1 &amp; 2"]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and plan.count("regexp_replace(CASE WHEN (doc_type") == plan.count("regexp_replace(") - plan.count("regexp_replace(translate(") > 0
