"""Every registered query against its DuckDB oracle at sf0.001 (the driver
does the same at sf0.01), plus the entry contract and plan shape checks."""

import hashlib
import math
import os

import duckdb
import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"
TABLES = ["documents", "conversations", "pages", "benchmark", "labels", "events"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def _digest(cols, rows):
    def norm(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
        return repr(v)
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return hashlib.md5("\n".join(sorted("|".join(norm(r[i]) for i in order) for r in rows)).encode()).hexdigest()


def test_entry(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0 and "sari_score" in df.columns


@pytest.mark.parametrize("name", sorted(E.oracle_sql()))
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF)
    srows = df.collect()
    cur = con.execute(E.oracle_sql()[name])
    ocols = [d[0] for d in cur.description]
    orows = cur.fetchall()
    assert sorted(df.columns) == sorted(ocols)
    assert len(srows) == len(orows)
    assert _digest(df.columns, srows) == _digest(ocols, orows)


def test_every_query_of_the_library_has_an_oracle():
    from redline.plans import ORACLE, QUERIES
    assert set(QUERIES) == set(ORACLE)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scorers_have_no_python_and_no_shuffle(spark):
    from redline.functions.tokens import tokens
    from redline.operators.scores import gleu, score_triples
    from redline.plans.fixtures import triples
    sari = _plan(score_triples(triples(spark, SF), metrics=("sari_recall", "sari_f1")))
    assert "ArrowEvalPython" not in sari and "BatchEvalPython" not in sari
    t = triples(spark, SF)
    builtin = _plan(t.select(gleu(tokens("prediction"), tokens("target_text")).alias("g")))
    scored = _plan(score_triples(t, metrics=("gleu",)))
    assert not any("EvalPython" in p for p in (builtin, scored))
    # the alignment of the rows that need one is the record's only Python
    assert _plan(E.queries()["grammar_record"](spark, SF)).count("ArrowEvalPython") <= 2
    # The only exchange allowed is the round-robin spread of a one-file input.
    for plan in (sari, builtin, scored):
        assert "hashpartitioning" not in plan


def test_gleu_equals_counters(spark):
    """Against plain counters, on turns and on rows that repeat n-grams on both sides."""
    from collections import Counter

    from redline.functions.tokens import tokens
    from redline.operators.scores import gleu
    from redline.plans.fixtures import turn_triples
    extra = spark.createDataFrame([("a a a b", "a a b b"), ("", ""), ("", "x"), ("x", "x"), ("a b a b a b", "b a b a"), (None, "x")],
                                  "prediction string, target_text string")
    t = turn_triples(spark, SF).select("prediction", "target_text").union(extra)
    rows = t.select(tokens("prediction").alias("p"), tokens("target_text").alias("r")).select("p", "r", gleu("p", "r").alias("g")).collect()

    def plain(p, r):
        c, d = (Counter(tuple(x[k:k + n]) for n in range(1, 5) for k in range(len(x) - n + 1)) for x in (p, r))
        n = max(sum(c.values()), sum(d.values()))
        return sum((c & d).values()) / n if n else 0.0
    for row in rows:
        assert row.g is None if row.p is None else abs(row.g - plain(row.p, row.r)) < 1e-12


def test_scan_prunes_columns(spark):
    df = E.queries()["length_compression"](spark, SF)
    plan = _plan(df)
    # Only the text column is read: keys, lang, source and n_chars are pruned.
    assert "ReadSchema: struct<text:string>" in plan


def test_metrics_single_final_exchange(spark):
    df = E.queries()["readability_record"](spark, SF)
    plan = _plan(df)
    assert plan.count("hashpartitioning(model") == 1
