import duckdb
import pytest
from pyspark.sql import functions as F

from redline.llm import mixing

SF = "/root/testdata/sf0.001"


def filled(sizes, weights, share=1.5, most=2):
    """Share by weight, cap, reshare the excess by weight until none is above."""
    total = share * sum(sizes)
    capped = set()
    while True:
        free = [k for k in range(len(sizes)) if k not in capped]
        left = total - sum(most * sizes[k] for k in capped)
        target = [most * sizes[k] if k in capped else left * weights[k] / sum(weights[j] for j in free) for k in range(len(sizes))]
        over = {k for k in free if target[k] > most * sizes[k] + 1e-9}
        if not over:
            return target
        capped |= over


def test_equals_oracle(spark, small):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    cur = con.execute(mixing.ORACLE)
    names = [d[0] for d in cur.description]
    got = mixing.query(small).select(*names).collect()
    assert sorted(map(tuple, got)) == sorted(cur.fetchall())


@pytest.mark.parametrize("sizes", [[10, 10, 10], [1, 100, 3, 7], [5], [0, 4, 9, 2, 2, 50], [0, 0]])
def test_targets(spark, sizes):
    rows = spark.createDataFrame([(f"s{k}" if k else None, n) for k, n in enumerate(sizes)], "source string, size long")
    got = {r.source: r.target for r in mixing.source_targets(rows).collect()}
    order = [*(f"s{k}" for k in range(1, len(sizes))), None]
    by = dict(zip([None, *order[:-1]], sizes, strict=True))
    want = filled([by[s] for s in order], [(5, 2, 1)[k % 3] for k in range(len(order))])
    assert [got[s] for s in order] == pytest.approx(want)


def test_awkward(awkward, empty, crowded):
    a, b = (sorted(map(str, mixing.query(awkward).collect())) for _ in range(2))
    assert a == b and len(a) == awkward.count()
    assert mixing.query(empty).collect() == []
    copies = mixing.mix(crowded)
    assert copies.where("copies < 0 or copies > 2").count() == 0
    out = mixing.emit(crowded)
    assert out.columns == crowded.columns and out.count() == copies.agg(F.sum("copies")).first()[0]
    assert mixing.emit(empty).collect() == []


def taken(docs):
    return mixing.mix(docs).groupBy("source").agg(F.max("target").alias("t"), F.sum(F.col("size") * F.col("copies")).alias("n"),
                                                  F.sum(F.col("size") * F.col("size")).alias("square")).collect()


def test_taken_is_near_the_target(spark, medium):
    """Each source within four standard deviations of independent draws."""
    for docs in (medium, spark.read.parquet("/root/testdata/sf0.1/documents.parquet")):
        for r in taken(docs):
            assert abs(r.n - r.t) <= 4 * (r.square / 4) ** 0.5, r


def test_repeated_and_missing_ids(spark):
    """Sources whose rows share an id, have none, or are equal in everything: within 2 per cent,
    and those of equal rows within one row."""
    def text(s, i):
        return f"{s} {i} " + "w " * 8
    rows = [(i, text("a", i), "a") for i in range(400)] + [(None, text("b", i), "b") for i in range(4000)] + [(7, text("c", i), "c") for i in range(4000)]
    rows += [(9, text("d", 0), "d")] * 400 + [(None, text("e", 0), "e")] * 400
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(6)
    for r in taken(docs):
        assert abs(r.n / r.t - 1) < (0.1 if r.source == "a" else 0.02), r
        if r.source in "de":
            assert abs(r.n - r.t) <= 10, r
    out = mixing.emit(docs).groupBy("source").count().collect()
    assert {r.source: r["count"] * 10 for r in out} == {r.source: r.n for r in taken(docs)}


def test_repeated_rows_equal_the_oracle(spark, small):
    docs = small.union(small).union(small.where("doc_id % 3 = 0")).union(small.withColumn("doc_id", F.lit(None).cast("long")))
    con = duckdb.connect()
    con.register("documents", docs.toArrow())
    want = con.execute(mixing.ORACLE).fetchall()
    got = mixing.query(docs).select("doc_id", "size", "source_size", "target", "taken").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_only_functions(small):
    plan = mixing.query(small)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan
