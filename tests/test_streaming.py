"""X-04: the stream result equals the batch result."""

import os

from redline.operators.scores import score_triples
from redline.plans.fixtures import triples
from redline.streaming import run_available_now, running_metrics, stream_triples_metrics

SF = "/root/testdata/sf0.001"


def test_stream_equals_batch(spark, tmpdir_path):
    src = os.path.join(tmpdir_path, "src")
    triples(spark, SF).select("model", "input_text", "prediction", "target_text").write.parquet(src)
    schema = spark.read.parquet(src).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    got = run_available_now(spark, stream_triples_metrics(stream), "redline_x04",
                            os.path.join(tmpdir_path, "ckpt"))
    batch = running_metrics(score_triples(spark.read.parquet(src), metrics=("gleu", "sari_recall")))
    def norm(df):
        return sorted((r.model, r.n, round(r.sari_score, 9), round(r.gleu_score, 9)) for r in df.collect())
    assert norm(got) == norm(batch)
    assert got.count() == 3


def test_a_crash_between_writing_and_committing(spark, tmpdir_path, monkeypatch):
    """The stream dies after a batch was written and before its commit: the batch before is what
    one reads; the restarted stream repeats the batch under its number and ends as the batch job does."""
    import pytest

    from redline.streaming import read_latest, run_to_path, scores
    src, out, state = (os.path.join(tmpdir_path, n) for n in ("src", "out", "state"))
    triples(spark, SF, models=("swap",)).select("model", "input_text", "prediction", "target_text").repartition(3).write.parquet(src)
    schema = spark.read.parquet(src).schema

    def stream():
        return stream_triples_metrics(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src))

    whole, written = scores.write_version, []

    def dying(batch, path, version):
        if version == 1 and "died" not in written:
            written.append("died")
            batch.write.mode("overwrite").parquet(f"{path}/versions/{version}")
            raise RuntimeError("lost")
        whole(batch, path, version)

    assert read_latest(spark, out) is None
    monkeypatch.setattr(scores, "write_version", dying)
    with pytest.raises(Exception, match="lost"):
        run_to_path(spark, stream(), out, state)
    counts = spark.read.parquet(src).count()
    partial = read_latest(spark, out).first().n
    assert 0 < partial < counts
    got = run_to_path(spark, stream(), out, state).first()
    batch = running_metrics(score_triples(spark.read.parquet(src), metrics=("gleu", "sari_recall"))).first()
    assert (got.n, round(got.sari_score, 9), round(got.gleu_score, 9)) == (batch.n, round(batch.sari_score, 9), round(batch.gleu_score, 9))
    assert sorted(spark.read.parquet(f"{out}/commits").collect()) == [(0,), (1,), (2,)]
    whole(spark.createDataFrame([("swap", 7)], "model string, n int"), out, 2)  # a batch that is repeated after its commit
    assert [r.n for r in read_latest(spark, out).collect()] == [7]
