"""Streams end where the batch runs end."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from originlens.operators import ngram
from originlens.streaming import drift, incremental, scoring


def test_incremental_resumes_without_duplicates(spark, tmp_path):
    src, out, ck = (str(tmp_path / n) for n in ("src", "out", "ck"))

    def work(df):
        return df.select("id", (F.col("v") * 2).alias("w"))

    def run():
        return incremental.incremental_process(spark, src, data.schema, work, out, ck, files_per_batch=1)

    data = spark.range(20).select(F.col("id").cast("string").alias("id"), F.col("id").alias("v"))
    data.filter("v < 10").repartition(3).write.parquet(src)
    assert run().count() == 10
    # the next delivery overlaps the first
    data.filter("v >= 5").repartition(2).write.mode("append").parquet(src)
    assert sorted((r.id, r.w) for r in run().collect()) == sorted((r.id, r.w) for r in work(data).collect())
    assert run().count() == 20


def test_stream_scores_equal_batch_scores(spark, tmp_path):
    data = spark.range(30).select("id", F.concat(F.lit("t"), F.col("id").cast("string")).alias("text"))
    data.repartition(4).write.parquet(str(tmp_path / "src"))

    def score(df):
        return df.select("id", (F.length("text") / 10.0).alias("score"))

    out = scoring.stream_score(spark, str(tmp_path / "src"), data.schema, score, str(tmp_path / "out"), str(tmp_path / "ck"), 2)
    assert sorted(out.collect()) == sorted(score(data).collect())


def test_stream_of_ngram_scores_survives_a_failed_batch(spark, tmp_path):
    src, out, ck = (str(tmp_path / n) for n in ("src", "out", "ck"))
    data = spark.createDataFrame([(i, f"a b c{i % 3} a b d{i % 5}") for i in range(12)] + [(90, None), (91, "")], "id long, text string")
    model = ngram.NgramModel.load(spark, _saved(data, str(tmp_path / "model")))
    data.filter("id < 6").repartition(3).write.parquet(src)
    calls = []

    def score(batch):
        scored = ngram.score_documents(batch, model, "id")
        calls.append(scored.count())
        if len(calls) == 2:
            raise RuntimeError("lost")
        return scored

    def run():
        return scoring.stream_score_batches(spark, src, data.schema, score, out, ck, files_per_batch=1)

    with pytest.raises(Exception, match="lost"):
        run()
    run()
    data.filter("id >= 6").repartition(2).write.mode("append").parquet(src)
    want = ngram.score_documents(data, model, "id")
    assert sorted(map(tuple, run().select(*want.columns).collect())) == sorted(map(tuple, want.collect()))
    n = len(calls)
    assert run().count() == want.count() and len(calls) == n  # nothing new


def _saved(data, path):
    ngram.fit(data.filter("text <> ''")).save(path)
    return path


def test_drift_updates_windows_and_drops_late_rows(spark, tmp_path):
    src = str(tmp_path / "src")
    day = datetime(2024, 1, 1)

    def deliver(rows):
        spark.createDataFrame(rows, "ts timestamp, score double").coalesce(1).write.mode("append").parquet(src)

    def run():
        schema = spark.read.parquet(src).schema
        t = drift.score_drift(spark, src, schema, str(tmp_path / "out"), str(tmp_path / "ck"), "2 hours", threshold=0.5, window="1 hour")
        return {r.window_start: (r.n, r.mean_score, r.share_above) for r in t.collect()}

    deliver([(day, 0.2), (day + timedelta(minutes=5), 0.8), (day + timedelta(hours=1), 1.0)])
    assert run() == {day: (2, 0.5, 0.5), day + timedelta(hours=1): (1, 1.0, 1.0)}
    deliver([(day + timedelta(minutes=30), 0.8), (day + timedelta(hours=9), 0.0)])
    after = run()
    assert after[day] == (3, (0.2 + 0.8 + 0.8) / 3, 2 / 3) and len(after) == 3
    deliver([(day, 0.9)])  # nine hours behind the newest row
    assert run() == after
