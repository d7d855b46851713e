"""Score drift over event time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def windowed_scores(df: DataFrame, ts: str, score: str, threshold: float, window: str) -> DataFrame:
    """Per tumbling window: rows, mean score and the share above ``threshold``."""
    return df.groupBy(F.window(ts, window).alias("w")).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(score).alias("mean_score"),
        F.avg((F.col(score) > F.lit(float(threshold))).cast("double")).alias("share_above"),
    ).select(F.col("w.start").alias("window_start"), "n", "mean_score", "share_above")


def score_drift(
    spark: SparkSession,
    source: str,
    schema: T.StructType,
    target: str,
    checkpoint: str,
    watermark: str,
    ts: str = "ts",
    score: str = "score",
    threshold: float = 0.5,
    window: str = "1 day",
    files_per_batch: int | None = None,
) -> DataFrame:
    """Keep ``target`` up to date with the drift table of an arriving stream.

    ``watermark`` is how late a row may be; a later one no longer changes its window. Changed windows are written per micro-batch
    into the batch's own folder (a repeated batch replaces it); the newest version of a window counts.
    """
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    arrivals = reader.parquet(source).withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, watermark)

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    query = (
        windowed_scores(arrivals, ts, score, threshold, window)
        .writeStream.foreachBatch(save)
        .option("checkpointLocation", checkpoint)
        .outputMode("update")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    newest = Window.partitionBy("window_start").orderBy(F.col("batch").desc())
    versions = spark.read.parquet(target)
    return versions.withColumn("_v", F.row_number().over(newest)).filter("_v = 1").drop("_v", "batch")
