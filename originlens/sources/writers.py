"""Sinks: splits with a manifest, submissions, summaries, generation records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from originlens.operators.sampling import split_groups, split_manifest


def write_csv(df: DataFrame, path: str, sep: str = ",") -> None:
    df.write.options(header=True, quote='"', escape='"', sep=sep).csv(path)


def write_generation_json(df: DataFrame, path: str) -> None:
    df.write.json(path)


def write_splits(df: DataFrame, path: str, seed: int, ratios=(0.6, 0.2, 0.2), group: str = "essay_idx") -> None:
    """The table partitioned by ``split`` (the whole folder is the full table), the manifest as
    JSON and the groups of each split beside it."""
    df.write.partitionBy("split").parquet(f"{path}/detection")
    split_manifest(df, seed, ratios, group).coalesce(1).write.json(f"{path}/manifest")
    split_groups(df, group).write.partitionBy("split").parquet(f"{path}/groups")


def submission(df: DataFrame, key: str = "id", score: str = "score") -> DataFrame:
    return df.select(F.col(key).alias("id"), F.col(score).alias("is_generated"))


def write_submission(df: DataFrame, path: str, key: str = "id", score: str = "score") -> None:
    write_csv(submission(df, key, score), path)


def summary(metrics: DataFrame) -> DataFrame:
    """Metric rows with the best AUC first."""
    return metrics.orderBy(F.col("roc_auc").desc())


def write_summary(metrics: DataFrame, path: str) -> None:
    write_csv(summary(metrics), path)


def write_text_dir(df: DataFrame, path: str, key: str, text: str) -> None:
    """One folder per key with its text in a file, the layout ``partitionBy`` gives; read it
    back with the pattern ``<key>=([^/]+)/``."""
    df.select(key, F.col(text).alias("value")).repartition(key).write.partitionBy(key).text(path)
