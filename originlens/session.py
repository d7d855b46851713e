"""Session helpers: a tuned local session for tests and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(
    app: str = "originlens", cores: str = "*", partitions: int = 8, checkpoint_dir: str | None = None
) -> SparkSession:
    """A local session for tests and benchmarks; a cluster brings its own session.

    ``checkpoint_dir`` overrides the ``spark.checkpoint.dir`` of Spark's defaults. Without either, this one
    machine gets a temporary folder of its own."""
    builder = SparkSession.builder
    if checkpoint_dir:
        builder = builder.config("spark.checkpoint.dir", checkpoint_dir)
    spark = (
        builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    if not spark.conf.get("spark.checkpoint.dir", None):
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="originlens-"))
    return spark


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below the one the session names in ``spark.checkpoint.dir``, which must be set."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{base.rstrip('/')}/originlens/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, so that several consumers
    share one evaluation and a lost executor costs a re-read, not a recomputation."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(scan: DataFrame) -> DataFrame:
    """A bare file scan with at least one partition per core.

    A small file is one partition however many cores wait; a large table has more splits than
    cores already and is returned as it is. Only for scans: counting the partitions of a plan
    with shuffles would run them.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan
