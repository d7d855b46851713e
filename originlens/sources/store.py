"""A store of model scores: what is stored is reused, only the rest is computed."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from originlens.sources.readers import exists

SCHEMA = "id string, score double"


class PredictionStore:
    """Scores (id, score) of each model and split, in versions.

    Each version adds one folder of Parquet files. It exists once its entry is in the log, which a rename puts there whole
    or not at all, and only if no other writer has taken the number. Readers follow the log: folders of writes that
    failed, or are under way, are not in it. An id is in one version only."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _root(self, model: str, split: str) -> str:
        return f"{self.path}/model={model}/split={split}"

    def folders(self, model: str, split: str) -> list[str]:
        """The committed folders, in the order of their versions, which have no gaps."""
        root = self._root(model, split)
        if not exists(self.spark, f"{root}/log"):
            return []
        rows = self.spark.read.text(f"{root}/log/*.entry").select("value", F.col("_metadata.file_name").alias("n")).orderBy("n").collect()
        return [f"{root}/data/{r.value}" for r in rows]

    def stored(self, model: str, split: str) -> DataFrame:
        """id, score of the newest version."""
        folders = self.folders(model, split)
        return self._read(folders)

    def _read(self, folders: list[str]) -> DataFrame:
        return self.spark.read.schema(SCHEMA).parquet(*folders) if folders else self.spark.createDataFrame([], SCHEMA)

    def _commit(self, root: str, name: str, version: int) -> bool:
        """Enter the folder as ``version``; False if another writer was first."""
        sc = self.spark.sparkContext
        fs = sc._jvm.org.apache.hadoop.fs
        target = fs.Path(f"{root}/log/{version:09d}.entry")
        # hidden from readers until it is renamed
        draft = fs.Path(f"{root}/log/.{name}")
        conf = sc._jsc.hadoopConfiguration()
        system = target.getFileSystem(conf)
        out = system.create(draft, False)
        out.write(bytearray(name.encode()))
        out.close()
        rename = getattr(fs, "Options$Rename")
        options = sc._gateway.new_array(rename, 1)
        options[0] = rename.NONE
        try:
            fs.FileContext.getFileContext(system.getUri(), conf).rename(draft, target, options)
        except (Py4JError, PySparkException):
            if not system.exists(target):
                raise
            system.delete(draft, False)
            return False
        return True

    def get(self, rows: DataFrame, model: str, split: str, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """id, score of each distinct id of ``rows``; missing ones are computed and stored as a new version.

        ``compute`` maps the missing rows, one per id, to (id, score). A NULL id is an id like others. A repeated call adds nothing. If
        another writer commits meanwhile, what it has stored is dropped from this write, and its scores stay."""
        root = self._root(model, split)
        asked = rows.withColumn("id", F.col("id").cast("string")).dropDuplicates(["id"])
        known = self.folders(model, split)

        def unknown(df: DataFrame, folders: list[str]) -> DataFrame:
            have = self._read(folders).select(F.col("id").alias("_have"))
            return df.join(have, F.col("id").eqNullSafe(F.col("_have")), "left_anti")

        fresh = compute(unknown(asked, known)).select(F.col("id").cast("string"), F.col("score").cast("double")).dropDuplicates(["id"])
        while True:
            name = uuid.uuid4().hex
            fresh.write.parquet(f"{root}/data/{name}")
            written = self.spark.read.schema(SCHEMA).parquet(f"{root}/data/{name}")
            if not written.head(1) or self._commit(root, name, len(known)):
                break
            # another writer was first: keep what it lacks
            known = self.folders(model, split)
            fresh = unknown(written, known)
        ids = asked.select(F.col("id").alias("_asked"))
        return self.stored(model, split).join(ids, F.col("id").eqNullSafe(F.col("_asked")), "left_semi")
