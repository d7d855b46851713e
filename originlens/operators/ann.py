"""Approximate nearest neighbours: an inverted file with bit sketches, stored once and probed by many searches."""

from __future__ import annotations

import json
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from originlens.functions.vectors import l2_normalize
from originlens.operators import neighbors
from originlens.session import materialise

MAX_CELLS = 4096
PART_ROWS = 8192  #: rows of a cell that a task holds
LEAST = 3  #: times k rows of a cell get an inner product, at least
SAMPLE = 200  #: queries on which the number of probes is chosen, at most
ROW = "id bigint, v array<double>, sketch binary, cell int"


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype("float64")


def _words(column: pd.Series) -> np.ndarray:
    """Sketches as rows of 64-bit words."""
    return np.frombuffer(b"".join(column), "<u8").reshape(len(column), -1)


def _units(df: DataFrame, key: str, vector: str) -> DataFrame:
    """id, v: unit vectors; rows without a vector have no neighbours and are none."""
    unit = l2_normalize(F.transform(vector, lambda x: x.cast("double")))
    return df.filter(F.size(vector) > 0).select(F.col(key).cast("bigint").alias("id"), unit.alias("v"))


@dataclass(frozen=True)
class NeighborIndex:
    """Reference rows by cell, each in the ``spill`` cells whose centres are nearest. A sketch has one bit for each of
    some random planes: the side on which the row lies, seen from the cell's centre.

    A search visits the ``probes`` cells nearest to a query, compares sketches there, and computes inner products
    for the share of a cell's rows whose sketches are closest, three for each neighbour asked for at least. ``rows`` are stored sorted by cell."""

    path: str
    rows: DataFrame
    centres: np.ndarray
    planes: np.ndarray
    counts: np.ndarray
    probes: int
    share: float

    @classmethod
    def build(
        cls, train: DataFrame, path: str, key: str = "vec_id", vector: str = "embedding",
        cell_rows: int = 64, spill: int = 2, bits: int = 256, share: float = 0.12, seed: int = 42,
    ) -> NeighborIndex:
        """Index all rows of ``train`` below ``path``.

        Centres are a bounded sample of rows by hash, one for about ``cell_rows`` of them and 4,096 at most. The
        index starts with seven twentieths of its cells as probes; :meth:`tuned` finds the number a recall needs."""
        spark = train.sparkSession
        units = _units(train, key, vector)
        n = max(1, min(MAX_CELLS, -(-units.count() // cell_rows)))
        centres = np.array([r.v for r in units.orderBy(F.xxhash64("id"), "id").limit(n).select("v").collect()], "float64")
        dims = centres.shape[1] if centres.size else 1
        planes = np.random.default_rng(seed).standard_normal((dims, bits))
        placed = _placed(units, centres, planes, min(spill, max(1, len(centres))))
        parts = max(1, min(len(centres), spark.sparkContext.defaultParallelism))
        placed.repartitionByRange(parts, "cell", "id").sortWithinPartitions("cell", "id").write.parquet(f"{path}/rows")
        counts = np.zeros(len(centres), np.int64)
        for r in spark.read.schema(ROW).parquet(f"{path}/rows").groupBy("cell").count().collect():
            counts[r["cell"]] = r["count"]
        about = {"seed": seed, "bits": bits, "dims": dims, "share": share, "probes": max(1, -(-7 * len(centres) // 20))}
        cells = [(i, [float(x) for x in c], int(m)) for i, (c, m) in enumerate(zip(centres, counts))]
        spark.createDataFrame(cells, "cell int, v array<double>, n bigint").write.parquet(f"{path}/cells")
        spark.createDataFrame([(json.dumps(about),)], "about string").write.parquet(f"{path}/about")
        return cls.load(spark, path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> NeighborIndex:
        about = json.loads(spark.read.parquet(f"{path}/about").first().about)
        cells = spark.read.schema("cell int, v array<double>, n bigint").parquet(f"{path}/cells").orderBy("cell").collect()
        planes = np.random.default_rng(about["seed"]).standard_normal((about["dims"], about["bits"]))
        centres = np.array([c.v for c in cells], "float64").reshape(len(cells), about["dims"])
        rows = spark.read.schema(ROW).parquet(f"{path}/rows")
        return cls(path, rows, centres, planes, np.array([c.n for c in cells], np.int64), about["probes"], about["share"])

    def search(self, query: DataFrame, k: int = 5, key: str = "vec_id", vector: str = "embedding", exclude_self: bool = False) -> DataFrame:
        """qid, tid, distance, rn: as :func:`neighbors.knn_cosine`, but a neighbour in a cell that is not probed, or
        with a sketch unlike the query's, is missed. Distances of what is found are exact."""
        if not len(self.centres):
            return query.sparkSession.createDataFrame([], "qid bigint, tid bigint, distance double, rn int")
        visits = materialise(_placed(_units(query, key, vector), self.centres, self.planes, min(self.probes, len(self.centres))), "probes")
        asked = np.zeros(len(self.centres), np.int64)
        for r in visits.groupBy("cell").count().collect():
            asked[r["cell"]] = r["count"]
        parts, own = (np.maximum(1, -(-c // PART_ROWS)) for c in (self.counts, asked))
        q = _dealt(visits, own, parts).groupBy("cell", F.col("mine").alias("qp"), F.col("theirs").alias("tp"))
        t = _dealt(self.rows, parts, own).groupBy("cell", F.col("theirs").alias("qp"), F.col("mine").alias("tp"))
        found = q.cogroup(t).applyInPandas(_closest(k, self.share, exclude_self), "qid bigint, tid bigint, distance double")
        once = found.groupBy("qid", "tid").agg(F.min("distance").alias("distance"))
        w = Window.partitionBy("qid").orderBy("distance", "tid")
        return once.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= k)

    def products(self, query: DataFrame, k: int = 5, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
        """One row: n_queries, sketches and products, both as a share of all pairs of a query and an indexed row."""
        placed = _placed(_units(query, key, vector), self.centres, self.planes, min(self.probes, len(self.centres)))
        size = np.maximum(np.minimum(LEAST * k, self.counts), np.ceil(self.share * self.counts))
        cells = query.sparkSession.createDataFrame([(i, int(c), float(s)) for i, (c, s) in enumerate(zip(self.counts, size))], "cell int, n bigint, size double")
        pairs = F.countDistinct("id") * F.lit(self.rows.select("id").distinct().count())
        return placed.select("id", "cell").join(cells, "cell").agg(
            F.countDistinct("id").alias("n_queries"), (F.sum("n") / pairs).alias("sketches"), (F.sum("size") / pairs).alias("products")
        )

    def recall(self, query: DataFrame, exact: DataFrame, k: int = 5, **columns) -> float:
        """The share of the exact neighbours (qid, tid) that a search finds."""
        got = self.search(query, k, **columns).select("qid", "tid", F.lit(1).alias("hit"))
        n, hits = exact.select("qid", "tid").join(got, ["qid", "tid"], "left").agg(F.count(F.lit(1)), F.sum("hit")).first()
        return (hits or 0) / n if n else 1.0

    def tuned(self, train: DataFrame, k: int = 5, least: float = 0.95, key: str = "vec_id", vector: str = "embedding", sample: int = SAMPLE) -> NeighborIndex:
        """The index with the fewest probes, doubled from a 64th of the cells on, and then the least share of rows, doubled
        from its own on, that reach the recall ``least`` on a bounded sample of ``train``'s rows, each left out of its
        neighbours. All rows of all cells reach it in any case."""
        some = materialise(train.orderBy(F.xxhash64(F.col(key), F.lit("tune")), key).limit(sample), "tune")
        exact = materialise(neighbors.knn_cosine(train, some, k, key, vector, exclude_self=True), "tune-exact")

        def enough(index: NeighborIndex) -> bool:
            return index.recall(some, exact, k, key=key, vector=vector, exclude_self=True) >= least

        cells, probes, share = max(1, len(self.centres)), max(1, len(self.centres) // 64), self.share
        while probes < cells and not enough(replace(self, probes=probes, share=1.0)):
            probes *= 2
        while share < 1 and not enough(replace(self, probes=min(probes, cells), share=share)):
            share *= 2
        return replace(self, probes=min(probes, cells), share=min(1.0, share))


def _placed(units: DataFrame, centres: np.ndarray, planes: np.ndarray, cells: int) -> DataFrame:
    """Each row in its nearest cells, with the sides of the planes through the cell's centre on which it lies."""

    def run(frames):
        seen = centres @ planes
        for frame in frames:
            for d in neighbors.tiles(frame, len(centres)):
                v = _matrix(d["v"])
                near = np.argsort(-(v @ centres.T), axis=1, kind="stable")[:, :cells]
                at, cell = np.repeat(np.arange(len(d)), near.shape[1]), near.ravel().astype("int32")
                sides = v @ planes
                for out in neighbors.copies(d, at, cell=cell, _at=at):
                    signs = sides[out["_at"].to_numpy()] > seen[out["cell"].to_numpy()]
                    yield out.assign(sketch=[s.tobytes() for s in np.packbits(signs, axis=1)])[["id", "v", "sketch", "cell"]]

    return units.mapInPandas(run, ROW)


def _dealt(df: DataFrame, own: np.ndarray, other: np.ndarray) -> DataFrame:
    """Rows of a cell in ``own[cell]`` parts by id, each once for every part of the other side."""

    def run(frames):
        for d in frames:
            yield from neighbors.dealt_rows(d, own, other)

    return df.mapInPandas(run, f"{ROW}, mine bigint, theirs bigint")


def _closest(k: int, share: float, exclude_self: bool):
    """The ``k`` rows of a cell nearest to each query, among those with the closest sketches."""

    def cell(queries: pd.DataFrame, refs: pd.DataFrame) -> pd.DataFrame:
        if queries.empty or refs.empty:
            return pd.DataFrame({"qid": [], "tid": [], "distance": []}).astype({"qid": "int64", "tid": "int64", "distance": "float64"})
        refs = refs.sort_values("id")
        tid, words, m = refs["id"].to_numpy(), _words(refs["sketch"]), _matrix(refs["v"])
        kept = min(len(refs), max(LEAST * k + exclude_self, int(np.ceil(share * len(refs)))))
        step = max(1, (1 << 20) // max(kept * m.shape[1], len(refs)))
        found = []
        for start in range(0, len(queries), step):
            some = queries.iloc[start : start + step]
            qid, asking = some["id"].to_numpy(), _words(some["sketch"])
            differ = np.zeros((len(some), len(refs)), np.int32)
            for j in range(words.shape[1]):
                differ += np.bitwise_count(asking[:, j, None] ^ words[None, :, j])
            differ[:, ~words.any(axis=1)] = 0  # a row in the centre has no side
            at = np.argpartition(differ, kept - 1, axis=1)[:, :kept]
            dist = np.round(1.0 - np.einsum("qd,qcd->qc", _matrix(some["v"]), m[at]), neighbors.DECIMALS) + 0.0
            if exclude_self:
                dist[qid[:, None] == tid[at]] = np.inf
            order = np.lexsort((tid[at], dist), axis=1)[:, :k]
            rows = np.repeat(np.arange(len(some)), order.shape[1])
            cols = order.ravel()
            good = np.isfinite(dist[rows, cols])
            rows, cols = rows[good], cols[good]
            found.append(pd.DataFrame({"qid": qid[rows], "tid": tid[at[rows, cols]], "distance": dist[rows, cols]}))
        return pd.concat(found, ignore_index=True)

    return cell
