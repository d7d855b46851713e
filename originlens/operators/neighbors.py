"""Exact nearest neighbours and scores built on them."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from originlens.functions.vectors import dot, l2_normalize
from originlens.operators.sampling import per_class_sample
from originlens.session import materialise

BLOCK_ROWS = 8192
MAX_CELLS = 4096
SLACK_ANGLE = 1e-6  # beyond what arc cosines of rounded products are off
TILE_ROWS = 128
TILE_PAIRS = 1 << 20  # pairs of a query and a reference row whose distances a task holds at once
GROUP = 8  # blocks of rows in a part, and in the cells that a query visits as one, at most
GROUP_CELLS = 62  # their bits are one long
TILE_CELLS = 1 << 20  # pairs of a row and a cell that a task works on at once
OUT_ROWS = 4096  # rows of a frame that a task returns, at most
DECIMALS = 8


def masked_mean_pool(tokens: DataFrame, key: str, vector: str = "embedding", mask: str | None = None) -> DataFrame:
    """Mean of the token vectors of each key whose mask is 1, dimension by dimension; the mask
    sum is clamped so that a fully masked key gives zeros. Partial sums are combined on the
    map side, so a key with many tokens shuffles few rows."""
    m = F.lit(1.0) if mask is None else F.col(mask).cast("double")
    dims = tokens.select(key, m.alias("_m"), F.posexplode(vector).alias("dim", "x"))
    return dims.groupBy(key, "dim").agg(
        (F.sum(F.col("x").cast("double") * F.col("_m")) / F.greatest(F.sum("_m"), F.lit(1e-9))).alias("value")
    )


@dataclass(frozen=True)
class Cells:
    """Cells of the reference rows: unit vectors in their middle, rows and largest angle of each.

    At most ``MAX_CELLS`` of them exist, so they travel with the tasks."""

    centres: np.ndarray
    rows: np.ndarray
    radius: np.ndarray

    def angles(self, v: np.ndarray) -> np.ndarray:
        return np.arccos(np.clip(v @ self.centres.T, -1.0, 1.0))

    def first(self, v: np.ndarray, k: int) -> np.ndarray:
        """For each vector, the cells nearest to it that hold ``k`` rows together, as a boolean matrix."""
        order = np.argsort(np.where(self.rows > 0, self.angles(v), np.inf), axis=1, kind="stable")
        before = np.cumsum(self.rows[order], axis=1) - self.rows[order]
        out = np.zeros(order.shape, np.bool_)
        np.put_along_axis(out, order, before < k, axis=1)
        return out & (self.rows > 0)

    def further(self, v: np.ndarray, bound: np.ndarray, k: int, decimals: int) -> np.ndarray:
        """The other cells that may hold a row within distance ``bound`` of each vector: those whose centre is
        no further than the bound's angle plus the cell's radius."""
        reach = np.arccos(np.clip(1.0 - bound - 10.0**-decimals, -1.0, 1.0)) + SLACK_ANGLE
        reach = np.where(np.isfinite(bound), reach, np.pi)
        near = self.angles(v) <= reach[:, None] + self.radius[None, :]
        return near & (self.rows > 0) & ~self.first(v, k)


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype("float64")


def tiles(d: pd.DataFrame, cells: int) -> Iterator[pd.DataFrame]:
    """Slices of a frame for which a matrix of rows by cells stays small, whatever the number of cells."""
    step = max(1, TILE_CELLS // max(cells, 1))
    for start in range(0, len(d), step):
        yield d.iloc[start : start + step]


def copies(d: pd.DataFrame, at: np.ndarray, **columns: np.ndarray) -> Iterator[pd.DataFrame]:
    """The rows ``at`` of a frame, which may repeat, with further columns, in frames of bounded size."""
    for start in range(0, len(at), OUT_ROWS):
        part = slice(start, start + OUT_ROWS)
        yield d.iloc[at[part]].assign(**{n: c[part] for n, c in columns.items()})


def dealt_rows(d: pd.DataFrame, own: np.ndarray, other: np.ndarray) -> Iterator[pd.DataFrame]:
    """Rows of a cell in ``own[cell]`` parts by id, each once for every part of the other side."""
    for tile in tiles(d, int(other.max(initial=1))):
        cell = tile["cell"].to_numpy()
        n = other[cell]
        mine = (tile["id"].to_numpy() * 2654435761 % 2**32) % own[cell]
        theirs = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        at = np.repeat(np.arange(len(tile)), n)
        yield from copies(tile, at, mine=mine[at].astype("int64"), theirs=theirs.astype("int64"))


def _centres(units: DataFrame, cell_rows: int) -> np.ndarray:
    """Unit vectors of a bounded sample of rows, one for about each ``cell_rows`` of them."""
    n = max(1, min(MAX_CELLS, -(-units.count() // cell_rows)))
    picked = units.orderBy(F.xxhash64("id"), "id").limit(n).select("v").collect()
    return np.array([r.v for r in picked], "float64")


def _placed(units: DataFrame, cells: np.ndarray) -> DataFrame:
    """id, v, cell, angle: rows with their nearest centre."""

    def run(frames):
        for frame in frames:
            for d in tiles(frame, len(cells)):
                cosine = _matrix(d["v"]) @ cells.T
                at = cosine.argmax(axis=1)
                angle = np.arccos(np.clip(cosine[np.arange(len(d)), at], -1.0, 1.0))
                yield d.assign(cell=at.astype("int32"), angle=angle)

    return units.mapInPandas(run, "id bigint, v array<double>, cell int, angle double")


def _counts(df: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    rows, top = np.zeros(n, np.int64), np.zeros(n)
    for r in df.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("angle").alias("top")).collect():
        rows[r.cell], top[r.cell] = r.n, r.top
    return rows, top


def _dealt(df: DataFrame, own: np.ndarray, other: np.ndarray, name: str, carry: str = "") -> DataFrame:
    """Rows of a cell in ``own[cell]`` parts by id, each once for every part of the other side. ``carry``: the schema of further columns."""
    schema = "".join([f"{name} bigint, v array<double>, cell int, ", carry and f"{carry}, ", "mine bigint, theirs bigint"])

    def run(frames):
        for d in frames:
            for out in dealt_rows(d, own, other):
                yield out.rename(columns={"id": name})

    return df.select("id", "v", "cell", *[c.split()[0] for c in carry.split(", ") if c]).mapInPandas(run, schema)


def _block_top_k(k: int, exclude_self: bool, decimals: int):
    def cell(queries: pd.DataFrame, refs: pd.DataFrame) -> pd.DataFrame:
        if queries.empty or refs.empty:
            return pd.DataFrame({"qid": [], "tid": [], "distance": []}).astype({"qid": "int64", "tid": "int64"})
        refs = refs.sort_values("tid")
        tid = refs["tid"].to_numpy()
        ref_matrix = np.stack(refs["v"].to_numpy()).astype("float64")
        found = []
        step = max(1, min(TILE_ROWS, TILE_PAIRS // len(refs)))
        for start in range(0, len(queries), step):
            tile = queries.iloc[start : start + step]
            qid = tile["qid"].to_numpy()
            dist = np.round(1.0 - np.stack(tile["v"].to_numpy()).astype("float64") @ ref_matrix.T, decimals) + 0.0
            if exclude_self:
                dist[qid[:, None] == tid[None, :]] = np.inf
            # ids ascend along the columns, so the first ties are those with the smallest ids
            kept = min(k, dist.shape[1])
            bound = np.partition(dist, kept - 1, axis=1)[:, kept - 1 : kept]
            nearer, tied = dist < bound, dist == bound
            room = kept - nearer.sum(axis=1, keepdims=True)
            take = (nearer | (tied & (np.cumsum(tied, axis=1, dtype="int32") <= room))) & np.isfinite(dist)
            rows, cols = np.nonzero(take)
            found.append(pd.DataFrame({"qid": qid[rows], "tid": tid[cols], "distance": dist[rows, cols]}))
        return pd.concat(found, ignore_index=True)

    return cell


def _groups(rows: np.ndarray, group_rows: int) -> np.ndarray:
    """The group of each cell: cells that follow each other, of about ``group_rows`` rows together, GROUP_CELLS at most."""
    out, held, cells = np.zeros(len(rows), np.int64), 0, 0
    for i in range(1, len(rows)):
        held, cells = held + rows[i - 1], cells + 1
        new = held + rows[i] > group_rows or cells == GROUP_CELLS
        out[i] = out[i - 1] + new
        if new:
            held = cells = 0
    return out


def _asked_groups(d: pd.DataFrame, need: np.ndarray, group: np.ndarray) -> Iterator[pd.DataFrame]:
    """Each row once for each group that holds a cell it needs, with these cells as bits."""
    for g in range(group[-1] + 1):
        own = np.flatnonzero(group == g)
        bits = need[:, own] @ (1 << np.arange(len(own)))
        row = np.flatnonzero(bits)
        yield from copies(d, row, cell=np.full(len(row), g, "int32"), bits=bits[row])


def _group_top_k(k: int, exclude_self: bool, decimals: int, group: np.ndarray):
    """As :func:`_block_top_k`, for a group of cells: a query meets the cells among its bits, and only rows within its bound count."""
    top_k = _block_top_k(k, exclude_self, decimals)

    def search(queries: pd.DataFrame, refs: pd.DataFrame) -> pd.DataFrame:
        if queries.empty or refs.empty:
            return top_k(queries, refs)
        first = int(np.searchsorted(group, refs["cell"].iloc[0]))  # the group's first cell
        v, bits = _matrix(queries["v"]), queries["bits"].to_numpy()
        qid, bound = queries["qid"].to_numpy(), queries["bound"].fillna(np.inf).to_numpy()
        found = []
        for at, part in refs.groupby("at"):
            asking = np.flatnonzero(bits >> (int(at) - first) & 1)
            tid, m = part["tid"].to_numpy(), np.ascontiguousarray(_matrix(part["v"]).T)
            step = max(1, TILE_PAIRS // len(part))
            for start in range(0, len(asking), step):
                some = asking[start : start + step]
                cosine = v[some] @ m
                near = np.flatnonzero(cosine >= (1.0 - bound[some] - 2 * 10.0**-decimals)[:, None])
                row, col = near // len(part), near % len(part)
                many = np.bincount(row, minlength=len(some)) > 4 * k  # no bound, or many rows at it
                if many.any():
                    found.append(top_k(queries.iloc[some[many]], part))
                    row, col = row[~many[row]], col[~many[row]]
                dist = np.round(1.0 - cosine[row, col], decimals) + 0.0
                keep = dist <= bound[some][row]
                if exclude_self:
                    keep &= qid[some][row] != tid[col]
                found.append(pd.DataFrame({"qid": qid[some][row[keep]], "tid": tid[col[keep]], "distance": dist[keep]}))
        return pd.concat(found, ignore_index=True) if found else top_k(queries.head(0), refs)

    return search


def knn_cosine(
    train: DataFrame,
    query: DataFrame,
    k: int = 5,
    key: str = "vec_id",
    vector: str = "embedding",
    exclude_self: bool = False,
    block_rows: int = BLOCK_ROWS,
    decimals: int = DECIMALS,
) -> DataFrame:
    """The ``k`` nearest ``train`` rows of each query row: (qid, tid, distance, rn).

    Exact, and pruned. Reference rows fall into cells around a bounded sample of them. A query first
    searches the nearest cells that hold ``k`` rows; its k-th distance there then rules out every cell that
    lies further away than this distance's angle plus the cell's own; the rest are searched too. A row is
    copied only to the cells a query visits first, and then to groups of up to GROUP times ``block_rows`` rows in cells it
    cannot rule out. Cells, groups and their queries are cut into parts of so many rows, so a task holds two parts however
    large a cell is, and a row is copied once for each part at most; no side is broadcast.
    Distances are rounded to ``decimals`` and ties broken by id, so the result does not depend on the cells.
    """
    unit = l2_normalize(F.transform(vector, lambda x: x.cast("double")))

    def units(df: DataFrame) -> DataFrame:
        return df.select(F.col(key).cast("bigint").alias("id"), unit.alias("v"))

    centres = _centres(units(train), block_rows)
    if not len(centres):
        return train.sparkSession.createDataFrame([], "qid bigint, tid bigint, distance double, rn int")
    refs = materialise(_placed(units(train), centres), "cells")
    cells = Cells(centres, *_counts(refs, len(centres)))
    need = k + exclude_self

    # so many parts on either side as blocks are in a part: few copies, and enough tasks
    part_rows = block_rows * int(np.clip(np.sqrt(cells.rows.sum() / block_rows), 1, GROUP))

    def parts(rows: np.ndarray) -> np.ndarray:
        return np.maximum(1, -(-rows // part_rows))

    def visits(frames):
        for frame in frames:
            for d in tiles(frame, len(centres)):
                row, cell = np.nonzero(cells.first(_matrix(d["v"]), need))
                yield from copies(d[["id", "v"]], row, cell=cell.astype("int32"), angle=np.zeros(len(row)))

    def searched(visited: DataFrame, refs: DataFrame, rows: np.ndarray, top_k, carry: str = "", of_refs: str = "") -> DataFrame:
        theirs, own = parts(rows), parts(_counts(visited, len(rows))[0])
        q = _dealt(visited, own, theirs, "qid", carry).groupBy("cell", F.col("mine").alias("qp"), F.col("theirs").alias("tp"))
        t = _dealt(refs, theirs, own, "tid", of_refs).groupBy("cell", F.col("theirs").alias("qp"), F.col("mine").alias("tp"))
        return q.cogroup(t).applyInPandas(top_k, "qid bigint, tid bigint, distance double")

    w = Window.partitionBy("qid").orderBy("distance", "tid")

    def best(near: DataFrame) -> DataFrame:
        return near.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= k)

    visited = units(query).mapInPandas(visits, "id bigint, v array<double>, cell int, angle double")
    found = searched(materialise(visited, "visits"), refs, cells.rows, _block_top_k(k, exclude_self, decimals))
    if len(centres) == 1:
        return best(found)
    found = materialise(best(found).drop("rn"), "near-first")
    kth = found.groupBy("qid").agg(F.count(F.lit(1)).alias("n"), F.max("distance").alias("bound"))
    kth = kth.select(F.col("qid").alias("id"), F.when(F.col("n") >= k, F.col("bound")).alias("bound"))
    asked = materialise(units(query).join(kth, "id", "left"), "asked")  # visits are made of it twice, as they are many
    group = _groups(cells.rows, part_rows)

    def asks(frames):
        for frame in frames:
            for d in tiles(frame, len(centres)):
                reached = cells.further(_matrix(d["v"]), d["bound"].fillna(np.inf).to_numpy(), need, decimals)
                yield from _asked_groups(d.assign(angle=0.0), reached, group)

    rest = asked.mapInPandas(asks, "id bigint, v array<double>, bound double, angle double, cell int, bits bigint")
    of_group = F.array(*[F.lit(int(g)) for g in group])
    grouped = refs.select("id", "v", F.get(of_group, F.col("cell")).alias("cell"), F.col("cell").alias("at"))
    rows = np.bincount(group, cells.rows).astype("int64")
    return best(found.unionByName(searched(rest, grouped, rows, _group_top_k(k, exclude_self, decimals, group), "bound double, bits bigint", "at int")))


def neighbour_summary(neighbours: DataFrame, labels: DataFrame, key: str = "vec_id", label: str = "y") -> DataFrame:
    """qid, mean distance of its neighbours and their share of positives."""
    lab = labels.select(F.col(key).alias("tid"), F.col(label).cast("double").alias("_y"))
    return neighbours.join(lab, "tid").groupBy("qid").agg(
        F.avg("distance").alias("mean_distance"), F.avg("_y").alias("positive_ratio")
    )


def knn_score(summary: DataFrame) -> DataFrame:
    """Add ``score``: half min-max scaled mean distance (over this query set), half positive share."""
    ends = summary.agg(F.struct(F.min("mean_distance").alias("lo"), F.max("mean_distance").alias("hi")))
    d = summary.withColumn("_e", ends.scalar())
    scaled = (F.col("mean_distance") - F.col("_e.lo")) / (F.col("_e.hi") - F.col("_e.lo") + F.lit(1e-8))
    return d.withColumn("score", F.lit(0.5) * scaled + F.lit(0.5) * F.col("positive_ratio")).drop("_e")


def class_centroids(refs: DataFrame, vector: str = "embedding", label: str = "y") -> DataFrame:
    """One row: mean vectors ``ai`` and ``human`` of the two classes as arrays."""
    unit = l2_normalize(F.transform(vector, lambda x: x.cast("double")))
    dims = refs.select(F.col(label).alias("_y"), F.posexplode(unit).alias("dim", "x"))
    means = dims.groupBy("_y", "dim").agg(F.avg("x").alias("m"))

    def side(y: int) -> Column:
        own = F.collect_list(F.when(F.col("_y") == y, F.struct("dim", "m")))
        return F.transform(F.sort_array(own), lambda s: s["m"])

    return means.agg(side(1).alias("ai"), side(0).alias("human"))


def reference_ranking_score(
    refs: DataFrame, query: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "y"
) -> DataFrame:
    """key, ``score``: mean similarity to AI references minus mean similarity to human ones,
    moved to [0, 1] and clipped.

    The mean of dot products is the dot product with the mean vector, so each query meets two
    vectors instead of every reference. A missing class counts as similarity 0.
    """
    c = class_centroids(refs, vector, label)
    unit = l2_normalize(F.transform(vector, lambda x: x.cast("double")))
    d = query.withColumn("_u", unit).withColumn("_c", c.select(F.struct("ai", "human")).scalar())

    def sim(side: str) -> Column:
        return F.when(F.size(F.col(f"_c.{side}")) > 0, dot("_u", f"_c.{side}")).otherwise(F.lit(0.0))

    score = F.lit(0.5) * (sim("ai") - sim("human") + F.lit(1.0))
    return d.withColumn("score", F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0))).drop("_u", "_c")


def sample_references(train: DataFrame, seed, n_refs: int, label: str = "y", key: str = "vec_id") -> DataFrame:
    """Half of ``n_refs`` per class, where a sample is wanted; the score itself takes all references."""
    return per_class_sample(train, n_refs // 2, seed, label, key)


def distance_by_agreement(summary: DataFrame, labels: DataFrame, key: str = "vec_id", label: str = "y") -> DataFrame:
    """One row: mean neighbour distance where the neighbours' majority is the row's own class,
    and where it is not."""
    lab = labels.select(F.col(key).alias("qid"), F.col(label).alias("_y"))
    same = (F.col("positive_ratio") > 0.5) == (F.col("_y") > 0.5)
    return summary.join(lab, "qid").agg(
        F.avg(F.when(same, F.col("mean_distance"))).alias("same_class_distance"),
        F.avg(F.when(~same, F.col("mean_distance"))).alias("diff_class_distance"),
        F.count_if(same).alias("n_same"),
        F.count_if(~same).alias("n_diff"),
    )

