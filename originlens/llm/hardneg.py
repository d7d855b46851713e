"""Hard negatives by threshold joins over inner products, with an inverted index in the manner of L2AP.

Rows are dealt into shards. A shard keeps postings for each block of dimensions; a row's postings end where the
norm of its remaining entries, times the query's norm, can't reach the threshold any more. A query adds up partial scores
along the postings, drops rows whose partial score plus the product of the remaining norms stays below the threshold,
and verifies the rest exactly. Its threshold starts near the top of its windows and is lowered until they are full.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from originlens.llm.whitening import matrix, padded, scaled
from originlens.session import materialise

STEP = 8  #: dimensions in a block of postings
QUERIES = 64  #: queries that a shard answers at a time
ENTRIES = 1 << 21  #: vector entries in a shard, at most
GROW = 16  #: times the shards of all stages before, that a stage visits at most
DEPTHS = (0.125, 0.5, 1.0)  #: thresholds, as a share of the way from the top of the windows to their bottom
FAR = 1 << 62


def dots(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of two integer matrices; beyond the range of a long, its end."""
    most = int(np.abs(x).max(initial=0)) * int(np.abs(y).max(initial=0))
    if most * max(1, x.shape[1]) < FAR:
        return np.einsum("ij,ij->i", x, y)
    exact = (sum(a * b for a, b in zip(u, v)) for u, v in zip(x.tolist(), y.tolist()))
    return np.array([max(-(1 << 63), min((1 << 63) - 1, v)) for v in exact], np.int64)


class Index:
    """Inverted index over the vectors of a shard."""

    def __init__(self, x: np.ndarray):
        self.x = x
        # dimensions with the most weight first, so that the norms of the remaining ones fall fast
        self.order = np.argsort(-(x.astype(float) ** 2).sum(axis=0), kind="stable")
        self.f = x[:, self.order].astype(float)
        self.left = self.rest(self.f)
        self.longest = float(self.left[:, 0].max(initial=0.0))

    @staticmethod
    def rest(f: np.ndarray) -> np.ndarray:
        """Norms of the entries from each block of dimensions on, and 0 at the end."""
        blocks = np.add.reduceat(f * f, np.arange(0, f.shape[1], STEP), axis=1)
        out = np.zeros((len(f), blocks.shape[1] + 1))
        out[:, :-1] = np.sqrt(np.cumsum(blocks[:, ::-1], axis=1)[:, ::-1])
        return out

    def join(self, q: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All (query, row, score) whose exact inner product reaches the query's threshold."""
        qf = q[:, self.order].astype(float)
        qleft = self.rest(qf)
        slack = 1e-9 * qleft[:, 0] * self.longest + 1e-6
        with np.errstate(divide="ignore", invalid="ignore"):
            need = np.where(qleft[:, 0] > 0, (t - slack) / qleft[:, 0], np.where(t > slack, np.inf, -np.inf)).min()
        # a row's postings: the blocks from which on its norm could still reach the least threshold
        ends = (self.left[:, :-1] >= need).sum(axis=1)
        rows = np.argsort(-ends, kind="stable")
        rows = rows[: int((ends > 0).sum())]
        ends = ends[rows]
        acc = np.zeros((len(q), len(rows)))
        alive = np.ones(acc.shape, bool)
        for j in range(self.left.shape[1] - 1):
            n = int(np.searchsorted(-ends, -j))  # rows with postings in block j come first
            if not n:
                break
            cols = slice(j * STEP, (j + 1) * STEP)
            acc[:, :n] += qf[:, cols] @ self.f[rows[:n], cols].T
            bound = acc[:, :n] + qleft[:, j + 1, None] * self.left[rows[:n], j + 1][None]
            alive[:, :n] &= bound >= (t - slack)[:, None]
            stay = alive.any(axis=0)
            if stay.mean() < 0.8:
                rows, ends, acc, alive = rows[stay], ends[stay], acc[:, stay], alive[:, stay]
        b, r = np.nonzero(alive)
        r = rows[r]
        s = np.concatenate([np.zeros(0, np.int64), *(dots(q[b[i : i + 65_536]], self.x[r[i : i + 65_536]]) for i in range(0, len(b), 65_536))])
        good = s >= t[b]
        return b[good], r[good], s[good]


def best_in_windows(
    index: Index, labels: np.ndarray, first: np.ndarray, q: np.ndarray, qlabels: np.ndarray, windows: list[list[tuple[int, int]]], k: int, same: bool
) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query: the rows, and their scores, that are among the first ``k`` in one of its windows (low, high).

    Rows have the query's label if ``same``, else another one; higher scores come first, ties by ``first``, the
    smallest id of a row. Thresholds go down the steps of DEPTHS until all windows hold ``k`` rows."""
    reach = np.ceil(np.sqrt((q.astype(float) ** 2).sum(axis=1)) * index.longest * (1 + 1e-9)) + 1
    top = np.array([max(h for _, h in w) for w in windows], float)
    bottom = np.array([min(v for v, _ in w) for w in windows], float)
    top, bottom = np.minimum(top, reach), np.maximum(bottom, -reach)
    todo = np.flatnonzero(top >= bottom)
    for depth in DEPTHS:
        if not len(todo):
            return
        t = np.floor(top - (top - bottom) * depth) if depth < 1 else bottom
        b, r, s = index.join(q[todo], t[todo])
        good = (labels[r] == qlabels[todo][b]) == same
        b, r, s = b[good], r[good], s[good]
        cuts = np.searchsorted(b, np.arange(len(todo) + 1))
        later = []
        for i, one in enumerate(todo):
            rows, scores = r[cuts[i] : cuts[i + 1]], s[cuts[i] : cuts[i + 1]]
            order = np.lexsort((first[rows], -scores))
            rows, scores = rows[order], scores[order]
            taken, full = [], True
            for low, high in windows[one]:
                inside = np.flatnonzero((scores >= low) & (scores <= high))[:k]
                taken.append(inside)
                full &= len(inside) == k or t[one] <= max(low, bottom[one])
            if full:
                chosen = np.unique(np.concatenate(taken))
                yield int(one), rows[chosen], scores[chosen]
            else:
                later.append(one)
        todo = np.array(later, int)


def _visit(shards: DataFrame, queries: DataFrame, start: int, end: int, dims: int, k: int, same: bool) -> DataFrame:
    """q, c, vec_id, score: rows of the shards ``start`` to ``end`` that are among the first ``k`` of a shard in a window.

    ``shards``: shard, c, label, x, ids; ``queries``: q, label, x, windows. A task reads a shard's rows, then
    streams the queries, and so holds one shard and a block of queries."""
    empty = F.lit(None).cast("array<struct<low:bigint,high:bigint>>")
    rows = shards.filter(F.col("shard").between(start, end - 1)).select("shard", F.lit(0).alias("kind"), F.col("c").alias("name"), "label", "x", "ids", empty.alias("windows"))
    asked = queries.select(
        F.explode(F.sequence(F.lit(start), F.lit(end - 1))).alias("shard"), F.lit(1).alias("kind"), F.col("q").alias("name"), "label", "x", F.lit(None).cast("array<bigint>").alias("ids"), "windows"
    )

    def run(batches: Iterable):
        import pyarrow as pa

        now, parts, index = None, [], None
        for batch in batches:
            shard, kind = (batch.column(i).to_numpy() for i in (0, 1))
            edges = np.flatnonzero((np.diff(shard) != 0) | (np.diff(kind) != 0)) + 1
            for a, e in zip([0, *edges], [*edges, len(shard)]):
                part = batch.slice(a, e - a)
                if shard[a] != now:
                    now, parts, index = shard[a], [], None
                if not kind[a]:
                    parts.append((matrix(part.column(4), dims), part.column(3).to_numpy(), part.column(2).to_pylist(), part.column(5).to_pylist()))
                    continue
                if not parts and index is None:
                    continue
                if index is None:
                    index = Index(np.concatenate([p[0] for p in parts]))
                    labels = np.concatenate([p[1] for p in parts])
                    names, ids = ([v for p in parts for v in p[i]] for i in (2, 3))
                    first = np.array([v[0] for v in ids], np.int64)
                    parts = []
                for i in range(0, part.num_rows, QUERIES):
                    some = part.slice(i, QUERIES)
                    asking = some.column(2).to_pylist()
                    windows = [[(w["low"], w["high"]) for w in ws] for ws in some.column(6).to_pylist()]
                    out: list[tuple] = []
                    for b, r, s in best_in_windows(index, labels, first, matrix(some.column(4), dims), some.column(3).to_numpy(), windows, k, same):
                        out += [(asking[b], names[row], i, score) for row, score in zip(r.tolist(), s.tolist()) for i in ids[row]]
                    if out:
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(col, kind) for col, kind in zip(zip(*out), (pa.string(), pa.string(), pa.int64(), pa.int64()))], names=["q", "c", "vec_id", "score"]
                        )

    dealt = rows.unionByName(asked).repartition(end - start, "shard").sortWithinPartitions("shard", "kind")
    return dealt.mapInArrow(run, "q string, c string, vec_id bigint, score bigint")


def _stages(n: int) -> list[tuple[int, int]]:
    """Ranges of shards: the first alone, then GROW times as many as before, to the last."""
    out, start, size = [], 0, 1
    while start < n:
        out.append((start, min(n, start + size)))
        start, size = start + size, (start + size) * (GROW - 1)
    return out


def _first(rows: DataFrame, by: list[str], k: int) -> DataFrame:
    """The first ``k`` rows of each group, with their rank."""
    w = Window.partitionBy(*by).orderBy(F.desc("score"), "vec_id", "c")
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _top(shards: DataFrame, n: int, queries: DataFrame, windows: DataFrame, dims: int, k: int, same: bool) -> DataFrame:
    """q, w, c, vec_id, score, rank: the first ``k`` rows of each window. ``windows``: q, w, low, high.

    Each shard is visited once. What the shards before have found bounds the windows of a stage from below, which
    keeps what a stage returns to about ``k`` times GROW rows a window, however many shards there are."""
    found = None
    for start, end in _stages(n):
        bounds = windows
        if found is not None:
            floor = found.filter(F.col("rank") == k).select("q", "w", F.col("score").alias("_least"))
            bounds = windows.join(floor, ["q", "w"], "left").withColumn("low", F.greatest("low", "_least")).drop("_least")
        asked = queries.join(bounds.groupBy("q").agg(F.collect_list(F.struct("low", "high")).alias("windows")), "q")
        hits = _visit(shards, asked, start, end, dims, k, same)
        inside = hits.join(bounds, "q").filter(F.col("score").between(F.col("low"), F.col("high"))).select("q", "w", "c", "vec_id", "score")
        if found is not None:
            inside = inside.unionByName(found.drop("rank"))
        found = materialise(_first(inside, ["q", "w"], k), "top")
    return found


def mine(rows: DataFrame, every: int = 100, positives: int = 5, negatives: int = 10, least: int = 30, most: int = 90) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``rows``: vec_id, label, x (array of long, not NULL, one length); scores are inner products. Anchors are rows whose
    id is divisible by ``every``, their positives the first ``positives`` other rows of their label. Negatives are
    the first ``negatives`` rows of other labels with a score from ``least`` to ``most`` percent of the positive's. Higher
    scores come first, ties by smaller id, then by vector.

    Rows with a NULL id or label take no part. Exact repeats of a row (id, label, vector) count once; an id that has several
    vectors or labels names several rows. A positive score below 0 has an empty window, one of 0 takes negatives of score 0. Rows with
    equal vector and label are one class, so copies are scored once; a class keeps its smallest ids, as many as
    a list can take. An empty table gives no rows.
    """
    spark = rows.sparkSession
    keep = max(positives + 1, negatives)
    kind = "struct<anchor_id:bigint,positive_id:bigint,rank:int,negative_id:bigint,positive_score:bigint,negative_score:bigint>"
    dims = rows.agg(F.max(F.size("x"))).first()[0]
    if dims is None:
        return spark.createDataFrame([], kind[7:-1].replace(":", " "))
    dims = max(1, dims)
    name = F.md5(F.concat_ws(",", F.col("x").cast("array<string>"), F.lit("label"), F.col("label").cast("string")))
    named = padded(rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "x"), dims)
    named = named.filter("vec_id is not null and label is not null").withColumn("c", name).dropDuplicates(["vec_id", "c"])
    ids = named.withColumn("_no", F.row_number().over(Window.partitionBy("c").orderBy("vec_id"))).filter(F.col("_no") <= keep)
    classes = materialise(ids.groupBy("c").agg(F.first("label").alias("label"), F.first("x").alias("x"), F.sort_array(F.collect_list("vec_id")).alias("ids")), "classes")
    count = classes.count()
    n = max(1, -(-count * dims // ENTRIES), min(-(-count // 256), 2 * spark.sparkContext.defaultParallelism))
    shards = classes.withColumn("shard", F.pmod(F.xxhash64("c"), F.lit(n)).cast("int"))

    asking = named.filter(F.pmod("vec_id", F.lit(every)) == 0)
    anchors = materialise(asking.select(F.col("vec_id").alias("anchor_id"), F.col("c").alias("q")), "anchors")
    queries = materialise(asking.groupBy(F.col("c").alias("q")).agg(F.first("label").alias("label"), F.first("x").alias("x")), "queries")

    whole = queries.select("q", F.lit(0).cast("long").alias("w"), F.lit(-FAR).alias("low"), F.lit(FAR).alias("high"))
    same = _top(shards, n, queries, whole, dims, positives + 1, True)
    others = anchors.join(same.drop("w", "rank"), "q").filter(~((F.col("c") == F.col("q")) & (F.col("vec_id") == F.col("anchor_id"))))
    chosen = _first(others, ["anchor_id", "q"], positives).select("anchor_id", "q", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    chosen = materialise(chosen, "positives")

    p = F.col("w")
    low, high = F.expr(f"({least} * w + 99) div 100"), F.expr(f"({most} * w) div 100")
    windows = chosen.filter("positive_score >= 0").select("q", F.col("positive_score").alias("w")).distinct()
    windows = materialise(windows.select("q", p, low.alias("low"), high.alias("high")).filter("low <= high"), "windows")
    other = _top(shards, n, queries, windows, dims, negatives, False)
    found = other.select("q", p.alias("positive_score"), "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return chosen.join(found, ["q", "positive_score"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def mine_embeddings(embeddings: DataFrame, **options) -> DataFrame:
    """:func:`mine` on floor(256*x) of vec_id, embedding, label; rows with an unusable vector take no part."""
    return mine(scaled(embeddings, keep=("vec_id", "label")), **options)
