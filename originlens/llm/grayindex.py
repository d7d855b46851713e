"""SimHash near-duplicates through a hierarchical index over fingerprints in Gray order.

Fingerprints are sorted by their rank in the reflected Gray code, so neighbours tend to differ in few bits. Runs
of neighbours form groups, runs of groups form nodes of the next level, up to a few nodes at the top. Each node keeps the
bits on which all fingerprints below it agree, as a pattern under a mask. Pairs of nodes are followed from the
top: the differences between their patterns, added up over the levels, are a lower bound for all pairs of
fingerprints below, and pairs of whole groups beyond the radius are dropped.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from originlens.llm.common import byte_texts, slices, text_of
from originlens.llm.components import components
from originlens.session import materialise

SEED = 42
GROUP = 256  #: fingerprints in a group, at most
SUB = 16  #: fingerprints under the lowest patterns, which are made inside a task
FAN = 32  #: nodes under one of the next level, at most
ALL = (1 << 64) - 1


def shingle_hashes(text: bytes, k: int = 3) -> np.ndarray:
    """XXH64 of all runs of ``k`` words, repeats included; of the whole sequence if there are fewer; none without words."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    k = min(k, len(words))
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = (ends - [len(w) + 1 for w in words])[: len(words) - k + 1].tolist()
    h = xxhash.xxh64_intdigest
    return np.array([h(line[a:b], SEED) for a, b in zip(starts, (ends[k - 1 :] - 1).tolist())], np.uint64)


def fingerprint(h: np.ndarray) -> int:
    """A bit is 1 if it is set in more than half of the hashes; 0 without hashes."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 32_768):
        part = h[i : i + 32_768].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, k: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long) of every whole text; NULL and empty texts have fingerprint 0."""

    def run(batches: Iterable):
        import pyarrow as pa

        for b in slices(batches, 256):
            fps = np.array([fingerprint(shingle_hashes(t, k)) for t in byte_texts(b.column(1))], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    src = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, fp bigint")


def gray_rank(fp: Column) -> Column:
    """Rank of a fingerprint in the reflected Gray code, as a signed long whose order is that of the unsigned rank."""
    r = fp
    for s in (1, 2, 4, 8, 16, 32):
        r = r.bitwiseXOR(F.shiftrightunsigned(r, s))
    return r.bitwiseXOR(F.lit(-(1 << 63)))


def patterns(fps: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Bits and masks of the runs of ``size`` fingerprints: the mask has the bits on which all of a run agree."""
    at = np.arange(0, len(fps), size)
    low, high = np.bitwise_and.reduceat(fps, at), np.bitwise_or.reduceat(fps, at)
    return low, ~(low ^ high)


def groups(fps: DataFrame) -> DataFrame:
    """part, no, fps: groups of neighbours in Gray order. ``fps``: distinct values.

    Spark's range partitioning deals ranges of ranks; each task cuts its sorted range into groups of bounded size."""

    def run(batches: Iterable):
        import pyarrow as pa

        no, rest = 0, np.zeros(0, np.int64)

        def batch(full: np.ndarray, first: int):
            rows = [full[i : i + GROUP] for i in range(0, len(full), GROUP)]
            return pa.RecordBatch.from_pydict(
                {
                    "no": pa.array(np.arange(first, first + len(rows))),
                    "fps": pa.array([r.tolist() for r in rows], pa.list_(pa.int64())),
                }
            )

        for b in batches:
            rest = np.concatenate([rest, b.column(0).to_numpy()])
            n = len(rest) - len(rest) % GROUP
            if n:
                yield batch(rest[:n], no)
                no, rest = no + n // GROUP, rest[n:]
        if len(rest):
            yield batch(rest, no)

    ranked = fps.select("fp", gray_rank(F.col("fp")).alias("rank"))
    dealt = ranked.repartitionByRange("rank").sortWithinPartitions("rank").select("fp")
    return dealt.mapInArrow(run, "no bigint, fps array<bigint>").select(F.spark_partition_id().alias("part"), "no", "fps")


def _agree() -> tuple[Column, Column]:
    """Pattern and mask of a node from those of its children."""
    mask = F.bit_and("mask").bitwiseAND(F.bitwise_not(F.bit_or("bits").bitwiseXOR(F.bit_and("bits"))))
    return F.bit_and("bits").alias("bits"), mask.alias("mask")


def levels(leaves: DataFrame) -> list[DataFrame]:
    """Nodes from the groups (first) to the top (last): node, parent, bits, mask. The nodes at the top have parent 0.

    ``leaves``: node, bits, mask, where node numbers follow the Gray order. A node's parent is the node of the next
    level that holds its FAN neighbours; levels are added until one node could hold the highest."""
    out = []
    level = leaves
    while True:
        n = level.count()
        if n <= FAN:
            return [*out, level.withColumn("parent", F.lit(0).cast("long"))]
        level = level.withColumn("parent", F.floor(F.col("node") / F.lit(FAN)).cast("long"))
        out.append(level)
        up = level.groupBy("parent").agg(*_agree()).withColumnRenamed("parent", "node")
        level = materialise(up, "gray-level")


def close_nodes(tree: list[DataFrame], radius: int) -> DataFrame:
    """a, b (a <= b): pairs of groups, of which no more than ``radius`` differences are known from their patterns.

    Starts with the root beside itself and goes down a level at a time: pairs of parents meet their children by
    equality of keys. A pair carries its differences so far and the bits already compared; children add the
    differences on bits that only they fix."""
    spark = tree[0].sparkSession
    zero = F.lit(0).cast("long")
    pairs = spark.range(1).select(zero.alias("a"), zero.alias("b"), zero.alias("seen"), zero.alias("diff"))
    for level in reversed(tree):
        one = level.select(F.col("parent").alias("a"), F.col("node").alias("na"), F.col("bits").alias("ba"), F.col("mask").alias("ma"))
        two = level.select(F.col("parent").alias("b"), F.col("node").alias("nb"), F.col("bits").alias("bb"), F.col("mask").alias("mb"))
        both = pairs.join(one, "a").join(two, "b").filter("na <= nb")
        common = F.col("ma").bitwiseAND(F.col("mb"))
        new = common.bitwiseAND(F.bitwise_not(F.col("seen")))
        diff = F.col("diff") + F.bit_count(F.col("ba").bitwiseXOR(F.col("bb")).bitwiseAND(new))
        found = both.select(F.col("na").alias("a"), F.col("nb").alias("b"), common.alias("seen"), diff.alias("diff"))
        pairs = materialise(found.filter(F.col("diff") <= radius), "gray-pairs")
    return pairs.select("a", "b")


def near_in(a: np.ndarray, b: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j) of all fingerprints of ``a`` and ``b`` within the radius; the lowest patterns prune runs of 16."""
    (xa, ma), (xb, mb) = patterns(a, SUB), patterns(b, SUB)
    known = np.bitwise_count((xa[:, None] ^ xb[None]) & ma[:, None] & mb[None])
    p, q = np.nonzero(known <= radius)
    i = (p[:, None] * SUB + np.arange(SUB)[None]).clip(max=len(a) - 1)
    j = (q[:, None] * SUB + np.arange(SUB)[None]).clip(max=len(b) - 1)
    k, x, y = np.nonzero(np.bitwise_count(a[i][:, :, None] ^ b[j][:, None, :]) <= radius)
    return i[k, x], j[k, y]


def _spanning(fps: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect the same fingerprints as the given ones: each with the first of its component."""
    low = np.arange(len(fps))
    while True:
        m = np.minimum(low[i], low[j])
        before = low.copy()
        np.minimum.at(low, i, m)
        np.minimum.at(low, j, m)
        low = low[low]
        if (low == before).all():
            break
    far = np.flatnonzero(low != np.arange(len(fps)))
    return fps[far], fps[low[far]]


def links(fps: DataFrame, radius: int = 2) -> DataFrame:
    """a, b: links between distinct fingerprints (column fp) that connect all those within ``radius`` bits.

    Every pair of groups that the index doesn't rule out is compared in a task of its own rows; a pair emits at
    most one link for each of its fingerprints, enough to connect all that lie within the radius."""

    def run(batches: Iterable):
        import pyarrow as pa

        for batch in slices(batches, 512):
            left, right = [], []
            for x, y in zip(batch.column(0), batch.column(1)):
                a, b = (c.values.to_numpy().view(np.uint64) for c in (x, y))
                i, j = near_in(a, b, radius)
                both = np.concatenate([a, b])
                _, first = np.unique(both, return_index=True)
                order = np.searchsorted(both[first], both)
                u, v = _spanning(both[first], order[i], order[j + len(a)])
                left.append(u), right.append(v)
            cols = [pa.array(np.concatenate([np.zeros(0, np.uint64), *c]).view(np.int64)) for c in (left, right)]
            yield pa.RecordBatch.from_arrays(cols, names=["a", "b"])

    dealt = materialise(groups(fps), "gray-groups")
    # groups are numbered in Gray order: by the groups of the parts before, then within the part
    sizes = dealt.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    node = (F.col("before") + F.col("no")).alias("node")
    low = F.aggregate("fps", F.lit(-1).cast("long"), lambda s, x: s.bitwiseAND(x))
    high = F.aggregate("fps", F.lit(0).cast("long"), lambda s, x: s.bitwiseOR(x))
    leaves = materialise(dealt.join(before, "part").select(node, low.alias("bits"), F.bitwise_not(low.bitwiseXOR(high)).alias("mask"), "fps"), "gray-leaves")
    pairs = close_nodes(levels(leaves.select("node", "bits", "mask")), radius)
    one = leaves.select(F.col("node").alias("a"), F.col("fps").alias("x"))
    two = leaves.select(F.col("node").alias("b"), F.col("fps").alias("y"))
    return pairs.join(one, "a").join(two, "b").select("x", "y").mapInArrow(run, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, radius: int = 2, k: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every row of ``docs`` (doc_id, text).

    Rows whose fingerprints differ in ``radius`` bits or less are linked; component_id is the smallest doc_id that
    links reach, the row itself included. NULL and empty texts have fingerprint 0 and are linked like others. Equal
    fingerprints are one node, so copies cost nothing. Repeated rows stay; a NULL doc_id is kept, and its component
    has the smallest id of the others, or NULL if there is none. An empty table gives no rows.
    """
    own = materialise(fingerprints(docs, k), "gray-fingerprints")
    # the smallest id of a fingerprint; NULL if all its ids are
    nodes = materialise(own.groupBy("fp").agg(F.min("doc_id").alias("least")), "gray-nodes")
    roots = components(links(nodes.select("fp"), radius))
    named = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    component = named.select("fp", "root").join(least, "root").select("fp", "component_id")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return own.join(component, "fp").select("doc_id", hexed, "component_id")
