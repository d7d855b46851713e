"""Near-duplicate documents: BagMinHash signatures of word shingles, banding, exact multiset overlap, components."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from originlens.llm.common import GOLDEN, WordHashes, byte_texts, mix64, shingles, signed, slices, text_of
from originlens.llm.components import components
from originlens.session import materialise

M = 128  #: components of a signature
ROWS = 4  #: of a band; at similarity 0.8 a pair shares one of 32 bands but for 5e-8
SLACK = 0.62  #: least share of equal components of a pair worth its exact check: 5 standard deviations below 0.8
BLOCK = 1024  #: signatures compared at a time within a bucket
_UNIT = 2.0**-53


def _points(seed: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Random bits of the ``r``-th point of each process: for its waiting time, and for its place."""
    with np.errstate(over="ignore"):
        a = mix64(seed + (np.uint64(2) * r + np.uint64(1)) * GOLDEN)
        b = mix64(seed + (np.uint64(2) * r + np.uint64(2)) * GOLDEN)
    return a, b


def signatures(bags: list[tuple[np.ndarray, np.ndarray]], m: int = M) -> np.ndarray:
    """BagMinHash signatures, 16 bits a component, of multisets given as (distinct hashes, counts).

    Weights are whole counts. The weight axis is cut at 1, 2, 4, 8, ...; each element has a Poisson
    process per interval, of a rate equal to the interval's length, seeded by element and interval. A
    point falls on one unit of the interval and counts if that unit is within the element's count; so
    the points two bags share follow the smaller count, those either has the larger one. A component
    takes the earliest counting point dealt to it, and agrees between two bags with a probability equal
    to their weighted Jaccard similarity. A process ends as soon as its time passes the latest component
    of its bag. All bags advance together; one without elements has a signature of zeros.
    """
    n = len(bags)
    first = np.full(n * m, np.inf)
    who = np.zeros(n * m, np.uint64)
    doc, seed, low, size, count = [], [], [], [], []
    for i, (x, c) in enumerate(bags):
        a, level = 0, 0
        while len(x):
            length = 1 if level == 0 else 1 << (level - 1)
            doc.append(np.full(len(x), i)), low.append(np.full(len(x), a)), size.append(np.full(len(x), length))
            seed.append(mix64(x ^ np.uint64(level * 0xA24BAED4963EE407 % 2**64))), count.append(c)
            a, level = a + length, level + 1
            x, c = x[c > a], c[c > a]
    if not doc:
        return np.zeros((n, m), np.uint16)
    doc, seed, low, size, count = map(np.concatenate, (doc, seed, low, size, count))
    t, r = np.zeros(len(doc)), np.zeros(len(doc), np.uint64)
    while len(doc):
        k = int(np.clip(16384 // len(doc), 1, 32))
        step = r[:, None] + np.arange(k, dtype=np.uint64)
        a, b = _points(seed[:, None], step)
        times = t[:, None] + np.cumsum(-np.log(((a >> np.uint64(11)) + 0.5) * _UNIT) / size[:, None], axis=1)
        at = doc[:, None] * m + (b & np.uint64(m - 1)).astype(np.int64)
        unit = (((b >> np.uint64(16)) & np.uint64(0xFFFFFFFF)) * size[:, None].astype(np.uint64)) >> np.uint64(32)
        ok = low[:, None] + unit.astype(np.int64) < count[:, None]
        at, when, name = at[ok], times[ok], a[ok]
        np.minimum.at(first, at, when)
        won = when == first[at]
        who[at[won]] = name[won]
        t, r = times[:, -1], r + np.uint64(k)
        more = t < first.reshape(n, m).max(axis=1)[doc]
        doc, seed, low, size, count, t, r = (v[more] for v in (doc, seed, low, size, count, t, r))
    return (mix64(who) >> np.uint64(48)).astype(np.uint16).reshape(n, m)


def bag(h: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(shingles(h, k), return_counts=True)


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Sum of smaller counts over sum of larger counts."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = int(np.minimum(a[1][i], b[1][j]).sum())
    return both / (int(a[1].sum()) + int(b[1].sum()) - both)


def words_of(text: bytes) -> list[bytes]:
    return text.lower().split()


def node_of(words: list[bytes]) -> int:
    """The document's words as a signed 64-bit key: texts with the same words are copies."""
    x = xxhash.xxh3_64_intdigest(b" ".join(words))
    return x - (1 << 64) if x >> 63 else x


def row_key() -> Column:
    """Key of a row: an id may be NULL or repeated with another text."""
    return F.xxhash64("doc_id", text_of("text"))


def sketch(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, node, sig (binary; NULL for a text without words), _row (:func:`row_key`) of every whole text."""

    def run(batches: Iterable):
        import pyarrow as pa

        hashes = WordHashes()
        for b in slices(batches, 1024):
            words = [words_of(t) for t in byte_texts(b.column(1))]
            s = signatures([bag(hashes.of(w), k) for w in words])
            sig = [s[i].tobytes() if w else None for i, w in enumerate(words)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([node_of(w) for w in words], pa.int64()), pa.array(sig, pa.binary()), b.column(2)],
                names=["doc_id", "node", "sig", "_row"],
            )

    src = docs.select("doc_id", text_of("text").alias("text"), row_key().alias("_row"))
    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, node bigint, sig binary, _row bigint")


def bands(nodes: DataFrame, id_col: str = "node", width: int = ROWS, m: int = M) -> DataFrame:
    """band, key, node: one row per band of each signature; a band of four 16-bit components is its own key."""
    n = 2 * width
    key = lambda i: F.conv(F.hex(F.substring("sig", i * n + 1, n)), 16, -10).cast("long")
    rows = F.array(*[F.struct(F.lit(i).alias("band"), key(i).alias("key")) for i in range(m // width)])
    return nodes.select(F.explode(rows).alias("b"), F.col(id_col).alias("node")).select("b.band", "b.key", "node")


def stars(banded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The members of shared buckets (band, key, node, hub, n), and the candidate links hub - member."""
    hubs = banded.groupBy("band", "key").agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    members = materialise(banded.join(hubs, ["band", "key"]), "bucket-members")
    links = members.filter("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    return members, links


def _alike(x: np.ndarray, y: np.ndarray, least: float) -> np.ndarray:
    """Index pairs of rows that agree in enough components."""
    out = []
    for i in range(0, len(x), 64):
        same = (x[i : i + 64, None, :] == y[None, :, :]).mean(axis=2)
        a, b = np.nonzero(same >= least)
        out.append(np.stack([a + i, b], axis=1))
    return np.concatenate(out) if out else np.zeros((0, 2), np.int64)


def _forest(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> list[int]:
    """Positions in (a, b) of links that join all components the links connect; ``c``: the component of each row."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = x = root[root[x]]
        return x

    _, first = np.unique(np.stack([c[a], c[b]], axis=1), axis=0, return_index=True)
    out = []
    for i in first.tolist():
        x, y = find(int(c[a[i]])), find(int(c[b[i]]))
        if x != y:
            root[max(x, y)] = min(x, y)
            out.append(i)
    return out


def loose_links(members: DataFrame, roots: DataFrame, sigs: DataFrame, slack: float = SLACK) -> DataFrame:
    """a, b: roots of components that may belong together, for their members' signatures in a bucket are alike.

    Members of one component need no further link between them, so most buckets, and all that hold one
    group of copies, end here. The rest are compared by signature, ``BLOCK`` against ``BLOCK`` rows at a
    time: a large bucket spreads over tasks by pairs of its blocks. Only links that join components are
    returned, fewer than there are rows.
    """
    m = members.filter("n > 2").join(roots.withColumnRenamed("root", "c"), "node", "left")
    m = m.withColumn("c", F.coalesce("c", "node"))
    open_ = m.groupBy("band", "key").agg(F.min("c").alias("_lo"), F.max("c").alias("_hi")).filter("_lo <> _hi")
    m = m.join(open_.select("band", "key"), ["band", "key"]).join(sigs.select("node", "sig"), "node")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    m = m.withColumn("_i", F.pmod(F.xxhash64("node"), blocks).cast("int"))
    m = m.withColumn("_j", F.explode(F.sequence(F.lit(0), blocks - 1)))
    m = m.select("band", "key", F.least("_i", "_j").alias("lo"), F.greatest("_i", "_j").alias("hi"), "_i", "c", "sig")

    def compare(t):
        import pyarrow as pa

        c, i = t.column("c").to_numpy(), t.column("_i").to_numpy()
        sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint16).reshape(len(c), -1)
        p, q = np.flatnonzero(i == t.column("lo")[0].as_py()), np.flatnonzero(i == t.column("hi")[0].as_py())
        ij = _alike(sig[p], sig[q], slack)
        a, b = p[ij[:, 0]], q[ij[:, 1]]
        keep = c[a] != c[b]
        a, b = a[keep], b[keep]
        at = _forest(a, b, c)
        a, b = c[a[at]], c[b[at]]
        return pa.table({"a": pa.array(np.minimum(a, b), pa.int64()), "b": pa.array(np.maximum(a, b), pa.int64())})

    return m.groupBy("band", "key", "lo", "hi").applyInArrow(compare, "a bigint, b bigint").distinct()


def _overlaps(bags: list[tuple[np.ndarray, np.ndarray]], p: np.ndarray, q: np.ndarray, slab: int = 4096) -> np.ndarray:
    """Multiset overlaps of all bags ``p`` with all bags ``q``: a shingle that occurs k times stands for k
    elements; products of 0/1 matrices, a slab of shared elements at a time."""
    with np.errstate(over="ignore"):
        each = []
        for x, c in bags:
            copy = np.arange(int(c.sum())) - np.repeat(np.cumsum(c) - c, c)
            each.append(np.repeat(x, c) + copy.astype(np.uint64) * GOLDEN)
    row = np.repeat(np.arange(len(bags)), [len(e) for e in each])
    _, col, df = np.unique(np.concatenate(each), return_inverse=True, return_counts=True)
    number = np.cumsum(df > 1) - 1
    shared = df[col] > 1
    row, col = row[shared], number[col[shared]]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    total = np.zeros((len(p), len(q)), np.float32)
    width = int(col[-1]) + 1 if len(col) else 0
    for at in range(0, width, slab):
        i, j = np.searchsorted(col, [at, at + slab])
        dense = np.zeros((len(bags), min(slab, width - at)), np.float32)
        dense[row[i:j], col[i:j] - at] = 1
        total += dense[p] @ dense[q].T
    return total


def settle(loose: DataFrame, nodes: DataFrame, roots: DataFrame, fetch, least: float) -> DataFrame:
    """a, b: verified links between nodes of different components that ``loose`` holds possible.

    Components that hang together loosely are one cluster. In a cluster, all nodes outside its largest
    component are compared with each other and with that component's nodes, by whole multisets, ``BLOCK``
    / 2 against as many at a time; a large cluster spreads over tasks by pairs of blocks. Only links that
    join components are returned. ``fetch``: multisets (node, x, c) of given nodes."""
    cluster = components(loose).select(F.col("node").alias("root"), F.col("root").alias("cluster"))
    m = nodes.select("node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")).join(cluster, "root")
    per = m.groupBy("cluster", "root").agg(F.count(F.lit(1)).alias("k"))
    most = per.groupBy("cluster").agg(F.max(F.struct("k", "root")).alias("big"), F.sum("k").alias("n"))
    m = m.join(most, "cluster")
    size = BLOCK // 2
    outer, inner = (F.ceil(x / size).cast("int") for x in (F.col("n") - F.col("big.k"), F.col("big.k")))
    is_big = F.col("root") == F.col("big.root")
    m = m.select(
        "cluster", "node", "root", outer.alias("outer"), inner.alias("inner"), is_big.alias("is_big"),
        F.when(is_big, outer + F.pmod(F.xxhash64("node"), inner)).otherwise(F.pmod(F.xxhash64("node"), outer)).cast("int").alias("i"),
    )
    others = F.sequence(F.lit(0), F.when(F.col("is_big"), F.col("outer")).otherwise(F.col("outer") + F.col("inner")) - 1)
    wanted = materialise(m, "cluster-nodes")
    m = wanted.withColumn("j", F.explode(others)).join(fetch(wanted.select("node")), "node")
    m = m.select("cluster", F.least("i", "j").alias("lo"), F.greatest("i", "j").alias("hi"), "i", "node", "root", "x", "c")

    def compare(t):
        import pyarrow as pa

        node, root, i = (t.column(n).to_numpy() for n in ("node", "root", "i"))
        p, q = np.flatnonzero(i == t.column("lo")[0].as_py()), np.flatnonzero(i == t.column("hi")[0].as_py())
        bags = [
            (np.frombuffer(x, np.uint64), np.frombuffer(c, np.uint32).astype(np.int64))
            for x, c in zip(t.column("x").to_pylist(), t.column("c").to_pylist())
        ]
        n = np.array([c.sum() for _, c in bags], np.float64)
        both = _overlaps(bags, p, q).astype(np.float64)
        a, b = np.nonzero(both >= least * (n[p][:, None] + n[q][None, :] - both))
        a, b = p[a], q[b]
        keep = root[a] != root[b]
        a, b = a[keep], b[keep]
        at = _forest(a, b, root)
        return pa.table({"a": pa.array(node[a[at]], pa.int64()), "b": pa.array(node[b[at]], pa.int64())})

    return m.groupBy("cluster", "lo", "hi").applyInArrow(compare, "a bigint, b bigint")


def screen(links: DataFrame, sigs: DataFrame, slack: float = SLACK) -> DataFrame:
    """The links whose signatures agree in enough components."""
    s = sigs.select("node", "sig")
    j = links.join(s.toDF("b", "sb"), "b").join(s.toDF("a", "sa"), "a")

    def run(batches: Iterable):
        import pyarrow as pa

        for t in slices(batches):
            x, y = (np.frombuffer(b"".join(t.column(n).to_pylist()), np.uint16).reshape(t.num_rows, -1) for n in ("sa", "sb"))
            keep = pa.array((x == y).mean(axis=1) >= slack)
            yield pa.RecordBatch.from_arrays([t.column("a").filter(keep), t.column("b").filter(keep)], names=["a", "b"])

    return j.select("a", "b", "sa", "sb").mapInArrow(run, "a bigint, b bigint")


def bags(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """node, x, c: the shingle multiset, as bytes, of each wanted node. ``wanted``: node, _row (key of a row that has it)."""
    asked = wanted.select(F.col("_row").alias("_asked"), F.col("node").alias("_node"))
    src = docs.select(row_key().alias("_row"), text_of("text").alias("text")).join(asked, F.col("_row") == F.col("_asked"))

    def run(batches: Iterable):
        import pyarrow as pa

        hashes = WordHashes()
        for b in slices(batches, 512):
            rows = []
            for t, node in zip(byte_texts(b.column(0)), b.column(1).to_pylist()):
                w = words_of(t)
                if node_of(w) == node:  # keys are hashes
                    x, c = bag(hashes.of(w), k)
                    rows.append((node, x.tobytes(), c.astype(np.uint32).tobytes()))
            yield pa.RecordBatch.from_pydict(
                {"node": pa.array([r[0] for r in rows], pa.int64()), "x": pa.array([r[1] for r in rows], pa.binary()), "c": pa.array([r[2] for r in rows], pa.binary())}
            )

    return src.select("text", "_node").mapInArrow(run, "node bigint, x binary, c binary").dropDuplicates(["node"])


def verify(links: DataFrame, bagged: DataFrame, least: float) -> DataFrame:
    """a, b, similarity of the links whose multisets overlap enough. The side with the hubs is joined last,
    so a hub's multiset meets its many members without being shuffled with them."""
    j = links.join(bagged.toDF("b", "xb", "cb"), "b").join(bagged.toDF("a", "xa", "ca"), "a")

    def run(batches: Iterable):
        import pyarrow as pa

        for t in slices(batches, 512):
            cols = [t.column(n).to_pylist() for n in ("xa", "ca", "xb", "cb")]
            sim = [
                weighted_jaccard((np.frombuffer(xa, np.uint64), np.frombuffer(ca, np.uint32)), (np.frombuffer(xb, np.uint64), np.frombuffer(cb, np.uint32)))
                for xa, ca, xb, cb in zip(*cols)
            ]
            keep = pa.array(np.array(sim) >= least, pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [t.column("a").filter(keep), t.column("b").filter(keep), pa.array(sim, pa.float64()).filter(keep)], names=["a", "b", "similarity"]
            )

    return j.select("a", "b", "xa", "ca", "xb", "cb").mapInArrow(run, "a bigint, b bigint, similarity double")


def classes(docs: DataFrame, k: int = 5, similarity: float = 0.8) -> DataFrame:
    """doc_id, class_id, class_size: near-duplicate classes of all rows of ``docs`` (doc_id, text).

    A class is a connected component of the links between documents whose multisets of ``k``-word
    shingles have a weighted Jaccard similarity of at least ``similarity``; class_id is its smallest
    doc_id. Words are split at white space and ASCII-lowercased; fewer than ``k`` words are one shingle.

    Texts with the same words are one node from the start, so a group of exact copies costs one row.
    In each bucket of a band all members are checked against the smallest; buckets that this does not
    join into one component are compared further (:func:`loose_links`, :func:`settle`). Every link is
    verified on whole multisets.
    Defined cases: a text without words (NULL, empty) is a class of its own row's id; repeated rows share
    a class; a NULL id is never the class_id of a class with other ids; an empty table gives no rows.
    """
    placed = _placed(docs, k, similarity)
    ids = placed.groupBy("_empty", "root").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("class_size"))
    return placed.join(ids, ["_empty", "root"]).select("doc_id", "class_id", "class_size")


def _placed(docs: DataFrame, k: int, similarity: float) -> DataFrame:
    """doc_id, _empty, root, _row: the class of every row."""
    rows = materialise(sketch(docs, k), "sketches")
    nodes = materialise(
        rows.filter("sig IS NOT NULL").groupBy("node").agg(F.min("_row").alias("_row"), F.first("sig").alias("sig")), "nodes"
    )
    members, star = stars(bands(nodes))
    star = materialise(screen(star, nodes), "star-links")

    def fetch(asked: DataFrame) -> DataFrame:
        return materialise(bags(docs, nodes.select("node", "_row").join(asked.distinct(), "node"), k), "bags")

    ends = star.select(F.explode(F.array("a", "b")).alias("node"))
    links = materialise(verify(star, fetch(ends), similarity).select("a", "b"), "links")
    roots = components(links)
    loose = materialise(loose_links(members, roots, nodes), "loose-links")
    if loose.head(1):
        more = materialise(settle(loose, nodes, roots, fetch, similarity), "more-links")
        roots = components(links.unionByName(more))
    placed = rows.select("doc_id", "node", F.col("sig").isNull().alias("_empty"), "_row").join(roots, "node", "left")
    # rows without words stand alone, by their id
    root = F.when(F.col("_empty"), F.xxhash64(F.lit("empty"), "doc_id")).otherwise(F.coalesce("root", "node"))
    return placed.select("doc_id", "_empty", root.alias("root"), "_row")


def deduplicate(docs: DataFrame, k: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row of each class of :func:`classes`: that of its smallest id, by the row's key (id and text) if that
    id has several rows there. Rows count, not ids: an id keeps a row in each class of its texts. A row with
    a NULL id stays if its class has no other id."""
    # equal rows are counted first, so that only those which have copies are shuffled with their texts
    rows = _placed(docs, k, similarity).groupBy("_empty", "root", "doc_id", "_row").agg(F.count(F.lit(1)).alias("n"))
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_row", "n"))
    kept = materialise(rows.groupBy("_empty", "root").agg(first.alias("first")).select("first._row", "first.n"), "kept-rows")
    own = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_doc"), row_key().alias("_row"))
    once = own.join(kept.filter("n = 1"), "_row", "left_semi")
    copied = own.join(kept.filter("n > 1"), "_row", "left_semi").groupBy("_row").agg(F.first("_doc").alias("_doc"))
    both = once.select("_doc").unionByName(copied.select("_doc"))
    return both.select(*[F.col("_doc").getField(c).alias(c) for c in docs.columns])
