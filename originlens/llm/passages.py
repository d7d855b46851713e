"""Substring deduplication: MinHash banding of paragraphs, exact verification, removal by components."""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from originlens.llm.bagminhash import bands, loose_links, row_key, screen, settle, stars, verify
from originlens.llm.common import GOLDEN, byte_texts, drop, mix64, release, signed, slices, text_of
from originlens.llm.components import components
from originlens.session import materialise

K = 5  #: words of a shingle
LEAST_WORDS = 20  #: of a line that counts as a paragraph, and of the common run of two sliding paragraphs
SLIDING = 49  #: words of a sliding paragraph
REACH = SLIDING - LEAST_WORDS  #: words from the edge of a common sliding paragraph to its run, at most
COMPONENTS = 16  #: of a line's signature: 8 bands of 2; a pair at similarity 0.8 shares one but for 3e-4
SLACK = 0.4  #: least share of equal components worth the exact check: of pairs at similarity 0.8, 2.5e-4 have less

#: Odd multipliers: shingle hashes are mixed already, so a product gives each component an order of its own.
_SEEDS = [np.uint64(mix64(np.array([i + 1], np.uint64))[0]) | np.uint64(1) for i in range(COMPONENTS)]

_BASE = 0xD1342543DE82EF95  #: of the polynomials that hash words, lines and runs; odd, so that it has an inverse
_BLOCK = 1 << 18  #: bytes of a text hashed at a time; a block ends between words
_GAP = re.compile(rb"[\x20\x09-\x0D]")
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LETTER = mix64(np.arange(1, 257, dtype=np.uint64))
_LETTER[ord("A") : ord("Z") + 1] = _LETTER[ord("a") : ord("z") + 1]


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, out=out)


@lru_cache(1)
def _usual_powers() -> tuple[np.ndarray, np.ndarray]:
    return _powers(_BASE, 2 * _BLOCK + 1), _powers(pow(_BASE, -1, 2**64), 2 * _BLOCK + 1)


def span_hashes(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Polynomials in ``values[first:last]``, wherever they stand, as differences of prefix sums."""
    n = len(values)
    up, down = _usual_powers() if n <= 2 * _BLOCK else (_powers(_BASE, n + 1), _powers(pow(_BASE, -1, 2**64), n + 1))
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(values * up[:n], out=total[1:])
    return (total[last] - total[first]) * down[first]


def word_hashes(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of a text's words, A-Z as a-z, and the number of words before each line feed."""
    hashes, breaks, n, at = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0, 0
    while at < len(text):
        gap = _GAP.search(text, at + _BLOCK - 1) if len(text) - at > _BLOCK else None
        end = gap.end() if gap else len(text)
        b = np.frombuffer(text, np.uint8, end - at, at)
        space = np.ones(len(b) + 2, bool)
        space[1:-1] = _SPACE[b]
        edge = np.flatnonzero(space[1:] != space[:-1])
        first, last = edge[::2], edge[1::2]
        hashes.append(mix64(span_hashes(_LETTER[b], first, last)))
        breaks.append(np.searchsorted(first, np.flatnonzero(b == 10)) + n)
        n, at = n + len(first), end
    return np.concatenate(hashes), np.concatenate(breaks)


def hashed(texts: list[bytes]) -> Iterable[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Short texts together, about a block at a time: their number, their words' hashes, the number of words
    before the end of each line, and before the end of each text."""
    some, size = [], 0
    for i, text in enumerate(texts):
        some.append(text)
        size += len(text)
        if size >= _BLOCK or i + 1 == len(texts):
            h, breaks = word_hashes(b"\n".join([*some, b""]))
            yield len(some), h, breaks, breaks[np.cumsum([t.count(b"\n") + 1 for t in some]) - 1]
            some, size = [], 0


def words_of(texts: list[bytes]) -> Iterable[np.ndarray]:
    """The hashes of each text's words."""
    for _, h, _, ends in hashed(texts):
        yield from np.split(h, ends[:-1])


def line_hashes(h: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Hashes of lines by their words; unlike those of runs even where the words are the same."""
    return mix64(span_hashes(h, first, last) ^ GOLDEN)


def run_hashes(h: np.ndarray, n: int = LEAST_WORDS) -> np.ndarray:
    """Hashes of all runs of ``n`` words: a polynomial in the words' hashes, by doubling, mixed at the end."""
    level, width, out, done = h, 1, None, 0
    with np.errstate(over="ignore"):
        while True:
            power = np.uint64(pow(_BASE, width, 2**64))
            if n & width:  # runs of the bits of n follow each other
                if out is None:
                    out = level
                else:
                    m = max(len(level) - done, 0)
                    out = out[:m] * power + level[done : done + m]
                done += width
            if width * 2 > n:
                return mix64(out)
            level = level[:-width] * power + level[width:] if len(level) > width else level[:0]
            width *= 2


def sliding_minima(g: np.ndarray, block: int) -> np.ndarray:
    """For each ``block`` neighbours, the position of the smallest hash, the last of equal ones."""
    low, at, width = g, np.arange(len(g)), 1
    while width < min(block, len(g)):
        step = min(width, min(block, len(g)) - width)  # two windows that overlap or meet make one
        later = low[step:] <= low[:-step]
        at = np.where(later, at[step:], at[:-step])
        low = np.minimum(low[step:], low[:-step])
        width += step
    return at


def chosen_runs(g: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Positions of the runs that are smallest in a sliding paragraph of one of the texts, or in a shorter text."""
    n = ends - begins
    windows = np.maximum(n - SLIDING + 1, 0)
    i = np.repeat(begins - np.cumsum(windows) + windows, windows) + np.arange(windows.sum())
    at = sliding_minima(g, SLIDING - LEAST_WORDS + 1)[i] if len(i) else i
    at = at[np.append(True, at[1:] != at[:-1])] if len(at) else at
    short = np.flatnonzero((n >= LEAST_WORDS) & (n < SLIDING))
    one = [e - LEAST_WORDS - int(g[b : e - LEAST_WORDS + 1][::-1].argmin()) for b, e in zip(begins[short].tolist(), ends[short].tolist())]
    return np.sort(np.append(at, np.array(one, np.int64)))


def paragraphs(texts: list[bytes]) -> Iterable[tuple[tuple, tuple]]:
    """Paragraphs of some texts, (text, first word, end word, node) as arrays: of lines, with a list of their
    signatures, and of runs.

    Lines of at least ``LEAST_WORDS`` words, with a MinHash signature of their shingles; and, wherever
    lines begin and end, all sliding paragraphs of ``SLIDING`` words, each represented by the one run of
    ``LEAST_WORDS`` words with the smallest hash. Two texts with a common passage of ``SLIDING`` words or
    more share such a run, however the passage is embedded; :func:`embedded` extends it word by word."""
    done = 0
    for n, h, breaks, ends in hashed(texts):
        begins = np.append(0, ends[:-1])
        first, last = np.append(0, breaks[:-1]), breaks
        long = last - first >= LEAST_WORDS
        first, last = first[long], last[long]
        sig: list[bytes] = []
        if len(first):
            cut = np.stack([first, last - K + 1], axis=1).ravel()
            padded = np.append(run_hashes(h, K), np.uint64(0))  # so that the last border is a position
            least = np.empty((len(first), COMPONENTS), np.uint64)
            for i, seed in enumerate(_SEEDS):
                least[:, i] = np.minimum.reduceat(padded * seed, cut)[::2]
            sig = [x.tobytes() for x in (mix64(least) >> np.uint64(32)).astype("<u4")]
        of = np.searchsorted(ends, first, "right")
        lines = (of + done, first - begins[of], last - begins[of], line_hashes(h, first, last), sig)
        g = run_hashes(h) if len(h) >= LEAST_WORDS else h[:0]
        at = chosen_runs(g, begins, ends)
        of = np.searchsorted(ends, at, "right")
        yield lines, (of + done, at - begins[of], at - begins[of] + LEAST_WORDS, g[at])
        done += n


def extract(docs: DataFrame) -> DataFrame:
    """doc_id, row, first, last, node, sig of all paragraphs of all whole texts; rows without an id are left out."""

    def run(batches: Iterable):
        import pyarrow as pa

        names = ["doc_id", "row", "first", "last", "node", "sig"]
        for b in slices(batches, 512):
            for parts in paragraphs(byte_texts(b.column(2))):
                for of, first, last, node, *sig in parts:
                    of = pa.array(of)
                    yield pa.RecordBatch.from_arrays(
                        [b.column(0).take(of), b.column(1).take(of), pa.array(first, pa.int32()), pa.array(last, pa.int32()), pa.array(signed(node)),
                         pa.array(sig[0], pa.binary()) if sig else pa.nulls(len(of), pa.binary())],
                        names=names,
                    )

    src = docs.filter("doc_id IS NOT NULL").select("doc_id", row_key().alias("row"), text_of("text").alias("text"))
    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, row bigint, first int, last int, node bigint, sig binary")


def _bags(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """node, x, c: shingle multisets of wanted lines (node, doc_id, first, last)."""
    asked = wanted.select(F.col("doc_id").alias("_id"), F.col("node").alias("_node"), F.col("first").alias("_a"), F.col("last").alias("_b"))
    src = docs.select("doc_id", text_of("text").alias("text")).join(asked, F.col("doc_id") == F.col("_id"))

    def run(batches: Iterable):
        import pyarrow as pa

        for t in slices(batches, 512):
            rows = []
            for h, node, a, b in zip(words_of(byte_texts(t.column(0))), *[t.column(i).to_pylist() for i in (1, 2, 3)]):
                h = h[a:b]
                if signed(line_hashes(h, np.array([0]), np.array([len(h)])))[0] == node:
                    x, c = np.unique(run_hashes(h, K), return_counts=True)
                    rows.append((node, x.tobytes(), np.ones(len(c), np.uint32).tobytes()))
            yield pa.RecordBatch.from_pydict(
                {"node": pa.array([r[0] for r in rows], pa.int64()), "x": pa.array([r[1] for r in rows], pa.binary()), "c": pa.array([r[2] for r in rows], pa.binary())}
            )

    return src.select("text", "_node", "_a", "_b").mapInArrow(run, "node bigint, x binary, c binary").dropDuplicates(["node"])


def line_links(docs: DataFrame, rows: DataFrame, similarity: float = 0.8) -> tuple[DataFrame, list[DataFrame]]:
    """a, b: nodes of different lines whose shingle sets have at least this Jaccard similarity; and the tables
    they are read from, to be dropped after them."""
    lines = rows.filter("sig IS NOT NULL")
    nodes = lines.groupBy("node").agg(F.min(F.struct("doc_id", "first", "last")).alias("at"), F.first("sig").alias("sig"))
    nodes = materialise(nodes.select("node", "at.*", "sig"), "line-nodes")
    members, star = stars(bands(nodes, width=4, m=2 * COMPONENTS))

    used = [nodes, members]

    def fetch(asked: DataFrame) -> DataFrame:
        used.append(materialise(_bags(docs, nodes.drop("sig").join(asked.distinct(), "node")), "line-bags"))
        return used[-1]

    star = materialise(screen(star, nodes, SLACK), "line-candidates")
    ends = star.select(F.explode(F.array("a", "b")).alias("node"))
    links = materialise(verify(star, fetch(ends), similarity).select("a", "b"), "line-links")
    roots = components(links)
    loose = materialise(loose_links(members, roots, nodes, SLACK), "loose-lines")
    used += [star, links, loose]
    return (links.unionByName(settle(loose, nodes, roots, fetch, similarity)) if loose.head(1) else links), used


def _contexts(docs: DataFrame, runs: DataFrame) -> DataFrame:
    """node, side, ctx, n, doc_id, row, first, lo_doc, lo_first: the ``REACH`` words before (side 0, nearest first)
    and after (side 1) each shared run, as 6 bytes of each word's hash; ``n`` of them are in the text."""
    asked = runs.groupBy("row").agg(F.collect_set(F.struct("first", "node", F.col("lo.doc_id").alias("lo_doc"), F.col("lo.first").alias("lo_first"))).alias("_r"))
    asked = asked.select(F.col("row").alias("_row"), *[F.col(f"_r.{c}").alias(f"_{c}") for c in ("first", "node", "lo_doc", "lo_first")])
    src = docs.filter("doc_id IS NOT NULL").select("doc_id", row_key().alias("row"), text_of("text").alias("text"))
    kind = src.schema["doc_id"].dataType.simpleString()
    src = src.join(asked, F.col("row") == F.col("_row")).select("doc_id", "row", "text", "_first", "_node", "_lo_doc", "_lo_first")

    def run(batches: Iterable):
        import pyarrow as pa

        at = np.arange(REACH)
        for t in slices(batches, 256):
            ctx, n, back = [], [], []
            for i, (h, first) in enumerate(zip(words_of(byte_texts(t.column(2))), t.column(3).to_pylist())):
                h = np.maximum(h >> np.uint64(16), np.uint64(1)) << np.uint64(16)
                padded = np.zeros(len(h) + 2 * REACH, ">u8")
                padded[REACH : REACH + len(h)] = h
                p = np.array(first, np.int64)
                before = padded[p[:, None] + REACH - 1 - at]
                after = padded[p[:, None] + REACH + LEAST_WORDS + at]
                for words in (before, after):
                    x = words.view(np.uint8).reshape(len(p), REACH, 8)[:, :, :6].reshape(len(p), -1)
                    ctx += [c.tobytes() for c in x]
                n += [np.minimum(p, REACH), np.minimum(len(h) - p - LEAST_WORDS, REACH)]
                back += [np.full(2 * len(p), i)]
            if not back:
                continue
            # each text's runs appear twice, one side after the other
            start = t.column(3).offsets.to_numpy() - t.column(3).offsets[0].as_py()
            twice = pa.array(np.concatenate([np.tile(np.arange(a, b), 2) for a, b in zip(start, start[1:])]))
            side = np.concatenate([np.repeat([0, 1], b - a) for a, b in zip(start, start[1:])])
            back = pa.array(np.concatenate(back))
            first, node, lo_doc, lo_first = (t.column(j).flatten().take(twice) for j in (3, 4, 5, 6))
            yield pa.RecordBatch.from_arrays(
                [node, pa.array(side, pa.int32()), pa.array(ctx, pa.binary()), pa.array(np.concatenate(n), pa.int32()),
                 t.column(0).take(back), t.column(1).take(back), first, lo_doc, lo_first],
                names=["node", "side", "ctx", "n", "doc_id", "row", "first", "lo_doc", "lo_first"],
            )

    return src.mapInArrow(run, f"node bigint, side int, ctx binary, n int, doc_id {kind}, row bigint, first int, lo_doc {kind}, lo_first int")


class _Reach:
    """How far each member of a run's class goes on like others, on one side.

    Members come in the order of their contexts (the class' first member before all), so the one that
    goes on alike for longest is the nearest that qualifies, before or after. ``wide``: like a member in
    another document. ``tight``: like a member at an earlier place, which may be cut."""

    def __init__(self, out: list):
        self.out, self.key = out, None

    @staticmethod
    def alike(x: int, y: int) -> int:
        return (48 * REACH - (x ^ y).bit_length()) // 48

    def add(self, key, v: int, n: int, doc, row: int, first: int, lo) -> None:
        place = (doc, first)
        if key != self.key:
            self.end()
            self.key, self.lo, self.stack, self.island, self.before = key, None, [], [], None
            self.lo = [key, v, n, doc, row, first, 0, 0, lo, 2]
            return
        alike, (lo_v, lo_doc) = self.alike, (self.lo[1], self.lo[3])
        with_lo = alike(v, lo_v)
        x = [key, v, n, doc, row, first, 0, with_lo if place != lo else -1, lo, 2]
        if doc != lo_doc:
            x[6] = with_lo
            self.lo[6] = max(self.lo[6], with_lo)
        if self.island and self.island[-1][3] != doc:
            self.before = self.island[-1][1]
            for y in self.island:
                y[6] = max(y[6], alike(y[1], v))
                self.done(y)
            self.island = []
        if self.before is not None:
            x[6] = max(x[6], alike(v, self.before))
        self.island.append(x)
        stack = self.stack
        while stack and (stack[-1][3], stack[-1][5]) > place:
            y = stack.pop()
            self.better(y, x)
            self.done(y)
        if stack and x[7] >= 0:
            self.better(x, stack[-1])
        if x[7] == REACH:  # whoever is like it is as much like the other, which is earlier
            self.done(x)
        else:
            stack.append(x)

    def better(self, x: list, y: list) -> None:
        k = self.alike(x[1], y[1])
        if k > x[7] >= 0 and (y[3], y[5]) < (x[3], x[5]):
            x[7], x[8] = k, (y[3], y[5])

    def done(self, x: list) -> None:
        x[9] -= 1
        if not x[9]:
            self.emit(x)

    def end(self) -> None:
        if self.key is not None:
            for x in (*self.island, *self.stack):
                self.done(x)
            self.lo[7] = -1
            self.emit(self.lo)

    def emit(self, x: list) -> None:
        (_, side), _, n, doc, row, first, wide, tight, (cls, at), _ = x
        wide = min(wide, n)
        tight = min(tight, wide)
        left, right = (1, 0) if side == 0 else (0, 1)
        a, b = first - left * wide, first + LEAST_WORDS + right * wide
        c, d = (first - left * tight, first + LEAST_WORDS + right * tight) if tight >= 0 else (-1, -1)
        self.out.append((doc, row, a, b, c, d, cls, at - left * max(tight, 0)))


def _merged(spans: list) -> list:
    """Spans (first, last, …) in order; those that overlap are one, with the rest of the first."""
    out: list = []
    for x in spans:
        if out and x[0] < out[-1][1]:
            out[-1][1] = max(out[-1][1], x[1])
        else:
            out.append(list(x))
    return out


def _joined(doc, rows: list) -> list:
    """(first, last, class id, class word, removed) of one text's (wide and tight) spans."""
    cut = _merged(sorted({(c, d, cls, at) for _, _, c, d, cls, at in rows if c >= 0}, key=lambda x: (x[0], x[2], x[3])))
    out = [(*x, True) for x in cut]
    i = 0
    for a, b in _merged(sorted({x[:2] for x in rows})):
        while i < len(cut) and cut[i][1] < b:
            i += 1
        if not (i < len(cut) and cut[i][0] <= a):
            out.append((a, b, doc, a, False))
    return out


def embedded(docs: DataFrame, runs: DataFrame) -> DataFrame:
    """doc_id, row, first, last, class_id, class_word, removed: whole common passages around shared runs.

    ``runs``: doc_id, row, first, node, lo (place of the node's first member). From a passage's edge to its
    nearest chosen run, and between two of them, there are at most ``REACH`` words; so each run is extended
    word by word that far, and what overlaps in a text is merged. A class is not compared pair by pair:
    sorted by their words, those members that go on alike for longest stand side by side.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    ctx = _contexts(docs, runs).withColumn("later", (F.col("doc_id") != F.col("lo_doc")) | (F.col("first") != F.col("lo_first")))
    ctx = ctx.repartition("node", "side").sortWithinPartitions("node", "side", "later", "ctx", "doc_id", "first", "row")

    def reach(batches: Iterable):
        import pyarrow as pa

        out: list = []
        r, last = _Reach(out), None

        def batch():
            cols = list(zip(*out)) or [()] * 8
            kinds = [ids, pa.int64(), *[pa.int32()] * 4, ids, pa.int32()]
            got = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["doc_id", "row", "a", "b", "c", "d", "class_id", "class_word"])
            out.clear()
            return got

        ids = None
        for t in slices(batches, 8192):
            ids = t.schema.field("doc_id").type
            names = ("node", "side", "ctx", "n", "doc_id", "row", "first", "lo_doc", "lo_first")
            for node, side, x, n, doc, row, first, lo_doc, lo_first in zip(*[t.column(c).to_pylist() for c in names]):
                if (node, side, doc, row, first) != last:  # rows may be repeated
                    last = (node, side, doc, row, first)
                    r.add((node, side), int.from_bytes(x, "big"), n, doc, row, first, (lo_doc, lo_first))
            yield batch()
        r.end()
        if out:
            yield batch()

    spans = ctx.mapInArrow(reach, f"doc_id {kind}, row bigint, a int, b int, c int, d int, class_id {kind}, class_word int")
    spans = spans.repartition("row").sortWithinPartitions("row")

    def join(batches: Iterable):
        import pyarrow as pa

        out, held, key, ids = [], [], None, None

        def batch():
            cols = list(zip(*out)) or [()] * 7
            kinds = [ids, pa.int64(), pa.int32(), pa.int32(), ids, pa.int32(), pa.bool_()]
            got = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["doc_id", "row", "first", "last", "class_id", "class_word", "removed"])
            out.clear()
            return got

        for t in slices(batches, 8192):
            ids = t.schema.field("doc_id").type
            for doc, row, *x in zip(*[c.to_pylist() for c in t.columns]):
                if row != key and held:
                    out += [(at, key, *y) for y in _joined(at, held)]
                    held = []
                key, at = row, doc
                held.append(tuple(x))
            yield batch()
        if held:
            out += [(at, key, *y) for y in _joined(at, held)]
            yield batch()

    return spans.mapInArrow(join, f"doc_id {kind}, row bigint, first int, last int, class_id {kind}, class_word int, removed boolean")


def _repeats(docs: DataFrame, similarity: float) -> DataFrame:
    """:func:`repeats` with the row's key."""
    rows = materialise(extract(docs), "paragraphs")
    links, used = line_links(docs, rows, similarity)
    roots = components(links)
    place = F.struct("doc_id", "first")
    seen = rows.groupBy("node").agg(F.min(place).alias("lo"), F.max("doc_id").alias("hi"), F.count(F.lit(1)).alias("n"))
    seen = seen.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    classes = seen.groupBy("root").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).filter(F.col("lo.doc_id") < F.col("hi"))
    found = materialise(seen.select("node", "root").join(classes, "root").select("node", "lo"), "repeated-nodes")
    out = materialise(rows.select("doc_id", "row", "first", "last", "node", F.col("sig").isNull().alias("run")).join(found, "node"), "repeated-paragraphs")
    drop(rows, found, *used)
    release(docs.sparkSession)
    lines = out.filter("NOT run").select(
        "doc_id",
        "row",
        "first",
        "last",
        F.col("lo.doc_id").alias("class_id"),
        F.col("lo.first").alias("class_word"),
        (~((F.col("doc_id") == F.col("lo.doc_id")) & (F.col("first") == F.col("lo.first")))).alias("removed"),
    )
    return lines.unionByName(embedded(docs, out.filter("run"))).withColumnsRenamed({"first": "first_word", "last": "end_word"})


def repeats(docs: DataFrame, similarity: float = 0.8) -> DataFrame:
    """Repeated paragraphs of ``docs`` (doc_id, text): doc_id, first_word, end_word, class_id, class_word, removed.

    Lines: one row per line of 20 words or more whose class has members in two or more documents. A class is
    a component of equal or similar lines (``similarity`` over 5-word shingles); class_id and class_word are
    the place of its first member by (doc_id, word), which stays; all others are ``removed``.

    Embedded passages: any common passage of 49 words is found, wherever lines begin and end, and reported
    from its first to its last common word; overlapping ones of a text are one row. All words of a row are
    common to other documents, and those of a ``removed`` one also stand at an earlier place by (doc_id,
    word); class_id and class_word are such a place of its beginning. A passage that goes on, in another
    document, beyond what stands earlier has a row that stays, with its own place. Words are compared by 48
    bits of their hashes.

    Equal paragraphs are collapsed by hash before banding: a line that a third of all documents
    has is one node. Defined cases: NULL, empty and shorter texts have no paragraphs; rows without an id
    are left out; rows that repeat an id do not make a repeat; an empty table gives no rows.
    """
    return _repeats(docs, similarity).drop("row").distinct()


def remove(docs: DataFrame, similarity: float = 0.8) -> DataFrame:
    """``docs`` without the removed paragraphs of :func:`repeats`; the other words keep their white space."""
    cut = _repeats(docs, similarity).filter("removed").groupBy("row").agg(F.collect_set(F.struct("first_word", "end_word")).alias("_cut"))
    cut = cut.withColumnRenamed("row", "_cut_row")
    j = docs.join(cut, F.when(F.col("doc_id").isNotNull(), row_key()) == F.col("_cut_row"), "left")
    # words stand at the odd places of (space, word, space, word, ...)
    text = text_of("text")
    words, spaces = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), ""), F.split(text, r"[^\x20\x09-\x0D]+")
    j = j.withColumn("_w", words).withColumn("_s", spaces)
    left = F.expr("filter(sequence(0, size(_w) - 1), i -> NOT exists(_cut, c -> i >= c.first_word AND i < c.end_word))")
    kept = F.concat(F.array_join(F.transform(left, lambda i: F.concat(F.col("_s")[i], F.col("_w")[i])), ""), F.element_at("_s", -1))
    return j.withColumn("text", F.when(F.col("_cut").isNull(), F.col("text")).otherwise(kept)).select(*docs.columns)
