"""Language identification by rank-order profiles of character n-grams."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from originlens.llm.common import crc_mod, slices, text_of

BITS = 21  # of a code point
MAX_RANK = 300
UNKNOWN = "und"

_LETTER = np.zeros(0x110000, np.bool_)


def _letters() -> np.ndarray:
    """Which code points are letters; filled once per worker."""
    if not _LETTER[97]:
        _LETTER[:] = [chr(i).isalpha() for i in range(0x110000)]
    return _LETTER


def ngrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The text's distinct n-grams of 1 to 3 characters and their counts.

    Lower-case letters only; any run of other characters is one word border, and texts begin and end
    with one. An n-gram may begin or end with a border, never lie across one, and has a letter. Code
    points fill 21 bits each of a 64-bit value, so values sort as the strings do.
    """
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    c = np.where(_letters()[c], c, 0)
    c = np.concatenate([[0], c, [0]]).astype(np.uint32)
    keep = np.ones(len(c), np.bool_)
    keep[1:] = (c[1:] != 0) | (c[:-1] != 0)
    c = c[keep]
    present = np.unique(c)
    small = len(present) <= 1024
    # few distinct characters: their numbers fit 10 bits, and 32-bit values sort much faster
    x, bits = (np.searchsorted(present, c).astype(np.uint32), 10) if small else (c.astype(np.uint64), BITS)
    kind, b = x.dtype.type, x.dtype.type(bits)
    one = x[c != 0]
    two = (x[:-1] << b) | x[1:]
    two = two[(c[:-1] != 0) | (c[1:] != 0)]
    three = (((x[:-2] << b) | x[1:-1]) << b) | x[2:]
    three = three[c[1:-1] != 0]
    values, counts = [], []
    mask = kind((1 << bits) - 1)
    for n, g in ((1, one), (2, two), (3, three)):
        g = np.sort(g)
        first = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])) if len(g) else np.zeros(0, np.int64)
        u, k = g[first], np.diff(np.append(first, len(g)))
        parts = [(u >> kind(bits * (n - 1 - i))) & mask for i in range(n)]
        if small:
            parts = [present[p] for p in parts]
        parts = [p.astype(np.uint64) + np.uint64(1) for p in parts]  # a border is 1, no character 0
        full = np.zeros(len(u), np.uint64)
        for i, p in enumerate(parts):
            full |= p << np.uint64(BITS * (2 - i))
        values.append(full)
        counts.append(k)
    return np.concatenate(values), np.concatenate(counts)


def top(values: np.ndarray, counts: np.ndarray, n: int = MAX_RANK) -> np.ndarray:
    """The ``n`` most frequent values, ties in the order of the strings."""
    if len(values) > n:
        least = np.partition(counts, len(counts) - n)[len(counts) - n]
        keep = counts >= least
        values, counts = values[keep], counts[keep]
    return values[np.lexsort((values, -counts))][:n]


class Profiles:
    """Ranks of the frequent n-grams of each language; small enough to travel with a task."""

    def __init__(self, ranks: dict[str, np.ndarray]):
        self.langs = sorted(ranks)
        self.values = np.unique(np.concatenate([ranks[x] for x in self.langs])) if ranks else np.zeros(0, np.uint64)
        self.ranks = np.full((len(self.langs), len(self.values) + 1), -1, np.int64)
        for i, x in enumerate(self.langs):
            self.ranks[i, np.searchsorted(self.values, ranks[x])] = np.arange(len(ranks[x]))

    def distances(self, ranked: np.ndarray) -> np.ndarray:
        """Out-of-place distance to each language; an absent n-gram costs the longest profile's length."""
        at = np.searchsorted(self.values, ranked)
        at = np.where((at < len(self.values)) & (self.values[np.minimum(at, len(self.values) - 1)] == ranked), at, -1)
        there = self.ranks[:, at]
        return np.where(there < 0, MAX_RANK, np.minimum(abs(there - np.arange(len(ranked))), MAX_RANK)).sum(axis=1)

    def predict(self, text: str | None) -> tuple[str, float]:
        """The nearest language (ties: the first in code-point order) and 1 - distance / largest distance."""
        if not text or not self.langs:
            return UNKNOWN, 0.0
        values, counts = ngrams(text)
        if not len(values):
            return UNKNOWN, 0.0
        ranked = top(values, counts)
        d = self.distances(ranked)
        best = int(np.argmin(d))
        return self.langs[best], 1.0 - float(d[best]) / (MAX_RANK * len(ranked))


def fit(docs: DataFrame, sample_per_lang: int = 2000, seed: str = "langid") -> Profiles:
    """Profiles of the values of ``lang`` in ``docs`` (doc_id, text, lang); rows without lang or text are left out.

    Learns from a bounded sample: about ``sample_per_lang`` documents of each language (all of a smaller
    one), drawn by a hash of the id. n-gram counts are summed in Spark, per task first; the driver gets
    the ``MAX_RANK`` most frequent of each language.
    """
    from pyspark.sql import Window

    known = docs.filter("lang IS NOT NULL AND text IS NOT NULL").select(
        F.col("lang").cast("string").alias("lang"), F.col("doc_id"), text_of("text").alias("text")
    )
    sizes = {r[0]: r[1] for r in known.groupBy("lang").count().collect()}
    if not sizes:
        return Profiles({})
    draw = F.pmod(F.xxhash64(F.lit(seed), text_of("doc_id")), F.lit(1_000_000))
    share = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1_000_000, -(-1_000_000 * sample_per_lang // n)))])
    sample = known.filter(draw < share[F.col("lang")]).select("lang", "text")

    def count(batches: Iterable):
        import pyarrow as pa

        total: dict[str, dict[int, int]] = {}
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                mine = total.setdefault(lang, {})
                values, counts = ngrams(text)
                for v, n in zip(values.tolist(), counts.tolist()):
                    mine[v] = mine.get(v, 0) + n
        for lang, mine in total.items():
            yield pa.RecordBatch.from_pydict(
                {"lang": pa.array([lang] * len(mine), pa.string()), "g": pa.array(list(mine), pa.int64()), "n": pa.array(list(mine.values()), pa.int64())}
            )

    counted = sample.mapInArrow(count, "lang string, g bigint, n bigint").groupBy("lang", "g").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "g")
    rows = counted.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= MAX_RANK).collect()
    ranks: dict[str, list] = {}
    for r in sorted(rows, key=lambda r: (r["lang"], r["r"])):
        ranks.setdefault(r["lang"], []).append(r["g"])
    return Profiles({k: np.array(v, np.uint64) for k, v in ranks.items()})


def predict(docs: DataFrame, profiles: Profiles, keep: list[str] | None = None) -> DataFrame:
    """lang_pred and score of every whole text, beside the columns ``keep`` (default: doc_id).

    NULL text, a text without a letter, or no learned language: ``und`` with score 0. Repeated rows are
    predicted alike; an empty table gives no rows; no column but the text is an input.
    """
    keep = keep or ["doc_id"]
    src = docs.select(*keep, F.col("text").cast("string").alias("_lang_text"))

    def run(batches: Iterable):
        import pyarrow as pa

        for b in slices(batches):
            got = [profiles.predict(t) for t in b.column(b.num_columns - 1).to_pylist()]
            cols = [b.column(i) for i in range(b.num_columns - 1)]
            cols += [pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())]
            yield pa.RecordBatch.from_arrays(cols, names=[*b.schema.names[:-1], "lang_pred", "score"])

    from pyspark.sql import types as T

    schema = T.StructType([*[src.schema[c] for c in keep], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return src.mapInArrow(run, schema)


def identify(docs: DataFrame, modulus: int = 4, held: int = 2, sample_per_lang: int = 2000) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row, learned from the rows that are not held out."""
    mark = docs.select("doc_id", "text", "lang", (crc_mod("doc_id", modulus) == held).alias("held_out"))
    profiles = fit(mark.filter(~F.col("held_out")), sample_per_lang)
    return predict(mark, profiles, ["doc_id", "held_out"])


def reject_unknown(docs: DataFrame, profiles: Profiles, allowed: list[str] | None = None, min_score: float = 0.0) -> DataFrame:
    """The rows of ``docs`` whose text has a language (of ``allowed``, if given) and at least ``min_score``."""
    rest = [c for c in docs.columns if c != "text"]
    p = predict(docs.withColumn("_whole", F.struct(*[docs[c] for c in docs.columns])), profiles, ["_whole"])
    p = p.filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= min_score))
    if allowed is not None:
        p = p.filter(F.col("lang_pred").isin(allowed))
    return p.select("_whole.*").select(*docs.columns) if rest else p.select("_whole.*")
