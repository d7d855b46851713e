"""SimHash fingerprints, and all pairs of them within a Hamming radius by permuted block tables."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from originlens.llm.common import WordHashes, byte_texts, mix64, shingles, slices, text_of
from originlens.session import materialise

BITS = 64


def _votes(h: np.ndarray) -> np.ndarray:
    """Votes of the hashes for each bit: set minus unset, in blocks of bounded size."""
    total = np.zeros(BITS, np.int64)
    for i in range(0, len(h), 65_536):
        part = h[i : i + 65_536].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones = np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        total += 2 * ones - len(part)
    return total


def fingerprint(h: np.ndarray, pair_weight: int = 2) -> int:
    """64 bits on which the terms of a text vote.

    ``h``: hashes of its words in order. Terms are the words, with weight 1, and the pairs of
    neighbouring words, with ``pair_weight``; each occurrence votes, so a term's weight grows with its
    count. Ties leave the bit unset; a text without words has fingerprint 0.
    """
    if not len(h):
        return 0
    v = _votes(mix64(h))
    if len(h) > 1:
        v = v + pair_weight * _votes(shingles(h, 2))
    return int(np.packbits(v > 0, bitorder="little").view("<u8")[0])


def _hex(fp: int) -> str:
    return f"{fp:016x}"


def likeness(a: int, b: int) -> float:
    """1 minus the share of differing bits."""
    return 1.0 - (a ^ b).bit_count() / BITS


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, fp (the 64 bits as a signed long) of every whole text; NULL and empty texts have fingerprint 0.

    Equal texts have equal fingerprints; repeated rows stay; an empty table gives no rows."""

    def run(batches: Iterable):
        import pyarrow as pa

        words = WordHashes()
        for b in slices(batches):
            fps = np.array([fingerprint(words.of(t.lower().split())) for t in byte_texts(b.column(1))], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], names=["id", "fp"])

    src = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("t"))
    return src.mapInArrow(run, f"id {src.schema['id'].dataType.simpleString()}, fp bigint")


def block_tables(radius: int, extra: int = 2) -> list[int]:
    """Bit masks of the permuted tables: the bits are cut into ``radius + extra`` blocks, and each table
    keys on ``extra`` of them. Two fingerprints that differ in at most ``radius`` bits agree on one table's key."""
    n = radius + extra
    edges = [BITS * i // n for i in range(n + 1)]
    blocks = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    return [sum(c) for c in combinations(blocks, extra)]


def near(queries: DataFrame, rows: DataFrame, radius: int = 3) -> DataFrame:
    """All (query_fp, fp, distance) with distance at most ``radius`` between distinct fingerprints.

    Both sides: fp. Copies are collapsed first, so a fingerprint that a third of all rows share is one row.
    Each table is a hash join on the masked bits; with two blocks per key about 25 bits must agree, so
    keys are rare and Spark splits a frequent one. The distance is checked for every candidate.
    """
    masks = block_tables(radius)
    keys = F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m)).alias("k")) for i, m in enumerate(masks)])

    def keyed(df: DataFrame, name: str) -> DataFrame:
        d = df.select("fp").distinct().withColumn("_k", F.explode(keys))
        return d.select(F.col("_k.t").alias("t"), F.col("_k.k").alias("k"), F.col("fp").alias(name))

    d = F.bit_count(F.col("query_fp").bitwiseXOR(F.col("fp")))
    pairs = keyed(queries, "query_fp").join(keyed(rows, "fp"), ["t", "k"]).withColumn("distance", d.cast("int"))
    return pairs.filter(F.col("distance") <= radius).select("query_fp", "fp", "distance").distinct()


def edited_texts(own: str, following: str) -> str:
    """The last half of the text replaced by as many code points of the start of the next one, or all of it."""
    half = len(own) // 2
    return own[: len(own) - half] + following[:half]


def with_next(docs: DataFrame, partitions: int | None = None) -> DataFrame:
    """doc_id, text, part, copy: rows dealt into ranges of ids, each range followed by the first row of the next.

    Ranges are cut at approximate quantiles of the ids, as many as ``partitions``; only the cut points, one
    id per range, pass the driver. Each text is shuffled once, the first text of a range twice. The last
    range is followed by the first row of all. NULL ids come first, like the smallest id.
    """
    spark = docs.sparkSession
    n = partitions or max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    low = F.lit(-(1 << 63)).cast("long")
    key = F.coalesce(F.col("doc_id").cast("long"), low)
    d = docs.select("doc_id", text_of("text").alias("text"), key.alias("_key"))
    cuts = docs.select(key.alias("_key")).agg(F.percentile_approx("_key", [i / n for i in range(1, n)], 10 * n)).first()[0] or []
    cuts = sorted(set(cuts))
    part = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: F.col("_key") > c)) if cuts else F.lit(0)
    first = docs.select(key.alias("_key")).withColumn("_part", part).groupBy("_part").agg(F.min("_key").alias("_key")).collect()
    firsts = sorted((r["_part"], r["_key"]) for r in first)
    d = d.withColumn("_part", part)
    # range -> the first id of the range after it, in a circle
    follow = {firsts[(i + 1) % len(firsts)][1]: p for i, (p, _) in enumerate(firsts)}
    copies = F.array(F.struct(F.col("_part").alias("part"), F.lit(0).alias("copy")))
    if follow:
        also = F.create_map(*[F.lit(x) for k, p in follow.items() for x in (k, p)])[F.col("_key")]
        more = F.array(F.struct(F.col("_part").alias("part"), F.lit(0).alias("copy")), F.struct(also.alias("part"), F.lit(1).alias("copy")))
        copies = F.when(F.col("_key").isin(list(follow)), more).otherwise(copies)
    d = d.withColumn("_c", F.explode(copies))
    d = d.select(F.col("_c.part").alias("part"), F.col("_c.copy").alias("copy"), "_key", "doc_id", "text")
    return d.repartition(max(1, len(firsts)), "part").sortWithinPartitions("part", "copy", "_key", "text")


def compare_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text, of its edited text and of the next document's text.

    ``docs``: doc_id, text. Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint (hex),
    near_edited, near_next. Documents follow each other by ascending doc_id (ties by text), the first
    follows the last; a single document follows itself. A task streams its ranges and holds two texts.
    NULL text is empty; repeated rows follow each other; an empty table gives no rows.
    """

    id_type = docs.schema["doc_id"].dataType

    def run(batches: Iterable):
        import pyarrow as pa

        words = WordHashes()

        def fp(text: str) -> int:
            return fingerprint(words.of(text.encode("utf-8", "surrogatepass").lower().split()))

        def finish(doc_id, own: str, own_fp: int, after: str, after_fp: int):
            edited = edited_texts(own, after)
            e = own_fp if edited == own else fp(edited)
            sha = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
            return doc_id, len(own), sha, _hex(own_fp), _hex(e), likeness(own_fp, e), likeness(own_fp, after_fp), signed_(own_fp)

        def rows() -> Iterator[tuple]:
            # A range ends with its copy row, the start of the range after it.
            last = None
            for b in batches:
                for part, copy, doc_id, text in zip(*[b.column(i).to_pylist() for i in range(4)]):
                    mine = fp(text)
                    if last is not None:
                        yield finish(*last, text, mine)
                    last = None if copy else (doc_id, text, mine)

        def signed_(x: int) -> int:
            return x - (1 << 64) if x >> 63 else x

        kinds = [_arrow_type(id_type), pa.int64(), *[pa.string()] * 3, pa.float64(), pa.float64(), pa.int64()]
        buffer: list[tuple] = []
        for r in rows():
            buffer.append(r)
            if len(buffer) == 2000:
                yield _batch(buffer, kinds)
                buffer = []
        if buffer:
            yield _batch(buffer, kinds)

    src = with_next(docs).select("part", "copy", "doc_id", "text")
    return src.mapInArrow(
        run,
        f"doc_id {id_type.simpleString()}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string,"
        " near_edited double, near_next double, fp bigint",
    )


def _arrow_type(kind):
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def _batch(rows: list[tuple], kinds: list):
    import pyarrow as pa

    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "fp"]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)


def search(docs: DataFrame, radius: int = 3, every: int = 100) -> DataFrame:
    """:func:`compare_edits` with ``n_near``: for ids divisible by ``every``, the number of rows whose
    fingerprint is within ``radius`` bits, itself included; NULL for other rows."""
    d = materialise(compare_edits(docs), "simhash")
    q = d.filter(F.pmod("doc_id", F.lit(every)) == 0)
    counts = d.groupBy("fp").agg(F.count(F.lit(1)).alias("_n"))
    found = near(q, d, radius).join(counts, "fp").groupBy("query_fp").agg(F.sum("_n").alias("n_near"))
    found = found.withColumn("_asked", F.lit(0))
    asked = F.when(F.pmod("doc_id", F.lit(every)) == 0, F.lit(0))
    d = d.withColumn("_asked", asked)
    j = d.join(found.withColumnRenamed("query_fp", "fp"), ["fp", "_asked"], "left")
    return j.drop("fp", "_asked")
