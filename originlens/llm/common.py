"""Helpers the operators of this folder share: words, hashes, held-out marks, tables."""

from __future__ import annotations

import gc
from collections.abc import Iterable

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Java pattern of the white space between words: blank, tab, line feed, vertical tab, form feed, return.
WS = r"[\x20\x09-\x0D]+"
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def text_of(c: str | Column) -> Column:
    """The text as a string, empty for NULL."""
    return F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit(""))


def crc_mod(key: str, m: int) -> Column:
    """crc32 of the key as text, modulo ``m``; a NULL key counts as the empty text."""
    return F.pmod(F.crc32(text_of(key)), F.lit(m))


def n_words(c: str | Column) -> Column:
    """Number of words, ``[^\\x20\\x09-\\x0D]+``, of a text; 0 for NULL."""
    return F.size(F.array_remove(F.split(text_of(c), WS), "")).cast("long")


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: equal inputs give equal outputs, all bits depend on all bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a fixed number of words per task."""

    LIMIT = 200_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` words; one of all the words if there are fewer, none without words."""
    if not len(h):
        return h
    k = min(k, len(h))
    n = len(h) - k + 1
    out = np.full(n, k, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            out = mix64(out * GOLDEN + h[i : i + n])
    return out


def byte_texts(column) -> list[bytes]:
    """The texts of an Arrow column as UTF-8 bytes, empty for NULL."""
    import pyarrow as pa

    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def slices(batches: Iterable, rows: int = 2048) -> Iterable:
    """Arrow batches cut to at most so many rows, which bounds what a task holds at a time."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def drop(*tables: DataFrame) -> None:
    """Remove stored intermediate tables that nothing reads any more, through Spark's file system."""
    for t in tables:
        sc = t.sparkSession.sparkContext
        for folder in {f.rsplit("/", 1)[0] for f in t.inputFiles()}:
            path = sc._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of finished jobs: it does so when the driver collects garbage,
    which a small driver with much memory may not do before the disks are full."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def signed(x: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit values as the signed ones Spark stores."""
    return x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64)
