"""Parallel reading of CSV files whose quoted texts span lines.

Spark cuts a file into ranges and reads their lines. Whether a line begins inside a quoted text depends on all quotes
before it, so the first pass reduces each range to the parity of its quotes; a running combination of the
parities gives the state each range begins in. The second pass cuts the lines of each range into records from that
state. Records inside a range never move; the two pieces that a border cuts a record into meet by the range in
which it began.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUOTE = '"'


class Range(NamedTuple):
    """A range of a file: whether it begins inside quotes, the range in which its first record began, its lines."""

    inside: bool
    owner: int
    lines: int


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """file, start (of the range), line: in the order of the file within a range, without the line feeds."""
    at = F.col("_metadata")
    return spark.read.option("lineSep", "\n").text(path).select(at["file_path"].alias("file"), at["file_block_start"].alias("start"), F.col("value").alias("line"))


def _runs(batches: Iterable) -> Iterator[tuple[tuple[str, int], object]]:
    """((file, start), the lines as an Arrow array) for each run of lines of one range; a range may come in several."""
    for b in batches:
        start = b.column(1).to_numpy()
        files = b.column(0).dictionary_encode()
        code = files.indices.to_numpy()
        edges = np.flatnonzero((np.diff(start) != 0) | (np.diff(code) != 0)) + 1
        for a, e in zip([0, *edges], [*edges, len(start)]):
            if e > a:
                yield (files.dictionary[int(code[a])].as_py(), int(start[a])), b.column(2).slice(a, e - a)


def _odd(lines) -> np.ndarray:
    """Whether each line has an odd number of quotes."""
    import pyarrow.compute as pc

    return pc.count_substring(lines, QUOTE).to_numpy(zero_copy_only=False) & 1


def _parities(lines: DataFrame) -> DataFrame:
    """file, start, lines, odd, begins: the quote parity of each range, and whether a record begins in it if the
    range itself begins inside quotes."""

    def run(batches: Iterable):
        import pyarrow as pa

        seen: dict[tuple[str, int], list] = {}
        for at, part in _runs(batches):
            n, parity, begins = seen.get(at, (0, 0, False))
            after = (np.cumsum(_odd(part)) + parity) & 1
            # a line behind an odd number of quotes begins a record then
            before = np.concatenate([[parity], after[:-1]])
            seen[at] = [n + len(after), int(after[-1]), begins or bool(before.any())]
        rows = [(f, s, *v) for (f, s), v in seen.items()]
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_())
        cols = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
        yield pa.RecordBatch.from_arrays(cols, names=["file", "start", "lines", "odd", "begins"])

    return lines.mapInArrow(run, "file string, start bigint, lines bigint, odd bigint, begins boolean")


def ranges(lines: DataFrame) -> dict[tuple[str, int], Range]:
    """The state of each range, from the ranges before it in its file.

    One row per range reaches the driver, as many as Spark's own list of file splits has. A file whose quotes
    don't pair up is an error."""
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    p = _parities(lines).withColumn("inside", F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2 == 1)
    # a record is under way at the start of a range only if that is inside quotes; it began in the last range with a beginning
    own = F.when(~F.col("inside") | F.col("begins"), F.col("start"))
    rows = p.withColumn("owner", F.last(own, ignorenulls=True).over(before)).collect()
    odd: dict[str, int] = {}
    for r in rows:
        odd[r.file] = odd.get(r.file, 0) ^ r.odd
    bad = sorted(f for f, v in odd.items() if v)
    if bad:
        raise ValueError(f"quotes don't pair up in {', '.join(bad[:3])}")
    return {(r.file, r.start): Range(r.inside, r.owner if r.inside else r.start, r.lines) for r in rows}


def records(spark: SparkSession, path: str) -> DataFrame:
    """record, first: the text of each record, and whether it is the first of its file. Empty lines are no records.

    Quotes are those of RFC 4180: around whole values, doubled inside them. Lines end with a line feed or with a carriage
    return and a line feed; inside quotes both stay as they are. Ranges are those of Spark's scan; should they
    differ between the passes (a small file after a change of the number of cores), the second fails.
    """
    lines = _lines(spark, path)
    known = ranges(lines)

    def run(batches: Iterable):
        import pyarrow as pa

        out: list[tuple] = []
        now, rest, count, head, met = None, [], 0, False, False

        def add(record: str, whole: bool, at: tuple[str, int], owner: int):
            """A record of this range, or a piece of one that a border cuts."""
            nonlocal met
            if whole:
                record = record.removesuffix("\r")
                if not record:
                    return
            first = at[1] == 0 and owner == 0 and not met
            met = True
            out.append((at[0], owner, at[1], record, whole, first))

        def close():
            """The range ends: what is open goes on in the next one."""
            if now is None:
                return
            if count != known[now].lines:
                raise RuntimeError(f"the ranges of {now[0]} changed between two scans; set spark.sql.files.minPartitionNum")
            if rest:
                add("\n".join(rest), False, now, known[now].owner if head else now[1])

        def flush():
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.bool_())
            cols = [pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)]
            out.clear()
            return pa.RecordBatch.from_arrays(cols, names=["file", "owner", "start", "record", "whole", "first"])

        for at, part in _runs(batches):
            if at != now:
                close()
                if at not in known:
                    raise RuntimeError(f"the ranges of {at[0]} changed between two scans; set spark.sql.files.minPartitionNum")
                now, rest, count, met = at, [], 0, False
                # head: the open record began in an earlier range
                head = inside = known[at].inside
            texts = part.to_pylist()
            count += len(texts)
            after = (np.cumsum(_odd(part)) + int(inside)) & 1
            inside = bool(after[-1])
            begin = 0
            for end in (np.flatnonzero(after == 0) + 1).tolist():
                piece = texts[begin] if end == begin + 1 else "\n".join(texts[begin:end])
                if rest:
                    piece, rest = "\n".join([*rest, piece]), []
                    add(piece, not head, at, known[at].owner if head else at[1])
                elif head:
                    add(piece, False, at, known[at].owner)
                else:
                    add(piece, True, at, at[1])
                head, begin = False, end
            rest += texts[begin:]
            if len(out) >= 4096:
                yield flush()
        close()
        yield flush()

    cut = lines.mapInArrow(run, "file string, owner bigint, start bigint, record string, whole boolean, first boolean")
    pieces = cut.filter(~F.col("whole")).groupBy("file", "owner").agg(
        F.array_sort(F.collect_list(F.struct("start", "record"))).alias("p"), F.max("first").alias("first")
    )
    joined = pieces.select(F.regexp_replace(F.array_join("p.record", "\n"), r"\r\z", "").alias("record"), "first")
    return cut.filter("whole").select("record", "first").unionByName(joined.filter("record <> ''"))


def read_split_csv(spark: SparkSession, path: str, schema: T.StructType, sep: str = ",") -> DataFrame:
    """The rows of CSV files with a header each; ``schema`` has the columns in the order of the files."""
    options = {"sep": sep, "quote": QUOTE, "escape": QUOTE, "multiLine": "true"}
    parsed = F.from_csv("record", _ddl(schema), options)
    return records(spark, path).filter(~F.col("first")).select(parsed.alias("_r")).select("_r.*")


def _ddl(schema: T.StructType) -> str:
    return ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in schema)
