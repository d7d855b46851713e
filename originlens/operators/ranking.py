"""Exact ranks and running totals without a single-task sort.

A global ``row_number`` puts every row of a group into one task. Here rows are first cut into
ordered buckets; each bucket is ranked on its own and shifted by the sizes of the buckets
before it. Only one row per (group, bucket) takes part in the second window.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from originlens.functions.hashing import md5_hex
from originlens.session import materialise

SAMPLE_ROWS = 8192
HASH_DIGITS = 4


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join in which NULL keys match each other; right-hand keys are dropped."""
    l, r = left.alias("l"), right.alias("r")
    on = reduce(lambda a, b: a & b, [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys])
    kept = [F.col(f"r.{c}") for c in right.columns if c not in keys]
    return l.join(r, on, how).select("l.*", *kept)


def _starts(df: DataFrame, groups: list[str], total: str | None) -> DataFrame:
    """Rows before each ``_bucket`` of a group, and all its rows as ``total``."""
    sizes = df.groupBy(*groups, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*[F.col(g) for g in groups])
    starts = sizes.select(
        *groups,
        "_bucket",
        (F.sum("_n").over(w.orderBy("_bucket")) - F.col("_n")).alias("_start"),
        F.sum("_n").over(w).alias("_total"),
    )
    return starts.withColumnRenamed("_total", total) if total else starts.drop("_total")


def hash_rank(
    df: DataFrame,
    seed,
    keys: list[str],
    groups: list[str] | None = None,
    out: str = "rn",
    total: str | None = None,
    facts: tuple[DataFrame, list[str]] | None = None,
    digits: int = HASH_DIGITS,
) -> DataFrame:
    """1-based rank of each row in md5 order of its keys, per group: a seeded shuffle.

    Buckets are the first ``digits`` md5 digits, so they are even whatever the data look like and a
    group holding most rows still spreads over 16 ** digits windows: with four digits, 1e11 rows of one
    group make windows of 1.5 million. ``keys`` must identify a row.
    ``facts`` is a table with one row per value of some group columns, and those columns: its
    other columns are added, and rows of groups it lacks are dropped. It meets the bucket
    sizes, not the rows, so a large group does not gather in one task for it either.
    """
    groups = groups or []
    d = df.withColumn("_hash", md5_hex(seed, *keys)).withColumn("_bucket", F.substring("_hash", 1, digits))
    starts = _starts(d.select(*groups, "_bucket"), groups, total)
    if facts is not None:
        starts = null_safe_join(starts, *facts)
    w = Window.partitionBy(*groups, "_bucket").orderBy("_hash", *keys)
    local = d.withColumn(out, F.row_number().over(w).cast("bigint"))
    return (
        null_safe_join(local, starts, [*groups, "_bucket"])
        .withColumn(out, F.col(out) + F.col("_start"))
        .drop("_hash", "_bucket", "_start")
    )


def range_cuts(df: DataFrame, value: str, buckets: int) -> list[float]:
    """Cut points that divide the rows evenly by ``value``.

    Quantiles of the rows with the smallest value hashes, a sample that is the same in every
    evaluation. It only balances the tasks: any cut points give right results.
    """
    probe = (
        df.select(F.col(value).cast("double").alias("_v"))
        .withColumn("_h", F.xxhash64("_v"))
        .orderBy("_h", "_v")
        .limit(SAMPLE_ROWS)
    )
    points = ", ".join(f"{i / buckets!r}D" for i in range(1, buckets))
    row = probe.agg(F.expr(f"percentile(_v, array({points}))")).first()
    return sorted(set(row[0] or []))


def range_bucket(df: DataFrame, value: str, cuts: list[float], out: str = "_bucket") -> DataFrame:
    """Add an INT bucket that grows with ``value``: the number of cuts below it, found in
    two steps so that a row is compared with about twice the root of the number of cuts."""
    if not cuts:
        return df.withColumn(out, F.lit(0))
    step = max(1, int(len(cuts) ** 0.5))
    v = F.col(value).cast("double")

    def literal(xs: list[float]) -> str:
        return "array(" + ", ".join(f"{x!r}D" for x in xs) + ")"

    blocks = [cuts[i : i + step] for i in range(0, len(cuts), step)]
    fences = F.expr(literal([b[-1] for b in blocks]))
    passed = F.size(F.filter(fences, lambda c: c < v))
    inside = F.try_element_at(F.expr("array(" + ", ".join(map(literal, blocks)) + ")"), F.col("_block") + 1)
    return (
        df.withColumn("_block", passed)
        .withColumn(out, F.col("_block") * step + F.coalesce(F.size(F.filter(inside, lambda c: c < v)), F.lit(0)))
        .drop("_block")
    )


def running_totals(
    df: DataFrame,
    groups: list[str],
    order: str,
    values: list[str],
    descending: bool = False,
    buckets: int = 256,
) -> DataFrame:
    """Add ``cum_<v>`` (running total including the row) and ``all_<v>`` (group total).

    ``(groups, order)`` must be unique: aggregate ties first. The table is written to the
    shared folder, as several passes read it. Rows are cut into ordered buckets that are summed
    on their own and shifted by the totals of the buckets before them, whatever their number.
    """
    d = materialise(df, "totals")
    by_order = F.col(order).desc() if descending else F.col(order).asc()
    group_w = Window.partitionBy(*[F.col(g) for g in groups])
    upto = Window.unboundedPreceding, Window.currentRow
    d = range_bucket(d, order, range_cuts(d, order, buckets))
    by_bucket = F.col("_bucket").desc() if descending else F.col("_bucket").asc()
    sums = d.groupBy(*groups, "_bucket").agg(*[F.sum(v).alias(f"_s_{v}") for v in values])
    offsets = sums.select(
        *groups,
        "_bucket",
        *[(F.sum(f"_s_{v}").over(group_w.orderBy(by_bucket)) - F.col(f"_s_{v}")).alias(f"_o_{v}") for v in values],
        *[F.sum(f"_s_{v}").over(group_w).alias(f"all_{v}") for v in values],
    )
    local_w = Window.partitionBy(*groups, "_bucket").orderBy(by_order).rowsBetween(*upto)
    local = d.select("*", *[F.sum(v).over(local_w).alias(f"cum_{v}") for v in values])
    joined = null_safe_join(local, offsets, [*groups, "_bucket"])
    for v in values:
        joined = joined.withColumn(f"cum_{v}", F.col(f"cum_{v}") + F.col(f"_o_{v}"))
    return joined.drop("_bucket", *[f"_o_{v}" for v in values])


def top_n(df: DataFrame, order: list[Column], n: int, groups: list[str] | None = None) -> DataFrame:
    """The first ``n`` rows of each group. Spark cuts each task's rows to ``n`` per group
    before the shuffle, so a large group never travels whole."""
    w = Window.partitionBy(*(groups or [])).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")
