"""Mixing sources to target weights by capped water-filling. DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from originlens.llm.common import n_words, text_of
from originlens.session import materialise

#: Rows of one source that a window task sorts when the cut is looked for.
ROWS_PER_BUCKET = 4096


def draw(seed: str, key: str = "doc_id", text: str = "text") -> Column:
    """A seeded draw of id and text as 32 hex digits; it orders the rows of a source. Only copies share it."""
    return F.md5(F.concat(F.lit(f"{seed}:"), text_of(key), F.lit(":"), F.md5(text_of(text))))


def fill(sources: DataFrame, weights: tuple[int, ...] = (5, 2, 1), epochs: int = 3) -> DataFrame:
    """Targets of the sources: ``target = least(epochs * words, level * weight)``.

    ``sources``: source, words. Sources by code point, NULL last, take ``weights`` in turn. The level is
    found in closed form: in the order of cap/weight the first sources are clamped, and the level is
    that of the first prefix after which no remaining source is above its cap. The table has one row
    per source; the windows run over it alone. Sources without words get a target of 0.
    """
    everything = Window.partitionBy()
    ranked = sources.withColumn("_r", F.row_number().over(everything.orderBy(F.col("source").asc_nulls_last())))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.col("_r") - 1, F.lit(len(weights))) + 1).cast("int"))
    caps = ranked.withColumn("_w", w).withColumn("_cap", (F.col("words") * epochs).cast("double"))
    order = everything.orderBy(F.col("_cap") / F.col("_w"), "_r")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rest_words = F.sum("words").over(everything).cast("double") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))
    rest_weight = F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(before), F.lit(0.0))
    levels = caps.withColumn("_i", F.row_number().over(order)).withColumn("_level", rest_words / rest_weight)
    fits = F.when(F.col("_level") * F.col("_w") <= F.col("_cap"), F.struct("_i", "_level"))
    level = F.min(fits).over(everything)["_level"]
    out = levels.withColumn("target", F.least(F.col("_cap"), F.coalesce(level, F.lit(0.0)) * F.col("_w")))
    return out.select("source", "words", F.col("_r").alias("source_no"), "target")


def plan(
    sized: DataFrame, weights: tuple[int, ...] = (5, 2, 1), epochs: int = 3
) -> DataFrame:
    """What each source takes: source, words, source_no, target, whole, cut, more.

    ``sized``: source, size, draw, one row per document. Every document is taken ``whole`` times; those
    whose draw is below ``cut`` once more (NULL: none is left out, empty string: none), and of the copies
    whose draw is the cut, ``more``. The cut is the draw at which the running words of the source pass what
    is missing to the target by more than half a document. Running sums are made within buckets of draws,
    whose number follows from the largest source, plus the sums of earlier buckets: a source with most of the
    rows spreads over all tasks, and copies, which share a draw, are counted before they meet.
    """
    stats = sized.groupBy("source").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("_n"))
    most = stats.agg(F.max("_n")).first()[0] or 1
    digits = max(1, math.ceil(math.log(max(1, most / ROWS_PER_BUCKET), 16)))
    q = F.when(F.col("words") > 0, F.col("target") / F.col("words")).otherwise(F.lit(0.0))
    filled = fill(stats.select("source", "words"), weights, epochs).withColumn("whole", F.floor(q))
    filled = filled.withColumn("_missing", F.col("target") - F.col("whole") * F.col("words"))
    bucketed = sized.withColumn("_b", F.substring("draw", 1, digits))
    sums = bucketed.groupBy("source", "_b").agg(F.sum("size").alias("_s"))
    earlier = Window.partitionBy("source").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_before", F.coalesce(F.sum("_s").over(earlier), F.lit(0)))
    # the one bucket per source in which the running words pass what is missing
    s = sums.alias("s").join(filled.alias("f"), F.col("s.source").eqNullSafe(F.col("f.source")))
    s = s.filter("_before + _s > _missing").groupBy(F.col("s.source").alias("source"), "_missing").agg(
        F.min(F.struct("_b", "_before")).alias("_at")
    )
    s = s.select(F.col("source").alias("_src"), F.col("_at._b").alias("_hit"), F.col("_at._before").alias("_before"), "_missing")
    inside = bucketed.join(s, F.col("source").eqNullSafe(F.col("_src")) & (F.col("_b") == F.col("_hit")))
    inside = inside.groupBy("source", "_b", "_before", "_missing", "draw", "size").agg(F.count(F.lit(1)).alias("_n"))
    within = Window.partitionBy("source", "_b").orderBy("draw").rowsBetween(Window.unboundedPreceding, -1)
    reached = F.col("_before") + F.coalesce(F.sum(F.col("size") * F.col("_n")).over(within), F.lit(0))
    inside = inside.withColumn("_reached", reached)
    over = F.col("_reached") + F.col("size") * F.col("_n") - F.col("size") / 2 > F.col("_missing")
    fit = F.greatest(F.floor((F.col("_missing") - F.col("_reached")) / F.col("size") + 0.5), F.lit(0))
    # a bucket whose last document still fits is followed by the next bucket's first draw
    first = F.when(over, F.struct("draw", F.when(F.col("size") > 0, fit).otherwise(0).cast("long").alias("more")))
    cuts = inside.groupBy("source").agg(F.min(first).alias("_first"), F.max("_b").alias("_last"))
    cuts = cuts.select(
        F.col("source").alias("_src"), F.coalesce("_first.draw", F.concat("_last", F.lit("g"))).alias("_cut"), "_first.more"
    )
    out = filled.join(cuts, F.col("source").eqNullSafe(F.col("_src")), "left")
    # nothing missing: no document is taken once more
    none = F.col("_missing") <= 0
    return out.select(
        "source", "words", "source_no", "target", "whole", F.when(none, F.lit("")).otherwise(F.col("_cut")).alias("cut"),
        F.when(none, 0).otherwise(F.coalesce("more", F.lit(0))).alias("more"),
    )


def times(rows: DataFrame, planned: DataFrame, name: str) -> DataFrame:
    """Add ``_n``, the times a row is taken, to rows of source and ``_draw``; ``_p`` is the plan's row.

    Copies at a cut are numbered within the partitions they are stored in, and these are counted: no task
    holds all of them. Which of the copies is taken more often is not defined."""
    p = planned.select(F.struct(*planned.columns).alias("_p"))
    j = rows.join(p, F.col("source").eqNullSafe(F.col("_p.source")))
    tied = (F.col("_p.more") > 0) & F.coalesce(F.col("_draw") == F.col("_p.cut"), F.lit(False))
    once_more = F.col("_p.cut").isNull() | (F.col("_draw") < F.col("_p.cut"))
    out = j.withColumn("_n", (F.col("_p.whole") + F.when(once_more, 1).otherwise(0)).cast("long"))
    if planned.filter("more > 0").isEmpty():
        return out
    at = j.filter(tied).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id())
    at = materialise(at, name)
    sums = at.groupBy(F.col("source").alias("_s"), F.col("_part").alias("_q")).agg(F.count(F.lit(1)).alias("_c"))
    earlier = Window.partitionBy("_s").orderBy("_q").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_earlier", F.coalesce(F.sum("_c").over(earlier), F.lit(0)))
    at = at.join(sums, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_part") == F.col("_q")))
    number = F.col("_earlier") + F.row_number().over(Window.partitionBy("source", "_part").orderBy("_at"))
    at = at.withColumn("_n", (F.col("_p.whole") + F.when(number <= F.col("_p.more"), 1).otherwise(0)).cast("long"))
    return out.filter(~tied).unionByName(at.select(*out.columns))


def sizes(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """doc_id, source, size, draw of each row: the narrow table the plan is made from."""
    return docs.select("doc_id", "source", n_words("text").alias("size"), draw(seed).alias("draw"))


def mixed_sizes(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), epochs: int = 3, seed: str = "mix") -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies, taken.

    Target sizes add up to all words of the corpus; no document is taken more than ``epochs`` times.
    Reruns agree, for the draw is a hash of the seed, the id and the text. Defined cases: NULL text has size 0,
    NULL source is a source of its own (the last), a NULL id draws as the empty one, of equal rows as many are
    taken once more as come nearest to the target, an empty table gives an empty result. Other columns of
    ``docs`` are not read.
    """
    sized = materialise(sizes(docs, seed), "mix-sizes")
    p = materialise(plan(sized, weights, epochs), "mix-plan")
    j = times(sized.withColumnRenamed("draw", "_draw"), p, "mix-tied")
    return j.select(
        "doc_id", "source", "size", F.col("_p.words").cast("long").alias("source_size"), F.col("_p.target").alias("target"),
        F.col("_n").alias("copies"), (F.col("size") * F.col("_n")).alias("taken"),
    )


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), epochs: int = 3, seed: str = "mix") -> DataFrame:
    """The rows of ``docs`` (doc_id, text, source and any others), each as often as the mix takes it.

    The decision is a comparison of the row's draw with its source's cut, so texts are not shuffled
    while the source table is small enough to be broadcast. Cases as in :func:`mixed_sizes`; of rows with
    equal id, text and source but different other columns, which is taken once more is not defined.
    """
    p = materialise(plan(materialise(sizes(docs, seed), "mix-sizes"), weights, epochs), "mix-plan")
    # the row travels as one struct, so that its columns may have any name
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_doc"), "source", draw(seed).alias("_draw"))
    j = times(rows, p, "mix-tied").filter("_n > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_n").cast("int"))))
    return j.select(*[F.col("_doc").getField(c).alias(c) for c in docs.columns])
