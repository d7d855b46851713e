"""Benchmark decontamination by canonical templates. DataFrame functions only.

Numbers, names and units of a text become typed placeholders, so that a question asked again with other
values has the same template; windows of template words are matched by hash, and the values behind the
placeholders must then change consistently.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from originlens.llm.common import WS, text_of
from originlens.session import materialise

WINDOW = 8  #: template words of a window
LITERALS = 4  #: of them at least so many are words, not placeholders
PASSAGE = 13  #: words that a matched passage has at least, or half of the item if that is less

NUMBER = r"^[^\p{L}\p{N}]*[0-9]+([.,:/-][0-9]+)*\p{L}{0,3}[^\p{L}\p{N}]*$"
NAME = r"^\p{Lu}\p{Ll}+[,;]?$"
#: Units of measure that may follow a number.
UNITS = (
    "mm cm m km in ft yd mi inch inches foot feet yard yards mile miles meter meters metre metres "
    "mg g kg lb lbs oz gram grams kilogram kilograms pound pounds ounce ounces ton tons "
    "ml l liter liters litre litres cup cups gallon gallons "
    "s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years "
    "percent % dollar dollars cent cents euro euros usd eur mph kph"
).split()
EDGE = ".,;:!?"


def slots(text: str | Column) -> Column:
    """The words of a text as structs w (the word), p (lowercase, without closing punctuation), n (a number).

    In the template a number is ``#num``; a unit behind a number ``#unit``; a capitalised word that does not begin a
    sentence ``#name``. Other words are lowercased without closing punctuation. NULL: no words."""
    words = F.array_remove(F.split(text_of(text), WS), "")

    def plain(x: Column) -> Column:
        return F.rtrim(F.lower(x), F.lit(EDGE))

    return F.transform(words, lambda x: F.struct(x.alias("w"), plain(x).alias("p"), x.rlike(NUMBER).alias("n")))


def template(typed: str) -> tuple[Column, Column]:
    """Template words and plain words, as two arrays, of a column made by :func:`slots`."""
    units = ", ".join(f"'{u}'" for u in UNITS)
    kind = (
        f"CASE WHEN x.n THEN '#num' WHEN i > 0 AND x.p IN ({units}) AND {typed}[i - 1].n THEN '#unit'"
        f" WHEN i > 0 AND x.w RLIKE r'{NAME}' AND NOT {typed}[i - 1].w RLIKE '[.!?:]$' THEN '#name'"
    )
    t = F.expr(f"transform({typed}, (x, i) -> {kind} ELSE x.p END)")
    return t, F.expr(f"transform({typed}, x -> x.p)")


def _prepared(df: DataFrame, id_col: str) -> DataFrame:
    """id, t, v, _h of each row: template words, values, hashes of the template words."""
    d = df.select(F.col(id_col), slots("text").alias("_s"))
    t, v = template("_s")
    d = d.select(id_col, t.alias("t"), v.alias("v"))
    return d.withColumn("_h", F.expr("transform(t, x -> xxhash64(x))"))


def item_windows(items: DataFrame, k: int = WINDOW, literals: int = LITERALS) -> DataFrame:
    """wh, item_id, ipos, k, n_words: searchable windows. An item of fewer than ``k`` words is one window."""
    p = _prepared(items.filter("text IS NOT NULL").select("item_id", "text"), "item_id").filter("size(t) > 0")
    p = p.withColumn("k", F.least(F.lit(k), F.size("t")))
    w = F.expr("transform(sequence(1, size(t) - k + 1), i -> struct(xxhash64(slice(_h, i, k)) AS wh, i - 1 AS ipos,"
               " size(filter(slice(t, i, k), x -> NOT startswith(x, '#'))) AS lit))")  # fmt: skip
    p = p.select("item_id", "k", F.size("t").alias("n_words"), F.explode(w).alias("_w"))
    p = p.filter(F.col("_w.lit") >= F.least(F.lit(literals), F.col("k")))
    return p.select("_w.wh", "item_id", "_w.ipos", "k", "n_words").distinct()


def matches(docs: DataFrame, items: DataFrame, k: int = WINDOW, literals: int = LITERALS, passage: int = PASSAGE) -> DataFrame:
    """Contaminated rows of ``docs`` (doc_id, text): doc_id, row_hash, item_id, n_windows, n_words, coverage,
    n_slots, changed.

    One row per document row and benchmark item (item_id, text) that share a passage: template windows on
    one diagonal whose placeholders map each item value to a single document value. Their words must
    number ``passage``, or half of the item's if that is less. ``coverage`` is their share of the item;
    ``changed`` tells that a value differs, i.e. the question was asked with other parameters.

    All windows of all documents are streamed through the hash join with the items' windows; that table
    is written first, so Spark broadcasts it only if its known size allows, and shuffles otherwise. Texts
    of hit documents alone are looked at again for the values. A text that holds an item many times has
    many diagonals, each a row, not an array. Defined cases: NULL and empty texts match nothing; repeated
    rows are all reported; an empty table on either side gives no rows; other columns are ignored.
    """
    windows = materialise(item_windows(items, k, literals), "item-windows")
    lengths = sorted(r[0] for r in windows.select("k").distinct().collect())
    rid = F.xxhash64("doc_id", "text")
    d = docs.select("doc_id", "text").withColumn("_rid", rid)
    p = _prepared(d, "_rid")
    each = [
        F.expr(f"CASE WHEN size(_h) >= {n} THEN transform(sequence(1, size(_h) - {n - 1}), i -> xxhash64(slice(_h, i, {n}))) ELSE array() END")
        for n in lengths
    ]
    hits = None
    for n, w in zip(lengths, each):
        one = p.select("_rid", F.posexplode(w).alias("pos", "wh")).join(windows.filter(F.col("k") == n), "wh")
        one = one.select("_rid", "item_id", "ipos", "k", "n_words", (F.col("pos") - F.col("ipos")).alias("diag"))
        hits = one if hits is None else hits.unionByName(one)
    if hits is None:
        return docs.select("doc_id", rid.alias("row_hash")).limit(0).select(
            "doc_id", "row_hash", F.lit(None).cast("bigint").alias("item_id"), F.lit(0).cast("long").alias("n_windows"),
            F.lit(0).alias("n_words"), F.lit(0.0).alias("coverage"), F.lit(0).alias("n_slots"), F.lit(False).alias("changed"),
        )
    by = ["_rid", "item_id", "k", "n_words", "diag"]
    diagonals = materialise(hits.groupBy(*by).agg(F.sort_array(F.collect_set("ipos")).alias("starts")), "diagonals")
    wanted = diagonals.select(F.col("_rid").alias("_hit")).distinct()
    hit_docs = d.join(materialise(wanted, "hit-rows"), F.col("_rid") == F.col("_hit"), "left_semi")
    values = _prepared(hit_docs, "_rid").dropDuplicates(["_rid"]).select("_rid", F.col("v").alias("dv"))
    asked = _prepared(items.filter("text IS NOT NULL").select("item_id", "text"), "item_id").select("item_id", F.col("t").alias("it"), F.col("v").alias("iv"))
    j = diagonals.join(values, "_rid").join(asked.dropDuplicates(["item_id"]), "item_id")
    j = j.withColumn("covered", F.expr("filter(sequence(0, n_words - 1), p -> exists(starts, s -> s <= p AND p < s + k))"))
    pairs = F.expr(
        "transform(filter(covered, p -> startswith(it[p], '#')),"
        " p -> struct(it[p] AS kind, iv[p] AS a, get(dv, p + diag) AS b))"
    )
    j = j.withColumn("pairs", F.array_distinct(pairs))
    j = j.filter(F.size("pairs") == F.size(F.array_distinct(F.expr("transform(pairs, x -> struct(x.kind, x.a))"))))
    j = j.select(
        "_rid", "item_id", "n_words", F.size("starts").alias("nw"), F.size("covered").alias("nc"),
        F.size("pairs").alias("ns"), F.expr("exists(pairs, x -> NOT x.a <=> x.b)").alias("changed"),
    )
    j = j.filter(F.col("nc") >= F.least(F.lit(float(passage)), F.col("n_words") / 2))
    best = j.groupBy("_rid", "item_id").agg(
        F.max(F.struct("nc", "nw", "ns", (~F.col("changed")).alias("same"), "n_words")).alias("b")
    )
    best = materialise(best.select("_rid", "item_id", "b.*"), "contaminated")
    ids = docs.select("doc_id", rid.alias("row_hash"))
    out = ids.join(best, F.col("row_hash") == F.col("_rid"))
    return out.select(
        "doc_id", "row_hash", "item_id", F.col("nw").cast("long").alias("n_windows"), F.col("nc").cast("long").alias("n_words"),
        (F.col("nc") / F.col("n_words")).alias("coverage"), F.col("ns").cast("long").alias("n_slots"),
        (~F.col("same")).alias("changed"),
    )


def decontaminate(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that share no passage with an item (see :func:`matches`), all columns kept."""
    bad = materialise(matches(docs, items, **options).select("row_hash").distinct(), "contaminated-rows")
    bad = bad.withColumnRenamed("row_hash", "_bad")
    return docs.join(bad, F.xxhash64(docs["doc_id"], docs["text"]) == F.col("_bad"), "left_anti")
