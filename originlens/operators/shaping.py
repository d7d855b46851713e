"""Unions, unpivots, fan-out and overlap checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from originlens.functions.text import strip
from originlens.operators.ranking import hash_rank, null_safe_join
from originlens.session import materialise

# What a detection row shows when its pair lacks the column.
PAIR_DEFAULTS = {"source": "unknown", "year": 2020, "prompt_name": "unknown"}


def build_detection_rows(pairs: DataFrame, dedupe: bool = False) -> DataFrame:
    """Two rows per (original, generated) pair: label 0 with ``variation_idx = -1``, and label 1.

    ``pairs`` has ``id, essay_idx, variation_idx, original_en, generated_en`` and optionally
    the columns of :data:`PAIR_DEFAULTS`. Blank texts give no row. An original comes once per
    variation unless ``dedupe`` keeps one per essay.
    """
    meta = [
        (F.col(c) if c in pairs.columns else F.lit(v)).alias(c) for c, v in PAIR_DEFAULTS.items()
    ]
    both = F.array(
        F.struct(
            F.col("original_en").alias("text"), F.lit(0).alias("is_generated"), F.lit(-1).alias("variation_idx")
        ),
        F.struct(
            F.col("generated_en").alias("text"),
            F.lit(1).alias("is_generated"),
            F.col("variation_idx").cast("int").alias("variation_idx"),
        ),
    )
    rows = (
        pairs.select("id", "essay_idx", *meta, F.explode(both).alias("r"))
        .select(
            F.concat("id", F.lit("/"), F.col("r.is_generated").cast("string")).alias("row_id"),
            strip("r.text").alias("text"),
            "r.is_generated",
            "essay_idx",
            "r.variation_idx",
            *PAIR_DEFAULTS,
            F.col("essay_idx").alias("original_essay_idx"),
        )
        .filter(F.col("text") != "")
    )
    if not dedupe:
        return rows
    originals = rows.filter("is_generated = 0")
    keep = originals.groupBy("essay_idx").agg(F.min("row_id").alias("row_id"))
    one = originals.join(keep, ["essay_idx", "row_id"], "left_semi")
    return one.select(*rows.columns).unionByName(rows.filter("is_generated = 1"))


def mix_sources(base: DataFrame, *external: DataFrame) -> DataFrame:
    """Rows of all tables; a column a table lacks is NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), external, base)


def fan_out_variations(df: DataFrame, n: int, essay: str = "essay_idx") -> DataFrame:
    """``n`` rows per essay with ``variation_idx`` from 0 and ``id = essay_<i>_var<k>``."""
    if n < 1:
        raise ValueError("at least one variation is needed")
    return df.withColumn("variation_idx", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn(
        "id",
        F.concat(
            F.lit("essay_"), F.col(essay).cast("string"), F.lit("_var"), F.col("variation_idx").cast("string")
        ),
    )


def concat_splits(splits: dict[str, DataFrame]) -> DataFrame:
    """One table with a ``split`` column from tables per split."""
    return mix_sources(*[df.withColumn("split", F.lit(name)) for name, df in splits.items()])


def text_overlap(train: DataFrame, test: DataFrame, text: str = "text") -> DataFrame:
    """Distinct texts in both tables. Hashes are matched first and the shared ones stored, so their size
    is known: while it allows a broadcast, only texts with a shared hash are shuffled; else all are.
    Equal hashes are then compared as texts."""
    def hashed(df):
        return df.select(F.xxhash64(text).alias("_h"), F.col(text)).filter(F.col(text).isNotNull())

    shared = hashed(train).select("_h").distinct().join(hashed(test).select("_h").distinct(), "_h", "left_semi")
    shared = materialise(shared, "shared-hashes")
    a = hashed(train).join(shared, "_h", "left_semi").select(text).distinct()
    b = hashed(test).join(shared, "_h", "left_semi").select(text).distinct()
    return a.join(b, text, "left_semi")


def group_overlap(train: DataFrame, test: DataFrame, key: str) -> DataFrame:
    """Distinct keys in both tables."""
    return train.select(key).distinct().join(test.select(key).distinct(), key, "left_semi")


PAIRS_PER_SALT = 100_000


def opposite_label_pairs(df: DataFrame, prompt: str, label: str, row_id: str, text: str, seed) -> DataFrame:
    """Human/AI pairs within a prompt, stripped: one pair per row of the prompt's larger class.

    Training pairs come as one partner per text, so rows are matched by position in a seeded
    shuffle, wrapping around the smaller class; the pairs grow with the rows, not with their
    product. A small class facing a huge one is replicated over salts, so that none of its
    rows gathers more than :data:`PAIRS_PER_SALT` partners in one key.
    """
    d = df.select(
        F.col(prompt).alias("prompt"), F.col(label).alias("y"), F.col(row_id).alias("rid"), strip(text).alias("t")
    )
    sizes = d.groupBy("prompt").agg(
        F.count_if(F.col("y") == 0).alias("n0"), F.count_if(F.col("y") == 1).alias("n1")
    )
    lead_label = F.when(F.col("n0") >= F.col("n1"), F.lit(0)).otherwise(F.lit(1))
    both = sizes.filter("n0 > 0 AND n1 > 0")
    ranked = hash_rank(d, seed, ["rid"], groups=["prompt", "y"], facts=(both, ["prompt"])).select(
        "*",
        (F.col("y") == lead_label).alias("leads"),
        F.least("n0", "n1").alias("n_small"),
        F.ceil(F.greatest("n0", "n1") / F.least("n0", "n1") / F.lit(PAIRS_PER_SALT)).alias("salts"),
    )
    lead = ranked.filter("leads").select(
        "prompt",
        "y",
        ((F.col("rn") - 1) % F.col("n_small")).alias("pos"),
        (F.expr("(rn - 1) div n_small") % F.col("salts")).alias("salt"),
        F.col("rid").alias("lead_id"),
        F.col("t").alias("lead_text"),
    )
    follow = ranked.filter("NOT leads").select(
        "prompt",
        (F.col("rn") - 1).alias("pos"),
        F.explode(F.expr("sequence(0L, salts - 1)")).alias("salt"),
        F.col("rid").alias("follow_id"),
        F.col("t").alias("follow_text"),
    )

    def pick(own: str, other: str, wanted: int, name: str) -> Column:
        return F.when(F.col("y") == wanted, F.col(own)).otherwise(F.col(other)).alias(name)

    return null_safe_join(lead, follow, ["prompt", "pos", "salt"]).select(
        "prompt",
        pick("lead_id", "follow_id", 0, "human_id"),
        pick("lead_id", "follow_id", 1, "ai_id"),
        pick("lead_text", "follow_text", 0, "human"),
        pick("lead_text", "follow_text", 1, "ai"),
    )
