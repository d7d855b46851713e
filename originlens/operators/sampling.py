"""Splits, folds, samples and batches. Every draw is a function of the row's key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from originlens.functions.hashing import md5_hex, uniform
from originlens.operators.ranking import hash_rank, null_safe_join, top_n


def bernoulli_split(df: DataFrame, seed, p: float, key: str = "id", names=("train", "valid")) -> DataFrame:
    """Add ``split``: the first name with probability ``p``. No shuffle."""
    return df.withColumn("split", F.when(uniform(seed, key) < F.lit(p), names[0]).otherwise(names[1]))


def group_split(
    df: DataFrame, group: str, seed, ratios=(0.6, 0.2, 0.2), names=("train", "val", "test")
) -> DataFrame:
    """Add ``split`` so that all rows of a group fall into one part.

    Distinct groups are shuffled by md5 and cut at exact counts: ``floor(n * r)`` groups to
    train, the rest divided by the remaining ratio.
    """
    ranked = hash_rank(df.select(group).distinct(), seed, [group], out="_rn", total="_total")
    train_end = F.floor(F.col("_total") * F.lit(float(ratios[0])))
    rest = F.col("_total") - train_end
    val_end = train_end + F.floor(rest * F.lit(ratios[1] / (ratios[1] + ratios[2])))
    split = (
        F.when(F.col("_rn") <= train_end, names[0]).when(F.col("_rn") <= val_end, names[1]).otherwise(names[2])
    )
    return null_safe_join(df, ranked.select(group, split.alias("split")), [group])


def split_stats(df: DataFrame, group: str = "essay_idx", label: str = "is_generated") -> DataFrame:
    """Rows, groups and class shares per split."""
    return df.groupBy("split").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.countDistinct(group).alias("n_groups"),
        F.count_if(F.col(label) == 0).alias("n_original"),
        F.count_if(F.col(label) == 1).alias("n_generated"),
        F.avg(F.col(label).cast("double")).alias("generated_share"),
    )


def variation_histogram(df: DataFrame, label: str = "is_generated") -> DataFrame:
    """Generated rows per split and variation."""
    return df.filter(F.col(label) == 1).groupBy("split", "variation_idx").agg(F.count(F.lit(1)).alias("n_rows"))


def split_manifest(df: DataFrame, seed: int, ratios=(0.6, 0.2, 0.2), group: str = "essay_idx") -> DataFrame:
    """One STRUCT row per split: seed, ratio, counts. The group ids of a split are kept as a
    table (:func:`split_groups`), which has no size limit, not as one array."""
    shares = F.create_map(*[x for n, r in zip(("train", "val", "test"), ratios) for x in (F.lit(n), F.lit(r))])
    return df.groupBy("split").agg(
        F.lit(seed).alias("seed"),
        F.first(shares[F.col("split")]).alias("ratio"),
        F.countDistinct(group).alias("n_groups"),
        F.count(F.lit(1)).alias("n_rows"),
    )


def split_groups(df: DataFrame, group: str = "essay_idx") -> DataFrame:
    """The groups of each split."""
    return df.select("split", group).distinct()


def stratified_kfold(df: DataFrame, seed, k: int = 5, label: str = "y", key: str = "id", out: str = "fold") -> DataFrame:
    """Add ``fold`` in [0, k): each class is shuffled by md5 and dealt out in turn."""
    ranked = hash_rank(df, seed, [key], groups=[label], out="_rn")
    return ranked.withColumn(out, ((F.col("_rn") - 1) % k).cast("int")).drop("_rn")


def holdout_permutation(df: DataFrame, seed, fraction: float = 0.8, key: str = "id") -> DataFrame:
    """Add ``part``: ``train`` for the first ``floor(fraction * n)`` rows of a seeded shuffle."""
    ranked = hash_rank(df, seed, [key], out="_rn", total="_total")
    cut = F.floor(F.col("_total") * F.lit(float(fraction)))
    return ranked.withColumn("part", F.when(F.col("_rn") <= cut, "train").otherwise("test")).drop("_rn", "_total")


def per_class_sample(df: DataFrame, n: int, seed, label: str = "y", key: str = "id") -> DataFrame:
    """``n`` seeded rows of each class (all of a smaller class)."""
    return top_n(df, [md5_hex(seed, key), F.col(key)], n, groups=[label])


def group_id_lists(df: DataFrame, groups: list[str], key: str, seed=0, chunk: int = 1000) -> DataFrame:
    """The ids of each group as arrays of at most ``chunk`` sorted ids, with ``part`` numbering
    the arrays of a group. A group of any size stays whole and never forms one giant array."""
    ranked = hash_rank(df.select(*groups, key), seed, [key], groups=groups, out="_rn")
    parts = ranked.withColumn("part", F.expr(f"(_rn - 1) div {int(chunk)}"))
    return parts.groupBy(*groups, "part").agg(F.sort_array(F.collect_list(key)).alias("ids"))


def balanced_prompt_batches(
    df: DataFrame, batch_size: int, seed, prompt: str = "prompt", label: str = "y", key: str = "id"
) -> DataFrame:
    """Rows with ``batch``: half of a batch positive and half negative, all of one prompt.
    Only full batches that both classes can fill are kept, as a loader drops the rest."""
    half = batch_size // 2
    counts = df.groupBy(prompt).agg(
        F.least(F.count_if(F.col(label) == 0), F.count_if(F.col(label) == 1)).alias("_small")
    )
    ranked = hash_rank(df, seed, [key], groups=[prompt, label], out="_rn", facts=(counts, [prompt]))
    return (
        ranked.withColumn("batch", F.expr(f"(_rn - 1) div {half}"))
        .filter(F.col("batch") < F.expr(f"_small div {half}"))
        .drop("_rn", "_small")
    )


def prompt_batches(
    df: DataFrame, batch_size: int, seed, p_same: float = 0.8, prompt: str = "prompt", key: str = "id"
) -> DataFrame:
    """Rows with ``kind`` and ``batch``. A row's home batch is a full slice of its prompt; a
    coin per home batch keeps it together (``same``) or returns its rows, like those of
    unfilled slices, to one global shuffle cut into ``mixed`` batches."""
    ranked = hash_rank(df, seed, [key], groups=[prompt], out="_rn", total="_total")
    home = ranked.withColumn("_home", F.expr(f"(_rn - 1) div {batch_size}"))
    full = (F.col("_home") + 1) * batch_size <= F.col("_total")
    same = full & (uniform(f"{seed}/batch", prompt, "_home") < F.lit(p_same))
    marked = home.withColumn("_same", same)
    kept = marked.filter("_same").select(
        *df.columns, F.lit("same").alias("kind"), F.concat_ws("/", prompt, F.col("_home").cast("string")).alias("batch")
    )
    rest = hash_rank(marked.filter("NOT _same").select(*df.columns), f"{seed}/mixed", [key], out="_rn")
    mixed = rest.select(
        *df.columns,
        F.lit("mixed").alias("kind"),
        F.expr(f"cast((_rn - 1) div {batch_size} AS string)").alias("batch"),
    )
    return kept.unionByName(mixed)


def permute_labels(df: DataFrame, seed, label: str = "y", key: str = "id", out: str = "y_shuffled") -> DataFrame:
    """Add the label of another row: two seeded orders of the rows are matched by rank, so the
    labels are a permutation and the class counts stay."""
    left = hash_rank(df, f"{seed}/rows", [key], out="_rn")
    right = hash_rank(df.select(key, label), f"{seed}/labels", [key], out="_rn")
    return left.join(right.select("_rn", F.col(label).alias(out)), "_rn").drop("_rn")


def draw_prompts(prompts: DataFrame, n: int, seed, key: str = "id") -> DataFrame:
    """``n`` prompts, uniform with replacement: draw ``i`` takes the prompt at a hashed rank.

    Draws of one prompt are spread evenly, so the join has no hot key."""
    ranked = hash_rank(prompts, f"{seed}/order", [key], out="_rn")
    total = prompts.agg(F.count(F.lit(1)))
    draws = prompts.sparkSession.range(n).withColumnRenamed("id", "draw")
    u = uniform(f"{seed}/draw", "draw")
    draws = draws.withColumn("_rn", F.floor(u * total.scalar().cast("double")) + 1)
    return draws.join(ranked, "_rn").drop("_rn")


def length_batches(
    df: DataFrame, batch_size: int, seed, length: str = "n_tokens", key: str = "id"
) -> DataFrame:
    """Rows with ``batch`` in order of length; rows of one length are in seeded order. ``df`` is
    read in three passes, so pass a stored table of keys and lengths, not of texts.

    Ranks are offsets of the shorter lengths plus a rank within the length, so a length that
    many rows share does not gather in one task."""
    by_length = df.groupBy(length).agg(F.count(F.lit(1)).alias("_n"))
    starts = by_length.select(
        length, (F.sum("_n").over(Window.orderBy(length)) - F.col("_n")).alias("_shorter")
    )
    placed = hash_rank(df, seed, [key], groups=[length], out="_rn", facts=(starts, [length]))
    return placed.withColumn("batch", F.expr(f"(_shorter + _rn - 1) div {batch_size}")).drop("_rn", "_shorter")


def batch_padding(batches: DataFrame, length: str = "n_tokens", multiple: int = 64) -> DataFrame:
    """Padded length of each batch and the padding it wastes."""
    padded = F.ceil(F.max(length) / F.lit(multiple)) * multiple
    return batches.groupBy("batch").agg(
        F.count(F.lit(1)).alias("n_rows"),
        padded.cast("bigint").alias("padded_len"),
        (padded * F.count(F.lit(1)) - F.sum(length)).cast("bigint").alias("padding"),
    )

