"""Keyed joins: predictions to labels, and what is still to do."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def attach_predictions(labels: DataFrame, preds: DataFrame, key: str = "id", check: bool = True) -> DataFrame:
    """Labels with the score of the same key.

    Scores and labels must cover the same keys once each. With ``check`` a mismatch fails the
    job that reads the result: both sides are counted per key on their way into one full outer
    join, and a key that a side lacks or repeats is an error. Nothing runs early or twice.
    """
    if not check:
        return labels.join(preds, key, "inner")

    def side(df: DataFrame, name: str) -> DataFrame:
        rest = F.struct(*[F.col(c) for c in df.columns if c != key] or [F.lit(1).alias("_")])
        return df.groupBy(key).agg(F.count(F.lit(1)).alias(f"_n_{name}"), F.first(rest).alias(f"_{name}"))

    joined = side(labels, "labels").join(side(preds, "preds"), key, "full_outer")
    n = [F.coalesce(c, F.lit(0)) for c in ("_n_labels", "_n_preds")]
    wrong = F.concat_ws(
        " ", F.lit("labels, predictions, matches: key"), F.col(key).cast("string"), F.lit("occurs"), *[x.cast("string") for x in n]
    )
    # the check is part of a column that every result has, so it cannot be pruned
    checked = F.when((n[0] == 1) & (n[1] == 1), F.col(key)).otherwise(F.raise_error(wrong).cast(labels.schema[key].dataType))
    own = [F.col(f"_labels.{c}") for c in labels.columns if c != key]
    return joined.select(checked.alias(key), *own, *[F.col(f"_preds.{c}") for c in preds.columns if c != key])


def resume_missing(todo: DataFrame, done: DataFrame, n_variations: int) -> DataFrame:
    """Variations still to produce: not in ``done``, and of an essay that lacks some of its
    ``n_variations``. Counted per essay, so an essay with all of them is skipped whole."""
    produced = done.select("id").distinct()
    per_essay = done.select("essay_idx", "id").distinct().groupBy("essay_idx").agg(F.count(F.lit(1)).alias("_n"))
    complete = per_essay.filter(F.col("_n") >= n_variations).select("essay_idx")
    return todo.join(complete, "essay_idx", "left_anti").join(produced, "id", "left_anti")


def skip_translated(df: DataFrame, translated: str) -> DataFrame:
    """Rows whose translation is missing or failed."""
    from originlens.operators.cleaning import is_valid_translation

    return df.filter(~is_valid_translation(translated))
