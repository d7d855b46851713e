"""Exact ranking and threshold metrics as grouped aggregates.

Scores are first counted per distinct value, which settles ties and shrinks the data; running
totals over the values come from :func:`running_totals`, so no model's scores are sorted in
one task. ``groups`` are the columns that tell models (and folds) apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from originlens.operators.ranking import null_safe_join, running_totals
from originlens.operators.sampling import stratified_kfold

EPS = 1e-8


def score_counts(df: DataFrame, groups: list[str], score: str = "score", label: str = "y") -> DataFrame:
    """groups, score, ``pos``, ``neg``: label counts of each distinct score."""
    known = df.filter(F.col(score).isNotNull() & F.col(label).isNotNull())
    # adding 0.0 turns -0.0 into 0.0, which compare equal
    return known.groupBy(*groups, (F.col(score).cast("double") + F.lit(0.0)).alias("score")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg")
    )


def score_curve(df: DataFrame, groups: list[str], score: str = "score", label: str = "y") -> DataFrame:
    """One row per distinct score with ``tp`` and ``fp`` at ``>=`` that score, and the class
    totals ``n_pos`` and ``n_neg``."""
    counts = score_counts(df, groups, score, label)
    return running_totals(counts, groups, "score", ["pos", "neg"], descending=True).select(
        *groups,
        "score",
        "pos",
        "neg",
        F.col("cum_pos").alias("tp"),
        F.col("cum_neg").alias("fp"),
        F.col("all_pos").alias("n_pos"),
        F.col("all_neg").alias("n_neg"),
    )


def _ratio(top: Column, bottom: Column) -> Column:
    """Quotient, 0 on an empty denominator."""
    return F.when(bottom == 0, F.lit(0.0)).otherwise(top.cast("double") / bottom.cast("double"))


def _f1(tp: Column, fp: Column, fn: Column) -> Column:
    return _ratio(tp * 2, tp * 2 + fp + fn)


def _auc_agg() -> Column:
    """Share of (positive, negative) pairs ranked rightly, ties counting half. NULL when a
    class is missing."""
    below = (F.col("n_neg") - F.col("fp")).cast("double") + F.col("neg").cast("double") / F.lit(2.0)
    won = F.sum(F.col("pos").cast("double") * below)
    pairs = F.max(F.col("n_pos").cast("double") * F.col("n_neg").cast("double"))
    return F.when(pairs > 0, won / pairs)


def roc_auc(df: DataFrame, groups: list[str] | None = None, score: str = "score", label: str = "y", digits: int | None = None) -> DataFrame:
    groups = groups or []
    auc = _auc_agg() if digits is None else F.round(_auc_agg(), digits)
    return score_curve(df, groups, score, label).groupBy(*groups).agg(auc.alias("roc_auc"))


def _curve_rates(curve: DataFrame) -> DataFrame:
    p = _ratio(F.col("tp"), F.col("tp") + F.col("fp"))
    r = F.when(F.col("n_pos") == 0, F.lit(1.0)).otherwise(F.col("tp").cast("double") / F.col("n_pos").cast("double"))
    return curve.withColumn("precision", p).withColumn("recall", r)


def pr_curve(df: DataFrame, groups: list[str] | None = None, score: str = "score", label: str = "y") -> DataFrame:
    """groups, threshold, precision, recall, tp, fp."""
    groups = groups or []
    rates = _curve_rates(score_curve(df, groups, score, label))
    return rates.select(*groups, F.col("score").alias("threshold"), "precision", "recall", "tp", "fp")


def _pr_f1() -> Column:
    p, r = F.col("precision"), F.col("recall")
    return F.lit(2.0) * (p * r) / (p + r + F.lit(EPS))


def best_f1_threshold(df: DataFrame, groups: list[str] | None = None, score: str = "score", label: str = "y") -> DataFrame:
    """The threshold with the largest F1; the lowest of equal ones."""
    groups = groups or []
    rates = _curve_rates(score_curve(df, groups, score, label)).withColumn("_f1", _pr_f1())
    best = F.max(F.struct("_f1", (-F.col("score")).alias("_t")))
    return rates.groupBy(*groups).agg(best.alias("_b")).select(
        *groups, (-F.col("_b._t")).alias("threshold"), F.col("_b._f1").alias("best_f1")
    )


def _confusion_rates() -> list[Column]:
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return [
        _ratio(tp, tp + fp).alias("precision"),
        _ratio(tp, tp + fn).alias("recall"),
        _f1(tp, fp, fn).alias("f1"),
        _ratio(tp + tn, tp + tn + fp + fn).alias("accuracy"),
    ]


def confusion(df: DataFrame, threshold: Column | float, groups: list[str] | None = None, score: str = "score", label: str = "y", strict: bool = False) -> DataFrame:
    """tn, fp, fn, tp at ``score >= threshold`` (``>`` if ``strict``)."""
    t = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    hit = (F.col(score) > t) if strict else (F.col(score) >= t)
    y = F.col(label)
    return df.groupBy(*(groups or [])).agg(
        F.count_if((y == 0) & ~hit).alias("tn"),
        F.count_if((y == 0) & hit).alias("fp"),
        F.count_if((y == 1) & ~hit).alias("fn"),
        F.count_if((y == 1) & hit).alias("tp"),
    )


def threshold_metrics(df: DataFrame, threshold: Column | float, groups: list[str] | None = None, score: str = "score", label: str = "y", strict: bool = False) -> DataFrame:
    """Confusion counts, precision, recall, F1 and accuracy; 0 on empty denominators."""
    c = confusion(df, threshold, groups, score, label, strict)
    return c.select("*", *_confusion_rates())


def classification_report(df: DataFrame, threshold: float = 0.5, score: str = "score", label: str = "y", groups: list[str] | None = None, strict: bool = True) -> DataFrame:
    """Rows ``0``, ``1``, ``macro avg`` and ``weighted avg`` with precision, recall, F1, support."""
    groups = groups or []
    c = confusion(df, threshold, groups, score, label, strict)
    tn, fp, fn, tp = (F.col(x) for x in ("tn", "fp", "fn", "tp"))

    def row(name: str, hit: Column, wrong: Column, missed: Column) -> Column:
        return F.struct(
            F.lit(name).alias("label"),
            _ratio(hit, hit + wrong).alias("precision"),
            _ratio(hit, hit + missed).alias("recall"),
            _f1(hit, wrong, missed).alias("f1"),
            (hit + missed).alias("support"),
        )

    classes = c.select(*groups, row("0", tn, fn, fp).alias("a"), row("1", tp, fp, fn).alias("b"))
    total = F.col("a.support") + F.col("b.support")

    def mixed(name: str, wa: Column, wb: Column) -> Column:
        def of(field: str) -> Column:
            return (F.col(f"a.{field}") * wa + F.col(f"b.{field}") * wb).alias(field)

        return F.struct(F.lit(name).alias("label"), of("precision"), of("recall"), of("f1"), total.alias("support"))

    half = F.lit(0.5)
    rows = F.array(
        F.col("a"),
        F.col("b"),
        mixed("macro avg", half, half),
        mixed("weighted avg", _ratio(F.col("a.support"), total), _ratio(F.col("b.support"), total)),
    )
    return classes.select(*groups, F.inline(rows))


def model_summary(df: DataFrame, groups: list[str] | None = None, score: str = "score", label: str = "y") -> DataFrame:
    """AUC, best-F1 threshold and the metrics at it, for all groups from one curve."""
    groups = groups or []
    rates = _curve_rates(score_curve(df, groups, score, label)).withColumn("_f1", _pr_f1())
    best = F.max(F.struct("_f1", (-F.col("score")).alias("_t"), "tp", "fp"))
    agg = rates.groupBy(*groups).agg(
        _auc_agg().alias("roc_auc"), best.alias("_b"), F.max("n_pos").alias("_p"), F.max("n_neg").alias("_n")
    )
    flat = agg.select(
        *groups,
        "roc_auc",
        (-F.col("_b._t")).alias("threshold"),
        (F.col("_n") - F.col("_b.fp")).alias("tn"),
        F.col("_b.fp").alias("fp"),
        (F.col("_p") - F.col("_b.tp")).alias("fn"),
        F.col("_b.tp").alias("tp"),
    )
    return flat.select("*", *_confusion_rates())


def fold_metrics(df: DataFrame, groups: list[str], threshold: float = 0.5, score: str = "score", label: str = "y") -> DataFrame:
    """AUC, F1 and accuracy at a fixed threshold per group."""
    curve = score_curve(df, groups, score, label)
    hit = F.col("score") >= F.lit(threshold)

    def count(col: str, when: Column) -> Column:
        return F.sum(F.when(when, F.col(col)).otherwise(F.lit(0)))

    agg = curve.groupBy(*groups).agg(
        _auc_agg().alias("auc"),
        count("pos", hit).alias("tp"),
        count("neg", hit).alias("fp"),
        count("pos", ~hit).alias("fn"),
        count("neg", ~hit).alias("tn"),
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return agg.select(*groups, "auc", _f1(tp, fp, fn).alias("f1"), _ratio(tp + tn, tp + tn + fp + fn).alias("accuracy"))


def cv_report(df: DataFrame, seed, k: int = 5, model: str = "model", key: str = "id", score: str = "score", label: str = "y", threshold: float = 0.5) -> DataFrame:
    """Per model: mean and population deviation over ``k`` stratified folds of AUC, F1, accuracy.

    Folds belong to rows, not to (row, model), so all models see the same folds."""
    rows = df.select(key, label).distinct()
    folds = stratified_kfold(rows, seed, k, label, key).select(key, "fold")
    per_fold = fold_metrics(df.join(folds, key), [model, "fold"], threshold, score, label)
    return per_fold.groupBy(model).agg(
        *[f(m).alias(f"{m}_{n}") for m in ("auc", "f1", "accuracy") for n, f in (("mean", F.avg), ("std", F.stddev_pop))]
    )


def score_stats(df: DataFrame, groups: list[str] | None = None, score: str = "score") -> DataFrame:
    """Minimum, maximum, mean, population deviation, median and the counts of extreme scores.

    The median is read off the running counts of distinct scores, not off a collected group."""
    groups = groups or []
    counts = df.filter(F.col(score).isNotNull()).groupBy(*groups, F.col(score).cast("double").alias("score")).agg(
        F.count(F.lit(1)).alias("n")
    )
    totals = running_totals(counts, groups, "score", ["n"])
    lo = F.expr("(all_n - 1) div 2")
    hi = F.expr("all_n div 2")

    def at(pos: Column) -> Column:
        inside = (F.col("cum_n") > pos) & (F.col("cum_n") - F.col("n") <= pos)
        return F.max(F.when(inside, F.col("score")))

    medians = totals.groupBy(*groups).agg(((at(lo) + at(hi)) / F.lit(2.0)).alias("median_score"))
    stats = df.groupBy(*groups).agg(
        F.min(score).alias("min_score"),
        F.max(score).alias("max_score"),
        F.avg(score).alias("mean_score"),
        F.stddev_pop(score).alias("std_score"),
        F.count_if(F.col(score) < 0.1).alias("n_low"),
        F.count_if(F.col(score) > 0.9).alias("n_high"),
        F.count(score).alias("n_scores"),
    )
    if groups:
        return null_safe_join(stats, medians, groups)
    return stats.withColumn("median_score", medians.scalar())


def error_summary(df: DataFrame, threshold: float = 0.5, groups: list[str] | None = None, score: str = "score", label: str = "y") -> DataFrame:
    """False positives and negatives, error rate, specificity and balanced accuracy."""
    c = confusion(df, threshold, groups, score, label)
    tn, fp, fn, tp = (F.col(x) for x in ("tn", "fp", "fn", "tp"))
    spec, rec = _ratio(tn, tn + fp), _ratio(tp, tp + fn)
    return c.select(
        *(groups or []),
        "fp",
        "fn",
        (fp + fn).alias("total_errors"),
        _ratio(fp + fn, tn + fp + fn + tp).alias("error_rate"),
        spec.alias("specificity"),
        ((spec + rec) / F.lit(2.0)).alias("balanced_accuracy"),
    )


def class_distribution(df: DataFrame, label: str = "y", groups: list[str] | None = None) -> DataFrame:
    return df.groupBy(*(groups or []), label).agg(F.count(F.lit(1)).alias("n_rows"))


def orient_scores(df: DataFrame, groups: list[str], score: str = "score", label: str = "y") -> DataFrame:
    """Negate the scores of a group whose AUC is below one half; ``flipped`` tells.

    Groups are models: their decisions go in as one map. A join on the model would gather all scores of
    a model in one task."""
    auc = roc_auc(df, groups, score, label)
    entry = F.struct(F.struct(*groups), F.coalesce(F.col("roc_auc") < 0.5, F.lit(False)))
    by_group = auc.agg(F.map_from_entries(F.collect_list(entry)))
    flip = F.coalesce(F.try_element_at(by_group.scalar(), F.struct(*groups)), F.lit(False))
    flipped = df.withColumn("flipped", flip)
    return flipped.withColumn(score, F.when(F.col("flipped"), -F.col(score)).otherwise(F.col(score)))

