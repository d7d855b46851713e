"""Metrics against brute force and published confusion matrices."""

import itertools

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from originlens.operators import ensembles, metrics
from originlens.operators.ranking import hash_rank, running_totals


def frame(spark, y, s, model="m"):
    rows = [(i, model, int(a), float(b)) for i, (a, b) in enumerate(zip(y, s))]
    return spark.createDataFrame(rows, "id int, model string, y int, score double")


def auc(y, s):
    pos, neg = s[y == 1], s[y == 0]
    return float(np.mean([(p > n) + 0.5 * (p == n) for p, n in itertools.product(pos, neg)]))


def best(y, s):
    found = []
    for t in np.unique(s):
        hit = s >= t
        p, r = y[hit].mean(), y[hit].sum() / y.sum()
        found.append((2 * p * r / (p + r + 1e-8), -t))
    f, t = max(found)
    return f, -t


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(5)
    y = (rng.random(400) < 0.3).astype(int)
    s = np.round(0.4 * y + rng.random(400), 2)
    return y, s


def test_auc_and_threshold(spark, data):
    y, s = data
    df = frame(spark, y, s)
    assert metrics.roc_auc(df).first()[0] == pytest.approx(auc(y, s), abs=1e-12)
    f, t = best(y, s)
    row = metrics.best_f1_threshold(df).first()
    assert (row.threshold, row.best_f1) == (pytest.approx(t), pytest.approx(f))
    m = metrics.model_summary(df).first()
    hit = s >= t
    assert (m.tp, m.fp, m.fn, m.tn) == tuple(int(x) for x in (y[hit].sum(), (1 - y[hit]).sum(), y[~hit].sum(), (1 - y[~hit]).sum()))


def test_auc_properties(spark, data):
    y, s = data
    df = frame(spark, y, s)
    a = metrics.roc_auc(df).first()[0]
    assert metrics.roc_auc(df.withColumn("score", F.exp("score") * 3)).first()[0] == pytest.approx(a)
    assert metrics.roc_auc(df.withColumn("score", -F.col("score"))).first()[0] == pytest.approx(1 - a)
    assert metrics.roc_auc(df.repartition(7)).first()[0] == pytest.approx(a)


def test_one_class_and_ties(spark):
    assert metrics.roc_auc(frame(spark, [1, 1], [0.1, 0.2])).first()[0] is None
    assert metrics.roc_auc(frame(spark, [0, 1, 0, 1], [0.5] * 4)).first()[0] == 0.5
    m = metrics.threshold_metrics(frame(spark, [0, 0], [0.1, 0.2]), 0.5).first()
    assert (m.tn, m.precision, m.recall, m.f1, m.accuracy) == (2, 0.0, 0.0, 0.0, 1.0)
    # the lowest of equally good thresholds
    assert metrics.best_f1_threshold(frame(spark, [0, 0], [0.3, 0.2])).first().threshold == 0.2


@pytest.mark.parametrize("descending", [False, True])
def test_bucketed_running_totals_equal_plain_ones(spark, descending):
    rng = np.random.default_rng(1)
    # one group holds most rows, and scores crowd near zero
    rows = [(("a" if i % 10 else "b") if i % 7 else None, float(v), int(i)) for i, v in enumerate(rng.exponential(0.01, 3000))]
    df = spark.createDataFrame(rows, "g string, v double, n int").dropDuplicates(["g", "v"])
    args = (["g"], "v", ["n"], descending)
    order = F.col("v").desc() if descending else F.col("v").asc()
    whole = Window.partitionBy("g")
    upto = whole.orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    plain = df.select("*", F.sum("n").over(upto).alias("cum_n"), F.sum("n").over(whole).alias("all_n"))
    want = sorted(map(str, plain.collect()))
    for buckets in (1, 16, 256):
        got = running_totals(df, *args, buckets=buckets).select("g", "v", "n", "cum_n", "all_n")
        assert sorted(map(str, got.collect())) == want


def test_weights_with_null_scores_and_missing_models(spark):
    rows = [(1, "a", 0.8), (1, "b", None), (2, "a", 0.5), (2, "b", 0.1), (3, "a", None), (3, "b", None)]
    df = spark.createDataFrame(rows, "id int, model string, score double")
    w = spark.createDataFrame([("a", 0.5), ("b", 0.5)], "model string, weight double")
    got = {r.id: r.score for r in ensembles.weighted_average(df, w).collect()}
    assert got == {1: 0.8, 2: pytest.approx(0.3), 3: None}
    with pytest.raises(Exception, match="no weight for model b"):
        ensembles.weighted_average(df, w.filter("model = 'a'")).collect()


def test_votes_of_negative_and_zero_scores(spark):
    rows = [(1, "a", 0.25), (1, "b", 1.0), (2, "a", -0.1), (2, "b", 0.5), (3, "a", 0.0), (3, "b", 0.5)]
    df = spark.createDataFrame(rows, "id int, model string, score double")
    got = {r.id: (r.max_score, r.geometric_mean) for r in ensembles.vote_scores(df).collect()}
    assert got == {1: (1.0, pytest.approx(0.5)), 2: (0.5, None), 3: (0.5, 0.0)}


def test_hash_rank_is_a_permutation_per_group(spark):
    df = spark.range(2000).select(F.col("id"), F.when(F.col("id") % 3 == 0, "a").when(F.col("id") % 97 == 1, None).otherwise("b").alias("g"))
    r = hash_rank(df, 1, ["id"], ["g"], total="n")
    for g in r.groupBy("g").agg(F.collect_set("rn").alias("s"), F.max("n").alias("n"), F.count("*").alias("c")).collect():
        assert sorted(g.s) == list(range(1, g.c + 1)) and g.n == g.c
    assert sorted(hash_rank(df.repartition(3), 1, ["id"], ["g"]).select("id", "rn").collect()) == sorted(r.select("id", "rn").collect())


# Published confusion counts (TN FP FN TP) and the rounded rates that follow.
PUBLISHED = [
    ((1005, 15, 26, 994), (0.9851, 0.9745, 0.9798, 0.9799)),
    ((1005, 15, 25, 995), (0.9851, 0.9755, 0.9803, 0.9804)),
    ((1005, 15, 28, 992), (0.9851, 0.9725, 0.9788, 0.9789)),
]


@pytest.mark.parametrize("counts, rates", PUBLISHED)
def test_published_identities(spark, counts, rates):
    tn, fp, fn, tp = counts
    cells = [(0, 0.0, tn), (0, 1.0, fp), (1, 0.0, fn), (1, 1.0, tp)]
    df = spark.createDataFrame(cells, "y int, score double, n int").select("y", "score", F.explode(F.sequence(F.lit(1), "n")))
    m = metrics.threshold_metrics(df, 0.5).first()
    assert tuple(round(x, 4) for x in (m.precision, m.recall, m.f1, m.accuracy)) == rates
    e = metrics.error_summary(df).first()
    assert (e.total_errors, e.error_rate) == (fp + fn, pytest.approx((fp + fn) / 2040))


def test_orientation(spark, data):
    y, s = data
    both = frame(spark, y, s, "up").unionByName(frame(spark, y, -s, "down"))
    out = metrics.orient_scores(both, ["model"])
    assert {(r.model, r.flipped) for r in out.select("model", "flipped").distinct().collect()} == {("up", False), ("down", True)}
    assert all(r.roc_auc > 0.5 for r in metrics.roc_auc(out, ["model"]).collect())


def test_weights_and_pairs(spark, data):
    y, s = data
    rng = np.random.default_rng(2)
    all_models = frame(spark, y, s, "a").unionByName(frame(spark, y, rng.random(400), "b")).unionByName(frame(spark, y, -s, "c"))
    w = {r.model: r.weight for r in ensembles.auc_weights(all_models).collect()}
    assert sum(w.values()) == pytest.approx(1.0) and w["a"] > w["b"] > 0 and w["c"] > 0
    pairs = ensembles.pairwise_scores(all_models)
    assert pairs.count() == 3 * 400
    got = {r.id: r.score for r in pairs.filter("pair = 'a+c'").collect()}
    assert all(v == 0.0 for v in got.values())


def test_moment_match(spark):
    rng = np.random.default_rng(3)
    base, btest, target = (frame(spark, [0] * 50, rng.random(50)) for _ in range(3))
    out = [r.score for r in ensembles.moment_match(base, btest, target).orderBy("id").collect()]
    x, b, t = (np.array([r.score for r in d.orderBy("id").collect()]) for d in (base, btest, target))
    assert np.allclose(out, np.clip((x - b.mean()) / (b.std() + 1e-8) * t.std() + t.mean(), 0, 1))
