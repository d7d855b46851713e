"""Classifiers and batched scoring."""

import numpy as np
import pytest

from originlens.operators import metrics, models


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(300):
        y = int(i % 2)
        x = rng.normal(size=3) + (3.0 * y, 0, 0)
        rows.append((i, y, [float(v) for v in x]))
    return spark.createDataFrame(rows, "id int, y int, features array<double>")


def logistic(x, y, c):
    """Newton's method for the penalised loss, intercept free."""
    a = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(a.shape[1])
    pen = np.diag([1.0] * x.shape[1] + [0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-a @ w))
        g = c * a.T @ (p - y) + pen @ w
        h = c * (a * (p * (1 - p))[:, None]).T @ a + pen
        w = w - np.linalg.solve(h, g)
    return w


def test_meta_learner_matches_newton(spark, table, tmp_path):
    wide = table.selectExpr("id", "y", "features[0] AS a", "features[1] AS b")
    m = models.fit_meta_learner(wide, ["a", "b"])
    rows = wide.orderBy("id").toPandas()
    w = logistic(rows[["a", "b"]].to_numpy(), rows.y.to_numpy(), 1.0)
    got = {r.model: r.coefficient for r in models.meta_coefficients(m, ["a", "b"], spark).collect()}
    assert got == pytest.approx({"a": w[0], "b": w[1], "(intercept)": w[2]}, abs=1e-4)
    assert models.fit_meta_learner(wide, ["a"]) is None
    assert models.meta_scores(m, wide, ["a", "b"]).filter("score BETWEEN 0 AND 1").count() == 300
    m.save(str(tmp_path / "meta"))
    same = models.meta_scores(models.load_meta_learner(str(tmp_path / "meta")), wide, ["a", "b"])
    assert sorted(same.select("id", "score").collect()) == sorted(models.meta_scores(m, wide, ["a", "b"]).select("id", "score").collect())
    holes = wide.selectExpr("id", "y", "if(id % 5 = 0, null, a) AS a", "b")
    scored = models.meta_scores(m, holes, ["a", "b"])
    assert scored.count() == 300 and scored.filter("score IS NULL").count() == holes.filter("a IS NULL").count()
    n = models.incomplete_rows(holes, ["a", "b"]).first()
    assert (n.n_rows, n.n_incomplete) == (300, holes.filter("a IS NULL").count())


@pytest.mark.parametrize("kind", models.KINDS)
def test_every_kind_ranks_well(table, kind):
    fitted = models.fit_classifier(kind, table.filter("id < 200"), c=5.0 if kind == "knnc" else 1.0)
    scored = fitted.score(table.filter("id >= 200")).select("id", "y", "score")
    assert scored.count() == 100
    assert metrics.roc_auc(scored).first()[0] > 0.7


def test_calibrated_scores_are_probabilities(table):
    scored = models.calibrated("svc", table.filter("id < 200"), 1).score(table.filter("id >= 200"))
    assert scored.filter("score > 0 AND score < 1").count() == 100
    mean = scored.selectExpr("avg(score)").first()[0]
    assert abs(mean - 0.5) < 0.1


def test_unknown_kind(table):
    with pytest.raises(ValueError):
        models.fit_classifier("other", table)


def test_batched_scores_and_nulls(spark):
    def make():
        return lambda texts: np.array([float(len(t)) - 2.0 for t in np.asarray(texts).reshape(-1)])

    df = spark.createDataFrame([(1, "ab"), (2, None), (3, ""), (4, "abcd")], "id int, text string")
    got = {r.id: r.score for r in models.score_batches(df, make, batch_size=2).collect()}
    assert got[2] is None
    assert [got[i] for i in (1, 3, 4)] == pytest.approx([0.5, 1 / (1 + np.exp(2)), 1 / (1 + np.exp(-2))])


def test_vote_fits_no_member_twice(table, monkeypatch):
    fits = []

    def fit(kind, *a, **b):
        fits.append(kind)
        return models.FittedClassifier(kind, lambda df: df.selectExpr("*", f"{len(kind)}.0D AS score"))

    monkeypatch.setattr(models, "fit_classifier", fit)
    fitted = models.fit_classifiers(["rfc", "linear_svc", "vote"], table)
    assert list(fitted) == ["rfc", "linear_svc", "vote"] and fits == ["rfc", "linear_svc", "svc"]
    assert {r.score for r in fitted["vote"].score(table).select("score").collect()} == {3.0}
