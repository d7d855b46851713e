"""N-gram probabilities and sequence features against plain Python."""

from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from originlens.functions.vectors import SCALAR_OPS
from originlens.operators import features, ngram
from originlens.plans import q_language

TEXTS = ["the cat sat on the mat", "the cat ran", "a dog", "", "the the the the", "cat"]
NEW = ["the cat flew", "zebra", "a dog sat on the cat"]


class Model:
    """Back-off model written down as loops over token lists."""

    def __init__(self, docs, v=None, d=0.9):
        self.v, self.d = v or len({w for t in docs for w in t}), d
        self.counts = {n: Counter(tuple(t[i : i + n]) for t in docs for i in range(len(t) - n + 1)) for n in (2, 3)}
        self.ctx = {n: defaultdict(Counter) for n in (2, 3)}
        for n in (2, 3):
            for g, c in self.counts[n].items():
                self.ctx[n][g[:-1]][g[-1]] += c
        before = defaultdict(set)
        for a, b in self.counts[2]:
            before[b].add(a)
        self.base = {w: len(s) / len(self.counts[2]) for w, s in before.items()}

    def p(self, gram):
        if len(gram) == 1:
            return self.base.get(gram[0], 1 / self.v)
        low, seen = self.p(gram[1:]), self.ctx[len(gram)].get(gram[:-1])
        if not seen:
            return low
        total = sum(seen.values())
        return self.d * len(seen) / total * low + max(seen.get(gram[-1], 0) - self.d, 0) / total


def texts(spark, rows):
    return spark.createDataFrame(list(enumerate(rows)), "id int, text string")


@pytest.mark.parametrize("scored", [TEXTS, NEW])
def test_probabilities(spark, scored):
    model = ngram.fit(texts(spark, TEXTS))
    plain = Model([t.split() for t in TEXTS])
    rows = ngram.score_documents(texts(spark, scored), model, "id").collect()
    assert len(rows) == sum(len(t.split()) for t in scored)
    for r in rows:
        t = ["", "", *scored[r.id].split()]
        gram = tuple(t[r.pos : r.pos + 3])
        assert r.p1 == pytest.approx(plain.p(gram[2:]), rel=1e-12)
        assert r.p2 == pytest.approx(plain.p(gram[1:]), rel=1e-12)
        assert r.p3 == pytest.approx(plain.p(gram), rel=1e-12)
        assert 0 < r.p3 <= 1


def test_counts_stay_inside_documents(spark):
    got = {(r.w1, r.w2): (r.c, r.ctx_total, r.ctx_followers) for r in ngram.ngram_counts(texts(spark, TEXTS), 2).collect()}
    plain = Model([t.split() for t in TEXTS])
    assert got == {
        g: (c, sum(plain.ctx[2][g[:1]].values()), len(plain.ctx[2][g[:1]])) for g, c in plain.counts[2].items()
    }


def test_laplace(spark):
    counts = ngram.raw_counts(texts(spark, TEXTS), 2)
    targets = spark.createDataFrame([("the", "cat"), ("the", "x"), ("q", "x")], "w1 string, w2 string")
    got = {(r.w1, r.w2): r.p for r in ngram.laplace_prob(targets, counts, 2, 100, 0.003).collect()}
    assert got == pytest.approx({("the", "cat"): 2.003 / 6.3, ("the", "x"): 0.003 / 6.3, ("q", "x"): 0.003 / 0.3})


def test_alignment(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0], [0.0, 0.0]), ([1.0], [0.0, 0.0])], "a array<double>, b array<double>")
    assert [r[0] for r in df.select(ngram.align_sequences("a", "b")).collect()] == [[2.0, 3.0], [1.0]]


def test_expressions():
    e = features.enumerate_expressions()
    assert len(e) == len(set(e)) == 322
    assert sum(len(x.split()) == 2 for x in e) == 28
    assert "trigram-probs v-sub llm1-probs s-avg" in e and "llm1-probs v-sub trigram-probs s-avg" not in e
    assert len(features.sample_expressions(100)) == 100


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(0)
    rows = [(i, *[rng.random(n).tolist() for _ in range(4)]) for i, n in enumerate([1, 25, 26, 90])]
    return rows, spark.createDataFrame(rows, "id int, llm1 array<double>, llm2 array<double>, trigram array<double>, unigram array<double>")


def test_symbolic(vectors):
    rows, df = vectors
    got = {(r.id, r.expr): r.feat for r in features.symbolic_features(df, "id", features.enumerate_expressions()).collect()}
    assert len(got) == 322 * len(rows)
    for i, a, b, t, u in rows:
        t, u = np.array(t), np.array(u)
        assert got[i, "unigram-probs v-mul trigram-probs s-l2"] == pytest.approx(np.linalg.norm(t * u))
        assert got[i, "unigram-probs v-> trigram-probs s-avg"] == pytest.approx(np.mean(u > t))
        assert got[i, "trigram-probs v-div unigram-probs s-avg-top-25"] == pytest.approx(np.sort(t / u)[::-1][:25].mean())
    one = features.symbolic_features(df, "id", [f"llm1-probs {s}" for s in SCALAR_OPS[:2]])
    assert one.count() == 2 * len(rows)


@pytest.mark.parametrize("compat", [False, True])
def test_custom(vectors, compat):
    rows, df = vectors
    long = features.custom_features(df, "id", compat)
    got = {(r.id, r.series, r.stat): r.value for r in long.collect()}
    assert len(got) == 100 * len(rows)
    for i, a, b, t, u in rows:
        def cut(x):
            return np.array(x) if len(x) <= 25 else np.array(x)[25:]
        ratio = np.clip(cut(a), 1e-4, 1e5) / np.clip(cut(u), 1e-4, 1e5)
        for series, x in (("trigram", cut(t)), ("llm1/unigram", ratio)):
            scale = 0.01 if compat else 1
            want = {
                "min": x.min(), "max": x.max(), "mean": x.mean(), "median": np.median(x), "l2": np.linalg.norm(x),
                "var": x.var(), **{k: np.quantile(x, q * scale) for k, q in features.QUANTILES.items() if k != "median"},
            }
            for stat, w in want.items():
                assert got[i, series, stat] == pytest.approx(w, rel=1e-10, abs=1e-15)
    matrix = features.feature_matrix(long, "id").collect()
    assert {len(r.features) for r in matrix} == {100}
    assert all(r.features[0] == got[r.id, "llm1", "min"] and r.features[99] == got[r.id, "unigram/trigram", "var"] for r in matrix)


def test_zscore_uses_train_only(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (2, "a", 3.0), (3, "a", 100.0), (1, "b", 2.0), (3, "b", 9.0)], "id int, f string, value double")
    out = {(r.id, r.f): r.z for r in features.zscore(df, df.filter("id < 3"), ["f"]).collect()}
    assert out == {(1, "a"): -1.0, (2, "a"): 1.0, (3, "a"): 98.0, (1, "b"): 0.0, (3, "b"): 0.0}


def test_documents_without_tokens_keep_their_rows(spark):
    model = ngram.fit(texts(spark, TEXTS))
    scored = ngram.score_documents(texts(spark, TEXTS), model, "id")
    v = ngram.probability_vectors(scored, "id", texts(spark, TEXTS))
    rows = {r.id: r for r in v.collect()}
    assert len(rows) == len(TEXTS) and rows[3].trigram == [] and len(rows[0].trigram) == 6
    long = features.custom_features(v, "id").filter("id = 3").collect()
    assert len(long) == 100 and {r.value for r in long} == {None}
    assert len(features.feature_matrix(features.custom_features(v, "id"), "id").collect()) == len(TEXTS)


def test_a_stored_model_scores_alike(spark, tmp_path):
    model = ngram.fit(texts(spark, TEXTS))
    model.save(str(tmp_path / "m"))
    again = ngram.NgramModel.load(spark, str(tmp_path / "m"))
    a, b = (sorted(ngram.score_documents(texts(spark, NEW), m, "id").collect()) for m in (model, again))
    assert a == b and again.vocab_size == model.vocab_size == 8


def test_stored_scaling(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 1.0), (2, "a", 3.0), (3, "a", 100.0)], "id int, f string, value double")
    features.scaling(df.filter("id < 3"), ["f"]).write.parquet(str(tmp_path / "s"))
    stored = spark.read.parquet(str(tmp_path / "s"))
    z = {r.id: r.z for r in features.zscore(df, None, ["f"], params=stored).collect()}
    assert z == {1: -1.0, 2: 1.0, 3: 98.0}
    # test rows change nothing in the train rows
    other = df.withColumn("value", F.when(F.col("id") == 3, -7.0).otherwise(F.col("value")))
    a, b = ({r.id: r.z for r in features.zscore(d, d.filter("id < 3"), ["f"]).collect() if r.id < 3} for d in (df, other))
    assert a == b


def test_asked_bigrams_keep_every_follower_of_a_target(spark, monkeypatch):
    d = spark.createDataFrame([(1, "a b a c d"), (2, "b a"), (3, ""), (4, None), (5, "z")], "doc_id int, text string")
    targets = spark.createDataFrame([("a", "b"), ("a", "x"), ("q", "r")], "w1 string, w2 string")
    got = {(r.w1, r.w2): r.c for r in ngram.asked_bigrams(d, targets).collect()}
    assert got == {("a", "b"): 1, ("a", "c"): 1, ("a", None): 1, ("b", None): 2, ("c", None): 1, ("d", None): 1, ("z", None): 1}
    monkeypatch.setattr(ngram, "FLAGS", 1)  # all words share a slot
    every = {(r.w1, r.w2): r.c for r in ngram.asked_bigrams(d, targets).filter("w2 is not null").collect()}
    assert every == {(r.w1, r.w2): r.c for r in ngram.raw_counts(d, 2).collect()}


def test_odd_vectors(spark):
    """NULL vectors and values, and vectors of unlike lengths, as Spark's array functions have them."""
    rows = [(1, [], [], [], []), (2, None, [0.5], [0.25], [1.0]), (3, [0.5, None, 2.0], [1.0, 0.0], [0.0] * 30, [4.0])]
    df = spark.createDataFrame(rows, "id int, llm1 array<double>, llm2 array<double>, trigram array<double>, unigram array<double>")
    got = {(r.id, r.expr): r.feat for r in features.symbolic_features(df, "id", features.enumerate_expressions()).collect()}
    assert len(got) == 322 * 3
    assert [got[1, f"llm1-probs {s}"] for s in SCALAR_OPS] == [None, None, None, None, 0.0, None, 0.0]
    assert [got[2, f"llm2-probs v-add llm1-probs {s}"] for s in SCALAR_OPS] == [None] * 7
    assert [got[3, f"llm1-probs {s}"] for s in SCALAR_OPS] == [2.0, 0.5, None, None, 3.0, None, None]
    assert [got[3, f"llm1-probs v-div llm2-probs {s}"] for s in ("s-max", "s-min", "s-len", "s-avg")] == [0.5, 0.0, 3.0, None]
    assert got[3, "trigram-probs s-avg-top-25"] == 0.0 and got[3, "unigram-probs v-> trigram-probs s-len"] == 30.0
    own = {(r.id, r.series, r.stat): r.value for r in features.custom_features(df, "id").collect()}
    assert len(own) == 300 and {v for (i, *_), v in own.items() if i == 1} == {None}
    assert [own[3, "llm1", s] for s in ("min", "max", "mean", "median", "q90")] == [None, 2.0, None, 0.5, pytest.approx(1.7)]
    assert [own[3, "llm1/llm2", s] for s in ("max", "min", "l2")] == [1.0, None, None]
    assert own[2, "llm2", "l2"] == 0.5 and own[2, "llm1/llm2", "max"] is None


def test_long_vectors_are_reduced_in_blocks(spark, monkeypatch, vectors):
    rows, df = vectors
    want = [sorted(f(df, "id").collect()) for f in (lambda d, k: features.symbolic_features(d, k, features.enumerate_expressions()), features.custom_features)]
    for name in ("BLOCK_VALUES", "OUT_VALUES"):
        monkeypatch.setattr(features, name, 100)
    got = [sorted(f(df, "id").collect()) for f in (lambda d, k: features.symbolic_features(d, k, features.enumerate_expressions()), features.custom_features)]
    assert got == want


def test_features_are_not_interpreted_value_by_value(vectors):
    _, df = vectors
    for long in (features.symbolic_features(df, "id", features.enumerate_expressions()), features.custom_features(df, "id")):
        plan = long._jdf.queryExecution().executedPlan().toString()
        assert "lambda" not in plan and "aggregate(" not in plan and "Exchange" not in plan


def test_zscore_query_makes_the_vectors_once(spark, sf):
    plan = q_language.s6_zscore(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "InArrow" not in plan
