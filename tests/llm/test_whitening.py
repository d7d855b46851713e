"""Whitening against a plain covariance in exact fractions."""

import math
from fractions import Fraction

import numpy as np
import pytest

from originlens.llm import queries, whitening


def _plain(rows, components=4):
    """vec_id, component -> (n, deviation, |whitened|, explained), from the definition."""
    xs = [(i, [math.floor(256 * float(c)) for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    dims = max(len(x) for _, x in xs)
    xs = [(i, x + [0] * (dims - len(x))) for i, x in xs]
    fit = list(dict.fromkeys(tuple(x) for _, x in xs))
    n, s = len(fit), [sum(c) for c in zip(*fit)]
    y = [[n * c - t for c, t in zip(x, s)] for x in fit]
    v = np.array([[float(Fraction(sum(r[i] * r[j] for r in y), n**3)) for j in range(dims)] for i in range(dims)])
    e, u = np.linalg.eigh(v)
    out = {}
    for i, x in xs:
        for c in range(min(components, dims)):
            d = u[:, dims - 1 - c]
            w = float((np.array(x) - np.array(s) / n) @ d / math.sqrt(e[dims - 1 - c]))
            out[i, c + 1] = (n, sum((n * a - t) ** 2 for a, t in zip(x, s)), abs(w), e[dims - 1 - c] / np.trace(v))
    return out


def _same(got, want):
    assert {(r.vec_id, r.component) for r in got} == set(want)
    for r in got:
        n, deviation, whitened, explained = want[r.vec_id, r.component]
        assert (r.n, r.deviation) == (n, deviation)
        assert abs(r.whitened) == pytest.approx(whitened, rel=1e-6, abs=1e-8)
        assert r.explained == pytest.approx(explained, rel=1e-9)
        assert r.identity_error < 1e-9


def test_query_equals_plain(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    _same(queries.QUERIES["op13_whitening"](spark, sf).collect(), _plain(rows))


def _frame(spark, rows):
    return spark.createDataFrame([(i, v, 1.0, 9) for i, v in rows], "vec_id long, embedding array<double>, x double, component int")


def test_unusable_rows_short_vectors_and_repeats(spark):
    rng = np.random.default_rng(1)
    good = [(i, rng.normal(size=5).tolist()) for i in range(60)]
    odd = [(100, None), (101, [0.1, None, 0.2, 0.3, 0.4]), (102, [math.nan] * 5), (103, [math.inf, 0.0, 0.0, 0.0, 0.0])]
    short = [(104, [0.5, 0.25]), (105, [])]
    rows = good + odd + short
    _same(whitening.whiten(_frame(spark, rows)).collect(), _plain(rows))
    # a copy under other ids changes no statistic
    copies = [(200 + i, good[0][1]) for i in range(40)]
    _same(whitening.whiten(_frame(spark, rows + copies)).collect(), _plain(rows + copies))
    twice = whitening.whiten(_frame(spark, [*rows, good[3]])).collect()
    assert len([r for r in twice if r.vec_id == 3]) == 8
    assert {r.vec_id for r in whitening.whiten(_frame(spark, [*good, (None, good[5][1])])).collect()} > {None}


def test_large_entries_stay_exact(spark):
    rng = np.random.default_rng(2)
    rows = [(i, (rng.normal(size=3) * 2.0**30 + 2.0**34).tolist()) for i in range(50)]
    got = whitening.whiten(_frame(spark, rows)).collect()
    want = _plain(rows, 3)
    assert all(r.deviation == (want[r.vec_id, 1][1] if want[r.vec_id, 1][1] < 1 << 63 else None) for r in got)
    assert all(abs(r.whitened) == pytest.approx(want[r.vec_id, r.component][2], rel=1e-6, abs=1e-8) for r in got)


def test_nothing_to_whiten(spark):
    for rows in ([], [(1, None)], [(1, [])], [(1, [0.5, 0.5]), (2, [0.5, 0.5])]):
        out = whitening.whiten(_frame(spark, rows))
        assert out.count() == 0 and out.columns[:2] == ["vec_id", "component"]
    # two vectors span one direction
    got = whitening.whiten(_frame(spark, [(1, [0.0, 1.0]), (2, [1.0, 0.0])])).collect()
    assert {r.component for r in got} == {1} and all(abs(r.whitened) == pytest.approx(1) for r in got)
