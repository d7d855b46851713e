"""Hard negatives against all inner products."""

import math

import numpy as np
import pytest

from originlens.llm import hardneg


def _plain(rows, every=100, positives=5, negatives=10):
    used = {(i, tuple(math.floor(256 * c) for c in v), y) for i, v, y in rows if i is not None and y is not None and v is not None and all(c is not None and math.isfinite(c) for c in v)}
    used = sorted(used, key=lambda r: r[0])
    out = []
    for a in used:
        if a[0] % every:
            continue
        dot = {b: sum(x * y for x, y in zip(a[1], b[1])) for b in used}
        order = sorted((b for b in used if b != a), key=lambda b: (-dot[b], b[0]))
        others = [b for b in order if b[2] != a[2]]
        for p in [b for b in order if b[2] == a[2]][:positives]:
            inside = [b for b in others if 30 * dot[p] <= 100 * dot[b] <= 90 * dot[p]][:negatives]
            out += [(a[0], p[0], i + 1, b[0], dot[p], dot[b]) for i, b in enumerate(inside)]
    return sorted(out)


def _frame(spark, rows):
    return spark.createDataFrame([(i, v, y, "extra", 3, 0.5) for i, v, y in rows], "vec_id long, embedding array<double>, label int, x string, q int, score double")


def _got(spark, rows, **options):
    return sorted(tuple(r) for r in hardneg.mine_embeddings(_frame(spark, rows), **options).collect())


@pytest.mark.parametrize("entries", [1 << 21, 1 << 8])
def test_equals_all_pairs(spark, monkeypatch, entries):
    monkeypatch.setattr(hardneg, "ENTRIES", entries)  # many shards, several stages
    monkeypatch.setattr(hardneg, "GROW", 3)
    rng = np.random.default_rng(5)
    c = rng.normal(size=(4, 20))
    rows = []
    for i in range(500):
        v = c[i % 4] + rng.normal(size=20) * 0.7
        rows.append((i, (v / np.linalg.norm(v)).tolist(), int(rng.integers(0, 3))))
    # vectors on a coarse grid, so that scores tie
    rows += [(500 + i, (rng.integers(-1, 2, 20) / 8).tolist(), i % 3) for i in range(200)]
    assert _got(spark, rows, every=20) == _plain(rows, every=20)


def test_copies_ties_and_unusable_rows(spark):
    rng = np.random.default_rng(6)
    one = [0.5, 0.25, -0.5, 0.125]
    rows = [(i, one, i % 2) for i in range(400)]  # a hot vector under two labels
    rows += [(1000 + i, rng.normal(size=4).tolist(), i % 3) for i in range(120)]
    rows += [rows[0], rows[0], (None, one, 1), (2000, None, 1), (2001, [0.1, None, 0.2, 0.3], 1), (2002, [math.nan] * 4, 0), (2003, [math.inf] * 4, 0), (2004, one, None)]
    rows += [(2100, [0.0] * 4, 0), (2200, [0.0] * 4, 1), (2300, [-0.5, -0.25, 0.5, -0.125], 7)]
    assert _got(spark, rows) == _plain(rows)


def test_few_rows_and_empty(spark):
    assert _got(spark, []) == []
    assert _got(spark, [(0, [0.5, 0.5], 1)]) == []
    rows = [(0, [0.5, 0.5], 1), (1, [0.5, 0.4], 1), (2, [0.2, 0.3], 2), (100, [0.1, 0.1], 2), (3, [], 1), (4, [0.5], 2)]
    assert _got(spark, rows) == _plain([(i, [*v, *[0.0] * (2 - len(v))], y) for i, v, y in rows])


def test_index_omits_postings_and_keeps_all_pairs():
    rng = np.random.default_rng(7)
    x = (rng.normal(size=(300, 40)) * np.geomspace(100, 1, 40)).astype(np.int64)
    q = x[:10]
    index = hardneg.Index(x)
    t = np.full(10, 12_000.0)
    b, r, s = index.join(q, t)
    all_scores = q @ x.T
    assert {(i, j, v) for i, j, v in zip(b.tolist(), r.tolist(), s.tolist())} == {(i, j, all_scores[i, j]) for i in range(10) for j in range(300) if all_scores[i, j] >= 12_000}
    need = (t / np.linalg.norm(q, axis=1)).min()
    assert ((index.left[:, :-1] >= need).sum(axis=1) < index.left.shape[1] - 1).all()
    large = np.array([[1 << 40, 1 << 40], [3, -1]])
    assert hardneg.dots(large, large).tolist() == [(1 << 63) - 1, 10]
