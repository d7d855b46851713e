"""Neighbours against brute force."""

import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from originlens.operators import neighbors


def frame(spark, ids, m, y=None):
    y = [int(i) % 2 for i in ids] if y is None else y
    return spark.createDataFrame([(int(i), [float(x) for x in v], int(l)) for i, v, l in zip(ids, m, y)], "vec_id long, embedding array<double>, y int")


def brute(tid, t, qid, q, k, exclude=False):
    t, q = (m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12) for m in (t, q))
    d = np.round(1 - q @ t.T, 8)
    out = {}
    for i, row in zip(qid, d):
        cand = sorted((x, j) for x, j in zip(row, tid) if not (exclude and i == j))
        out[int(i)] = [int(j) for _, j in cand[:k]]
    return out


def got(df):
    rows = df.orderBy("qid", "rn").collect()
    return {q: [r.tid for r in rows if r.qid == q] for q in {r.qid for r in rows}}


@pytest.mark.parametrize("block_rows", [17, 64, 100000])
def test_exact_whatever_the_blocks(spark, block_rows):
    rng = np.random.default_rng(0)
    t, q = rng.normal(size=(150, 8)), rng.normal(size=(60, 8))
    t[40:90] = t[40]  # a third of the references are copies of one
    q[5] = t[40]
    tid, qid = np.arange(150), np.arange(1000, 1060)
    out = neighbors.knn_cosine(frame(spark, tid, t), frame(spark, qid, q), 5, block_rows=block_rows)
    assert got(out) == brute(tid, t, qid, q, 5)


def test_clustered_rows_visit_few_cells(spark, monkeypatch):
    rng = np.random.default_rng(4)
    middle = rng.normal(size=(40, 16))
    t = np.repeat(middle, 50, axis=0) + rng.normal(scale=0.01, size=(2000, 16))
    q = middle[rng.integers(0, 40, 300)] + rng.normal(scale=0.01, size=(300, 16))
    made = []
    keep = neighbors.materialise
    monkeypatch.setattr(neighbors, "materialise", lambda df, name: made.append((name, out := keep(df, name))) or out)
    out = neighbors.knn_cosine(frame(spark, range(2000), t), frame(spark, range(5000, 5300), q), 5, block_rows=50)
    assert got(out) == brute(range(2000), t, range(5000, 5300), q, 5)
    visited = sum(df.count() for name, df in made if name == "visits")
    assert visited < 300 * 40 / 4


def test_no_references(spark):
    t = frame(spark, [1], np.ones((1, 4)))
    assert neighbors.knn_cosine(t.limit(0), t, 3).collect() == []
    assert neighbors.knn_cosine(t, t.limit(0), 3).collect() == []


def test_more_neighbours_than_references(spark):
    rng = np.random.default_rng(1)
    t = rng.normal(size=(3, 4))
    out = neighbors.knn_cosine(frame(spark, range(3), t), frame(spark, [9], t[:1]), 10)
    assert len(got(out)[9]) == 3


def test_exclude_self(spark):
    rng = np.random.default_rng(2)
    t = rng.normal(size=(80, 4))
    t[10] = t[20]
    e = frame(spark, range(80), t)
    out = neighbors.knn_cosine(e, e, 3, exclude_self=True)
    assert got(out) == brute(range(80), t, range(80), t, 3, exclude=True)
    assert got(out)[10][0] == 20


def test_score_and_reference_ranking(spark):
    rng = np.random.default_rng(3)
    t, q = rng.normal(size=(40, 6)), rng.normal(size=(20, 6))
    train, query = frame(spark, range(40), t), frame(spark, range(100, 120), q)
    near = neighbors.knn_cosine(train, query, 5)
    s = neighbors.knn_score(neighbors.neighbour_summary(near, train)).orderBy("qid").toPandas()
    d = s.mean_distance
    want = 0.5 * (d - d.min()) / (d.max() - d.min() + 1e-8) + 0.5 * s.positive_ratio
    assert np.allclose(s.score, want)
    u = t / np.linalg.norm(t, axis=1, keepdims=True)
    v = q / np.linalg.norm(q, axis=1, keepdims=True)
    y = np.arange(40) % 2
    direct = np.clip(0.5 * ((v @ u[y == 1].T).mean(1) - (v @ u[y == 0].T).mean(1) + 1), 0, 1)
    out = neighbors.reference_ranking_score(train, query).orderBy("vec_id").toPandas()
    assert np.allclose(out.score, direct)
    one_class = neighbors.reference_ranking_score(train.filter("y = 1"), query).orderBy("vec_id").toPandas()
    assert np.allclose(one_class.score, np.clip(0.5 * ((v @ u[y == 1].T).mean(1) + 1), 0, 1))


def test_masked_mean(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0], 1), (1, [3.0, 6.0], 1), (1, [100.0, 0.0], 0), (2, [5.0, 5.0], 0)], "k int, embedding array<double>, m int")
    out = {(r.k, r.dim): r.value for r in neighbors.masked_mean_pool(df, "k", mask="m").collect()}
    assert out == {(1, 0): 2.0, (1, 1): 4.0, (2, 0): 0.0, (2, 1): 0.0}


def test_no_nested_loop_or_broadcast_of_tables(spark):
    e = spark.range(100).select(F.col("id").alias("vec_id"), F.array(F.rand(1), F.rand(2)).alias("embedding"))
    plan = neighbors.knn_cosine(e, e, 3)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan and "BroadcastExchange" not in plan


def _peak(run) -> int:
    """Bytes that numpy and pandas hold at most while ``run`` yields."""
    tracemalloc.start()
    for _ in run:
        pass
    top = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return top


def test_tasks_hold_slices_whatever_the_cells(spark):
    rng = np.random.default_rng(2)
    m = rng.normal(size=(4000, 4))
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    d = pd.DataFrame({"id": np.arange(4000), "v": list(m), "cell": np.arange(4000, dtype="int32") % 7})
    own, other = np.full(7, 3), np.full(7, 200)
    # 800,000 copies, and matrices of 4000 rows by 4096 cells
    assert _peak(neighbors.dealt_rows(d, own, other)) < 40e6
    cells = neighbors.Cells(rng.normal(size=(4096, 4)), np.full(4096, 3), np.zeros(4096))
    sliced = [cells.first(np.stack(t["v"].to_numpy()), 5) for t in neighbors.tiles(d.head(600), 4096)]
    assert (np.concatenate(sliced) == cells.first(m[:600], 5)).all()
    assert _peak(cells.first(np.stack(t["v"].to_numpy()), 5) for t in neighbors.tiles(d, 4096)) < 100e6
    out = pd.concat(neighbors.dealt_rows(d.head(50), own, other))
    assert len(out) == 50 * 200 and set(out["theirs"]) == set(range(200)) and out.groupby("id")["mine"].nunique().max() == 1


def test_a_block_of_queries_is_searched_in_small_tiles():
    rng = np.random.default_rng(3)
    t = pd.DataFrame({"tid": np.arange(8192), "v": list(rng.normal(size=(8192, 4)))})
    q = pd.DataFrame({"qid": np.arange(1024), "v": list(rng.normal(size=(1024, 4)))})
    assert _peak(neighbors._block_top_k(5, False, 8)(q, t) for _ in range(1)) < 60e6


@pytest.mark.parametrize("exclude", [False, True])
def test_a_row_is_copied_to_groups_of_cells(spark, monkeypatch, exclude):
    rng = np.random.default_rng(5)
    t = rng.normal(size=(640, 24))  # no cell can be ruled out
    t[100:140] = t[100]
    dealt, keep = [], neighbors._dealt
    monkeypatch.setattr(neighbors, "_dealt", lambda df, *a: dealt.append(out := keep(df, *a)) or out)
    e = frame(spark, range(640), t)
    out = neighbors.knn_cosine(e, e, 5, exclude_self=exclude, block_rows=10)
    assert got(out) == brute(range(640), t, range(640), t, 5, exclude=exclude)
    # 64 cells of about 10 rows: each would be visited by nearly every row
    assert sum(df.count() for df in dealt) < 640 * 64 / 2


def test_groups_of_cells():
    assert neighbors._groups(np.array([5, 5, 1, 30, 0, 2]), 10).tolist() == [0, 0, 1, 2, 3, 3]
    assert np.bincount(neighbors._groups(np.zeros(200), 10)).max() == neighbors.GROUP_CELLS
