"""The approximate neighbour index against exact search."""

import numpy as np
import pytest

from originlens.operators import ann, neighbors


def frame(spark, ids, m):
    return spark.createDataFrame([(int(i), [float(x) for x in v]) for i, v in zip(ids, m)], "vec_id long, embedding array<double>")


def test_recall_and_work_without_clusters(spark, tmp_path):
    rng = np.random.default_rng(0)
    t, q = rng.normal(size=(8000, 64)), rng.normal(size=(120, 64))
    train, query = frame(spark, range(8000), t), frame(spark, range(90_000, 90_120), q)
    index = ann.NeighborIndex.build(train, str(tmp_path / "i"))
    exact = neighbors.knn_cosine(train, query, 5)
    assert index.recall(query, exact) >= 0.9
    work = index.products(query).first()
    assert work.n_queries == 120 and work.products < 0.1
    # what is found has the exact distance
    found = index.search(query).join(exact.select("qid", "tid", exact.distance.alias("d")), ["qid", "tid"])
    assert found.filter("distance <> d").count() == 0


def test_tuned_probes_on_clusters(spark, tmp_path):
    rng = np.random.default_rng(1)
    middle = rng.normal(size=(30, 24))
    t = np.repeat(middle, 60, axis=0) + rng.normal(scale=0.05, size=(1800, 24))
    train = frame(spark, range(1800), t)
    index = ann.NeighborIndex.build(train, str(tmp_path / "i"), cell_rows=20)
    fitted = index.tuned(train, sample=60)
    assert fitted.probes < len(index.centres) // 4
    q = frame(spark, range(5000, 5050), middle[rng.integers(0, 30, 50)] + rng.normal(scale=0.05, size=(50, 24)))
    assert fitted.recall(q, neighbors.knn_cosine(train, q, 5)) >= 0.9
    again = ann.NeighborIndex.load(spark, str(tmp_path / "i"))
    assert sorted(map(tuple, again.search(q).collect())) == sorted(map(tuple, index.search(q).collect()))


def test_small_and_hard_inputs(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ann, "PART_ROWS", 16)  # cells and queries in many parts
    one = [1.0, 0.0, 0.5]
    rows = [(i, one) for i in range(200)] + [(500, [0.0, 1.0, 0.0]), (501, None), (502, []), (503, [0.0, 0.0, 0.0])]
    train = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    index = ann.NeighborIndex.build(train, str(tmp_path / "i"))
    got = index.search(train.filter("vec_id in (7, 501)"), 3, exclude_self=True).collect()
    assert [(r.qid, r.distance) for r in got] == [(7, 0.0)] * 3 and 7 not in {r.tid for r in got}
    empty = ann.NeighborIndex.build(train.limit(0), str(tmp_path / "e"))
    assert empty.search(train).count() == 0
    with pytest.raises(Exception):
        ann.NeighborIndex.build(train, str(tmp_path / "i"))  # an index is not overwritten
