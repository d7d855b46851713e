"""The Gray-order index against all pairs of fingerprints."""

import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from originlens.llm import grayindex as g
from originlens.llm import queries


def _fingerprint(text):
    t = re.sub(r"[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def _components(rows, radius=2):
    """The smallest id that links between the fingerprints of (id, fingerprint) reach."""
    fps = sorted({f for _, f in rows})
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    a = np.array(fps, np.uint64)
    for i, f in enumerate(fps):
        for j in np.flatnonzero(np.bitwise_count(a[i + 1 :] ^ a[i]) <= radius):
            root[find(f)] = find(fps[i + 1 + j])
    least = {}
    for i, f in rows:
        if i is not None:
            least[find(f)] = min(i, least.get(find(f), i))
    return [(i, f"{f:016x}", least.get(find(f))) for i, f in rows]


def _key(rows):
    return sorted((tuple(r) for r in rows), key=str)


@pytest.mark.parametrize("group, sub, fan", [(256, 16, 32), (4, 2, 3)])
def test_query_equals_all_pairs(spark, sf, monkeypatch, group, sub, fan):
    for name, v in (("GROUP", group), ("SUB", sub), ("FAN", fan)):
        monkeypatch.setattr(g, name, v)
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    want = _components([(r.doc_id, _fingerprint(r.text)) for r in docs])
    assert _key(queries.QUERIES["op12_gray_simhash"](spark, sf).collect()) == _key(want)


def test_hash_is_that_of_the_session(spark):
    text = "été One two  three\tfour"
    h = spark.range(1).select(F.xxhash64(F.lit("one two three"))).first()[0]
    assert h % (1 << 64) in g.shingle_hashes(text.encode()).tolist()
    assert g.shingle_hashes("a B".encode()).tolist() == [xxhash.xxh64_intdigest(b"a b", 42)]


def _near(rng, n, centres):
    """Fingerprints around centres, up to three bits away, and some far ones."""
    out = set()
    for c in rng.integers(0, 1 << 63, centres, dtype=np.uint64).tolist():
        for _ in range(n):
            f = c
            for b in rng.integers(0, 64, rng.integers(0, 4)).tolist():
                f ^= 1 << b
            out.add(f)
    return sorted(out | set(rng.integers(0, 1 << 63, n, dtype=np.uint64).tolist()) | {0, 1, 3, 7, (1 << 64) - 1})


def test_links_connect_all_near_pairs(spark, monkeypatch):
    monkeypatch.setattr(g, "GROUP", 16)
    monkeypatch.setattr(g, "SUB", 4)
    monkeypatch.setattr(g, "FAN", 4)
    fps = _near(np.random.default_rng(3), 60, 30)
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    got = [(r.a % (1 << 64), r.b % (1 << 64)) for r in g.links(df, 2).collect()]
    assert all((a ^ b).bit_count() <= 64 for a, b in got)
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in got:
        root[find(a)] = find(b)
    want = {f: c for (_, f, c) in _components(list(enumerate(fps)))}
    byhex = {f: want[f"{f:016x}"] for f in fps}
    assert len({(find(f), byhex[f]) for f in fps}) == len(set(byhex.values())) == len({find(f) for f in fps})


def test_gray_rank(spark):
    codes = [i ^ (i >> 1) for i in range(40)]
    rows = spark.createDataFrame([(c,) for c in codes], "fp long").select("fp", g.gray_rank(F.col("fp")).alias("r")).collect()
    assert [r.r + (1 << 63) for r in rows] == list(range(40))
    top = spark.range(1).select(g.gray_rank(F.lit(-(1 << 63))).alias("r")).first().r
    assert top == (1 << 63) - 1  # the code with the first bit alone comes last


def test_hard_cases(spark, hard_docs, no_docs):
    got = g.near_duplicates(hard_docs).collect()
    rows = [(r.doc_id, _fingerprint(r.text)) for r in hard_docs.collect()]
    assert _key(got) == _key(_components(rows))
    assert g.near_duplicates(no_docs).count() == 0
    alone = g.near_duplicates(hard_docs.filter("doc_id is null")).collect()
    assert [(r.doc_id, r.component_id) for r in alone] == [(None, None)]


def test_many_copies_are_one_node(spark):
    rows = [(i, "the same words again and again") for i in range(3000)] + [(5000, "quite other words are here today")]
    got = g.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.component_id for r in got if r.doc_id < 5000} == {0} and len(got) == 3001
