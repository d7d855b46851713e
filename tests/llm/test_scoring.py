"""Language model: the trie against a table, scores against plain counting."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest

from originlens.llm import lm
from originlens.llm.trie import GRID, SPAN, EliasFano, Trie, quantise


@pytest.mark.parametrize("n,top", [(0, 1), (1, 5), (3 * SPAN + 5, 10**9), (SPAN, 900), (1000, 2**40)])
def test_elias_fano_gives_back_and_finds(n, top):
    rng = np.random.default_rng(n)
    x = np.sort(rng.integers(0, top, n)).astype(np.uint64)
    e = EliasFano.encode(x)
    assert n == 0 or (np.concatenate([e.span(s) for s in range(len(e.starts))]) == x).all()
    q = np.sort(np.concatenate([rng.integers(0, top + 9, 500).astype(np.uint64), x[::97]]))
    at, equal = e.successors(q)
    assert (at == np.searchsorted(x, q)).all()
    assert (equal == np.isin(q, x)).all()


def test_trie_finds_exactly_its_bigrams():
    rng = np.random.default_rng(3)
    key = np.unique(rng.integers(0, 400 * 3000, 150_000))
    p = rng.random(len(key))
    t = Trie.frombuffer(Trie.build(key // 3000, key % 3000, p, np.full(len(key), 0.5)).tobytes())
    q = np.unique(np.concatenate([rng.choice(key, 20_000), rng.integers(0, 410 * 3000, 20_000)]))
    at = np.minimum(np.searchsorted(key, q), len(key) - 1)
    want = np.where(key[at] == q, quantise(p)[at], 0)
    assert (t.lookup(q // 3000, q % 3000) == want).all()
    assert len(t.tobytes()) < 4 * len(key)


def _plain(rows):
    docs = [(i, (t or "").encode().lower().split() + [b"\n"], zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2) for i, t in rows]
    count = Counter(w for _, ws, h in docs if not h for w in ws)
    pairs = Counter(p for _, ws, h in docs if not h for p in zip([b""] + ws[:-1], ws))
    starts = sum(not h for *_, h in docs)
    n, v = sum(count.values()), len(count)
    out = []
    for i, ws, h in docs:
        one = [(count[w] + 1) / (n + v + 1) for w in ws]
        score = 0.0
        for a, w, p in zip([b""] + ws[:-1], ws, one):
            c = starts if a == b"" else count[a]
            score += math.log10(pairs[a, w] / (c + lm.MU) + lm.MU / (c + lm.MU) * p)
        out.append((i, h, len(ws), sum(count[w] > 0 for w in ws), n, sum(map(math.log10, one)), score))
    return out


@pytest.mark.parametrize("chunk", [50, 1_000_000])
def test_scores_equal_plain_counting(spark, documents, hard_docs, monkeypatch, chunk):
    monkeypatch.setattr(lm, "CHUNK_TOKENS", chunk)
    docs = documents.select("doc_id", "text").limit(60).unionByName(hard_docs.select("doc_id", "text"))
    want = sorted(_plain([tuple(r) for r in docs.collect()]), key=str)
    got = sorted([tuple(r) for r in lm.score_held_out(docs).collect()], key=str)
    for g, w in zip(got, want, strict=True):
        assert g[:5] == w[:5]
        assert g[5] == pytest.approx(w[5], abs=1e-6)
        assert abs(g[6] - w[6]) <= g[2] * 0.51 / GRID * 1.01


def test_empty_table_has_no_scores(no_docs):
    assert lm.score_held_out(no_docs).collect() == []
