"""Subword tokens against plain byte-pair merging, and n-grams over them."""

from collections import Counter

import pytest
import regex

from originlens.operators import ngram, subwords
from originlens.plans.q_language import SUBWORD_RANKS

TEXTS = ["", " ", "Hello world, it's 2024!\n\n  tabs\tand  spaces ", "été 日本語 🙂 naïve", "aaaaaaaaaaaaaaaa" * 20, "don't DON'T we'll", None, "<|endoftext|>"]


@pytest.fixture(scope="module")
def ranks(spark):
    return subwords.read_ranks(spark, SUBWORD_RANKS)


def _merge(piece, ranks):
    parts = [bytes([b]) for b in piece]
    while len(parts) > 1:
        r, i = min((ranks.get(a + b, 1 << 30), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
        if r == 1 << 30:
            break
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return parts


def test_equals_plain_merging(spark, ranks):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "id int, text string")
    got = {r.id: r for r in subwords.subword_tokens(docs, ranks).collect()}
    for i, t in enumerate(TEXTS):
        if t is None:
            assert got[i].tokens is None and got[i].token_ids is None
            continue
        want = [p for w in regex.findall(subwords.PATTERN, t) for p in _merge(w.encode(), ranks)]
        assert got[i].token_ids == [ranks[p] for p in want]
        assert "".join(got[i].tokens).encode("latin-1").decode() == t
    assert subwords.subword_tokens(docs.limit(0), ranks).collect() == []
    # columns with the names of the new ones are replaced
    clash = docs.selectExpr("id", "text", "'x' AS tokens", "1 AS token_ids")
    assert sorted(subwords.subword_tokens(clash, ranks).columns) == ["id", "text", "token_ids", "tokens"]


def test_ngrams_over_subwords(spark, ranks):
    texts = ["the cat sat on the mat", "the cat ran"]
    docs = subwords.subword_tokens(spark.createDataFrame(list(enumerate(texts)), "id int, text string"), ranks)
    tokens = {r.id: r.tokens for r in docs.collect()}
    want = Counter(p for t in tokens.values() for p in zip(t, t[1:]))
    assert {(r.w1, r.w2): r.c for r in ngram.raw_counts(docs, 2, "tokens").collect()} == want
    scored = ngram.score_documents(docs, ngram.fit(docs, "tokens"), "id", "tokens").collect()
    assert sorted((r.id, r.pos, r.token) for r in scored) == sorted((i, n, t) for i, ts in tokens.items() for n, t in enumerate(ts))
    assert all(0 < r.p3 <= 1 for r in scored)


def test_long_batches_are_cut(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(subwords, "PIECE_BYTES", 10)
    texts = ["abcd", None, "abcdefgh", "x" * 30, "", "ab", None]
    batch = pa.RecordBatch.from_pydict({"text": texts})
    parts = [p.column("text").to_pylist() for p in subwords._pieces(batch, "text")]
    assert [t for p in parts for t in p] == texts
    assert max(sum(len(t or "") for t in p) for p in parts if len(p) > 1) <= 10 and len(parts) == 4
    assert list(subwords._pieces(batch.slice(0, 0), "text")) == []
