"""Text and vector expressions against plain Python."""

import re
import time

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from originlens.functions import text as tx
from originlens.functions import vectors as V
from originlens.functions.prompts import chat_format, instruction, mask_tokens, sft_sequence

TEXTS = ["", "   ", "\n\t x  ", "one two", "a b\x0bc\x1fd\n", "é, ü! ß? end.", " ".join(f"w{i}" for i in range(57))]


def one(spark, expr, **cols):
    df = spark.createDataFrame([tuple(cols.values())], list(cols)) if cols else spark.range(1)
    return df.select(expr.alias("r")).first()[0]


@pytest.mark.parametrize("t", TEXTS)
def test_words_and_strip_follow_python(spark, t):
    assert one(spark, tx.words("t"), t=t) == t.split()
    assert one(spark, tx.strip("t"), t=t) == t.strip()


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(max_size=60), min_size=1, max_size=20))
def test_words_property(spark, texts):
    texts = [t.replace("\x00", "").encode("utf-8", "ignore").decode() for t in texts]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: (r.w, r.s) for r in df.select("i", tx.words("t").alias("w"), tx.strip("t").alias("s")).collect()}
    assert got == {i: (t.split(), t.strip()) for i, t in enumerate(texts)}


@pytest.mark.parametrize("t", TEXTS)
@pytest.mark.parametrize("ratio", [0.2, 0.3, 0.6])
def test_prefixes(spark, t, ratio):
    w = t.split()
    assert one(spark, tx.word_prefix("t", ratio), t=t) == " ".join(w[: max(10, int(len(w) * ratio))])
    split = one(spark, tx.continuation_split("t", ratio), t=t)
    n = int(len(w) * ratio)
    assert (split.prefix, split.rest) == (" ".join(w[:n]), " ".join(w[n:]))


@pytest.mark.parametrize(
    "raw, want",
    [
        ("p ### Response: hello</s> x", "hello"),
        ("### Response: a ### Response:  b <unk> c<|endoftext|>d", "b  c"),
        ("no marker", "no marker"),
        ("### Response:   </s>", ""),
    ],
)
def test_clean_response(spark, raw, want):
    assert one(spark, tx.clean_response("t"), t=raw) == want


@pytest.mark.parametrize(
    "text, limit, want",
    [
        ("It fits. Whole!", 40, ["It fits. Whole!"]),
        ("Aa bb. Cc! Dd? Ee.", 12, ["Aa bb. Cc.", "Dd. Ee."]),
        ("...!!!", 5, []),
        ("One. " + "x" * 30 + ". Two.", 10, ["One.", "x" * 30 + ".", "Two."]),
    ],
)
def test_pack_sentences_by_hand(spark, text, limit, want):
    assert one(spark, tx.pack_sentences("t", limit), t=text) == want


@settings(max_examples=30, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.lists(st.text("abc xyz", min_size=1, max_size=9), max_size=12), st.sampled_from(".!?")), min_size=1, max_size=6), st.integers(4, 40))
def test_pack_sentences_properties(spark, paragraphs, limit):
    texts = [f"{end} ".join(parts) + end for parts, end in paragraphs]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for r in df.select("i", tx.pack_sentences("t", limit).alias("c")).collect():
        text = texts[r.i]
        if len(text) <= limit:
            assert r.c == [text]
            continue
        inside = [[p for p in (x.strip() for x in c.split(".")) if p] for c in r.c]
        # every sentence, in order, once
        assert [p for c in inside for p in c] == [p for p in (x.strip() for x in re.split("[.!?]", text)) if p]
        for chunk, parts in zip(r.c, inside):
            assert chunk == ". ".join(parts) + "."
            assert len(chunk) <= limit + 1 or len(parts) == 1  # the last mark is not counted
        # a chunk is closed only when the next sentence and its mark would not fit
        for left, right in zip(inside, inside[1:]):
            assert sum(len(p) + 2 for p in left) + len(right[0]) > limit - 2


def test_pack_sentences_of_a_long_text(spark):
    """As a plain fold, and in seconds; NULL and empty texts."""
    parts = [f"s{i} " + "x" * (i * 7919 % 90) for i in range(100_000)]
    text = ". ".join(p.strip() for p in parts) + "."
    rows = spark.createDataFrame([(0, text), (1, None), (2, ""), (3, "!" * 5000)], "i int, t string")
    begin = time.time()
    got = {r.i: r.c for r in rows.select("i", tx.pack_sentences("t", 1000).alias("c")).collect()}
    assert time.time() - begin < 60
    want, chunk, size = [], [], 0
    for p in (p.strip() for p in parts):
        if size + len(p) + 2 <= 1000:
            chunk, size = [*chunk, p], size + len(p) + 2
        else:
            want, chunk, size = ([*want, ". ".join(chunk) + "."] if chunk else want), [p], len(p)
    assert got == {0: [*want, ". ".join(chunk) + "."], 1: None, 2: [""], 3: []}


def test_overlap_and_truncation(spark):
    assert one(spark, tx.word_overlap("a", "b"), a="The cat the dog", b="THE fox") == pytest.approx(100 / 3)
    assert one(spark, tx.word_overlap("a", "b"), a="", b="x") == 0.0
    assert one(spark, tx.truncate_tokens("t", 2, "left"), t=["a", "b", "c"]) == ["b", "c"]
    assert one(spark, tx.truncate_tokens("t", 5, "left"), t=["a"]) == ["a"]
    assert one(spark, tx.truncate_tokens("t", 2, "right"), t=["a", "b", "c"]) == ["a", "b"]


def test_prompts(spark):
    names = ["prompt_name", "task", "holistic_essay_score", "grade_level", "ell_status", "student_disability_status"]
    row = spark.createDataFrame([("P", "T", 5, 10, "No", "None")], names)
    want = "Prompt: P\nTask: T\nScore: 5\nStudent Grade Level: 10\nEnglish Language Learner: No\nDisability Status: None"
    assert row.select(instruction()).first()[0] == want
    assert one(spark, chat_format("i", "s", "inst"), i="do", s="go") == "<s>[INST] do [/INST] go"
    assert one(spark, chat_format("i"), i="do") == "### Instruction:\ndo\n\n### Response: "


def test_sft_labels(spark):
    df = spark.createDataFrame([("do it", "a b c")], "i string, t string")
    r = sft_sequence(df, "i", "t", 8).first()
    assert r.tokens == ["###", "Instruction:", "do", "it", "###", "Response:", "a", "b"]
    assert r.labels == ["-100"] * 5 + ["Response:", "a", "b"]
    short = sft_sequence(df, "i", "t", 3).first()
    assert short.labels == ["-100"] * 3


def test_mask_tokens_share_and_special(spark):
    df = spark.range(200).select("id", F.array_repeat(F.lit("x"), 50).alias("t"), F.array_repeat(F.lit("<s>"), 5).alias("s"))
    share = df.select(F.avg(F.size(F.filter(mask_tokens("t", 0.1, 1, "id"), lambda x: x == "<pad>")) / 50)).first()[0]
    assert 0.08 < share < 0.12
    kept = df.select(mask_tokens("s", 1.0, 1, "id", special=("<s>",)).alias("m")).distinct().collect()
    assert [r.m for r in kept] == [["<s>"] * 5]


def test_vector_functions(spark):
    rng = np.random.default_rng(0)
    a, b = rng.random(40), rng.random(40)
    b[3] = 0.0
    cols = dict(a=a.tolist(), b=b.tolist())
    want = {
        "v-add": a + b, "v-sub": a - b, "v-mul": a * b,
        "v-div": np.divide(a, b, out=np.zeros_like(a), where=b != 0),
        "v->": (a > b).astype(float), "v-<": (a < b).astype(float),
    }
    for op, w in want.items():
        assert np.allclose(one(spark, V.vector_op(op, "a", "b"), **cols), w)
    scalars = {
        "s-max": a.max(), "s-min": a.min(), "s-avg": a.mean(), "s-avg-top-25": np.sort(a)[::-1][:25].mean(),
        "s-len": 40.0, "s-var": a.var(), "s-l2": np.linalg.norm(a),
    }
    for op, w in scalars.items():
        assert one(spark, V.scalar_op(op, "a"), **cols) == pytest.approx(w, rel=1e-12)
    for q in (0.0, 0.0025, 0.25, 0.5, 0.9, 1.0):
        assert one(spark, V.quantile(F.sort_array("a"), q), **cols) == pytest.approx(np.quantile(a, q), rel=1e-12)
    assert one(spark, V.l2_normalize("v"), v=[0.0, 0.0]) == [0.0, 0.0]
    assert one(spark, V.mean(F.array().cast("array<double>"))) is None
