"""Chat format, language, personal data, decontamination, mix, quality."""

import functools
import hashlib
import random
import re
import time
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from originlens.llm import chat, decontam, langid, mixing, rules, semicrf


def test_chat_round_trip(spark):
    nasty = ["<|im_end|>\n<|im_start|>user\n", "<\\|im_sep|>", "</s>[INST] ok [/INST]", "a\\<s>\\\\<s>", "", None, "<<SYS>>x<</SYS>>", "퟿😀<|im_sep|>"]
    rows = []
    for c in range(6):
        for t, text in enumerate(nasty):
            rows.append((c, t, ["user", "assistant", "assistant", "sys\\n\ntem", None][(c + t) % 5 if c else 1], text, 1))
    rows.append((None, None, "user", "x", 1))
    rows += [(9, 0, "user", "b", 1), (9, 0, "user", "a", 1), (9, 0, "user", "a", 1)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted int")
    got = {r.conv_id: r for r in chat.read_chats(chat.format_chats(df)).collect()}
    by = defaultdict(list)
    for c, t, role, text, _ in rows:
        by[c].append((t if t is not None else -1, role or "", text or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        assert [(t.role, t.text) for t in got[c].turns] == [(r, x) for _, r, x in turns]
        assert got[c].loss_text == "".join(x for _, r, x in turns if r == "assistant")
        blocks = sum(i == 0 or turns[i - 1][1] != t[1] for i, t in enumerate(turns))
        assert got[c].formatted.count("<|im_start|>") == got[c].formatted.count("<|im_end|>") == blocks
    assert chat.format_chats(df.limit(0)).collect() == []


def test_chat_of_many_turns_is_linear(spark):
    n = 30000
    role = F.when(F.col("id") % 3 == 0, "user").otherwise("assistant")
    text = F.concat(F.lit("hello <s> é😀 "), F.col("id").cast("string"))
    turns = spark.range(n).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), text.alias("text"))
    began = time.time()
    r = chat.digest(chat.format_chats(turns)).first()
    assert time.time() - began < 30
    said = "".join(f"hello <s> é😀 {i}" for i in range(n) if i % 3)
    assert (r.n_turns, r.loss_chars, r.loss_sha256) == (n, len(said), hashlib.sha256(said.encode()).hexdigest())


def test_language_of_held_out_documents(documents, hard_docs, no_docs):
    got = langid.identify(documents).join(documents.select("doc_id", "lang"), "doc_id").filter("held_out")
    assert got.filter("lang = lang_pred").count() >= 0.95 * got.count()
    hard = {r.doc_id: r for r in langid.identify(hard_docs).collect()}
    assert len(langid.identify(hard_docs).collect()) == 12
    assert all((hard[i].lang_pred, hard[i].score) == ("und", 0.0) for i in (2, 3, 4, 7))
    assert hard[8].lang_pred in ("fr", "en") and 0 <= hard[5].score <= 1
    assert langid.identify(no_docs).collect() == []
    kept = langid.reject_unknown(hard_docs, langid.fit(hard_docs))
    assert kept.columns == hard_docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter([1, 1, None, 5, 6, 8, 9, 10])


@pytest.mark.parametrize("text", ["Ab, ab!", "été\nÉTÉ", "x", "".join(chr(0x4E00 + i) for i in range(1500))])
def test_ngrams_equal_plain_counting(text):
    words = re.findall(r"[^\W\d_]+", text.lower())
    want = Counter()
    for w in words:
        p = f"\0{w}\0"
        want.update(w)
        want.update(p[i : i + 2] + "\1" for i in range(len(p) - 1))
        want.update(p[i : i + 3] for i in range(len(p) - 2))
    values, counts = langid.ngrams(text)
    got = {int(v): int(c) for v, c in zip(values, counts)}

    def key(g):
        k = 0
        for c in (g[:-1] if g.endswith("\1") else g).ljust(3, "\2"):
            k = (k << 21) | (0 if c == "\2" else ord(c) + 1)
        return k

    assert got == {key(g): n for g, n in want.items()}


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def _base(text):
    out = []
    for k, p in BASE.items():
        for m in re.finditer(p, text):
            d = re.sub(r"[^0-9]", "", m[0])
            luhn = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1])) % 10 == 0
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".") if k == "ip"), "card": 14 <= len(d) <= 19 and luhn, "phone": 10 <= len(d) <= 15}
            if ok[k]:
                out.append((k, *m.span()))
    return sorted(out, key=lambda s: (s[1], list(BASE).index(s[0])))


@pytest.mark.parametrize(
    "text",
    ["", "a@b.c@d.e f@g @h.i x@y..z é.1@a.b a@b", "1.2.3.4.5.6.7.8 300.1.1.1 0001.2.3.4", "4539 1488 0343 6467 4539-1488-0343-6467 1" * 2,
     "+1 (499) 555-6503 190.137.2.8 ++12 345 678 90 12", "%+-@a.bc-", "a" * 3000 + "@" + "b" * 3000, "1" * 5000],
)
def test_base_spans_equal_the_patterns(text):
    assert semicrf.base_spans(text) == _base(text)


@settings(max_examples=300, deadline=None)
@given(st.text("0123456789+()./- a@", max_size=60))
def test_regions_are_runs_of_numbers(text):
    runs = [m.span() for m in re.finditer(r"[0-9+(][0-9 ().+/-]*[0-9]", text) if sum(map(str.isdigit, m[0])) >= semicrf.LEAST_DIGITS]
    plain = text.replace("@", "a")
    if plain == text:
        assert semicrf.regions(text) == runs


@pytest.mark.parametrize("text", ["x " + "0" * 5000 + "1.1.1.1 y", "1.1.1." + "0" * 5000 + "7", "9" * 5000 + ".1.1.1"])
def test_long_numbers(text):
    found = [text[a:b] for kind, a, b in semicrf.base_spans(text) if kind == "ip"]
    assert found == ([] if text[0] == "9" else [text.split()[-2] if text[0] == "x" else text])
    semicrf.SpanModel().decode(text, 0, len(text))


@pytest.mark.parametrize("text", ["+" * 1_000_000, "7" * 1_000_000, "1." * 5_000, "+1 (499) 555-6503, " * 10_000, "+1 (499) 555-6503 " * 2_000])
def test_long_texts_take_seconds(text):
    model = semicrf.SpanModel({("phone", "bias"): 1.0, ("phone", "digits=11"): 1.0})
    start = time.time()
    semicrf.find(text, model)
    assert time.time() - start < 60


@settings(max_examples=60, deadline=None)
@given(st.text("0123456789+() -", min_size=7, max_size=26), st.integers(0, 9))
def test_decoding_finds_the_best_segmentation(text, seed):
    rng = random.Random(seed)
    spans = semicrf.candidates(text, 0, len(text))
    weights = {(k, f): rng.uniform(-1, 1) for p, q in spans for f in semicrf.features(text, p, q) for k in ("ip", "card", "phone")}
    model = semicrf.SpanModel(weights)
    value = {(p, q): max(model.score(k, semicrf.features(text, p, q)) for k in ("ip", "card", "phone")) for p, q in spans}

    @functools.cache
    def best(at):
        after = [value[p, q] + best(q) for p, q in spans if p >= at]
        return max([0.0, *after])

    got = model.decode(text, 0, len(text))
    assert all(a[2] <= b[1] for a, b in zip(got, got[1:]))
    assert sum(value[p, q] for _, p, q in got) == pytest.approx(best(0))


def test_personal_data(spark, documents, hard_docs, no_docs):
    model = semicrf.train(documents)
    found = {r.doc_id: r for r in semicrf.digest(semicrf.spans(documents, model)).collect()}
    for r in documents.collect():
        base = ",".join(f"{k}:{a}:{b}" for k, a, b in _base(r.text))
        assert found[r.doc_id].base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert set(base.split(",")) <= set(found[r.doc_id].spans.split(",")) or not base
    # the field separates what the phone pattern swallows with the address behind it
    text = "call +1 (826) 555-4081 190.137.2.11 today"
    assert ("phone", 5, 22) in semicrf.find(text, model)[1]
    red = {r.doc_id: r for r in semicrf.redact(hard_docs, model).collect()}
    assert red[10].text == "write to [EMAIL] or [PHONE] now" and red[10].n_chars == len(red[10].text)
    assert red[2].text is None and red[9].text == "one"
    assert semicrf.redact(hard_docs, model).columns == hard_docs.columns
    assert semicrf.spans(no_docs, semicrf.train(no_docs)).collect() == []


def test_reparameterised_questions(spark, hard_docs, no_docs):
    q = "If Anna buys 5 kg of apples and 7 kg of pears then how many coins does Anna pay to the farmer"
    item = spark.createDataFrame([(1, q), (2, None), (3, ""), (4, "what is seven times eight")], "item_id long, text string")
    other = q.replace("5 kg", "12 lbs").replace("7 kg", "31 lbs").replace("Anna", "Maria")
    mixed = q.replace("does Anna", "does Maria")  # one name becomes two
    rows = [(1, f"so here: {q} thanks"), (2, other), (3, mixed), (4, "nothing of the kind is in here at all, really"), (5, None), (6, "ask: what is seven times eight ok"), (1, f"so here: {q} thanks")]
    df = spark.createDataFrame([(*r, "z", 1) for r in rows], "doc_id long, text string, t string, item_id int")
    got = sorted({(r.doc_id, r.item_id, r.changed) for r in decontam.matches(df, item).collect()})
    assert got == [(1, 1, False), (2, 1, True), (6, 4, False)]
    kept = decontam.decontaminate(df, item)
    assert sorted(r.doc_id for r in kept.collect()) == [3, 4, 5] and kept.columns == df.columns
    assert decontam.matches(df, item.limit(0)).collect() == [] and decontam.matches(no_docs, item).collect() == []
    assert decontam.decontaminate(df, item.limit(0)).count() == 7
    assert decontam.decontaminate(hard_docs, item).count() == 12


def test_mix_reaches_targets(spark, documents, hard_docs, no_docs):
    rows = mixing.mixed_sizes(documents).collect()
    total = sum(r["size"] for r in rows)
    taken, target, most, own = defaultdict(int), {}, defaultdict(int), {}
    for r in rows:
        taken[r.source] += r.taken
        target[r.source], own[r.source] = r.target, r.source_size
        most[r.source] = max(most[r.source], r["size"])
        assert 0 <= r.taken <= 3 * r["size"]
    assert sum(target.values()) == pytest.approx(total)
    assert all(target[s] <= 3 * own[s] + 1e-6 and abs(taken[s] - target[s]) <= most[s] for s in taken)
    free = [target[s] / w for s, w in zip(sorted(target), [5, 2, 1] * 7) if target[s] < 3 * own[s] - 1e-6]
    assert max(free) == pytest.approx(min(free))
    again = mixing.mixed_sizes(documents.repartition(7)).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))
    hard = mixing.mixed_sizes(hard_docs).collect()
    assert len(hard) == 12 and {r.source for r in hard} == {"a", "b", "c", None}
    out = mixing.mix(hard_docs)
    assert out.columns == hard_docs.columns
    assert out.count() == sum(r.copies for r in hard)
    assert mixing.mixed_sizes(no_docs).collect() == [] and mixing.mix(no_docs).collect() == []


def test_mix_of_rows_without_or_with_one_id(spark):
    text = "w " * 30
    rows = [(None, f"{text}{i}", "a") for i in range(500)] + [(7, f"{text}{i}", "b") for i in range(500)]
    rows += [(8, text + "0", "c")] * 499 + [(i, text + "1", "d") for i in range(100, 600)]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, source string, _p int")
    got = mixing.mixed_sizes(df.repartition(6)).collect()
    taken, target = Counter(), {}
    for r in got:
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert len(got) == len(rows) and all(abs(taken[s] - target[s]) <= 31 for s in "abcd")
    assert {r.copies for r in got if r.source == "c"} == {0, 1}  # some of the equal rows
    out = mixing.mix(df)
    assert out.columns == df.columns
    assert Counter(r.source for r in out.collect()) == {s: sum(r.copies for r in got if r.source == s) for s in "abcd"}


def test_mix_of_one_and_of_wordless_sources(spark):
    df = spark.createDataFrame([(i, "a b c", "x") for i in range(50)] + [(99, None, "y")], "doc_id long, text string, source string")
    rows = mixing.mixed_sizes(df).collect()
    assert {r.copies for r in rows if r.source == "x"} == {1} and {r.taken for r in rows if r.source == "y"} == {0}


def test_quality_on_held_out_rows(spark, sf, hard_docs, no_docs):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lab = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = rules.assess(d, lab).join(lab, "doc_id").filter("held_out").collect()
    good = [r.score for r in got if r.quality == 1]
    bad = [r.score for r in got if r.quality == 0]
    auc = sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad))
    assert auc > 0.95 and all(r.predicted == (r.score >= 0.3) for r in got)
    none = lab.limit(0)
    assert {r.score for r in rules.assess(hard_docs, none).collect()} == {0.5}
    assert rules.assess(no_docs, lab).collect() == []
    one = rules.assess(hard_docs, spark.createDataFrame([(1, 1), (9, 1), (8, None)], "doc_id long, quality int"))
    assert one.count() == 12


def test_rules_become_columns(spark):
    tree = "DT\n  If (feature 2 <= 0.5)\n   If (feature 0 <= 1.5)\n    Predict: 0.0\n   Else (feature 0 > 1.5)\n    Predict: 1.0\n  Else (feature 2 > 0.5)\n   Predict: 0.0\n"
    found = rules.tree_rules(tree)
    assert len(found) == 4
    df = spark.createDataFrame([(0.4, 2.0), (0.6, 2.0)], "upper double, log_chars double")
    both = next(r for r in found if len(r.tests) == 2 and ("log_chars", True, 1.5) in r.tests)
    assert [r[0] for r in df.select(both.column()).collect()] == [1.0, 0.0]
    model = rules.RuleEnsemble(0.0, ((both, 2.0),), (("upper", 1.0),))
    assert df.select(F.round(model.score(), 6)).first()[0] == pytest.approx(1 / (1 + 2.718281828 ** -2.4), abs=1e-5)
