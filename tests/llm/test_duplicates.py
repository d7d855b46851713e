"""Near-duplicates, repeated passages and fingerprints against brute force."""

from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from originlens.llm import bagminhash as bm
from originlens.llm import components, passages, simhash


def _classes(docs, k=5, least=0.8):
    bags = {}
    for i, t in docs:
        w = (t or "").encode().lower().split()
        n = min(k, len(w))
        bags[i] = Counter(tuple(w[j : j + n]) for j in range(len(w) - n + 1)) if w else Counter()
    root = {i: i for i in bags}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    where = defaultdict(list)
    for i, b in bags.items():
        for s in b:
            where[s].append(i)
    for a, b in {p for ids in where.values() for p in combinations(sorted(ids), 2)}:
        if sum((bags[a] & bags[b]).values()) >= least * sum((bags[a] | bags[b]).values()):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: find(i) for i in bags}


def test_classes_equal_brute_force(documents):
    docs = [tuple(r) for r in documents.select("doc_id", "text").collect()]
    got = {r.doc_id: r.class_id for r in bm.classes(documents).collect()}
    assert got == _classes(docs)


def test_large_group_of_near_copies_and_unlinked_neighbours(spark):
    base = [f"w{i}" for i in range(120)]
    rows = [(0, " ".join(base))]
    rows += [(i, " ".join([*base[:110], *[f"x{i}y{j}" for j in range(i % 3)], *base[110:]])) for i in range(1, 150)]
    rows += [(1000 + i, " ".join([*base[:60], *[f"z{i}v{j}" for j in range(60)]])) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert {r.doc_id: r.class_id for r in bm.classes(df).collect()} == _classes(rows)


def test_blocks_of_a_bucket_compare_all(spark, monkeypatch):
    monkeypatch.setattr(bm, "BLOCK", 4)
    base = [f"w{i}" for i in range(80)]
    # a chain: neighbours are similar, ends are not
    rows = [(i, " ".join([*base[2 * i :], *[f"n{j}" for j in range(2 * i)]])) for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in bm.classes(df).collect()} == _classes(rows)


def test_hard_cases(hard_docs, no_docs):
    got = sorted([tuple(r) for r in bm.classes(hard_docs).collect()], key=str)
    by_id = {}
    for doc_id, class_id, size in got:
        by_id.setdefault(doc_id, (class_id, size))
    assert len(got) == 12
    assert by_id[1] == (1, 2) and by_id[6] == (5, 2)
    assert [by_id[i] for i in (2, 3, 4)] == [(2, 1), (3, 1), (4, 1)]
    assert by_id[None] == (None, 1)
    kept = bm.deduplicate(hard_docs)
    assert kept.columns == hard_docs.columns
    assert sorted(r.doc_id for r in kept.filter("doc_id is not null").collect()) == [1, 2, 3, 4, 5, 7, 8, 9, 10]
    assert bm.classes(no_docs).collect() == [] and bm.deduplicate(no_docs).collect() == []


def test_rows_are_kept_by_class_not_by_id(spark):
    t = {c: " ".join(f"{c}{i}" for i in range(40)) for c in "abcde"}
    rows = [(None, t["a"]), (None, t["b"]), (None, t["c"]), (1, t["c"]), (2, t["d"]), (2, t["e"]), (3, t["d"]), (3, t["d"])]
    kept = bm.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, kept), key=str) == sorted([rows[0], rows[1], rows[3], rows[4], rows[5]], key=str)


def test_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(5)
    x = np.arange(1, 301, dtype=np.uint64) * np.uint64(7919)
    errors = []
    for _ in range(40):
        a, b = rng.integers(0, 9, 300), rng.integers(0, 9, 300)
        bags = [(x[c > 0], c[c > 0]) for c in (a, b)]
        x = x + np.uint64(1)
        s = bm.signatures(bags)
        errors.append((s[0] == s[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum())
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.07


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}}
    assert components.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_all_long_repeats_are_found_and_nothing_else(documents):
    docs = {r.doc_id: (r.text or "").lower().split() for r in documents.collect()}
    got = passages.repeats(documents).collect()
    runs = {n: defaultdict(set) for n in (20, 49)}
    for n, seen in runs.items():
        for i, w in docs.items():
            for j in range(len(w) - n + 1):
                seen[tuple(w[j : j + n])].add(i)
    must = {i for s in runs[49].values() if len(s) > 1 for i in s}
    may = {i for s in runs[20].values() if len(s) > 1 for i in s}
    found = {r.doc_id for r in got}
    assert must <= found <= may
    assert all((r.doc_id, r.first_word) == (r.class_id, r.class_word) for r in got if not r.removed)


def test_similar_lines_and_removal(spark, hard_docs, no_docs):
    line = [f"a{i}" for i in range(60)]
    other = [*line[:30], "new", *line[31:]]
    rows = [(1, "first only\n" + " ".join(line)), (2, " ".join(other) + "\nlast only"), (3, " ".join(f"q{i}" for i in range(70)))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = passages.repeats(df).collect()
    assert {r.doc_id for r in got} == {1, 2}
    assert any(r.removed and r.end_word - r.first_word == 60 for r in got if r.doc_id == 2)
    left = {r.doc_id: r.text for r in passages.remove(df).collect()}
    assert left[1] == rows[0][1] and left[3] == rows[2][1] and left[2].split() == ["last", "only"]
    assert {r.doc_id for r in passages.repeats(hard_docs).collect()} == {5, 6}
    assert passages.remove(hard_docs).count() == 12 and passages.remove(hard_docs).columns == hard_docs.columns
    assert passages.repeats(no_docs).collect() == []


def test_whole_embedded_passages_are_reported_and_removed(spark):
    rng = np.random.default_rng(8)
    fresh = iter(range(10**9))

    def new(n):
        return [f"u{next(fresh)}" for _ in range(n)]

    rows, want = [], {}
    for case, n in enumerate([49, 55, 60, 80, 120, 300] * 3):
        passage = new(n)
        for copy in range(3):
            before = int(rng.integers(0, 70))
            i = 10 * case + copy
            rows.append((i, "\n".join([*new(before), " ".join(passage[:9]), *passage[9:], *new(int(rng.integers(0, 70)))])))
            want[i] = (before, before + n)
    # all members share the middle, later ones two different, longer passages
    x, mid, y = new(40), new(60), new(40)
    for i, (a, b) in enumerate([(new(40), new(40)), (x, new(40)), (x, new(40)), (new(40), y), (new(40), y)]):
        rows.append((1000 + i, " ".join([*a, *mid, *b])))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = defaultdict(set)
    for r in passages.repeats(df).collect():
        if r.doc_id < 1000 or (r.first_word, r.end_word) != (0, 140):  # the latter are similar lines, if any
            got[r.doc_id].add((r.first_word, r.end_word, r.class_id, r.class_word, r.removed))
    for i, (a, b) in want.items():
        lo = i - i % 10
        assert (a, b, lo, want[lo][0], i != lo) in got[i], (i, got[i])
    embedded = {i: {s[:2] + s[4:] for s in got[i]} for i in range(1000, 1005)}
    assert embedded == {
        1000: {(40, 100, False)},
        1001: {(40, 100, True), (0, 100, False)},
        1002: {(0, 100, True)},
        1003: {(40, 100, True), (40, 140, False)},
        1004: {(40, 140, True)},
    }
    left = {r.doc_id: (r.text or "").split() for r in passages.remove(df).collect()}
    texts = {i: t.split() for i, t in rows}
    assert all(left[i] == (texts[i] if i % 10 == 0 else texts[i][:a] + texts[i][b:]) for i, (a, b) in want.items())
    assert left[1002] == texts[1002][100:] and left[1004] == texts[1004][:40]


def test_cuts_follow_the_row_when_an_id_has_two_texts(spark):
    p = [f"p{i}" for i in range(60)]
    rows = [(1, " ".join(p)), (2, "a\n" + " ".join(p) + "\nb"), (2, " ".join(f"q{i}" for i in range(80)))]
    left = sorted(" ".join(r.text.split()) for r in passages.remove(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert left == sorted(["a b", rows[0][1], rows[2][1]])


def test_edited_fingerprints_equal_plain_python(documents, hard_docs, no_docs):
    import hashlib

    for docs in (documents.select("doc_id", "text"), hard_docs.filter("doc_id is not null").select("doc_id", "text").dropDuplicates(), hard_docs.limit(1)):
        rows = sorted((r.doc_id, r.text or "") for r in docs.collect())
        got = {r.doc_id: r for r in simhash.search(docs).collect()}
        assert len(got) == len(rows)
        for (i, t), (j, u) in zip(rows, rows[1:] + rows[:1]):
            h = len(t) // 2
            edited = t[: len(t) - h] + u[:h]
            g = got[i]
            assert g.n_chars == len(t) and g.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
            assert g.near_next == simhash.likeness(int(g.fingerprint, 16), int(got[j].fingerprint, 16))
            assert g.near_edited == simhash.likeness(int(g.fingerprint, 16), int(g.edited_fingerprint, 16))
    assert simhash.search(no_docs).collect() == []
    assert len(simhash.search(hard_docs).collect()) == 12


def test_block_tables_find_all_within_the_radius(spark):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, 40, dtype=np.int64)
    rows = [int(b) for b in base]
    for b in base:
        for flips in range(1, 6):
            x = int(b)
            for bit in rng.choice(63, flips, replace=False):
                x ^= 1 << int(bit)
            rows.append(x)
    df = spark.createDataFrame([(x,) for x in rows], "fp long")
    q = spark.createDataFrame([(int(b),) for b in base], "fp long")
    got = {(r.query_fp, r.fp) for r in simhash.near(q, df, 3).collect()}
    assert got == {(int(a), b) for a in base for b in set(rows) if bin(int(a) ^ b).count("1") <= 3}


def test_equal_texts_have_equal_fingerprints(documents):
    d = simhash.fingerprints(documents).join(documents.select(F.col("doc_id").alias("id"), "text"), "id")
    assert d.groupBy("text").agg(F.countDistinct("fp").alias("n")).filter("n > 1").count() == 0


@pytest.mark.parametrize("radius", [1, 3, 5])
def test_masks_cover_all_bits(radius):
    masks = simhash.block_tables(radius)
    union = 0
    for m in masks:
        union |= m
    assert union == (1 << 64) - 1


@pytest.mark.parametrize("n", [1, 2, 3, 5, 20, 31])
def test_run_hashes_are_those_of_their_words_in_order(n):
    h = np.random.default_rng(0).integers(0, 2**63, 60).astype(np.uint64)
    got = passages.run_hashes(h, n)
    assert len(got) == 61 - n and len(passages.run_hashes(h[: n - 1], n)) == 0
    again = passages.run_hashes(np.concatenate([h[7 : 7 + n], h]), n)
    assert again[0] == got[7]
    if n > 3:
        swapped = h[:n].copy()
        swapped[[1, 2]] = swapped[[2, 1]]
        assert passages.run_hashes(swapped, n)[0] != got[0]


def test_paragraphs_of_texts_hashed_together_equal_a_plain_search(documents):
    texts = [(r.text or "").encode() for r in documents.limit(150).collect()]
    numbered = [b" ".join(b"w%d" % i for i in range(n)) for n in (0, 1, 19, 20, 21, 48, 49, 50)]
    some = [b"", b" \n\n ", b"A a\tA\x0bb\r\n" * 30, b"x " * 70, *numbered, b"y" * 700_000 + b" z", *texts]
    lines, runs = ([[] for _ in some] for _ in range(2))
    for a, b in passages.paragraphs(some):
        for of, first, last, node, sig in zip(*a, strict=True):
            lines[of].append((first, last, int(node), sig))
        for of, first, last, node in zip(*b, strict=True):
            runs[of].append((first, last, int(node)))
    by_word, by_line = {}, {}
    for text, h, got, chosen in zip(some, passages.words_of(some), lines, runs, strict=True):
        words = text.lower().split()
        assert all(by_word.setdefault(w, x) == x for w, x in zip(words, h.tolist(), strict=True))
        want, at = [], 0
        for line in text.split(b"\n"):
            want.append((at, at + len(line.split())))
            at = want[-1][1]
        assert [x[:2] for x in got] == [x for x in want if x[1] - x[0] >= 20]
        for a, b, node, sig in got:
            assert by_line.setdefault(tuple(words[a:b]), (node, sig)) == (node, sig)
        g = passages.run_hashes(h).tolist() if len(h) >= 20 else []
        places = {max(range(i, min(i + 30, len(g))), key=lambda j: (-g[j], j)) for i in range(max(len(g) - 29, 1) if g else 0)}
        assert chosen == [(p, p + 20, g[p]) for p in sorted(places)]
    assert len(set(by_word.values())) == len(by_word) and len({n for n, _ in by_line.values()}) == len(by_line)


def test_equal_rows_and_a_run_in_all_documents(spark):
    run = " ".join(f"c{i}" for i in range(60))
    rows = [(1, f"{run}\n" + " ".join(f"a{i}" for i in range(240)))] * 200
    rows += [(i, " ".join([*(f"b{i}_{j}" for j in range(i % 7)), run, *(f"e{i}_{j}" for j in range(30))])) for i in range(2, 300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    runs = passages.extract(df).filter("sig IS NULL").withColumn("lo", F.struct("doc_id", "first"))
    assert passages._contexts(df, runs).count() <= 200 * 2 * runs.distinct().count()
    got = {(r.doc_id, r.first_word, r.end_word, r.removed) for r in passages.repeats(df).collect()}
    assert got >= {(i, i % 7, i % 7 + 60, True) for i in range(2, 300)} and (1, 0, 60, False) in got


def test_overlaps_of_multisets_in_slabs():
    rng = np.random.default_rng(9)
    bags = []
    for _ in range(12):
        x = np.unique(rng.integers(0, 60, 40)).astype(np.uint64)
        bags.append((x, rng.integers(1, 5, len(x)).astype(np.int64)))
    got = bm._overlaps(bags, np.arange(5), np.arange(5, 12), slab=7)
    for i in range(5):
        for j in range(5, 12):
            a, b = (dict(zip(x.tolist(), c.tolist())) for x, c in (bags[i], bags[j]))
            assert got[i, j - 5] == sum(min(a[k], b[k]) for k in a.keys() & b.keys())
