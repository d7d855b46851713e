"""Language-model scoring: a bigram model in sharded Elias-Fano tries, fitted and queried in two exchanges.

Documents become chunks of local word numbers. Words, then bigrams, go to shards packed per chunk, with
their counts in training text; a shard adds the counts of all chunks, builds its part of the model, and
answers every chunk in the order it was asked. No word or bigram occurrence is a row, no model is broadcast.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from originlens.llm.common import GOLDEN, WordHashes, byte_texts, crc_mod, drop, mix64, text_of
from originlens.llm.trie import VALUES, Trie, quantise
from originlens.session import materialise

MU = 8.0  #: weight of the unigram distribution, in tokens, under every context
CHUNK_TOKENS = 300_000  #: of a chunk, after which it is closed
SHARD_WORDS, SHARD_TOKENS = 700_000, 1_000_000  #: local words and tokens for each shard, sized for executors of 3 GB
END, BEGIN = 0, 1  #: local numbers of the end and of the context of a first word
_SPECIAL = np.array([1, 2], np.uint64)  #: their hashes


def _pack(x: np.ndarray) -> bytes:
    """Small numbers as compressed byte planes."""
    x = np.ascontiguousarray(x, "<u4")
    return zlib.compress(x.view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def _unpack(b: bytes) -> np.ndarray:
    flat = np.frombuffer(zlib.decompress(b), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(flat.T).view("<u4").ravel()


def chunks(docs: DataFrame, held: str) -> DataFrame:
    """One row per chunk of whole documents: chunk, ids, held, lens, words (hashes of its distinct words),
    tokens (their local numbers in order, an end behind each document), n_words, n_tokens.

    A chunk is closed by the document with which it reaches ``CHUNK_TOKENS``; its number is that of its
    task and its place there, and the table is written before it is used."""
    src = docs.select("doc_id", F.coalesce(F.col(held), F.lit(False)).alias("held"), text_of("text").alias("text"))
    kind = src.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterable):
        import pyarrow as pa
        from pyspark import TaskContext

        hashes = WordHashes()
        task, made = TaskContext.get().partitionId(), 0
        id_type = None

        def fresh():
            local = defaultdict()
            local.default_factory = local.__len__
            local[b"\n"], local[b"\r"]  # no words; numbers END and BEGIN
            return local, [], [], [], []

        def close(local, ids, held_, lens, tokens):
            words = np.concatenate([_SPECIAL, hashes.of(list(local)[2:])])
            row = [
                (task << 24) + made, ids, held_, lens, words.tobytes(), _pack(np.concatenate(tokens)), len(words), int(sum(lens)),
            ]
            types = [pa.int64(), pa.list_(id_type), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.int64(), pa.int64()]
            names = ["chunk", "ids", "held", "lens", "words", "tokens", "n_words", "n_tokens"]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)], names=names)

        local, ids, held_, lens, tokens = fresh()
        total = 0
        for b in batches:
            id_type = b.schema.field(0).type
            for doc_id, h, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), byte_texts(b.column(2))):
                words = text.lower().split()
                t = np.empty(len(words) + 1, np.uint32)
                t[:-1] = np.fromiter(map(local.__getitem__, words), np.uint32, len(words))
                t[-1] = END
                ids.append(doc_id), held_.append(h), lens.append(len(t)), tokens.append(t)
                total += len(t)
                if total >= CHUNK_TOKENS:
                    yield close(local, ids, held_, lens, tokens)
                    local, ids, held_, lens, tokens = fresh()
                    made, total = made + 1, 0
        if ids:
            yield close(local, ids, held_, lens, tokens)

    return src.mapInArrow(
        run,
        f"chunk bigint, ids array<{kind}>, held array<boolean>, lens array<int>, words binary, tokens binary, n_words bigint, n_tokens bigint",
    )


def _marks(held: list[bool], lens: np.ndarray) -> np.ndarray:
    """Which tokens are training text."""
    return np.repeat(~np.array(held, np.bool_), lens)


def _emit(rows: list[tuple], schema):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def _word_questions(table: DataFrame, shards: int) -> DataFrame:
    """shard, chunk, words, counts: a chunk's words in the shards of their hashes, with training counts."""

    def run(batches: Iterable):
        import pyarrow as pa

        schema = pa.schema([("shard", pa.int32()), ("chunk", pa.int64()), ("words", pa.binary()), ("counts", pa.binary())])
        for b in batches:
            for i in range(b.num_rows):
                r = b.slice(i, 1).to_pylist()[0]
                words, tokens = np.frombuffer(r["words"], np.uint64), _unpack(r["tokens"])
                train = _marks(r["held"], np.array(r["lens"]))
                counts = np.bincount(tokens[train], minlength=len(words))
                counts[BEGIN] = len(r["held"]) - sum(r["held"])
                place = (words % np.uint64(shards)).astype(np.int64)
                order = np.argsort(place, kind="stable")
                cut = np.searchsorted(place[order], np.arange(shards + 1))
                out = []
                for s in range(shards):
                    k = order[cut[s] : cut[s + 1]]
                    if len(k):
                        out.append((s, r["chunk"], words[k].tobytes(), _pack(counts[k])))
                yield _emit(out, schema)

    return table.select("chunk", "held", "lens", "words", "tokens").mapInArrow(run, "shard int, chunk bigint, words binary, counts binary")


def _count_words(shards: int):
    def run(t):
        """Totals of a shard's words; numbers for those in training text; the shard's own sums in the row of chunk -1."""
        import pyarrow as pa

        shard = t.column("shard")[0].as_py()
        parts = [np.frombuffer(x, np.uint64) for x in t.column("words").to_pylist()]
        counts = np.concatenate([_unpack(x) for x in t.column("counts").to_pylist()])
        words, back = np.unique(np.concatenate(parts), return_inverse=True)
        total = np.bincount(back, counts, len(words)).astype(np.int64)
        number = np.zeros(len(words), np.int64)  # 0: unknown
        number[total > 0] = np.arange(1, (total > 0).sum() + 1) * shards + shard
        real = (total > 0) & (words != _SPECIAL[BEGIN])
        cut = np.cumsum([0, *map(len, parts)])
        rows = [(-1, shard, None, None, int(total[real].sum()), int(real.sum()))]
        for chunk, a, b in zip(t.column("chunk").to_pylist(), cut, cut[1:]):
            i = back[a:b]
            rows.append((chunk, shard, _wide(total[i]), _wide(number[i]), None, None))
        cols = list(zip(*rows))
        types = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64()]
        return pa.table([pa.array(c, k) for c, k in zip(cols, types)], names=["chunk", "shard", "totals", "numbers", "n", "v"])

    return run


def _word_answers(r: dict, answers: list[dict], shards: int) -> tuple[np.ndarray, np.ndarray]:
    """Training counts and numbers of a chunk's words, in its own order."""
    words = np.frombuffer(r["words"], np.uint64)
    place = (words % np.uint64(shards)).astype(np.int64)
    order = np.argsort(place, kind="stable")
    totals, numbers = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
    got = sorted(answers, key=lambda x: x["shard"])
    totals[order] = np.concatenate([_unwide(x["totals"]) for x in got])
    numbers[order] = np.concatenate([_unwide(x["numbers"]) for x in got])
    return totals, numbers


def _bigrams(r: dict, totals: np.ndarray, numbers: np.ndarray, n: int, shards: int):
    """A chunk's distinct bigrams of known words: keys, which tokens have which (-1: none), training counts,
    and the shard of each.

    A context lives in one shard, unless it is so frequent that its successors fill more than one: then it
    has as many shards as its share of all tokens needs, by a rule that every chunk applies alike."""
    tokens, lens = _unpack(r["tokens"]).astype(np.int64), np.array(r["lens"])
    context = np.empty_like(tokens)
    context[1:] = tokens[:-1]
    context[np.cumsum(lens)[:-1]] = BEGIN
    context[0] = BEGIN
    known = (totals[context] > 0) & (totals[tokens] > 0)
    m = len(totals)
    keys, back = np.unique(context[known] * m + tokens[known], return_inverse=True)
    index = np.full(len(tokens), -1, np.int64)
    index[known] = back
    train = _marks(r["held"], lens)
    counts = np.bincount(index[known & train], minlength=len(keys))
    c, w = keys // m, keys % m
    ways = np.ceil(totals * (shards / max(n, 1))).astype(np.uint64)
    ways = np.maximum(ways, np.uint64(1))
    with np.errstate(over="ignore"):
        home = mix64(numbers.astype(np.uint64) * GOLDEN)
        spot = (home[c] + mix64(numbers[w].astype(np.uint64)) % ways[c]) % np.uint64(shards)
    return c, w, index, counts, spot.astype(np.int64), tokens, context


def _order(c, w, spot, numbers, shards):
    """Bigrams by shard, context number, word number; where each shard begins."""
    order = np.lexsort((numbers[w], numbers[c], spot))
    return order, np.searchsorted(spot[order], np.arange(shards + 1))


def _join_answers(table: DataFrame, answers: DataFrame, fields: str) -> DataFrame:
    got = answers.groupBy("chunk").agg(F.collect_list(F.struct(*fields.split())).alias("answers"))
    return table.join(got, "chunk", "left")


def _bigram_questions(table: DataFrame, n: int, word_shards: int, shards: int) -> DataFrame:
    """shard, chunk, contexts, context_counts, sizes, words, counts: a chunk's bigrams, grouped by context."""

    def run(batches: Iterable):
        import pyarrow as pa

        names = ["contexts", "context_counts", "sizes", "words", "counts"]
        schema = pa.schema([("shard", pa.int32()), ("chunk", pa.int64()), *[(x, pa.binary()) for x in names]])
        for b in batches:
            for i in range(b.num_rows):
                r = b.slice(i, 1).to_pylist()[0]
                totals, numbers = _unwide(r["totals"]).astype(np.int64), _unwide(r["numbers"]).astype(np.int64)
                c, w, _, counts, spot, _, _ = _bigrams(r, totals, numbers, n, shards)
                order, cut = _order(c, w, spot, numbers, shards)
                out = []
                for s in range(shards):
                    k = order[cut[s] : cut[s + 1]]
                    if not len(k):
                        continue
                    first = np.flatnonzero(np.concatenate([[True], c[k][1:] != c[k][:-1]]))
                    own = c[k][first]
                    sizes = np.diff(np.append(first, len(k)))
                    out.append((s, r["chunk"], _wide(np.diff(numbers[own], prepend=0)), _wide(totals[own]),
                                _pack(sizes), _wide(numbers[w[k]]), _pack(counts[k])))
                yield _emit(out, schema)

    return table.mapInArrow(
        run, "shard int, chunk bigint, contexts binary, context_counts binary, sizes binary, words binary, counts binary"
    )


def _wide(x: np.ndarray) -> bytes:
    """64-bit numbers as two packed halves."""
    x = x.astype(np.uint64)
    return _pack(np.concatenate([x & np.uint64(0xFFFFFFFF), x >> np.uint64(32)]))


def _unwide(b: bytes) -> np.ndarray:
    x = _unpack(b).astype(np.uint64)
    n = len(x) // 2
    return x[:n] | (x[n:] << np.uint64(32))


def _question(t, i: int):
    sizes = _unpack(t.column("sizes")[i].as_py()).astype(np.int64)
    contexts = np.repeat(np.cumsum(_unwide(t.column("contexts")[i].as_py())), sizes)
    totals = np.repeat(_unwide(t.column("context_counts")[i].as_py()), sizes)
    return contexts, totals, _unwide(t.column("words")[i].as_py()), _unpack(t.column("counts")[i].as_py())


def build_shard(context: np.ndarray, total: np.ndarray, word: np.ndarray, count: np.ndarray) -> Trie:
    """The trie of a shard from all chunks' bigrams sorted by (context, word): those of training text."""
    keep = count > 0
    c, total, w, k = context[keep], total[keep], word[keep], count[keep]
    new = np.concatenate([[True], (c[1:] != c[:-1]) | (w[1:] != w[:-1])]) if len(c) else np.zeros(0, np.bool_)
    at = np.flatnonzero(new)
    n = np.add.reduceat(k.astype(np.int64), at) if len(at) else np.zeros(0, np.int64)
    c, w, total = c[at], w[at], total[at].astype(np.float64)
    return Trie.build(c, w, n / (total + MU), MU / (total + MU))


def _answer(t):
    """Codes of every chunk's bigrams, in the order of its question. All questions are put to the trie at once,
    sorted, so that each of its spans is decoded once."""
    import pyarrow as pa

    parts = [_question(t, i) for i in range(t.num_rows)]
    cut = np.cumsum([0, *[len(p[0]) for p in parts]])
    c, total, w, k = (np.concatenate([p[j] for p in parts]) for j in range(4))
    del parts
    order = np.lexsort((w, c))
    c, w = c[order], w[order]
    trie = Trie.frombuffer(build_shard(c, total[order], w, k[order]).tobytes())
    codes = np.zeros(len(c), np.uint8)
    codes[order] = trie.lookup(c, w)
    out = [codes[a:b].tobytes() for a, b in zip(cut, cut[1:])]
    return pa.table([t.column("chunk"), t.column("shard"), pa.array(out, pa.binary())], names=["chunk", "shard", "codes"])


def _score(n: int, v: int, shards: int):
    def run(batches: Iterable):
        import pyarrow as pa

        for b in batches:
            for i in range(b.num_rows):
                r = b.slice(i, 1).to_pylist()[0]
                totals, numbers = _unwide(r["totals"]).astype(np.int64), _unwide(r["numbers"]).astype(np.int64)
                c, w, index, _, spot, tokens, context = _bigrams(r, totals, numbers, n, shards)
                order, _ = _order(c, w, spot, numbers, shards)
                codes = np.zeros(len(c), np.uint8)
                got = sorted(r["answers"] or [], key=lambda x: x["shard"])
                if got:
                    codes[order] = np.concatenate([np.frombuffer(x["codes"], np.uint8) for x in got])
                one = (totals[tokens] + 1) / float(n + v + 1)
                weight = VALUES[quantise(MU / (totals[context] + MU))]
                seen = np.where(index >= 0, VALUES[codes[np.maximum(index, 0)]] if len(codes) else 0.0, 0.0)
                lens = np.array(r["lens"])
                at = np.cumsum(lens) - lens
                score = np.add.reduceat(np.log10(seen + weight * one), at)
                base = np.add.reduceat(np.log10(one), at)
                known = np.add.reduceat((totals[tokens] > 0).astype(np.int64), at)
                ids = b.column("ids").slice(i, 1).flatten()
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(r["held"], pa.bool_()), pa.array(lens, pa.int64()), pa.array(known, pa.int64()),
                     pa.array(np.full(len(lens), n), pa.int64()), pa.array(base), pa.array(score)],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    return run


def score_corpus(docs: DataFrame, held: str) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every whole text.

    ``docs``: doc_id, text, and the boolean column ``held`` of documents the model must not learn from
    (NULL: it may). Words are ASCII-lowercased and split at white space; an end token follows each text.
    The model: P(w | v) = c(vw) / (c(v) + mu) + mu / (c(v) + mu) * P(w), where P(w) = (c(w) + 1) / (N + V + 1) is
    the base; both parts of a bigram are quantised on a grid of 32 steps per power of ten. Scores are
    sums of log10. Defined cases: a NULL or empty text is one end token; repeated rows are scored, and
    counted, each; without training text all counts are 0; an empty table gives no rows.

    Shards follow from the corpus: so many for so many words and tokens. A frequent context is dealt over
    several shards, so none grows with one word's share.
    """
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    first = materialise(chunks(docs, held), "chunks")
    words, tokens = first.agg(F.coalesce(F.sum("n_words"), F.lit(0)), F.coalesce(F.sum("n_tokens"), F.lit(0))).first()
    least = max(8, spark.sparkContext.defaultParallelism)
    word_shards, shards = max(least, -(-words // SHARD_WORDS)), max(least, -(-tokens // SHARD_TOKENS))
    answers = _word_questions(first, word_shards).groupBy("shard").applyInArrow(
        _count_words(word_shards), "chunk bigint, shard int, totals binary, numbers binary, n bigint, v bigint"
    )
    answers = materialise(answers, "word-counts")
    n, v = answers.filter("chunk = -1").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()

    def known(batches: Iterable):
        import pyarrow as pa

        for b in batches:
            for i in range(b.num_rows):
                one = b.slice(i, 1)
                r = one.select(["words", "answers"]).to_pylist()[0]
                totals, numbers = _word_answers(r, r["answers"], word_shards)
                cols = [one.column(x) for x in ("chunk", "ids", "held", "lens", "tokens")]
                cols += [pa.array([_wide(totals)], pa.binary()), pa.array([_wide(numbers)], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=["chunk", "ids", "held", "lens", "tokens", "totals", "numbers"])

    joined = _join_answers(first.select("chunk", "ids", "held", "lens", "words", "tokens"), answers.filter("chunk >= 0"), "shard totals numbers")
    second = joined.mapInArrow(
        known, f"chunk bigint, ids array<{kind}>, held array<boolean>, lens array<int>, tokens binary, totals binary, numbers binary"
    )
    second = materialise(second, "counted-chunks")
    drop(first, answers)
    codes = _bigram_questions(second.drop("ids"), n, word_shards, shards).groupBy("shard").applyInArrow(
        _answer, "chunk bigint, shard int, codes binary"
    )
    return _join_answers(second, codes, "shard codes").mapInArrow(
        _score(n, v, shards),
        f"doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double",
    )


def score_held_out(docs: DataFrame, modulus: int = 7, held: int = 2) -> DataFrame:
    """:func:`score_corpus` with the documents held out whose crc32(doc_id as text) has this remainder."""
    return score_corpus(docs.select("doc_id", "text", (crc_mod("doc_id", modulus) == held).alias("held")), "held")
