"""N-gram language model as tables: counts are aggregates, probabilities are joins.

N-grams stay inside a document. A fitted model stores the finished probability of every seen
n-gram and the back-off weight of every seen context. Scoring then shuffles each token
occurrence once, to meet the trigram table; only unseen n-grams go on to the lower orders, as
distinct n-grams. A frequent n-gram meets one probability row, and adaptive
execution splits such a partition of occurrences over tasks.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from originlens.functions.text import words
from originlens.session import materialise

# Additive smoothing and discount. The published model takes 50257, the vocabulary of its
# tokenizer, as the number of words; here words are split at white space and counted.
BEGIN = ""  # no word is empty, so a padded n-gram never equals one of the corpus
ALPHA = 0.003
DELTA = 0.9
FLAGS = 1 << 16  #: slots for the words that targets begin with


def tokenize_corpus(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """One row per token: key, pos from 0, token."""
    return df.select(key, F.posexplode(_tokens(df, text)).alias("pos", "token"))


def _tokens(df: DataFrame, text: str) -> Column:
    """The words of a text column, or the tokens that an array column holds already."""
    return F.col(text) if isinstance(df.schema[text].dataType, T.ArrayType) else words(text)


def _w(n: int) -> list[str]:
    return [f"w{i + 1}" for i in range(n)]


def raw_counts(df: DataFrame, n: int, text: str = "text") -> DataFrame:
    """w1..wn and their count ``c``."""
    tokens = df.select(_tokens(df, text).alias("_t"))
    shifted = [F.expr(f"slice(_t, {i + 1}, greatest(size(_t) - {n - 1}, 0))").alias(f"w{i + 1}") for i in range(n)]
    rows = tokens.select(*shifted).select(F.inline(F.arrays_zip(*_w(n))))
    return rows.groupBy(*_w(n)).agg(F.count(F.lit(1)).alias("c"))


def _flags(targets: DataFrame) -> Column:
    """An array of FLAGS booleans, true at the slots of the words ``w1``."""
    slots = targets.select(_slot("w1").alias("slot")).distinct().withColumn("on", F.lit(True))
    every = targets.sparkSession.range(FLAGS).select(F.col("id").cast("int").alias("slot")).join(slots, "slot", "left")
    marked = F.sort_array(F.collect_list(F.struct("slot", F.col("on").isNotNull().alias("on"))))
    return every.agg(marked["on"].alias("f")).scalar()


def _slot(word: str) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(FLAGS)).cast("int")


def asked_bigrams(df: DataFrame, targets: DataFrame, text: str = "text") -> DataFrame:
    """w1, w2 and their count ``c`` in one pass: all bigrams whose first word is one of a target (w1, w2), as
    :func:`raw_counts` has them, and each word with a NULL ``w2`` where it is not, or where it ends a text.

    Words without a target's slot among FLAGS lose their followers before anything is shuffled. Words that share a
    slot keep theirs, so what is kept grows to all bigrams with the targets, and is whole for each of them."""
    tokens = df.select(_tokens(df, text).alias("w1")).select("w1", F.expr("slice(w1, 2, greatest(size(w1) - 1, 0))").alias("w2"))
    rows = tokens.select(F.inline(F.arrays_zip("w1", "w2")))
    asked = F.get(_flags(targets), _slot("w1"))
    return rows.select("w1", F.when(asked, F.col("w2")).alias("w2")).groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("c"))


def contexts(counts: DataFrame, n: int) -> DataFrame:
    """Total ``ctx_total`` and number of distinct followers ``ctx_followers`` of each context."""
    return counts.groupBy(*_w(n - 1)).agg(
        F.sum("c").alias("ctx_total"), F.count(F.lit(1)).alias("ctx_followers")
    )


def ngram_counts(df: DataFrame, n: int, text: str = "text") -> DataFrame:
    """Each n-gram with its count, its context's total and its context's distinct followers."""
    counts = raw_counts(df, n, text)
    if n == 1:
        return counts.withColumn("ctx_total", counts.agg(F.sum("c")).scalar()).withColumn(
            "ctx_followers", counts.agg(F.count(F.lit(1))).scalar()
        )
    return counts.join(contexts(counts, n), _w(n - 1))


def kneser_ney_unigram(bigrams: DataFrame) -> DataFrame:
    """token, ``p``: its distinct predecessors over all distinct bigrams. ``bigrams`` has one
    row per distinct (w1, w2)."""
    n_distinct = bigrams.agg(F.count(F.lit(1))).scalar().cast("double")
    by_word = bigrams.groupBy(F.col("w2").alias("token")).agg(F.count(F.lit(1)).alias("n_pred"))
    return by_word.select("token", "n_pred", (F.col("n_pred").cast("double") / n_distinct).alias("p"))


@dataclass
class NgramModel:
    """Probability tables of a training corpus, stored in the shared folder.

    ``base``: token, p. ``bigrams``: w1, w2, p1, p2, laplace2. ``trigrams``: w1, w2, w3 and the
    probabilities of the n-grams that end it. The context tables hold ``backoff``, the weight
    of the lower order for unseen followers, and for bigrams also the context's total.
    """

    base: DataFrame
    bigrams: DataFrame
    bigram_contexts: DataFrame
    trigrams: DataFrame
    trigram_contexts: DataFrame
    vocab_size: int
    alpha: float = ALPHA

    TABLES = ("base", "bigrams", "bigram_contexts", "trigrams", "trigram_contexts")

    def save(self, path: str) -> None:
        """Write the model below ``path``, which must not exist."""
        for name in self.TABLES:
            getattr(self, name).write.parquet(f"{path}/{name}")
        numbers = self.base.sparkSession.createDataFrame([(self.vocab_size, self.alpha)], "vocab_size long, alpha double")
        numbers.write.parquet(f"{path}/numbers")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> NgramModel:
        numbers = spark.read.parquet(f"{path}/numbers").first()
        return cls(*[spark.read.parquet(f"{path}/{name}") for name in cls.TABLES], numbers.vocab_size, numbers.alpha)


def occurrences(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """One row per token: its position and the trigram ending in it, after two begin tokens."""
    padded = df.select(key, F.concat(F.array(F.lit(BEGIN), F.lit(BEGIN)), _tokens(df, text)).alias("_t"))
    shifted = [F.expr(f"slice(_t, {i + 1}, size(_t) - 2)").alias(f"w{i + 1}") for i in range(3)]
    zipped = padded.select(key, *shifted).select(key, F.posexplode(F.arrays_zip("w1", "w2", "w3")).alias("pos", "g"))
    return zipped.select(key, "pos", "g.w1", "g.w2", "g.w3")


def _backoff(ctx: DataFrame, delta: float) -> DataFrame:
    """Add the share ``backoff`` of a context's probability that discounting frees."""
    followers, total = F.col("ctx_followers").cast("double"), F.col("ctx_total").cast("double")
    return ctx.withColumn("backoff", F.lit(delta) * (followers / total))


def _discounted(lower: str, delta: float) -> Column:
    """Probability of a seen n-gram from ``c``, its context and the lower order."""
    own = F.greatest(F.col("c").cast("double") - F.lit(delta), F.lit(0.0)) / F.col("ctx_total").cast("double")
    return F.col("backoff") * F.col(lower) + own


def _laplace(count: Column, total: Column, alpha: float, vocab_size: int) -> Column:
    seen, all_seen = (F.coalesce(x.cast("double"), F.lit(0.0)) for x in (count, total))
    return (seen + F.lit(alpha)) / (all_seen + F.lit(alpha * vocab_size))


def fit(
    df: DataFrame, text: str = "text", vocab_size: int | None = None, delta: float = DELTA, alpha: float = ALPHA
) -> NgramModel:
    """Probability tables from one pass over the corpus. ``vocab_size``: its distinct words if not given.

    Every token ends exactly one padded trigram, so the padded trigram counts hold the
    trigrams (no begin token) and sum up to the bigrams. Count tables are written out, as
    several joins read them.
    """
    rows = occurrences(df.withColumn("_k", F.lit(0)), "_k", text)
    padded = materialise(rows.groupBy("w1", "w2", "w3").agg(F.count(F.lit(1)).alias("c")), "ngram-counts3")
    pairs = materialise(
        padded.filter(F.col("w2") != BEGIN)
        .groupBy(F.col("w2").alias("w1"), F.col("w3").alias("w2"))
        .agg(F.sum("c").alias("c")),
        "ngram-counts2",
    )
    if vocab_size is None:
        vocab_size = max(1, padded.select("w3").distinct().count())
    triples = padded.filter(F.col("w1") != BEGIN)
    base = kneser_ney_unigram(pairs)
    ctx2, ctx3 = _backoff(contexts(pairs, 2), delta), _backoff(contexts(triples, 3), delta)
    bigrams = materialise(
        pairs.join(ctx2, "w1")
        .join(base.select(F.col("token").alias("w2"), F.col("p").alias("p1")), "w2")
        .select(
            "w1",
            "w2",
            "p1",
            _discounted("p1", delta).alias("p2"),
            _laplace(F.col("c"), F.col("ctx_total"), alpha, vocab_size).alias("laplace2"),
        ),
        "ngram-bigrams",
    )
    trigrams = materialise(
        triples.join(ctx3, ["w1", "w2"])
        .join(bigrams.toDF("w2", "w3", "p1", "p2", "laplace2"), ["w2", "w3"])
        .select("w1", "w2", "w3", "p1", "p2", "laplace2", _discounted("p2", delta).alias("p3")),
        "ngram-trigrams",
    )
    return NgramModel(base, bigrams, ctx2, trigrams, ctx3, vocab_size, alpha)


def laplace_prob(
    targets: DataFrame, counts: DataFrame, n: int, vocab_size: int, alpha: float = ALPHA
) -> DataFrame:
    """Add ``p = (c + a) / (C + a V)`` to distinct target n-grams; ``vocab_size`` is V."""
    ctx = contexts(counts, n).select(*_w(n - 1), "ctx_total")
    joined = targets.join(counts.select(*_w(n), "c"), _w(n), "left").join(ctx, _w(n - 1), "left")
    return joined.withColumn("p", _laplace(F.col("c"), F.col("ctx_total"), alpha, vocab_size)).drop("c", "ctx_total")


def backoff_bigram(targets: DataFrame, model: NgramModel) -> DataFrame:
    """Add ``p1``, ``p2`` and ``laplace2`` to distinct (w1, w2). A word never seen after another
    has ``p1 = 1 / V``; an unseen context passes the lower order on."""
    seen = model.bigrams.select("w1", "w2", F.col("p2").alias("_p2"), F.col("laplace2").alias("_l2"))
    base = model.base.select(F.col("token").alias("w2"), F.col("p").alias("_p1"))
    ctx = model.bigram_contexts.select("w1", F.col("backoff").alias("_b"), F.col("ctx_total").alias("_ct"))
    joined = targets.join(seen, ["w1", "w2"], "left").join(base, "w2", "left").join(ctx, "w1", "left")
    p1 = F.coalesce("_p1", F.lit(1.0 / model.vocab_size))
    return (
        joined.withColumn("p1", p1)
        .withColumn("p2", F.coalesce("_p2", F.coalesce("_b", F.lit(1.0)) * F.col("p1")))
        .withColumn("laplace2", F.coalesce("_l2", _laplace(F.lit(0), F.col("_ct"), model.alpha, model.vocab_size)))
        .drop("_p1", "_p2", "_l2", "_b", "_ct")
    )


def backoff_trigram(targets: DataFrame, model: NgramModel) -> DataFrame:
    """Add ``p1``, ``p2``, ``laplace2`` (of w2 w3) and ``p3`` to distinct (w1, w2, w3)."""
    pairs = targets.select(F.col("w2").alias("w1"), F.col("w3").alias("w2")).distinct()
    low = backoff_bigram(pairs, model).select(
        F.col("w1").alias("w2"), F.col("w2").alias("w3"), "p1", "p2", "laplace2"
    )
    seen = model.trigrams.select("w1", "w2", "w3", F.col("p3").alias("_p3"))
    ctx = model.trigram_contexts.select("w1", "w2", F.col("backoff").alias("_b"))
    joined = (
        targets.join(low, ["w2", "w3"]).join(seen, ["w1", "w2", "w3"], "left").join(ctx, ["w1", "w2"], "left")
    )
    return joined.withColumn("p3", F.coalesce("_p3", F.coalesce("_b", F.lit(1.0)) * F.col("p2"))).drop("_p3", "_b")


def score_documents(df: DataFrame, model: NgramModel, key: str, text: str = "text") -> DataFrame:
    """One row per token with p1 (unigram), p2 (bigram), laplace2 and p3 (trigram).

    The occurrences that met a seen trigram are done; they are written out together with the
    rest, so that the two ways on do not repeat the scan and the join."""
    grams, probs = ["w1", "w2", "w3"], ["p1", "p2", "laplace2", "p3"]
    met = materialise(occurrences(df, key, text).join(model.trigrams, grams, "left"), "ngram-occurrences")
    new = met.filter(F.col("p3").isNull()).drop(*probs)
    rest = new.join(backoff_trigram(new.select(*grams).distinct(), model), grams)
    out = [key, "pos", F.col("w3").alias("token"), *probs]
    return met.filter(F.col("p3").isNotNull()).select(*out).unionByName(rest.select(*out))


def probability_vectors(scored: DataFrame, key: str, docs: DataFrame | None = None) -> DataFrame:
    """One row per document with an ARRAY<DOUBLE> per series, in token order.

    ``docs``: all documents, by ``key``; those without a token, which have no scored row, get empty arrays."""
    rows = scored.groupBy(key).agg(
        F.sort_array(F.collect_list(F.struct("pos", "p1", "p2", "laplace2", "p3"))).alias("_r")
    )
    if docs is not None:
        rows = docs.select(key).join(rows, key, "left")
        rows = rows.withColumn("_r", F.coalesce("_r", F.array().cast(rows.schema["_r"].dataType)))
    return rows.select(
        key,
        F.col("_r.p2").alias("llm1"),
        F.col("_r.laplace2").alias("llm2"),
        F.col("_r.p3").alias("trigram"),
        F.col("_r.p1").alias("unigram"),
    )


def align_sequences(ngram: Column | str, reference: Column | str) -> Column:
    """An n-gram vector longer than the model's drops its first entry and is cut to length."""
    ng = F.col(ngram) if isinstance(ngram, str) else ngram
    ref = F.col(reference) if isinstance(reference, str) else reference
    return F.when(F.size(ng) > F.size(ref), F.slice(ng, F.lit(2), F.size(ref))).otherwise(ng)
