"""Quality classifier: a sparse ensemble of rules over text statistics.

Trees fitted on a bounded sample of labelled documents give conjunctive rules; a lasso logistic model over
rules and statistics keeps few of them; those are compiled into one Spark column expression.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from originlens.llm.common import byte_texts, crc_mod, slices, text_of
from originlens.session import materialise

STATS = [
    "log_chars", "log_words", "upper", "digit", "space", "symbol", "sentence_end", "comma", "pipe", "bang", "high",
    "chars_per_word", "words_per_line", "log_lines", "short_lines", "repeated_lines", "repeated_words",
    "top_word", "words_per_sentence", "capital_words", "symbol_words", "long_words",
]

_CLASS = np.zeros((8, 256), np.int64)
for _row, _bytes in enumerate(
    [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\n\r\x0b\x0c", b"#$%&*@^~_=+<>\\/{}[]", b".?!", b",;:", b"|", b"!"]
):
    _CLASS[_row, list(_bytes)] = 1
_SYMBOLS = tuple("#$%&*|!".encode()[i : i + 1] for i in range(7))


def statistics(text: bytes) -> list[float]:
    """The values of ``STATS`` of one whole text; shares are 0 where there is nothing to share."""
    n = len(text)
    hist = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    upper, digit, space, symbol, end, comma, pipe, bang = (_CLASS @ hist).tolist()
    chars = n - int(hist[0x80:0xC0].sum())  # continuation bytes are no characters
    words = text.split()
    lines = text.split(b"\n")
    nw, nl = len(words), len(lines)
    by_word: dict[bytes, int] = {}
    for w in words:
        by_word[w] = by_word.get(w, 0) + 1
    c, w1 = max(chars, 1), max(nw, 1)
    return [
        np.log1p(chars), np.log1p(nw), upper / c, digit / c, space / c, symbol / c, end / w1, comma / w1, pipe / w1, bang / w1,
        int(hist[0xC0:].sum()) / c, chars / w1, nw / nl, np.log1p(nl),
        sum(len(x) < 30 for x in lines) / nl, 1 - len(set(lines)) / nl, 1 - len(by_word) / w1,
        max(by_word.values(), default=0) / w1, nw / max(end, 1),
        sum(w[:1].isupper() for w in words) / w1, sum(w.endswith(_SYMBOLS) for w in words) / w1,
        sum(len(w) > 14 for w in words) / w1,
    ]


def with_statistics(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep`` and the statistics of ``text``, one double each; NULL text is empty."""
    src = docs.select(*keep, text_of("text").alias("_stat_text"))
    schema = T.StructType([*[src.schema[c] for c in keep], *[T.StructField(s, T.DoubleType()) for s in STATS]])

    def run(batches: Iterable):
        import pyarrow as pa

        for b in slices(batches):
            x = np.array([statistics(t) for t in byte_texts(b.column(b.num_columns - 1))], np.float64).reshape(b.num_rows, len(STATS))
            cols = [b.column(i) for i in range(b.num_columns - 1)] + [pa.array(x[:, i]) for i in range(len(STATS))]
            yield pa.RecordBatch.from_arrays(cols, names=[*keep, *STATS])

    return src.mapInArrow(run, schema)


@dataclass(frozen=True)
class Rule:
    """A conjunction of tests (statistic, is_above, threshold)."""

    tests: tuple[tuple[str, bool, float], ...]

    def column(self) -> Column:
        out = F.lit(True)
        for stat, above, t in self.tests:
            out = out & (F.col(stat) > t if above else F.col(stat) <= t)
        return out.cast("double")


@dataclass(frozen=True)
class RuleEnsemble:
    """Kept rules and statistics with their logistic weights."""

    intercept: float
    rules: tuple[tuple[Rule, float], ...]
    linear: tuple[tuple[str, float], ...] = ()

    def score(self) -> Column:
        """The probability of label 1 as one column expression over the statistics."""
        z = F.lit(self.intercept)
        for rule, w in self.rules:
            z = z + rule.column() * w
        for stat, w in self.linear:
            z = z + F.col(stat) * w
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def tree_rules(tree: str) -> list[Rule]:
    """All paths of a tree printed by Spark, from the root to each inner node and leaf, as rules."""
    out: list[Rule] = []
    path: list[tuple[int, tuple[str, bool, float]]] = []
    for line in tree.splitlines():
        m = re.match(r"( *)(If|Else) \(feature (\d+) (<=|>) ([-\d.eE]+)\)", line)
        if not m:
            continue
        depth = len(m[1])
        path = [p for p in path if p[0] < depth]
        path.append((depth, (STATS[int(m[3])], m[4] == ">", float(m[5]))))
        out.append(Rule(tuple(sorted(p[1] for p in path))))
    return out


def fit(labelled: DataFrame, label: str = "label", trees: int = 30, depth: int = 3, penalty: float = 0.002, seed: int = 7) -> RuleEnsemble:
    """Fit on ``labelled``: the statistics and a 0/1 label. With one class only, a constant score.

    Trees are depth-limited random forests' members of Spark ML, so rules differ; the lasso drops what
    does not help."""
    from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    n, ones = labelled.agg(F.count(label), F.coalesce(F.sum(label), F.lit(0))).first()
    if ones in (0, n):
        p = (ones + 1) / (n + 2)
        return RuleEnsemble(float(np.log(p / (1 - p))), ())
    data = VectorAssembler(inputCols=STATS, outputCol="_x").transform(labelled.select(*STATS, F.col(label).cast("double").alias("_y")))
    forest = RandomForestClassifier(
        featuresCol="_x", labelCol="_y", numTrees=trees, maxDepth=depth, minInstancesPerNode=5, subsamplingRate=0.5,
        featureSubsetStrategy="0.4", maxBins=64, seed=seed,
    ).fit(data)
    rules = sorted({r for t in forest.trees for r in tree_rules(t.toDebugString)}, key=lambda r: r.tests)
    named = data.select("_y", *STATS, *[r.column().alias(f"_r{i}") for i, r in enumerate(rules)])
    inputs = [*[f"_r{i}" for i in range(len(rules))], *STATS]
    ready = VectorAssembler(inputCols=inputs, outputCol="_x").transform(named).select("_y", "_x")
    lasso = LogisticRegression(featuresCol="_x", labelCol="_y", elasticNetParam=1.0, regParam=penalty, maxIter=60).fit(ready)
    w = lasso.coefficients.toArray()
    return RuleEnsemble(
        float(lasso.intercept),
        tuple((r, float(x)) for r, x in zip(rules, w) if x),
        tuple((s, float(x)) for s, x in zip(STATS, w[len(rules) :]) if x),
    )


def assess(
    docs: DataFrame, labels: DataFrame, modulus: int = 5, held: int = 0, threshold: float = 0.3, sample: int = 20_000
) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs`` (doc_id, text).

    ``labels``: doc_id, quality (0/1; NULL rows are left out). Learns from rows that are not held out, at
    most about ``sample`` of them, drawn by a hash of the id; scores the whole of every text. Defined
    cases: NULL text scores as the empty text; repeated rows score alike; contradicting labels of one id
    are separate rows of the fit; without any label all score 0.5; an empty table gives no rows.
    """
    marked = docs.select("doc_id", "text", (crc_mod("doc_id", modulus) == held).alias("held_out"))
    stats = materialise(with_statistics(marked, ["doc_id", "held_out"]), "statistics")
    known = labels.filter("quality IS NOT NULL").select(F.col("doc_id").alias("_id"), F.col("quality").alias("label"))
    train = stats.filter(~F.col("held_out")).join(known, F.col("doc_id") == F.col("_id"))
    n = train.count()
    share = min(1.0, sample / max(n, 1))
    draw = F.pmod(F.xxhash64(F.lit("quality"), text_of("doc_id")), F.lit(1 << 20)) / F.lit(float(1 << 20))
    model = fit(materialise(train.filter(draw < share), "quality-sample").cache().coalesce(8))
    scored = stats.select("doc_id", "held_out", model.score().alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
