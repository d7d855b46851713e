"""N-gram probabilities and features of probability sequences."""

from __future__ import annotations

from pyspark.sql import functions as F

from originlens.functions import vectors as V
from originlens.functions.hashing import uniform
from originlens.operators import features, ngram, packed, subwords
from originlens.plans import duck, views
from originlens.plans.registry import query
from originlens.plans.views import rounded, single
from originlens.session import materialise

#: Merge ranks of a public vocabulary of byte pairs.
SUBWORD_RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"


@query("g1_tokenize_corpus", f"WITH {duck.GRAMS} SELECT doc_id, CAST(pos AS INTEGER) AS pos, w AS token FROM tok")
def g1_tokenize_corpus(spark, sf):
    return ngram.tokenize_corpus(views.texts(spark, sf), "doc_id")


@query(
    "g1_subword_tokens",
    "SELECT doc_id, md5(text) AS text_md5, CAST(strlen(text) AS BIGINT) AS n_bytes, true AS known FROM documents WHERE text IS NOT NULL",
)
def g1_subword_tokens(spark, sf):
    """Subwords of a public vocabulary; joined again, they are the bytes of the text."""
    ranks = subwords.read_ranks(spark, SUBWORD_RANKS)
    t = subwords.subword_tokens(views.texts(spark, sf).filter("text is not null"), ranks)
    joined = F.encode(F.array_join("tokens", ""), "ISO-8859-1")
    known = F.coalesce(F.array_max("token_ids") < len(ranks), F.lit(True)) & (F.size("token_ids") == F.size("tokens"))
    return t.select("doc_id", F.md5(joined).alias("text_md5"), F.octet_length(joined).cast("long").alias("n_bytes"), known.alias("known"))


@query(
    "g2_ngram_counts",
    f"""WITH {duck.GRAMS}
    SELECT w1, w2, NULL AS w3, c, ct AS ctx_total, cf AS ctx_followers FROM bi JOIN bi_ctx USING (w1)
    UNION ALL SELECT w1, w2, w3, c, ct, cf FROM tri JOIN tri_ctx USING (w1, w2)""",
)
def g2_ngram_counts(spark, sf):
    g = packed.grams(views.texts(spark, sf), "doc_id").filter("c > 0")
    return g.select("w1", "w2", "w3", "c", "ctx_total", "ctx_followers")


@query(
    "g3_laplace_prob",
    f"""WITH {duck.GRAMS}, b AS (SELECT {duck.words('text')} AS t FROM benchmark),
    target AS (SELECT DISTINCT w1, w2 FROM (
      SELECT unnest(list_slice(t, 1, len(t) - 1)) AS w1, unnest(list_slice(t, 2, len(t))) AS w2 FROM b))
    SELECT w1, w2, {duck.single('(coalesce(bi.c, 0) + 0.003::DOUBLE) / (coalesce(x.ct, 0) + 0.003::DOUBLE * (SELECT count(DISTINCT w) FROM tok))')} AS p
    FROM target LEFT JOIN bi USING (w1, w2) LEFT JOIN bi_ctx x USING (w1)""",
)
def g3_laplace_prob(spark, sf):
    """Bigrams of the benchmark texts under the counts of the documents."""
    targets = ngram.raw_counts(views.table(spark, sf, "benchmark"), 2).select("w1", "w2")
    found = materialise(ngram.asked_bigrams(views.texts(spark, sf), targets), "asked-bigrams")
    words = found.select("w1").distinct().count()
    return single(ngram.laplace_prob(targets, found.filter("w2 is not null"), 2, words), "p")


@query("g4_kneser_ney_unigram", f"WITH {duck.GRAMS} SELECT token, n_pred, {duck.single('p')} AS p FROM kn")
def g4_kneser_ney_unigram(spark, sf):
    return single(ngram.kneser_ney_unigram(ngram.raw_counts(views.texts(spark, sf), 2)), "p")


@query(
    "g5_backoff_bigram",
    f"WITH {duck.TOKEN_PROBS} SELECT DISTINCT w2 AS w1, w3 AS w2, {duck.single('p1')} AS p1, {duck.single('p2')} AS p2 FROM two",
)
def g5_backoff_bigram(spark, sf):
    g = packed.grams(views.texts(spark, sf), "doc_id").filter("w3 is null")
    return single(g.select("w1", "w2", "p1", "p2"), "p1", "p2")


@query(
    "g6_backoff_trigram",
    f"""WITH {duck.TOKEN_PROBS} SELECT DISTINCT o.w1, o.w2, o.w3, {duck.single('t.p3')} AS p3
    FROM two o JOIN token_probs t USING (doc_id, pos)""",
)
def g6_backoff_trigram(spark, sf):
    g = packed.grams(views.texts(spark, sf), "doc_id").filter("w3 is not null")
    return single(g.select("w1", "w2", "w3", "p3"), "p3")


@query(
    "g7_score_documents",
    f"""WITH {duck.TOKEN_PROBS} SELECT doc_id, CAST(pos AS INTEGER) AS pos, {duck.single('p3')} AS trigram,
    {duck.single('p1')} AS unigram FROM token_probs""",
)
def g7_score_documents(spark, sf):
    d = views.texts(spark, sf)
    scored = packed.scored(packed.vectors(d, "doc_id"), "doc_id")
    out = scored.select("doc_id", "pos", F.col("p3").alias("trigram"), F.col("p1").alias("unigram"))
    return single(out, "trigram", "unigram")


@query(
    "g8_align_sequences",
    f"""WITH {duck.PROBS}, a AS (
      SELECT doc_id, trigram, list_slice(llm1, 1, greatest(len(llm1) - (doc_id % 3), 0)) AS ref FROM probs),
    s AS (SELECT doc_id, CASE WHEN len(trigram) > len(ref) THEN list_slice(trigram, 2, len(ref) + 1) ELSE trigram END AS v FROM a)
    SELECT doc_id, CAST(len(v) AS INTEGER) AS n, round(coalesce(list_sum(v), 0), 9) AS total FROM s""",
)
def g8_align_sequences(spark, sf):
    """Trigram vectors against model vectors that are up to two tokens shorter."""
    p = views.probs(spark, sf).withColumn(
        "ref", F.slice("llm1", F.lit(1), F.greatest(F.size("llm1") - (F.col("doc_id") % 3).cast("int"), F.lit(0)))
    )
    v = p.select("doc_id", ngram.align_sequences("trigram", "ref").alias("v"))
    return rounded(v.select("doc_id", F.size("v").alias("n"), V.total("v").alias("total")))


_OPS_SQL = {
    "v-add": "x[1] + x[2]",
    "v-sub": "x[1] - x[2]",
    "v-mul": "x[1] * x[2]",
    "v-div": "CASE WHEN x[2] = 0 THEN 0 ELSE x[1] / x[2] END",
    "v->": "CAST(x[1] > x[2] AS INTEGER)::DOUBLE",
    "v-<": "CAST(x[1] < x[2] AS INTEGER)::DOUBLE",
}


def _op_sql(op: str, a: str, b: str) -> str:
    return f"list_transform(list_zip({a}, {b}), lambda x: {_OPS_SQL[op]})"


_SCALARS_SQL = {
    "s-max": "list_max(v)",
    "s-min": "list_min(v)",
    "s-avg": "list_avg(v)",
    "s-avg-top-25": "list_avg(list_slice(list_reverse_sort(v), 1, 25))",
    "s-len": "len(v)::DOUBLE",
    "s-var": "list_var_pop(v)",
    "s-l2": "sqrt(list_sum(list_transform(v, lambda x: x * x)))",
}

_S1 = "\n UNION ALL ".join(
    f"SELECT doc_id, '{op}' AS op, {_op_sql(op, 'trigram', 'unigram')} AS v FROM probs" for op in V.VECTOR_OPS
)


@query(
    "s1_vector_ops",
    f"WITH {duck.PROBS}, o AS ({_S1}) SELECT doc_id, op, CAST(len(v) AS INTEGER) AS n, {duck.single('list_sum(v)')} AS total FROM o",
)
def s1_vector_ops(spark, sf):
    ops = F.array(
        *[F.struct(F.lit(o).alias("op"), V.vector_op(o, "trigram", "unigram").alias("v")) for o in V.VECTOR_OPS]
    )
    rows = views.probs(spark, sf).select("doc_id", F.inline(ops))
    return single(rows.select("doc_id", "op", F.size("v").alias("n"), V.total("v").alias("total")), "total")


_FOUR = "\n UNION ALL ".join(f"SELECT doc_id, '{n}' AS name, {c} AS v FROM probs" for n, c in features.VECTORS.items())


def _scalars(src: str) -> str:
    names = ", ".join(f"'{s}'" for s in V.SCALAR_OPS)
    values = ", ".join(_SCALARS_SQL[s] for s in V.SCALAR_OPS)
    return f"SELECT doc_id, name, unnest([{names}]) AS fn, unnest([{values}]) AS feat FROM {src}"


@query(
    "s2_scalar_ops",
    f"WITH {duck.PROBS}, o AS ({_FOUR}), f AS ({_scalars('o')}) SELECT doc_id, name || ' ' || fn AS expr, {duck.single('feat')} AS feat FROM f",
)
def s2_scalar_ops(spark, sf):
    exprs = [f"{v} {s}" for v in features.VECTORS for s in V.SCALAR_OPS]
    return single(features.symbolic_features(views.probs(spark, sf), "doc_id", exprs), "feat")


def _combos_sql(combos) -> str:
    col = features.VECTORS
    return "\n UNION ALL ".join(
        f"SELECT doc_id, '{' '.join(c)}' AS name, "
        + (col[c[0]] if len(c) == 1 else _op_sql(c[1], col[c[0]], col[c[2]]))
        + " AS v FROM probs"
        for c in combos
    )


_ALL = _combos_sql(features.vector_combinations())


@query(
    "s3_enumerate_expressions",
    f"""WITH {duck.PROBS.replace('probs AS (', 'probs AS MATERIALIZED (')}, o AS ({_ALL}), f AS ({_scalars('o')})
    SELECT name || ' ' || fn AS expr, count(*) AS n_docs, {duck.single('avg(feat)')} AS mean_feat FROM f GROUP BY name, fn""",
)
def s3_enumerate_expressions(spark, sf):
    """Every expression over every document, summarised per expression."""
    long = features.symbolic_features(views.probs(spark, sf), "doc_id", features.enumerate_expressions())
    return single(long.groupBy("expr").agg(F.count(F.lit(1)).alias("n_docs"), F.avg("feat").alias("mean_feat")), "mean_feat")


@query(
    "s4_symbolic_features",
    f"""WITH {duck.PROBS.replace('probs AS (', 'probs AS MATERIALIZED (')}, o AS ({_ALL}), f AS ({_scalars('o')})
    SELECT doc_id, name || ' ' || fn AS expr, {duck.single('feat')} AS feat FROM f""",
)
def s4_symbolic_features(spark, sf):
    """The full set of expressions; ``sample_expressions`` draws from it where fewer are wanted."""
    return single(features.symbolic_features(views.probs(spark, sf), "doc_id", features.enumerate_expressions()), "feat")


def _skip_sql(v: str) -> str:
    return f"CASE WHEN len({v}) <= 25 THEN {v} ELSE list_slice({v}, 26, len({v})) END"


def _custom_sql(scale: float) -> str:
    clip = "list_transform({v}, lambda x: least(greatest(x, 0.0001::DOUBLE), 100000.0::DOUBLE))"
    series = "\n UNION ALL ".join(
        [f"SELECT doc_id, '{s}' AS series, {s} AS v FROM skipped" for s in features.SERIES]
        + [
            f"SELECT doc_id, '{a}/{b}', list_transform(list_zip({clip.format(v=a)}, {clip.format(v=b)}), lambda x: x[1] / x[2]) FROM skipped"
            for a, b in features.RATIOS
        ]
    )
    stats = {
        "min": "list_min(v)",
        "max": "list_max(v)",
        "mean": "list_avg(v)",
        "l2": _SCALARS_SQL["s-l2"],
        "var": "list_var_pop(v)",
        "median": "list_aggregate(v, 'quantile_cont', 0.5)",
        **{
            q: f"list_aggregate(v, 'quantile_cont', {features.QUANTILES[q] * scale!r})"
            for q in ("q25", "q75", "q10", "q90")
        },
    }
    names = ", ".join(f"'{s}'" for s in features.STATISTICS)
    values = ", ".join(stats[s] for s in features.STATISTICS)
    skipped = ", ".join(f"{_skip_sql(s)} AS {s}" for s in features.SERIES)
    return f"""{duck.PROBS}, skipped AS (SELECT doc_id, {skipped} FROM probs), o AS ({series}),
    f AS (SELECT doc_id, series, unnest([{names}]) AS stat, unnest([{values}]) AS value FROM o)"""


@query(
    "s5_custom_features",
    f"WITH {_custom_sql(1.0)} SELECT doc_id, series, stat, {duck.single('value')} AS value FROM f",
)
def s5_custom_features(spark, sf):
    return single(features.custom_features(views.probs(spark, sf), "doc_id"), "value")


@query(
    "s5_custom_features_compat",
    f"WITH {_custom_sql(0.01)} SELECT doc_id, series, stat, {duck.single('value')} AS value FROM f",
)
def s5_custom_features_compat(spark, sf):
    return single(features.custom_features(views.probs(spark, sf), "doc_id", compat=True), "value")


@query(
    "s6_zscore",
    f"""WITH {_custom_sql(1.0)},
    p AS (SELECT series, stat, avg(value) AS mu, stddev_pop(value) AS sigma FROM f
          WHERE {duck.u('zs', 'doc_id')} < 0.8::DOUBLE GROUP BY series, stat)
    SELECT doc_id, series, stat, round(CASE WHEN sigma = 0 THEN 0 ELSE (value - mu) / sigma END, 5) AS z
    FROM f JOIN p USING (series, stat)""",
)
def s6_zscore(spark, sf):
    """Parameters from the train rows only. The features, which two passes read, are stored: the vectors are made once."""
    long = materialise(features.custom_features(views.probs(spark, sf), "doc_id"), "features")
    train = long.filter(uniform("zs", "doc_id") < 0.8)
    return rounded(features.zscore(long, train, ["series", "stat"]).select("doc_id", "series", "stat", "z"), 5)
