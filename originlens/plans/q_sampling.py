"""Splits, folds, samples and batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from originlens.functions.prompts import decoding_params, mask_tokens, variation_params
from originlens.functions.text import word_count
from originlens.functions.text import words
from originlens.operators import sampling
from originlens.plans import duck, views
from originlens.plans.registry import query
from originlens.plans.views import rounded
from originlens.session import materialise


@query(
    "e1_bernoulli_split",
    f"""SELECT doc_id, CASE WHEN {duck.u('detect', 'doc_id')} < 0.99::DOUBLE THEN 'train' ELSE 'valid' END AS split_99,
    CASE WHEN {duck.u('clm', 'doc_id')} < 0.98::DOUBLE THEN 'train' ELSE 'valid' END AS split_98 FROM documents""",
)
def e1_bernoulli_split(spark, sf):
    d = views.table(spark, sf, "documents").select("doc_id")
    a = sampling.bernoulli_split(d, "detect", 0.99, "doc_id").withColumnRenamed("split", "split_99")
    return sampling.bernoulli_split(a, "clm", 0.98, "doc_id").withColumnRenamed("split", "split_98")


@query("e2_group_split", f"WITH {duck.SPLIT_DETECT} SELECT row_id, essay_idx, is_generated, split FROM split_detect")
def e2_group_split(spark, sf):
    return sampling.group_split(views.detect(spark, sf), "essay_idx", 42).select(
        "row_id", "essay_idx", "is_generated", "split"
    )


@query(
    "e3_split_stats",
    f"""WITH {duck.SPLIT_DETECT}
    SELECT split, count(*) AS n_rows, count(DISTINCT essay_idx) AS n_groups, count(*) FILTER (is_generated = 0) AS n_original,
           count(*) FILTER (is_generated = 1) AS n_generated, round(avg(is_generated::DOUBLE), 9) AS generated_share
    FROM split_detect GROUP BY split""",
)
def e3_split_stats(spark, sf):
    return rounded(sampling.split_stats(sampling.group_split(views.detect(spark, sf), "essay_idx", 42)))


@query(
    "e3_variation_histogram",
    f"""WITH {duck.SPLIT_DETECT} SELECT split, variation_idx, count(*) AS n_rows FROM split_detect
    WHERE is_generated = 1 GROUP BY split, variation_idx""",
)
def e3_variation_histogram(spark, sf):
    return sampling.variation_histogram(sampling.group_split(views.detect(spark, sf), "essay_idx", 42))


@query(
    "e3_split_manifest",
    f"""WITH {duck.SPLIT_DETECT}
    SELECT split, 42 AS seed, CASE split WHEN 'train' THEN 0.6::DOUBLE ELSE 0.2::DOUBLE END AS ratio,
           count(DISTINCT essay_idx) AS n_groups, count(*) AS n_rows FROM split_detect GROUP BY split""",
)
def e3_split_manifest(spark, sf):
    return sampling.split_manifest(sampling.group_split(views.detect(spark, sf), "essay_idx", 42), 42)


@query(
    "e4_stratified_kfold",
    f"WITH {duck.DOCS} SELECT doc_id, y, CAST(({duck.shuffled('kfold', 'doc_id', 'y')} - 1) % 5 AS INTEGER) AS fold FROM docs",
)
def e4_stratified_kfold(spark, sf):
    d = views.doc_labels(spark, sf).select("doc_id", "y")
    return sampling.stratified_kfold(d, "kfold", 5, "y", "doc_id")


@query(
    "e5_holdout_permutation",
    f"""SELECT doc_id, CASE WHEN {duck.shuffled('hold', 'doc_id')} <= floor(count(*) OVER () * 0.8::DOUBLE)
    THEN 'train' ELSE 'test' END AS part FROM documents""",
)
def e5_holdout_permutation(spark, sf):
    return sampling.holdout_permutation(views.table(spark, sf, "documents").select("doc_id"), "hold", 0.8, "doc_id")


@query(
    "e6_per_class_sample",
    f"""WITH {duck.DOCS} SELECT doc_id, y FROM docs QUALIFY {duck.shuffled('refs', 'doc_id', 'y')} <= 100""",
)
def e6_per_class_sample(spark, sf):
    return sampling.per_class_sample(views.doc_labels(spark, sf).select("doc_id", "y"), 100, "refs", "y", "doc_id")


@query(
    "e7_group_id_lists",
    f"""WITH {duck.DOCS}, r AS (SELECT prompt, y, doc_id, ({duck.shuffled('0', 'doc_id', 'prompt, y')} - 1) // 1000 AS part FROM docs)
    SELECT prompt, y, part, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) AS ids FROM r GROUP BY prompt, y, part""",
)
def e7_group_id_lists(spark, sf):
    lists = sampling.group_id_lists(views.doc_labels(spark, sf), ["prompt", "y"], "doc_id")
    return lists.withColumn("ids", F.array_join(F.transform("ids", lambda i: i.cast("string")), ","))


@query(
    "e8_balanced_prompt_batches",
    f"""WITH {duck.DOCS},
    r AS (SELECT doc_id, prompt, y, ({duck.shuffled('bal', 'doc_id', 'prompt, y')} - 1) // 2 AS batch FROM docs),
    s AS (SELECT prompt, least(count(*) FILTER (y = 0), count(*) FILTER (y = 1)) // 2 AS full_batches FROM docs GROUP BY prompt)
    SELECT doc_id, prompt, y, batch FROM r JOIN s USING (prompt) WHERE batch < full_batches""",
)
def e8_balanced_prompt_batches(spark, sf):
    d = views.doc_labels(spark, sf)
    return sampling.balanced_prompt_batches(d, 4, "bal", "prompt", "y", "doc_id").select("doc_id", "prompt", "y", "batch")


@query(
    "e9_prompt_batches",
    f"""WITH {duck.DOCS},
    r AS (SELECT doc_id, prompt, ({duck.shuffled('pb', 'doc_id', 'prompt')} - 1) // 8 AS home,
                 count(*) OVER (PARTITION BY prompt) AS n FROM docs),
    m AS (SELECT *, (home + 1) * 8 <= n AND {duck.u('pb/batch', 'prompt', 'home')} < 0.8::DOUBLE AS same FROM r)
    SELECT doc_id, prompt, 'same' AS kind, prompt || '/' || home AS batch FROM m WHERE same
    UNION ALL
    SELECT doc_id, prompt, 'mixed', CAST(({duck.shuffled('pb/mixed', 'doc_id')} - 1) // 8 AS VARCHAR) FROM m WHERE NOT same""",
)
def e9_prompt_batches(spark, sf):
    d = views.doc_labels(spark, sf).select("doc_id", "prompt")
    return sampling.prompt_batches(d, 8, "pb", 0.8, "prompt", "doc_id")


@query(
    "e10_permute_labels",
    f"""WITH {duck.DOCS},
    a AS (SELECT doc_id, y, {duck.shuffled('perm/rows', 'doc_id')} AS rn FROM docs),
    b AS (SELECT y AS y_shuffled, {duck.shuffled('perm/labels', 'doc_id')} AS rn FROM docs)
    SELECT a.doc_id, a.y, b.y_shuffled FROM a JOIN b USING (rn)""",
)
def e10_permute_labels(spark, sf):
    return sampling.permute_labels(views.doc_labels(spark, sf).select("doc_id", "y"), "perm", "y", "doc_id")


@query(
    "e11_mask_tokens",
    f"""WITH t AS (SELECT doc_id, {duck.words('text')} AS w FROM documents),
    r AS (SELECT doc_id, unnest(range(len(w))) AS i, unnest(w) AS tok FROM t)
    SELECT doc_id, CAST(i AS INTEGER) AS pos,
           CASE WHEN {duck.u('mask', 'doc_id', 'i')} < 0.1::DOUBLE AND tok NOT IN ('the', 'The') THEN '<pad>' ELSE tok END AS token FROM r""",
)
def e11_mask_tokens(spark, sf):
    t = views.texts(spark, sf).select("doc_id", words("text").alias("tokens"))
    masked = mask_tokens("tokens", 0.1, "mask", "doc_id", special=("the", "The"))
    return t.select("doc_id", F.posexplode(masked).alias("pos", "token"))


@query(
    "e12_seeded_params",
    f"""WITH {duck.PAIRS} SELECT id,
    round({duck.rand_range(0.5, 1.5, 'p/temperature', 'id')}, 9) AS temperature, {duck.rand_int(128, 256, 'p/top_k', 'id')} AS top_k,
    round({duck.rand_range(0, 1, 'p/penalty_alpha', 'id')}, 9) AS penalty_alpha,
    round({duck.rand_range(1, 0.25, 'p/guidance_scale', 'id')}, 9) AS guidance_scale,
    round({duck.rand_range(0.0001, 0.0005, 'p/eta_cutoff', 'id')}, 9) AS eta_cutoff,
    round({duck.rand_range(0.6, 0.3, 'p/var_temperature', 'id')}, 9) AS var_temperature,
    round({duck.rand_range(0.2, 0.2, 'p/prefix_ratio', 'id')}, 9) AS prefix_ratio,
    {duck.rand_int(4, 6, 'p/score', 'id')} AS holistic_essay_score, {duck.rand_int(9, 11, 'p/grade', 'id')} AS grade_level FROM pairs""",
)
def e12_seeded_params(spark, sf):
    p = views.pairs(spark, sf)
    return rounded(p.select("id", *decoding_params("p", "id"), *variation_params("p", "id")))


@query(
    "e13_draw_prompts",
    f"""WITH p AS (SELECT doc_id, source, {duck.shuffled('draw/order', 'doc_id')} AS rn FROM documents),
    d AS (SELECT range AS draw, CAST(floor({duck.u('draw/draw', 'range')} * (SELECT count(*) FROM documents)::DOUBLE) + 1 AS BIGINT) AS rn
          FROM range((SELECT count(*) FROM documents)))
    SELECT draw, doc_id, source FROM d JOIN p USING (rn)""",
)
def e13_draw_prompts(spark, sf):
    """As many draws as there are prompts."""
    d = views.table(spark, sf, "documents").select("doc_id", "source")
    return sampling.draw_prompts(d, d.count(), "draw", "doc_id")


_LENGTHS = f"lens AS (SELECT doc_id, len({duck.words('text')}) AS n_tokens FROM documents)"
_BATCHES = f"""{_LENGTHS}, b AS (
  SELECT doc_id, n_tokens, (row_number() OVER (ORDER BY n_tokens, {duck.md5('len', 'doc_id')}, doc_id) - 1) // 32 AS batch FROM lens)"""


def _length_batches(spark, sf):
    d = views.texts(spark, sf).select("doc_id", word_count("text").cast("bigint").alias("n_tokens"))
    d = materialise(d, "lengths")
    return sampling.length_batches(d, 32, "len", "n_tokens", "doc_id")


@query("f13_length_batches", f"WITH {_BATCHES} SELECT doc_id, n_tokens, batch FROM b")
def f13_length_batches(spark, sf):
    return _length_batches(spark, sf).select("doc_id", "n_tokens", "batch")


@query(
    "f13_batch_padding",
    f"""WITH {_BATCHES}, m AS (
      SELECT batch, count(*) AS n_rows, CAST(ceil(max(n_tokens) / 64.0::DOUBLE) * 64 AS BIGINT) AS padded_len,
             sum(n_tokens)::BIGINT AS used FROM b GROUP BY batch)
    SELECT batch, n_rows, padded_len, padded_len * n_rows - used AS padding FROM m""",
)
def f13_batch_padding(spark, sf):
    return sampling.batch_padding(_length_batches(spark, sf))
