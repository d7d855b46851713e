"""Sources and sinks: the given tables are written in each format to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from originlens.functions.prompts import decoding_params
from originlens.operators import ensembles, metrics
from originlens.operators.sampling import bernoulli_split, group_split
from originlens.plans import duck, views
from originlens.plans.registry import query
from originlens.plans.views import rounded
from originlens.session import shared_dir
from originlens.sources import readers, writers
from originlens.sources.store import PredictionStore


def _essays(spark, sf):
    d = views.docs(spark, sf)
    return d.select(
        F.col("doc_id").cast("string").alias("id"),
        F.expr("cast(substr(prompt, 4) AS int)").alias("prompt_id"),
        "text",
        F.col("y").alias("generated"),
    )


_ESSAYS = f"""WITH {duck.DOCS} SELECT CAST(doc_id AS VARCHAR) AS id, CAST(substr(prompt, 4) AS INTEGER) AS prompt_id,
md5(text) AS text_md5, y AS generated FROM docs"""


def _digest(df):
    return df.select("id", "prompt_id", F.md5("text").alias("text_md5"), "generated")


@query("a1_read_any", _ESSAYS)
def a1_read_any(spark, sf):
    """Of the documented names only ``train.csv`` is there; texts hold quotes and line breaks."""
    folder = shared_dir(spark, "essays")
    writers.write_csv(_essays(spark, sf), f"{folder}/train.csv")
    return _digest(readers.read_any(spark, [f"{folder}/{n}" for n in readers.TRAIN_NAMES], readers.ESSAYS))


@query(
    "a2_read_delimited_auto",
    f"""WITH {duck.PAIRS} SELECT md5(original_en) AS src_md5, md5(generated_en) AS en_md5, id AS source,
    CAST(2000 + essay_idx % 24 AS INTEGER) AS year, sep FROM pairs, (VALUES (';'), (',')) s(sep)""",
)
def a2_read_delimited_auto(spark, sf):
    p = views.pairs(spark, sf).select(
        F.col("original_en").alias("Текст"),
        F.col("generated_en").alias("Текст_en"),
        F.col("id").alias("Источник"),
        (F.lit(2000) + F.col("essay_idx") % 24).cast("int").alias("Год"),
    )
    out = None
    for sep in (";", ","):
        path = shared_dir(spark, "foreign")
        writers.write_csv(p, path, sep)
        part = readers.rename_foreign(readers.read_delimited_auto(spark, path, p.schema)).select(
            F.md5("text_src").alias("src_md5"), F.md5("text_en").alias("en_md5"), "source", "year", F.lit(sep).alias("sep")
        )
        out = part if out is None else out.unionByName(part)
    return out


@query("a3_read_text_dir", "SELECT CAST(item_id AS VARCHAR) AS id, md5(text || chr(10)) AS text_md5 FROM benchmark")
def a3_read_text_dir(spark, sf):
    """One file per benchmark text; the writer ends each with a line break."""
    path = shared_dir(spark, "texts")
    writers.write_text_dir(views.table(spark, sf, "benchmark"), path, "item_id", "text")
    return readers.read_text_dir(spark, path, r"item_id=([^/]+)/").select("id", F.md5("text").alias("text_md5"))


@query(
    "a4_read_token_logprobs",
    f"""WITH t AS (SELECT item_id, {duck.words('text')} AS w FROM benchmark),
    r AS (SELECT item_id, unnest(range(len(w))) AS i, unnest(w) AS tok FROM t)
    SELECT CAST(item_id AS VARCHAR) AS id, CAST(i AS INTEGER) AS pos, CASE WHEN i % 7 = 3 THEN 'ĠĠĠ' ELSE tok END AS token,
           round(exp(-length(tok)::DOUBLE / 4), 9) AS p FROM r""",
)
def a4_read_token_logprobs(spark, sf):
    """Log-probabilities fall with the length of a word; every seventh token is a blank."""
    path = shared_dir(spark, "logprobs")
    lines = F.transform(
        "tokens",
        lambda t, i: F.concat(
            F.when(i % 7 == 3, F.lit(" ")).otherwise(t), F.lit(" "), (-F.length(t).cast("double") / 4).cast("string")
        ),
    )
    t = views.benchmark_tokens(spark, sf).select("item_id", F.array_join(lines, "\n").alias("text"))
    writers.write_text_dir(t, path, "item_id", "text")
    read = readers.read_token_logprobs(spark, path, "m", pattern=r"item_id=([^/]+)/")
    return rounded(
        read.select("id", F.posexplode(F.arrays_zip("tokens", "probs")).alias("pos", "z")).select(
            "id", "pos", F.col("z.tokens").alias("token"), F.col("z.probs").alias("p")
        )
    )


@query(
    "a5_generation_json",
    f"""WITH {duck.PAIRS}, r AS (
      SELECT id, md5(original_en) AS prompt_md5, round({duck.rand_range(0.5, 1.5, 'gen/temperature', 'id')}, 9) AS temperature,
             {duck.rand_int(128, 256, 'gen/top_k', 'id')} AS top_k, generated_en FROM pairs)
    SELECT id, prompt_md5, temperature, top_k, CAST(k AS INTEGER) AS response_idx,
           md5(CASE k WHEN 0 THEN generated_en ELSE lower(generated_en) END) AS response_md5
    FROM (SELECT *, unnest(range(2)) AS k FROM r)""",
)
def a5_generation_json(spark, sf):
    path = shared_dir(spark, "generations")
    p = views.pairs(spark, sf)
    records = p.select(
        "id",
        F.col("original_en").alias("prompt"),
        *decoding_params("gen", "id"),
        F.array("generated_en", F.lower("generated_en")).alias("responses"),
    ).drop("eta_cutoff")
    writers.write_generation_json(records, path)
    flat = readers.flatten_responses(readers.read_generation_json(spark, path))
    return rounded(
        flat.select(
            "id", F.md5("prompt").alias("prompt_md5"), "temperature", "top_k", "response_idx", F.md5("response").alias("response_md5")
        )
    )


@query(
    "a6_resolve_columns",
    """SELECT doc_id AS id, md5(text) AS text_md5, source AS prompt_name, 'Writing' AS task, -1 AS score,
    lang AS ell_status FROM documents""",
)
def a6_resolve_columns(spark, sf):
    d = readers.resolve_columns(
        views.table(spark, sf, "documents"),
        {
            "id": (["doc_id"], None),
            "text": (["full_text", "text"], ""),
            "prompt_name": (["prompt_name", "source"], "Unknown"),
            "task": (["task", "discourse_type"], "Writing"),
            "score": (["holistic_essay_score", "score"], -1),
            "ell_status": (["ell_status", "lang"], "Unknown"),
        },
    )
    return d.select("id", F.md5("text").alias("text_md5"), "prompt_name", "task", "score", "ell_status")


@query(
    "a7_write_splits",
    f"""WITH {duck.SPLIT_DETECT}
    SELECT split, count(*) AS n_rows, count(DISTINCT essay_idx) AS n_groups, count(*) AS manifest_rows,
           count(DISTINCT essay_idx) AS manifest_groups, count(DISTINCT essay_idx) AS listed_groups FROM split_detect GROUP BY split""",
)
def a7_write_splits(spark, sf):
    """Counts of the files read back, beside those of the manifest."""
    path = shared_dir(spark, "splits")
    writers.write_splits(group_split(views.detect(spark, sf), "essay_idx", 42), path, 42)
    rows = spark.read.parquet(f"{path}/detection").groupBy("split").agg(
        F.count(F.lit(1)).alias("n_rows"), F.countDistinct("essay_idx").alias("n_groups")
    )
    manifest = spark.read.schema("split string, n_groups bigint, n_rows bigint").json(f"{path}/manifest").select(
        "split", F.col("n_rows").alias("manifest_rows"), F.col("n_groups").alias("manifest_groups")
    )
    groups = spark.read.parquet(f"{path}/groups").groupBy("split").agg(F.count(F.lit(1)).alias("listed_groups"))
    return rows.join(manifest, "split").join(groups, "split")


@query(
    "a8_prediction_store",
    f"""WITH {duck.SCORES} SELECT CAST(doc_id AS VARCHAR) AS id,
    CASE WHEN {duck.u('stored', 'doc_id')} < 0.5 THEN score ELSE score + 1 END AS score FROM scores WHERE model = 'word'""",
)
def a8_prediction_store(spark, sf):
    """Half of the rows are stored first; a second request computes the other half only
    (marked by adding 1) and reuses what is stored."""
    rows = views.scores(spark, sf).filter("model = 'word'").select(
        F.col("doc_id").cast("string").alias("id"), F.col("score").alias("s"), "doc_id"
    )
    store = PredictionStore(spark, shared_dir(spark, "predictions"))
    first = bernoulli_split(rows, "stored", 0.5, "doc_id", ("old", "new")).filter("split = 'old'")
    store.get(first, "word", "all", lambda d: d.select("id", F.col("s").alias("score")))
    return store.get(rows, "word", "all", lambda d: d.select("id", (F.col("s") + 1).alias("score")))


@query(
    "a9_read_preferences",
    f"WITH {duck.PAIRS} SELECT md5(original_en) AS prompt, md5(generated_en) AS chosen, md5('no: ' || generated_en) AS rejected FROM pairs",
)
def a9_read_preferences(spark, sf):
    path = shared_dir(spark, "preferences")
    views.pairs(spark, sf).select(
        F.col("original_en").alias("prompt"),
        F.col("generated_en").alias("chosen"),
        F.concat(F.lit("no: "), "generated_en").alias("rejected"),
        F.col("id").alias("dpo_id"),
        F.lit(1.0).alias("diff"),
    ).write.parquet(path)
    return readers.read_preferences(spark, path).select(*[F.md5(c).alias(c) for c in ("prompt", "chosen", "rejected")])


@query(
    "a10_write_submission",
    f"""WITH {duck.SCORES} SELECT doc_id AS id, round(sum(score) / 3, 6) AS is_generated FROM scores GROUP BY doc_id""",
)
def a10_write_submission(spark, sf):
    path = shared_dir(spark, "submission")
    mean = ensembles.weighted_average(
        views.scores(spark, sf), views.scores(spark, sf).select("model").distinct().withColumn("weight", F.lit(1.0)), "doc_id"
    )
    writers.write_submission(mean, path, "doc_id")
    return rounded(readers.read_csv(spark, path, writers.submission(mean, "doc_id").schema), 6)


@query(
    "a10_write_summary",
    f"WITH {duck.SCORES}, {duck.auc('scores')} SELECT model, round(roc_auc, 9) AS roc_auc FROM auc ORDER BY roc_auc DESC",
)
def a10_write_summary(spark, sf):
    path = shared_dir(spark, "summary")
    m = metrics.roc_auc(views.scores(spark, sf), ["model"])
    writers.write_summary(m, path)
    return rounded(writers.summary(readers.read_csv(spark, path, m.schema)))
