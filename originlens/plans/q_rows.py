"""Row filters, unions, fan-out, overlaps and keyed joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from originlens.functions.hashing import uniform
from originlens.functions.text import WS_CHARS, words
from originlens.operators import cleaning, joins, shaping
from originlens.plans import duck, views
from originlens.plans.registry import query

# Turns of a conversation as a translation table: a source text, and a translated text that
# is missing, failed or blank for a seeded share of the rows.
_TRANSLATED = f"""tr AS (
  SELECT conv_id, turn, role, text AS src, CASE
      WHEN {duck.u('tr', 'conv_id', 'turn')} < 0.1 THEN NULL
      WHEN {duck.u('tr', 'conv_id', 'turn')} < 0.2 THEN '[Translation error: max retries exceeded]'
      WHEN {duck.u('tr', 'conv_id', 'turn')} < 0.3 THEN ''
      WHEN {duck.u('tr', 'conv_id', 'turn')} < 0.4 THEN 'Request exception can happen'
      ELSE text END AS text_en FROM conversations)"""


def _translated(spark, sf):
    r = uniform("tr", "conv_id", "turn")
    return views.table(spark, sf, "conversations").select(
        "conv_id",
        "turn",
        "role",
        F.col("text").alias("src"),
        F.when(r < 0.1, F.lit(None).cast("string"))
        .when(r < 0.2, F.lit("[Translation error: max retries exceeded]"))
        .when(r < 0.3, F.lit(""))
        .when(r < 0.4, F.lit("Request exception can happen"))
        .otherwise(F.col("text"))
        .alias("text_en"),
    )


@query("b1_drop_null_text", f"WITH {_TRANSLATED} SELECT conv_id, turn, text_en FROM tr WHERE text_en IS NOT NULL")
def b1_drop_null_text(spark, sf):
    return cleaning.drop_null_text(_translated(spark, sf), "text_en").select("conv_id", "turn", "text_en")


@query(
    "b2_valid_text",
    f"""SELECT page_id, {duck.strip("'  ' || chr(10) || regexp_replace(html, '<[^>]*>', ' ', 'g') || chr(160)")} AS text
    FROM pages WHERE {duck.strip("regexp_replace(html, '<[^>]*>', ' ', 'g')")} <> ''""",
)
def b2_valid_text(spark, sf):
    bare = F.regexp_replace("html", "<[^>]*>", " ")
    p = views.table(spark, sf, "pages").select(
        "page_id", F.concat(F.lit("  \n"), bare, F.lit(chr(160))).alias("text")
    )
    return cleaning.valid_text(p)


_OK = "coalesce(text_en IS NOT NULL AND text_en <> '' AND NOT contains(text_en, 'Translation error') AND NOT contains(text_en, 'Request exception'), false)"


@query(
    "b3_valid_translation",
    f"""WITH {_TRANSLATED}, f AS (
      SELECT role, {_OK} AS ok, trim(src, '{WS_CHARS}') <> '' AS has FROM tr)
    SELECT role, count(*) FILTER (ok) AS n_valid, count(*) FILTER (NOT ok AND has) AS n_error,
           count(*) FILTER (NOT ok AND NOT has) AS n_blank, count(*) AS n_rows FROM f GROUP BY role""",
)
def b3_valid_translation(spark, sf):
    return cleaning.translation_counts(_translated(spark, sf), "src", "text_en", ["role"])


_META = f"""meta AS (
  SELECT d.doc_id,
    CASE WHEN {duck.u('ell', 'd.doc_id')} < 0.5 THEN d.lang END AS ell_status,
    CASE WHEN l.toxic = 1 THEN 'Identified' END AS student_disability_status,
    l.quality::DOUBLE AS holistic_essay_score,
    CASE WHEN {duck.u('grade', 'd.doc_id')} < 0.5 THEN 8 + d.n_chars % 5 END AS grade_level,
    d.source AS prompt_name, d.text
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)"""


def essays(spark, sf):
    """Documents as rated essays: metadata is missing where a document has no label or a coin says so."""
    d = views.table(spark, sf, "documents")
    lab = views.table(spark, sf, "labels")
    return d.join(lab, "doc_id", "left").select(
        "doc_id",
        F.when(uniform("ell", "doc_id") < 0.5, F.col("lang")).alias("ell_status"),
        F.when(F.col("toxic") == 1, "Identified").alias("student_disability_status"),
        F.col("quality").cast("double").alias("holistic_essay_score"),
        F.when(uniform("grade", "doc_id") < 0.5, F.lit(8) + F.col("n_chars") % 5).alias("grade_level"),
        F.col("source").alias("prompt_name"),
        "text",
    )


META_SQL = _META
FILLED_SQL = f"""{_META},
filled AS (
  SELECT doc_id, text, prompt_name, coalesce(ell_status, 'Unknown') AS ell_status,
         coalesce(student_disability_status, 'Unknown') AS student_disability_status,
         coalesce(holistic_essay_score, -1) AS holistic_essay_score, coalesce(grade_level, -1) AS grade_level FROM meta)"""


@query(
    "b4_fill_metadata",
    f"WITH {FILLED_SQL} SELECT doc_id, ell_status, student_disability_status, holistic_essay_score, grade_level FROM filled",
)
def b4_fill_metadata(spark, sf):
    return cleaning.fill_metadata(essays(spark, sf)).select(
        "doc_id", "ell_status", "student_disability_status", "holistic_essay_score", "grade_level"
    )


@query(
    "b5_parse_variation_id",
    f"""WITH {duck.PAIRS}, i AS (SELECT id FROM pairs UNION ALL SELECT 'page_' || page_id FROM pages)
    SELECT id, CAST(nullif(regexp_extract(id, '^essay_(\\d+)_var(\\d+)$', 1), '') AS BIGINT) AS essay_idx,
           CAST(nullif(regexp_extract(id, '^essay_(\\d+)_var(\\d+)$', 2), '') AS INTEGER) AS variation_idx FROM i""",
)
def b5_parse_variation_id(spark, sf):
    ids = views.pairs(spark, sf).select("id")
    other = views.table(spark, sf, "pages").select(F.concat(F.lit("page_"), F.col("page_id").cast("string")).alias("id"))
    return cleaning.parse_variation_id(ids.unionByName(other))


@query(
    "b6_prompt_name_from_url",
    """SELECT page_id, CASE WHEN url IS NULL OR url = '' THEN 'Essay'
      ELSE replace(replace(string_split(url, '/')[-1], '.html', ''), '#respond', '') END AS prompt_name FROM pages""",
)
def b6_prompt_name_from_url(spark, sf):
    return views.table(spark, sf, "pages").select(
        "page_id", cleaning.prompt_name_from_url("url").alias("prompt_name")
    )


@query(
    "b7_prompt_range_filter",
    "SELECT DISTINCT CAST(substr(source, 4) AS INTEGER) AS prompt_id FROM documents WHERE CAST(substr(source, 4) AS INTEGER) <= 8",
)
def b7_prompt_range_filter(spark, sf):
    d = views.table(spark, sf, "documents").select(F.expr("cast(substr(source, 4) AS int)").alias("prompt_id"))
    return cleaning.prompt_range_filter(d)


@query(
    "b8_binarize_label",
    f"WITH {duck.SCORES} SELECT doc_id, model, CAST(score > 0.5 AS INTEGER) AS label FROM scores",
)
def b8_binarize_label(spark, sf):
    return views.scores(spark, sf).select("doc_id", "model", cleaning.binarize_label("score").alias("label"))


@query(
    "b9_first_n",
    """SELECT 'head' AS part, doc_id, n_chars FROM (SELECT * FROM documents ORDER BY n_chars DESC, doc_id LIMIT 25)
    UNION ALL SELECT 'all', doc_id, n_chars FROM documents""",
)
def b9_first_n(spark, sf):
    d = views.table(spark, sf, "documents").select("doc_id", "n_chars")
    order = [F.col("n_chars").desc(), F.col("doc_id")]
    head = cleaning.first_n(d, 25, order).withColumn("part", F.lit("head"))
    return head.unionByName(cleaning.first_n(d, -1, order).withColumn("part", F.lit("all")))


_TOKEN_ID = "CAST(CAST('0x' || substr(md5(w), 1, 8) AS BIGINT) % 50257 AS BIGINT)"


@query(
    "b10_vocab_complement",
    f"""WITH seen AS (
      SELECT DISTINCT {_TOKEN_ID} AS token_id FROM (SELECT unnest({duck.words('text')}) AS w FROM documents))
    SELECT r.range AS token_id FROM range(50257) r ANTI JOIN seen ON seen.token_id = r.range""",
)
def b10_vocab_complement(spark, sf):
    """Token ids are words hashed into the vocabulary."""
    ids = F.transform(
        words("text"), lambda w: F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("bigint") % 50257
    )
    return cleaning.vocab_complement(views.table(spark, sf, "documents").select(ids.alias("ids")), "ids", 50257)


@query("c1_build_detection_rows", f"WITH {duck.DETECT} SELECT * FROM detect")
def c1_build_detection_rows(spark, sf):
    return views.detect(spark, sf)


FAN_SQL = _FAN = f"""{duck.PAIRS},
fan AS (
  SELECT 'essay_' || k || '_var' || v AS id, k AS essay_idx, CAST(v AS INTEGER) AS variation_idx, original_en, generated_en
  FROM (SELECT essay_idx * 1000 + variation_idx AS k, unnest(range(3)) AS v, original_en, generated_en FROM pairs))"""


def fanned(spark, sf, n=3):
    p = views.pairs(spark, sf).select(
        (F.col("essay_idx") * 1000 + F.col("variation_idx")).alias("essay_idx"), "original_en", "generated_en"
    )
    return shaping.fan_out_variations(p, n)


@query(
    "c1_build_detection_rows_dedupe",
    f"""WITH {_FAN}
    SELECT 'essay_' || essay_idx || '_var0/0' AS row_id, {duck.strip('original_en')} AS text, 0 AS is_generated, essay_idx,
           -1 AS variation_idx FROM fan WHERE variation_idx = 0 AND {duck.strip('original_en')} <> ''
    UNION ALL
    SELECT id || '/1', {duck.strip('generated_en')}, 1, essay_idx, variation_idx FROM fan
    WHERE {duck.strip('generated_en')} <> ''""",
)
def c1_build_detection_rows_dedupe(spark, sf):
    rows = shaping.build_detection_rows(fanned(spark, sf), dedupe=True)
    return rows.select("row_id", "text", "is_generated", "essay_idx", "variation_idx")


_MIX = f"""{duck.DOCS},
mix AS (
  SELECT 'd' || doc_id AS id, md5(text) AS text_md5, y AS generated, prompt FROM docs
  UNION ALL SELECT 'b' || item_id, md5(text), NULL, NULL FROM benchmark
  UNION ALL SELECT 'c' || conv_id || '.' || turn, md5(text), CASE WHEN role = 'assistant' THEN 1 ELSE 0 END, role FROM conversations)"""


@query("c2_mix_sources", f"WITH {_MIX} SELECT * FROM mix")
def c2_mix_sources(spark, sf):
    d = views.docs(spark, sf).select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"),
        F.md5("text").alias("text_md5"),
        F.col("y").alias("generated"),
        "prompt",
    )
    b = views.table(spark, sf, "benchmark").select(
        F.concat(F.lit("b"), F.col("item_id").cast("string")).alias("id"), F.md5("text").alias("text_md5")
    )
    c = views.table(spark, sf, "conversations").select(
        F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("."), F.col("turn").cast("string")).alias("id"),
        F.md5("text").alias("text_md5"),
        F.when(F.col("role") == "assistant", 1).otherwise(0).alias("generated"),
        F.col("role").alias("prompt"),
    )
    return shaping.mix_sources(d, b, c)


@query("c3_fan_out_variations", f"WITH {_FAN} SELECT id, essay_idx, variation_idx FROM fan")
def c3_fan_out_variations(spark, sf):
    return fanned(spark, sf).select("id", "essay_idx", "variation_idx")


@query(
    "c4_concat_splits",
    f"WITH {duck.SPLIT_DETECT} SELECT row_id, split FROM split_detect",
)
def c4_concat_splits(spark, sf):
    from originlens.operators.sampling import group_split

    d = group_split(views.detect(spark, sf), "essay_idx", 42)
    parts = {n: d.filter(F.col("split") == n).drop("split") for n in ("train", "val", "test")}
    return shaping.concat_splits(parts).select("row_id", "split")


_HALVES = f"CASE WHEN {duck.u('half', 'doc_id')} < 0.7 THEN 'train' ELSE 'test' END"


def halves(spark, sf):
    d = views.table(spark, sf, "documents").withColumn(
        "part", F.when(uniform("half", "doc_id") < 0.7, "train").otherwise("test")
    )
    return d.filter("part = 'train'"), d.filter("part = 'test'")


@query(
    "c5_text_overlap",
    f"""WITH h AS (SELECT text, {_HALVES} AS part FROM documents)
    SELECT DISTINCT a.text FROM h a SEMI JOIN (SELECT text FROM h WHERE part = 'test') b ON a.text = b.text WHERE a.part = 'train'""",
)
def c5_text_overlap(spark, sf):
    return shaping.text_overlap(*halves(spark, sf))


@query(
    "c6_group_overlap",
    f"""WITH h AS (SELECT source, {_HALVES} AS part FROM documents)
    SELECT DISTINCT source FROM h WHERE part = 'train' INTERSECT SELECT DISTINCT source FROM h WHERE part = 'test'""",
)
def c6_group_overlap(spark, sf):
    return shaping.group_overlap(*halves(spark, sf), "source")


@query(
    "d1_attach_predictions",
    f"WITH {duck.SCORES} SELECT d.doc_id, d.prompt, d.y, s.score FROM docs d JOIN scores s USING (doc_id) WHERE s.model = 'word'",
)
def d1_attach_predictions(spark, sf):
    preds = views.scores(spark, sf).filter("model = 'word'").select("doc_id", "score")
    return joins.attach_predictions(views.doc_labels(spark, sf), preds, "doc_id")


@query(
    "d2_resume_missing",
    f"""WITH {_FAN}, done AS (SELECT id, essay_idx FROM fan WHERE {duck.u('done', 'id')} < 0.6),
    full_essays AS (SELECT essay_idx FROM done GROUP BY essay_idx HAVING count(DISTINCT id) >= 3)
    SELECT f.id, f.essay_idx, f.variation_idx FROM fan f
    WHERE f.id NOT IN (SELECT id FROM done) AND f.essay_idx NOT IN (SELECT essay_idx FROM full_essays)""",
)
def d2_resume_missing(spark, sf):
    todo = fanned(spark, sf).select("id", "essay_idx", "variation_idx")
    done = todo.filter(uniform("done", "id") < 0.6)
    return joins.resume_missing(todo, done, 3)


@query(
    "d2_skip_translated",
    f"WITH {_TRANSLATED} SELECT conv_id, turn FROM tr WHERE NOT {_OK}",
)
def d2_skip_translated(spark, sf):
    return joins.skip_translated(_translated(spark, sf), "text_en").select("conv_id", "turn")


@query(
    "d4_human_ai_pairs",
    f"""WITH {duck.DOCS},
    r AS (SELECT doc_id, prompt, y, {duck.strip('text')} AS t, {duck.shuffled('pairs', 'doc_id', 'prompt, y')} AS rn,
                 count(*) OVER (PARTITION BY prompt, y) AS n FROM docs),
    p AS (
      SELECT a.prompt, a.doc_id AS human_id, b.doc_id AS ai_id, a.t AS human, b.t AS ai
      FROM r a JOIN r b ON a.prompt = b.prompt AND a.y = 0 AND b.y = 1 AND (
        (a.n >= b.n AND b.rn = (a.rn - 1) % b.n + 1) OR (a.n < b.n AND a.rn = (b.rn - 1) % a.n + 1)))
    SELECT prompt, human_id, ai_id, md5(human) AS human, md5(ai) AS ai FROM p""",
)
def d4_human_ai_pairs(spark, sf):
    p = shaping.opposite_label_pairs(views.docs(spark, sf), "prompt", "y", "doc_id", "text", "pairs")
    return p.withColumn("human", F.md5("human")).withColumn("ai", F.md5("ai"))
