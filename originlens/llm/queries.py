"""Named queries of the operators over the given tables, and the DuckDB SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from originlens.llm import decontam
from originlens.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return add


@query(
    "op3_chat_format",
    r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
marked AS (
  SELECT *, row_number() OVER w AS rn, coalesce(lag(role) OVER w <> role, true) AS head,
         length(regexp_replace(text, '([<\[]\\*)(/?s>|/?INST\]|</?SYS>>|\|im_(?:start|sep|end)\|>)', '\1\\\2', 'g')) AS n
  FROM rows WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY rn)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY rn) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(n + CASE WHEN head THEN length(role) + 13 + 11 ELSE 10 END)::BIGINT AS formatted_chars
FROM marked GROUP BY conv_id""",
)
def op3_chat_format(spark, sf):
    from originlens.llm import chat

    t = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    said = F.lit("</s>[INST] ok [/INST]")
    two = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        said.alias("text"),
    )
    return chat.digest(chat.format_chats(t.unionByName(two)))


@query("op5_language")
def op5_language(spark, sf):
    from originlens.llm import langid

    return langid.identify(table(spark, sf, "documents"))


@query(
    "op9_mix",
    r"""
WITH sized AS (
  SELECT doc_id, source, md5('mix:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))) AS draw,
         len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> ''))::BIGINT AS size
  FROM documents),
src AS (
  SELECT source, sum(size)::BIGINT AS words, row_number() OVER (ORDER BY source NULLS LAST) AS no FROM sized GROUP BY source),
caps AS (
  SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][((no - 1) % 3 + 1)::INT] AS w, (words * 3)::DOUBLE AS cap FROM src),
lev AS (
  SELECT *, ((SELECT sum(words) FROM caps) - coalesce(sum(cap) OVER o, 0))::DOUBLE
            / ((SELECT sum(w) FROM caps) - coalesce(sum(w) OVER o, 0)) AS level,
         row_number() OVER (ORDER BY cap / w, no) AS i
  FROM caps WINDOW o AS (ORDER BY cap / w, no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
lam AS (SELECT level FROM lev WHERE level * w <= cap ORDER BY i LIMIT 1),
tgt AS (
  SELECT source, words, least(cap, coalesce((SELECT level FROM lam), 0) * w) AS target FROM caps),
q AS (
  SELECT *, CASE WHEN words > 0 THEN floor(target / words) ELSE 0 END AS whole,
         target - words * CASE WHEN words > 0 THEN floor(target / words) ELSE 0 END AS missing FROM tgt),
run AS (
  SELECT d.*, q.words, q.target, q.whole, q.missing,
         row_number() OVER o AS i, sum(d.size) OVER o - d.size / 2.0::DOUBLE AS reach
  FROM sized d JOIN q ON d.source IS NOT DISTINCT FROM q.source
  WINDOW o AS (PARTITION BY d.source ORDER BY d.draw ROWS UNBOUNDED PRECEDING)),
cut AS (SELECT *, min(CASE WHEN reach > missing THEN i END) OVER (PARTITION BY source) AS cut FROM run),
taken AS (
  SELECT *, (whole + CASE WHEN missing > 0 AND (cut IS NULL OR i < cut) THEN 1 ELSE 0 END)::BIGINT AS copies FROM cut)
SELECT doc_id, size, words AS source_size, round(target, 6) AS target, copies, size * copies AS taken FROM taken""",
)
def op9_mix(spark, sf):
    from originlens.llm import mixing

    m = mixing.mixed_sizes(table(spark, sf, "documents"))
    return m.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "copies", "taken")


_UNITS = ", ".join(f"'{u}'" for u in decontam.UNITS)
_TYPED = f"""list_transform(range(1, len(w) + 1), lambda i: CASE
    WHEN regexp_matches(w[i], '{decontam.NUMBER}') THEN '#num'
    WHEN i > 1 AND rtrim(lower(w[i]), '{decontam.EDGE}') IN ({_UNITS}) AND regexp_matches(w[i - 1], '{decontam.NUMBER}') THEN '#unit'
    WHEN i > 1 AND regexp_matches(w[i], '{decontam.NAME}') AND NOT regexp_matches(w[i - 1], '[.!?:]$') THEN '#name'
    ELSE rtrim(lower(w[i]), '{decontam.EDGE}') END)"""
_WORDS = r"list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '')"


@query(
    "op7_decontaminate",
    f"""
WITH dw AS (SELECT doc_id, {_WORDS} AS w FROM documents WHERE text IS NOT NULL),
iw AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE text IS NOT NULL),
dt AS (SELECT doc_id, {_TYPED} AS t, list_transform(w, lambda x: rtrim(lower(x), '{decontam.EDGE}')) AS v FROM dw),
it AS (SELECT item_id, {_TYPED} AS t, list_transform(w, lambda x: rtrim(lower(x), '{decontam.EDGE}')) AS v, len(w) AS n FROM iw),
ix AS (
  SELECT item_id, n, ipos, list_slice(t, ipos + 1, ipos + 8) AS g
  FROM (SELECT *, unnest(range(len(t) - 7)) AS ipos FROM it WHERE len(t) >= 8)
  WHERE len(list_filter(list_slice(t, ipos + 1, ipos + 8), lambda x: NOT starts_with(x, '#'))) >= 4),
dx AS (
  SELECT doc_id, pos, list_slice(t, pos + 1, pos + 8) AS g
  FROM (SELECT *, unnest(range(len(t) - 7)) AS pos FROM dt WHERE len(t) >= 8)),
hit AS (SELECT doc_id, item_id, n, ipos, pos - ipos AS diag FROM dx JOIN ix USING (g)),
cov AS (SELECT DISTINCT doc_id, item_id, n, diag, unnest(range(ipos, ipos + 8)) AS p FROM hit),
val AS (
  SELECT cov.*, it.t[p + 1] AS kind, it.v[p + 1] AS a, dt.v[p + diag + 1] AS b, starts_with(it.t[p + 1], '#') AS s
  FROM cov JOIN it USING (item_id) JOIN dt USING (doc_id)),
dg AS (
  SELECT doc_id, item_id, n, diag, count(*) AS nc, count(DISTINCT (kind, a, b)) FILTER (s) AS ns,
         count(DISTINCT (kind, a)) FILTER (s) AS na, coalesce(bool_or(a <> b) FILTER (s), false) AS changed
  FROM val GROUP BY ALL),
best AS (
  SELECT dg.doc_id, dg.item_id, dg.n, nc, (SELECT count(DISTINCT ipos) FROM hit h WHERE h.doc_id = dg.doc_id AND h.item_id = dg.item_id AND h.diag = dg.diag) AS nw,
         ns, changed
  FROM dg WHERE ns = na AND nc >= least(13, n / 2.0))
SELECT doc_id, item_id, nw::BIGINT AS n_windows, nc::BIGINT AS n_words, round(nc::DOUBLE / n::DOUBLE, 9) AS coverage,
       ns::BIGINT AS n_slots, changed
FROM best QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY nc DESC, nw DESC, ns DESC, changed) = 1""",
)
def op7_decontaminate(spark, sf):
    m = decontam.matches(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    return m.select("doc_id", "item_id", "n_windows", "n_words", F.round("coverage", 9).alias("coverage"), "n_slots", "changed")


@query("op2_near_duplicates")
def op2_near_duplicates(spark, sf):
    from originlens.llm import bagminhash

    return bagminhash.classes(table(spark, sf, "documents"))


@query("op4_simhash")
def op4_simhash(spark, sf):
    from originlens.llm import simhash

    return simhash.search(table(spark, sf, "documents").select("doc_id", "text"))


@query("op10_quality")
def op10_quality(spark, sf):
    from originlens.llm import rules

    return rules.assess(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query("op6_pii")
def op6_pii(spark, sf):
    from originlens.llm import semicrf

    d = table(spark, sf, "documents")
    return semicrf.digest(semicrf.spans(d, semicrf.train(d)))


@query("op8_repeated_passages")
def op8_repeated_passages(spark, sf):
    from originlens.llm import passages

    return passages.repeats(table(spark, sf, "documents").select("doc_id", "text"))


@query("op1_lm_score")
def op1_lm_score(spark, sf):
    from originlens.llm import lm

    return lm.score_held_out(table(spark, sf, "documents"))


@query("op13_whitening")
def op13_whitening(spark, sf):
    from originlens.llm import whitening

    return whitening.whiten(table(spark, sf, "embeddings"))


@query("op12_gray_simhash")
def op12_gray_simhash(spark, sf):
    from originlens.llm import grayindex

    return grayindex.near_duplicates(table(spark, sf, "documents").select("doc_id", "text"))


@query(
    "op11_hard_negatives",
    """
WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda c: floor(256 * c::DOUBLE)) AS x
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, list_dot_product(a.x, b.x)::BIGINT AS score
  FROM r a, r b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT p.anchor_id, positive_id, row_number() OVER w AS rank, other_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT same AND 100 * score BETWEEN 30 * positive_score AND 90 * positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other_id)
QUALIFY row_number() OVER w <= 10""",
)
def op11_hard_negatives(spark, sf):
    from originlens.llm import hardneg

    e = table(spark, sf, "embeddings")
    moved = F.when(F.pmod("vec_id", F.lit(7)) == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hardneg.mine_embeddings(e.withColumn("label", moved))
