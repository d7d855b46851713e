"""Building blocks of the checking SQL (DuckDB dialect)."""

from __future__ import annotations

from originlens.functions.text import WS_CHARS, WS_CLASS

W = f"'{WS_CLASS}+'"


def strip(x: str) -> str:
    return f"trim({x}, '{WS_CHARS}')"


def words(x: str) -> str:
    return f"list_filter(string_split_regex({x}, {W}), lambda w: w <> '')"


def md5(seed: str, *keys: str) -> str:
    return "md5(concat_ws(':', " + ", ".join([f"'{seed}'", *[f"CAST({k} AS VARCHAR)" for k in keys]]) + "))"


def u(seed: str, *keys: str) -> str:
    return f"(CAST('0x' || substr({md5(seed, *keys)}, 1, 8) AS BIGINT)::DOUBLE / 4294967296.0::DOUBLE)"


def rand_int(lo: int, hi: int, seed: str, *keys: str) -> str:
    return f"CAST({lo} + floor({u(seed, *keys)} * {float(hi - lo + 1)}::DOUBLE) AS INTEGER)"


def rand_range(lo: float, width: float, seed: str, *keys: str) -> str:
    return f"({float(lo)}::DOUBLE + {float(width)}::DOUBLE * {u(seed, *keys)})"


def single(x: str) -> str:
    return f"CAST(CAST({x} AS FLOAT) AS DOUBLE)"


def shuffled(seed: str, key: str, groups: str = "") -> str:
    part = f"PARTITION BY {groups} " if groups else ""
    return f"row_number() OVER ({part}ORDER BY {md5(seed, key)}, {key})"


PAIRS = """pairs AS (
  SELECT 'essay_' || u.conv_id || '_var' || (u.turn // 2) AS id, u.conv_id AS essay_idx,
         CAST(u.turn // 2 AS INTEGER) AS variation_idx, u.text AS original_en, a.text AS generated_en
  FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
  WHERE u.role = 'user' AND a.role = 'assistant')"""

DETECT = f"""{PAIRS},
detect AS (
  SELECT id || '/' || is_generated AS row_id, {strip('raw')} AS text, is_generated, essay_idx, variation_idx,
         'unknown' AS source, 2020 AS year, 'unknown' AS prompt_name, essay_idx AS original_essay_idx
  FROM (SELECT id, essay_idx, original_en AS raw, 0 AS is_generated, -1 AS variation_idx FROM pairs
        UNION ALL
        SELECT id, essay_idx, generated_en, 1, variation_idx FROM pairs)
  WHERE {strip('raw')} <> '')"""

SPLIT_DETECT = f"""{DETECT},
essays AS (SELECT DISTINCT essay_idx FROM detect),
placed AS (
  SELECT essay_idx, {shuffled('42', 'essay_idx')} AS rn, count(*) OVER () AS n FROM essays),
cuts AS (
  SELECT essay_idx, rn, floor(n * 0.6::DOUBLE) AS a,
         floor(n * 0.6::DOUBLE) + floor((n - floor(n * 0.6::DOUBLE)) * 0.5::DOUBLE) AS b FROM placed),
split_detect AS (
  SELECT d.*, CASE WHEN rn <= a THEN 'train' WHEN rn <= b THEN 'val' ELSE 'test' END AS split
  FROM detect d JOIN cuts USING (essay_idx))"""

DOCS = """docs AS (
  SELECT d.doc_id, d.text, d.source AS prompt, 1 - l.quality AS y
  FROM documents d JOIN labels l ON l.doc_id = d.doc_id)"""

EMB = f"""emb AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v, CASE WHEN label < 5 THEN 1 ELSE 0 END AS y,
         CASE WHEN {u('emb', 'vec_id')} < 0.8 THEN 'train' ELSE 'query' END AS split
  FROM embeddings),
unit AS (
  SELECT vec_id, y, split,
         list_transform(v, lambda x: x / greatest(sqrt(list_dot_product(v, v)), 1e-12)) AS v FROM emb),
train AS (SELECT * FROM unit WHERE split = 'train'),
query AS (SELECT * FROM unit WHERE split = 'query')"""


def knn(name: str, train: str, query: str, k: int = 5, extra: str = "true") -> str:
    return f"""{name} AS (
  SELECT qid, tid, distance, rn FROM (
    SELECT qid, tid, distance, row_number() OVER (PARTITION BY qid ORDER BY distance, tid) AS rn
    FROM (SELECT q.vec_id AS qid, t.vec_id AS tid, round(1 - list_dot_product(q.v, t.v), 8) AS distance
          FROM {query} q JOIN {train} t ON {extra}))
  WHERE rn <= {k})"""


def knn_scored(name: str, knn_name: str, labels: str, query: str, y: str = "y") -> str:
    return f"""{name}_sum AS (
  SELECT qid, avg(distance) AS mean_distance, avg({y}::DOUBLE) AS positive_ratio
  FROM {knn_name} JOIN {labels} l ON l.vec_id = tid GROUP BY qid),
{name} AS (
  SELECT s.qid, s.mean_distance, s.positive_ratio, q.y,
         0.5::DOUBLE * ((s.mean_distance - lo) / (hi - lo + 1e-8::DOUBLE)) + 0.5::DOUBLE * s.positive_ratio AS score
  FROM {name}_sum s JOIN {query} q ON q.vec_id = s.qid,
       (SELECT min(mean_distance) AS lo, max(mean_distance) AS hi FROM {name}_sum))"""


def _cut(x: str) -> str:
    return f"floor(({x}) * 10000.0::DOUBLE)::DOUBLE / 10000.0::DOUBLE"


SCORES = f"""{DOCS},
stats AS (
  SELECT doc_id, y, CASE WHEN {u('scores', 'doc_id')} < 0.5 THEN 'val' ELSE 'test' END AS split,
         length(text)::DOUBLE AS n, length(replace(text, ',', ''))::DOUBLE AS rest,
         length(text)::DOUBLE / greatest(len({words('text')}), 1)::DOUBLE AS per_word FROM docs),
scores AS (
  SELECT doc_id, y, split, 'comma' AS model,
         {_cut('least(1.0::DOUBLE, (n - rest) * 20.0::DOUBLE / greatest(n, 1.0::DOUBLE))')} AS score FROM stats
  UNION ALL SELECT doc_id, y, split, 'length', {_cut('n / (n + 2000.0::DOUBLE)')} FROM stats
  UNION ALL SELECT doc_id, y, split, 'word', {_cut('per_word / (per_word + 5.0::DOUBLE)')} FROM stats)"""


def curve(src: str, groups: str = "model", name: str = "curve") -> str:
    """Running counts per distinct score, and precision, recall and F1 at each."""
    part = f"PARTITION BY {groups}" if groups else ""
    lead = f"{groups}, " if groups else ""
    return f"""{name}_c AS (
  SELECT {lead}score, count(*) FILTER (y = 1) AS pos, count(*) FILTER (y = 0) AS neg
  FROM {src} GROUP BY {lead}score),
{name}_t AS (
  SELECT {lead}score, pos, neg,
         sum(pos) OVER ({part} ORDER BY score DESC)::BIGINT AS tp,
         sum(neg) OVER ({part} ORDER BY score DESC)::BIGINT AS fp,
         sum(pos) OVER ({part})::BIGINT AS n_pos, sum(neg) OVER ({part})::BIGINT AS n_neg FROM {name}_c),
{name} AS (
  SELECT *, CASE WHEN tp + fp = 0 THEN 0.0::DOUBLE ELSE tp::DOUBLE / (tp + fp)::DOUBLE END AS precision,
         CASE WHEN n_pos = 0 THEN 1.0::DOUBLE ELSE tp::DOUBLE / n_pos::DOUBLE END AS recall FROM {name}_t)"""


F1_SCORE = "(2.0::DOUBLE * (precision * recall) / (precision + recall + 1e-8::DOUBLE))"


def auc(src: str, groups: str = "model", name: str = "auc") -> str:
    """AUC from average ranks, a formula of its own."""
    lead = f"{groups}, " if groups else ""
    part = f"PARTITION BY {groups} " if groups else ""
    tail = f"GROUP BY {groups}" if groups else ""
    peers = f"PARTITION BY {groups}, score" if groups else "PARTITION BY score"
    return f"""{name}_r AS (
  SELECT {lead}y, rank() OVER ({part}ORDER BY score) + (count(*) OVER ({peers}) - 1) / 2.0::DOUBLE AS r FROM {src}),
{name} AS (
  SELECT {lead}(sum(r) FILTER (y = 1) - (count(*) FILTER (y = 1)) * ((count(*) FILTER (y = 1)) + 1) / 2.0::DOUBLE)
         / nullif((count(*) FILTER (y = 1))::DOUBLE * (count(*) FILTER (y = 0))::DOUBLE, 0) AS roc_auc
  FROM {name}_r {tail})"""


def ratio(a: str, b: str) -> str:
    return f"(CASE WHEN ({b}) = 0 THEN 0.0::DOUBLE ELSE ({a})::DOUBLE / ({b})::DOUBLE END)"


RATES = f"""round({ratio('tp', 'tp + fp')}, 9) AS precision, round({ratio('tp', 'tp + fn')}, 9) AS recall,
  round({ratio('2 * tp', '2 * tp + fp + fn')}, 9) AS f1, round({ratio('tp + tn', 'tp + tn + fp + fn')}, 9) AS accuracy"""


def confusion(op: str, t: str) -> str:
    return f"""count(*) FILTER (y = 0 AND NOT (score {op} {t})) AS tn, count(*) FILTER (y = 0 AND score {op} {t}) AS fp,
  count(*) FILTER (y = 1 AND NOT (score {op} {t})) AS fn, count(*) FILTER (y = 1 AND score {op} {t}) AS tp"""


# Token probabilities: counts by GROUP BY, probabilities per token by LEFT JOIN.
GRAMS = f"""toks AS (
  SELECT doc_id, {words('text')} AS t FROM documents),
tok AS (SELECT doc_id, unnest(range(len(t))) AS pos, unnest(t) AS w FROM toks),
bi AS (
  SELECT a.w AS w1, b.w AS w2, count(*) AS c FROM tok a JOIN tok b ON b.doc_id = a.doc_id AND b.pos = a.pos + 1
  GROUP BY a.w, b.w),
tri AS (
  SELECT a.w AS w1, b.w AS w2, c.w AS w3, count(*) AS c
  FROM tok a JOIN tok b ON b.doc_id = a.doc_id AND b.pos = a.pos + 1
             JOIN tok c ON c.doc_id = a.doc_id AND c.pos = a.pos + 2
  GROUP BY a.w, b.w, c.w),
bi_ctx AS (SELECT w1, sum(c)::BIGINT AS ct, count(*) AS cf FROM bi GROUP BY w1),
tri_ctx AS (SELECT w1, w2, sum(c)::BIGINT AS ct, count(*) AS cf FROM tri GROUP BY w1, w2),
kn AS (SELECT w2 AS token, count(*) AS n_pred,
       count(*)::DOUBLE / (SELECT count(*) FROM bi)::DOUBLE AS p FROM bi GROUP BY w2)"""

TOKEN_PROBS = f"""{GRAMS},
occ AS (
  SELECT doc_id, pos, coalesce(lag(w, 2) OVER d, '') AS w1, coalesce(lag(w, 1) OVER d, '') AS w2,
         w AS w3 FROM tok WINDOW d AS (PARTITION BY doc_id ORDER BY pos)),
one AS (
  SELECT o.*, coalesce(kn.p, 1.0::DOUBLE / (SELECT count(DISTINCT w) FROM tok)::DOUBLE) AS p1, bi.c AS c2, bc.ct AS ct2, bc.cf AS cf2,
         tri.c AS c3, tc.ct AS ct3, tc.cf AS cf3
  FROM occ o LEFT JOIN kn ON kn.token = o.w3
  LEFT JOIN bi ON bi.w1 = o.w2 AND bi.w2 = o.w3 LEFT JOIN bi_ctx bc ON bc.w1 = o.w2
  LEFT JOIN tri ON tri.w1 = o.w1 AND tri.w2 = o.w2 AND tri.w3 = o.w3
  LEFT JOIN tri_ctx tc ON tc.w1 = o.w1 AND tc.w2 = o.w2),
two AS (
  SELECT *, (coalesce(c2, 0)::DOUBLE + 0.003::DOUBLE) / (coalesce(ct2, 0)::DOUBLE + 0.003::DOUBLE * (SELECT count(DISTINCT w) FROM tok)) AS laplace2,
         CASE WHEN ct2 IS NULL THEN p1 ELSE 0.9::DOUBLE * (cf2::DOUBLE / ct2::DOUBLE) * p1
           + CASE WHEN c2 IS NULL THEN 0.0::DOUBLE ELSE greatest(c2::DOUBLE - 0.9::DOUBLE, 0) / ct2::DOUBLE END END AS p2 FROM one),
token_probs AS (
  SELECT doc_id, pos, w3 AS token, p1, p2, laplace2,
         CASE WHEN ct3 IS NULL THEN p2 ELSE 0.9::DOUBLE * (cf3::DOUBLE / ct3::DOUBLE) * p2
           + CASE WHEN c3 IS NULL THEN 0.0::DOUBLE ELSE greatest(c3::DOUBLE - 0.9::DOUBLE, 0) / ct3::DOUBLE END END AS p3 FROM two)"""

PROBS = f"""{TOKEN_PROBS},
probs AS (
  SELECT doc_id, list(p2 ORDER BY pos) AS llm1, list(laplace2 ORDER BY pos) AS llm2,
         list(p3 ORDER BY pos) AS trigram, list(p1 ORDER BY pos) AS unigram FROM token_probs GROUP BY doc_id)"""
