"""Text, prompt and token-sequence functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from originlens.functions import text as tx
from originlens.functions.hashing import rand_int
from originlens.functions.prompts import INSTRUCTION_LINES, chat_format, instruction, sft_sequence
from originlens.operators.cleaning import fill_metadata
from originlens.plans import duck, views
from originlens.plans.q_rows import FILLED_SQL, essays
from originlens.plans.registry import query
from originlens.plans.views import rounded

_INSTR = " || chr(10) || ".join(
    f"'{label}: ' || " + {"task": "'Writing'"}.get(col, f"CAST({col} AS VARCHAR)") for label, col in INSTRUCTION_LINES
)
_INSTR_SQL = f"{FILLED_SQL}, ins AS (SELECT doc_id, text, {_INSTR} AS instruction FROM filled)"


def _instructions(spark, sf):
    d = fill_metadata(essays(spark, sf)).withColumn("task", F.lit("Writing"))
    return d.select("doc_id", "text", instruction().alias("instruction"))


@query("f1_instruction", f"WITH {_INSTR_SQL} SELECT doc_id, instruction FROM ins")
def f1_instruction(spark, sf):
    return _instructions(spark, sf).select("doc_id", "instruction")


@query(
    "f2_chat_format",
    f"""WITH {_INSTR_SQL}
    SELECT doc_id, '### Instruction:' || chr(10) || instruction || chr(10) || chr(10) || '### Response: ' AS response_style,
           '<s>[INST] ' || instruction || ' [/INST] ' || md5(text) AS inst_style FROM ins""",
)
def f2_chat_format(spark, sf):
    d = _instructions(spark, sf)
    return d.select(
        "doc_id",
        chat_format("instruction").alias("response_style"),
        chat_format("instruction", F.md5("text"), "inst").alias("inst_style"),
    )


def _prefix_sql(w: str, n: str) -> str:
    return f"array_to_string(list_slice({w}, 1, {n}), ' ')"


@query(
    "f3_word_prefix",
    f"""WITH t AS (SELECT doc_id, {duck.words('text')} AS w FROM documents)
    SELECT doc_id, md5({_prefix_sql('w', 'greatest(10, CAST(floor(len(w)::DOUBLE * 0.3::DOUBLE) AS INTEGER))')}) AS prefix_md5,
           {_prefix_sql('w', 'greatest(10, CAST(floor(len(w)::DOUBLE * 0.01::DOUBLE) AS INTEGER))')} AS short_prefix FROM t""",
)
def f3_word_prefix(spark, sf):
    return views.table(spark, sf, "documents").select(
        "doc_id", F.md5(tx.word_prefix("text", 0.3)).alias("prefix_md5"), tx.word_prefix("text", 0.01).alias("short_prefix")
    )


@query(
    "f4_continuation_split",
    f"""WITH t AS (SELECT doc_id, {duck.words('text')} AS w FROM documents),
    c AS (SELECT *, CAST(floor(len(w)::DOUBLE * 0.6::DOUBLE) AS INTEGER) AS n FROM t)
    SELECT doc_id, md5({_prefix_sql('w', 'n')}) AS prefix_md5, md5(array_to_string(list_slice(w, n + 1, len(w)), ' ')) AS rest_md5 FROM c""",
)
def f4_continuation_split(spark, sf):
    d = views.table(spark, sf, "documents").select("doc_id", tx.continuation_split("text", 0.6).alias("c"))
    return d.select("doc_id", F.md5("c.prefix").alias("prefix_md5"), F.md5("c.rest").alias("rest_md5"))


@query(
    "f5_char_start",
    f"""SELECT doc_id, substr(text, 1, {duck.rand_int(16, 64, 'start', 'doc_id')}) AS short_start,
    substr(text, 1, {duck.rand_int(64, 128, 'start2', 'doc_id')}) AS long_start FROM documents""",
)
def f5_char_start(spark, sf):
    return views.table(spark, sf, "documents").select(
        "doc_id",
        tx.char_start("text", rand_int(16, 64, "start", "doc_id")).alias("short_start"),
        tx.char_start("text", rand_int(64, 128, "start2", "doc_id")).alias("long_start"),
    )


# Generated turns dressed as raw model output: prompt, marker, answer, end mark and a tail.
_RAW = f"""{duck.PAIRS}, raw AS (
  SELECT id, '### Instruction:' || chr(10) || original_en || chr(10) || '### Response:  ' || generated_en || '<unk> ' ||
         CASE WHEN variation_idx % 2 = 0 THEN '</s>' ELSE '<|endoftext|>' END || ' tail <unk>' AS raw, variation_idx FROM pairs)"""


@query(
    "f6_clean_response",
    f"""WITH {_RAW}, t AS (
      SELECT id, string_split(raw, '### Response:')[-1] AS tail, contains(raw, '</s>') AS closed FROM raw)
    SELECT id, replace({duck.strip("string_split(tail, CASE WHEN closed THEN '</s>' ELSE '<|endoftext|>' END)[1]")}, '<unk>', '') AS response FROM t""",
)
def f6_clean_response(spark, sf):
    p = views.pairs(spark, sf)
    end = F.when(F.col("variation_idx") % 2 == 0, "</s>").otherwise("<|endoftext|>")
    raw = F.concat(
        F.lit("### Instruction:\n"), "original_en", F.lit("\n### Response:  "), "generated_en", F.lit("<unk> "), end, F.lit(" tail <unk>")
    )
    return p.select("id", tx.clean_response(raw).alias("response"))


@query(
    "f7_detection_prompt",
    f"SELECT doc_id, md5({duck.strip('text')} || chr(10) || '###' || chr(10) || 'Is the essay generated by AI?') AS prompt_md5 FROM documents",
)
def f7_detection_prompt(spark, sf):
    return views.table(spark, sf, "documents").select("doc_id", F.md5(tx.detection_prompt("text")).alias("prompt_md5"))


# Greedy packing as a recursive walk over the sentences: a chunk number and its fill.
_PACK = f"""s AS (
  SELECT doc_id, list_filter(list_transform(string_split(translate(text, '!?', '..'), '.'), lambda x: {duck.strip('x')}), lambda x: x <> '') AS s
  FROM documents WHERE length(text) > 2000),
walk AS (
  SELECT doc_id, s, 0 AS i, 0 AS chunk, 0 AS fill FROM s
  UNION ALL
  SELECT doc_id, s, i + 1,
         CASE WHEN fill + length(s[i + 1]) + 2 <= 2000 OR i = 0 THEN chunk ELSE chunk + 1 END,
         CASE WHEN fill + length(s[i + 1]) + 2 <= 2000 THEN fill + length(s[i + 1]) + 2 ELSE length(s[i + 1]) END
  FROM walk WHERE i < len(s))"""


@query(
    "f8_pack_sentences",
    f"""WITH RECURSIVE {_PACK}
    SELECT doc_id, CAST(chunk AS INTEGER) AS pos, md5(string_agg(s[i], '. ' ORDER BY i) || '.') AS chunk_md5
    FROM walk WHERE i > 0 GROUP BY doc_id, chunk
    UNION ALL SELECT doc_id, 0, md5(text) FROM documents WHERE length(text) <= 2000""",
)
def f8_pack_sentences(spark, sf):
    d = views.table(spark, sf, "documents")
    return d.select("doc_id", F.posexplode(tx.pack_sentences("text", 2000)).alias("pos", "chunk")).select(
        "doc_id", "pos", F.md5("chunk").alias("chunk_md5")
    )


@query(
    "f9_word_overlap",
    f"""WITH {duck.PAIRS}, w AS (
      SELECT id, list_distinct({duck.words('lower(original_en)')}) AS a, list_distinct({duck.words('lower(generated_en)')}) AS b FROM pairs)
    SELECT id, round(len(list_intersect(a, b))::DOUBLE / greatest(len(a), 1) * 100, 6) AS overlap FROM w""",
)
def f9_word_overlap(spark, sf):
    p = views.pairs(spark, sf)
    return rounded(p.select("id", tx.word_overlap("original_en", "generated_en").alias("overlap")), 6)


@query(
    "f10_text_lengths",
    f"SELECT doc_id, CAST(length(text) AS INTEGER) AS n_chars, CAST(len({duck.words('text')}) AS INTEGER) AS n_words FROM documents",
)
def f10_text_lengths(spark, sf):
    return views.table(spark, sf, "documents").select("doc_id", *tx.lengths("text"))


@query(
    "f11_sft_labels",
    f"""WITH {_INSTR_SQL}, t AS (
      SELECT doc_id, {duck.words("'### Instruction:' || chr(10) || instruction || chr(10) || chr(10) || '### Response: '")} AS src,
             {duck.words("text || ' </s>'")} AS tgt FROM ins),
    c AS (SELECT doc_id, len(src) AS n_src, list_slice(list_concat(src, tgt), 1, 256) AS tok FROM t)
    SELECT doc_id, CAST(len(tok) AS INTEGER) AS n_tokens, md5(array_to_string(tok, ' ')) AS tokens_md5,
           md5(array_to_string(list_concat(list_transform(list_slice(tok, 1, n_src - 1), lambda x: '-100'), list_slice(tok, n_src, len(tok))), ' ')) AS labels_md5
    FROM c""",
)
def f11_sft_labels(spark, sf):
    s = sft_sequence(_instructions(spark, sf), "instruction", "text", 256)
    return s.select(
        "doc_id",
        F.size("tokens").alias("n_tokens"),
        F.md5(F.array_join("tokens", " ")).alias("tokens_md5"),
        F.md5(F.array_join("labels", " ")).alias("labels_md5"),
    )


@query(
    "f12_truncate_tokens",
    f"""WITH t AS (SELECT doc_id, {duck.words('text')} AS w FROM documents)
    SELECT doc_id, md5(array_to_string(list_slice(w, 1, 64), ' ')) AS right_md5,
           md5(array_to_string(list_slice(w, greatest(1, len(w) - 63), len(w)), ' ')) AS left_md5 FROM t""",
)
def f12_truncate_tokens(spark, sf):
    t = views.table(spark, sf, "documents").select("doc_id", tx.words("text").alias("w"))
    return t.select(
        "doc_id",
        F.md5(F.array_join(tx.truncate_tokens("w", 64, "right"), " ")).alias("right_md5"),
        F.md5(F.array_join(tx.truncate_tokens("w", 64, "left"), " ")).alias("left_md5"),
    )


@query(
    "f14_first_words",
    f"SELECT doc_id, md5(array_to_string(list_slice({duck.words('text')}, 1, 1000), ' ')) AS first_md5 FROM documents",
)
def f14_first_words(spark, sf):
    return views.table(spark, sf, "documents").select("doc_id", F.md5(tx.first_words("text", 1000)).alias("first_md5"))
