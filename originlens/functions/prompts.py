"""Prompt and training-sequence expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from originlens.functions.hashing import rand_int, rand_range, uniform
from originlens.functions.text import words

# Line labels of the instruction, in order, with the column each one shows.
INSTRUCTION_LINES = [
    ("Prompt", "prompt_name"),
    ("Task", "task"),
    ("Score", "holistic_essay_score"),
    ("Student Grade Level", "grade_level"),
    ("English Language Learner", "ell_status"),
    ("Disability Status", "student_disability_status"),
]
IGNORE_LABEL = "-100"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def instruction(columns: dict[str, Column] | None = None) -> Column:
    """Six ``label: value`` lines; ``columns`` overrides where a value comes from."""
    given = columns or {}
    return F.concat_ws(
        "\n",
        *[
            F.concat(F.lit(f"{label}: "), _col(given.get(name, name)).cast("string"))
            for label, name in INSTRUCTION_LINES
        ],
    )


def chat_format(instr, start="", style: str = "response") -> Column:
    """An instruction and the start of its answer in one of two chat layouts."""
    start = F.lit("") if isinstance(start, str) and not start else _col(start)
    if style == "response":
        return F.concat(F.lit("### Instruction:\n"), _col(instr), F.lit("\n\n### Response: "), start)
    if style == "inst":
        return F.concat(F.lit("<s>[INST] "), _col(instr), F.lit(" [/INST] "), start)
    raise ValueError(f"unknown chat style {style!r}")


def sft_sequence(df: DataFrame, instr: str, text: str, max_len: int, eos: str = "</s>") -> DataFrame:
    """Add ``tokens`` and ``labels``: source then target, cut to ``max_len``; the labels of the
    first ``source length - 1`` tokens are ignored by the loss."""
    source = words(chat_format(instr))
    target = words(F.concat_ws(" ", _col(text), F.lit(eos)))
    out = df.withColumn("_src", F.size(source)).withColumn(
        "tokens", F.slice(F.concat(source, target), 1, max_len)
    )
    labels = F.transform(
        "tokens", lambda t, i: F.when(i < F.col("_src") - 1, F.lit(IGNORE_LABEL)).otherwise(t)
    )
    return out.withColumn("labels", labels).drop("_src")


def mask_tokens(tokens, p: float, seed, key, pad: str = "<pad>", special: tuple[str, ...] = ()) -> Column:
    """Replace non-special tokens by ``pad`` with probability ``p``; the coin is keyed by
    (row, position)."""

    def one(t, i):
        hit = uniform(seed, key, i) < F.lit(p)
        if special:
            hit = hit & ~t.isin(*special)
        return F.when(hit, F.lit(pad)).otherwise(t)

    return F.transform(_col(tokens), one)


def decoding_params(seed, key) -> list[Column]:
    """Per-row draws of the decoding settings of an essay generator."""
    return [
        rand_range(0.5, 1.5, f"{seed}/temperature", key).alias("temperature"),
        rand_int(128, 256, f"{seed}/top_k", key).alias("top_k"),
        rand_range(0.0, 1.0, f"{seed}/penalty_alpha", key).alias("penalty_alpha"),
        rand_range(1.0, 0.25, f"{seed}/guidance_scale", key).alias("guidance_scale"),
        rand_range(1e-4, 5e-4, f"{seed}/eta_cutoff", key).alias("eta_cutoff"),
    ]


def variation_params(seed, key) -> list[Column]:
    """Per-row draws of the settings of a variation generator."""
    return [
        rand_range(0.6, 0.3, f"{seed}/var_temperature", key).alias("var_temperature"),
        rand_range(0.2, 0.2, f"{seed}/prefix_ratio", key).alias("prefix_ratio"),
        rand_int(4, 6, f"{seed}/score", key).alias("holistic_essay_score"),
        rand_int(9, 11, f"{seed}/grade", key).alias("grade_level"),
    ]
