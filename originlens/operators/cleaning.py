"""Row filters, fills and small parsers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from originlens.functions.text import strip

# Texts a failed translation leaves behind, and metadata defaults.
TRANSLATION_ERRORS = ["Translation error", "Request exception"]
METADATA_DEFAULTS = {
    "student_disability_status": "Unknown",
    "ell_status": "Unknown",
    "grade_level": -1,
    "holistic_essay_score": -1,
}
MAX_PROMPT_ID = 8


def drop_null_text(df: DataFrame, text: str = "text") -> DataFrame:
    return df.filter(F.col(text).isNotNull())


def valid_text(df: DataFrame, text: str = "text") -> DataFrame:
    """Keep rows whose text is not null and not blank; the text comes out stripped."""
    return df.withColumn(text, strip(text)).filter(F.col(text) != "")


def is_valid_translation(col) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    ok = c.isNotNull() & (c != "")
    for marker in TRANSLATION_ERRORS:
        ok = ok & ~F.contains(c, F.lit(marker))
    return F.coalesce(ok, F.lit(False))


def translation_counts(df: DataFrame, source: str, translated: str, by: list[str] | None = None) -> DataFrame:
    """Valid, failed and blank-source rows."""
    ok = is_valid_translation(translated)
    has_source = F.coalesce(strip(source) != "", F.lit(False))
    return df.groupBy(*(by or [])).agg(
        F.count_if(ok).alias("n_valid"),
        F.count_if(~ok & has_source).alias("n_error"),
        F.count_if(~ok & ~has_source).alias("n_blank"),
        F.count(F.lit(1)).alias("n_rows"),
    )


def fill_metadata(df: DataFrame, defaults: dict | None = None) -> DataFrame:
    return df.fillna(METADATA_DEFAULTS if defaults is None else defaults)


def parse_variation_id(df: DataFrame, id_col: str = "id") -> DataFrame:
    """``essay_<i>_var<k>`` to INT ``essay_idx`` and ``variation_idx``; NULL if it does not match."""
    pattern = r"^essay_(\d+)_var(\d+)$"
    return df.withColumn(
        "essay_idx", F.nullif(F.regexp_extract(id_col, pattern, 1), F.lit("")).cast("bigint")
    ).withColumn("variation_idx", F.nullif(F.regexp_extract(id_col, pattern, 2), F.lit("")).cast("int"))


def prompt_name_from_url(url) -> Column:
    """Last path segment without the page suffix and the reply anchor; ``Essay`` without a URL."""
    c = F.col(url) if isinstance(url, str) else url
    last = F.element_at(F.split(c, "/"), -1)
    bare = F.replace(F.replace(last, F.lit(".html"), F.lit("")), F.lit("#respond"), F.lit(""))
    return F.when(c.isNull() | (c == ""), F.lit("Essay")).otherwise(bare)


def prompt_range_filter(df: DataFrame, prompt: str = "prompt_id", upper: int = MAX_PROMPT_ID) -> DataFrame:
    """Distinct prompts up to ``upper``."""
    return df.filter(F.col(prompt) <= upper).select(prompt).distinct()


def binarize_label(col, cut: float = 0.5) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return (c > F.lit(cut)).cast("int")


def first_n(df: DataFrame, n: int, order: list[Column]) -> DataFrame:
    """The first ``n`` rows in ``order``; ``n = -1`` keeps all."""
    return df if n == -1 else df.orderBy(*order).limit(n)


def vocab_complement(df: DataFrame, token_ids: str, vocab_size: int) -> DataFrame:
    """Ids in [0, vocab_size) that no row's ARRAY of token ids contains."""
    seen = df.select(F.explode(token_ids).alias("token_id")).select(F.col("token_id").cast("bigint")).distinct()
    return df.sparkSession.range(vocab_size).withColumnRenamed("id", "token_id").join(seen, "token_id", "left_anti")
