"""Readers with explicit schemas. Paths are probed through the file system Spark uses, never
by trying a read and catching the failure."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from originlens.functions.text import strip, words
from originlens.sources.split_csv import read_split_csv

# File names a training folder may hold, in order of preference.
TRAIN_NAMES = ["train_essays.csv", "train_essays.parquet", "train.csv", "train.parquet"]
# Fixed value: the mark that stands for a space in byte-level tokens.
SPACE_MARK = "Ġ"

ESSAYS = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("prompt_id", T.IntegerType()),
        T.StructField("text", T.StringType()),
        T.StructField("generated", T.IntegerType()),
    ]
)
GENERATION_RECORD = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("prompt", T.StringType()),
        T.StructField("temperature", T.DoubleType()),
        T.StructField("top_k", T.IntegerType()),
        T.StructField("guidance_scale", T.DoubleType()),
        T.StructField("penalty_alpha", T.DoubleType()),
        T.StructField("responses", T.ArrayType(T.StringType())),
    ]
)
# Column names of the foreign-language table and ours for them.
FOREIGN_COLUMNS = {"Текст": "text_src", "Текст_en": "text_en", "Источник": "source", "Год": "year"}


def exists(spark: SparkSession, path: str) -> bool:
    """Whether ``path`` exists on its Hadoop file system."""
    sc = spark.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(sc._jsc.hadoopConfiguration()).exists(p)


def read_csv(spark: SparkSession, path: str, schema: T.StructType, sep: str = ",", split: bool = True) -> DataFrame:
    """CSV with a header and quoted texts that may span lines.

    Columns go by the names in the header, in whatever order; others are ignored, a missing one is an
    error. Files are cut into ranges that tasks parse side by side (:mod:`split_csv`), which takes quotes to enclose
    whole values; ``split=False`` has Spark read each file in one task, for files with other quotes or line ends."""
    reader = spark.read.options(header=True, multiLine=True, quote='"', escape='"', sep=sep)
    names = reader.csv(path).columns
    lacking = [f.name for f in schema if f.name not in names]
    if lacking:
        raise ValueError(f"{path} has no column {', '.join(lacking)}")
    own = {f.name: f for f in schema}
    found = T.StructType([own.get(n, T.StructField(n, T.StringType())) for n in names])
    rows = read_split_csv(spark, path, found, sep) if split else reader.schema(found).csv(path)
    return rows.select(*[f"`{f.name}`" for f in schema])


def read_any(spark: SparkSession, paths: list[str], schema: T.StructType) -> DataFrame:
    """The first of several CSV or Parquet candidates that exists; an error if none does."""
    for path in paths:
        if exists(spark, path):
            if path.rstrip("/").endswith(".csv"):
                return read_csv(spark, path, schema)
            return spark.read.schema(schema).parquet(path)
    raise FileNotFoundError(f"none of these exists: {', '.join(paths)}")


def read_delimited_auto(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV separated by ``;`` if the header line has one, else by ``,``."""
    header = spark.read.text(path).first()
    sep = ";" if header is not None and ";" in header[0] else ","
    return read_csv(spark, path, schema, sep)


def rename_foreign(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(f"`{c}`").alias(FOREIGN_COLUMNS.get(c, c)) for c in df.columns])


def read_text_dir(spark: SparkSession, path: str, pattern: str = r"([^/]+)\.txt$") -> DataFrame:
    """id, text: one row per file; ``pattern`` captures the id in the file path, which Spark gives in URL form."""
    coded = F.regexp_extract(F.col("_metadata.file_path"), pattern, 1)
    plain = F.url_decode(F.replace(coded, F.lit("+"), F.lit("%2B")))
    return spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(
        plain.alias("id"), F.col("value").alias("text")
    )


def parse_token_logprobs(content, num_tokens: int | None = None):
    """STRUCT<tokens, probs> of ``token logprob`` lines.

    A token that is itself white space leaves one part in its line: the token becomes one
    space mark per blank-separated piece of the line, the part is the log-probability. All
    tokens are kept, of the probabilities the first ``num_tokens`` if that is given.
    """
    c = F.col(content) if isinstance(content, str) else content
    lines = F.filter(F.split(c, "\n"), lambda line: strip(line) != "")

    def entry(line):
        parts = words(line)
        pieces = F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))) + 1
        token = F.when(F.size(parts) > 1, F.element_at(parts, 1)).otherwise(F.repeat(F.lit(SPACE_MARK), pieces))
        return F.struct(token.alias("t"), F.element_at(parts, -1).cast("double").alias("lp"))

    parsed = F.transform(lines, entry)
    read = parsed if num_tokens is None else F.slice(parsed, 1, num_tokens)
    probs = F.transform(read, lambda x: F.exp(x["lp"]))
    return F.struct(parsed["t"].alias("tokens"), probs.alias("probs"))


def read_token_logprobs(
    spark: SparkSession, path: str, model: str, num_tokens: int | None = None, pattern: str | None = None
) -> DataFrame:
    """id, tokens, probs from the files ``{id}-{model}.txt``."""
    own = read_text_dir(spark, path, pattern or rf"([^/]+)-{model}\.txt$").filter("id != ''")
    return own.withColumn("_p", parse_token_logprobs("text", num_tokens)).select("id", "_p.tokens", "_p.probs")


def read_generation_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(GENERATION_RECORD).json(path)


def flatten_responses(records: DataFrame) -> DataFrame:
    """One row per response with its position."""
    return records.select(
        *[c for c in records.columns if c != "responses"], F.posexplode("responses").alias("response_idx", "response")
    )


def resolve_columns(df: DataFrame, mapping: dict[str, tuple[list[str], object]]) -> DataFrame:
    """``{target: (candidates, default)}``: the first candidate that is a column, else the
    default. Existence decides, not NULL values."""
    out = []
    for target, (candidates, default) in mapping.items():
        found = next((c for c in candidates if c in df.columns), None)
        out.append((F.col(f"`{found}`") if found else F.lit(default)).alias(target))
    return df.select(*out)


def read_preferences(spark: SparkSession, path: str) -> DataFrame:
    """prompt, chosen, rejected."""
    return spark.read.parquet(path).drop("dpo_id", "diff")
