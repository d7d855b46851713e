"""Subword tokens of a given vocabulary of byte pairs."""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: the published pattern that cuts a text into pieces, which no token crosses.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""

PIECE_BYTES = 1 << 20  #: of text that a task holds as Python tokens at once


def read_ranks(spark: SparkSession, path: str) -> dict[bytes, int]:
    """Byte strings and their merge ranks from a file of ``base64 rank`` lines; as many as the vocabulary has."""
    lines = spark.read.text(path).filter("value <> ''").select(F.split("value", " ").alias("p"))
    return {base64.b64decode(r.p[0]): int(r.p[1]) for r in lines.collect()}


def _pieces(batch, text: str) -> Iterator:
    """Slices of a batch with about PIECE_BYTES of text each, or one longer text."""
    import pyarrow.compute as pc

    start, held = 0, 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()):
        if held and held + n > PIECE_BYTES:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if batch.num_rows > start:
        yield batch.slice(start)


def subword_tokens(docs: DataFrame, ranks: dict[bytes, int], text: str = "text", pattern: str = PATTERN) -> DataFrame:
    """Add ``token_ids`` (array of int) and ``tokens`` (array of string) of each whole text.

    A token's string has one character, of code 0 to 255, for each of its bytes, so that tokens which end inside a
    character stay distinct: joined and encoded as Latin-1 they are the text's UTF-8 bytes again. A NULL text has NULL
    tokens, an empty one none. The ranks are sent once to each worker, whatever the number of documents; texts are not
    shuffled."""
    names = {i: b.decode("latin-1") for b, i in ranks.items()}
    shared = docs.sparkSession.sparkContext.broadcast((ranks, names))
    kept = [f.name for f in docs.schema if f.name not in ("token_ids", "tokens")]
    schema = docs.select(*kept).schema.add("token_ids", T.ArrayType(T.IntegerType())).add("tokens", T.ArrayType(T.StringType()))

    def run(batches: Iterable):
        import pyarrow as pa
        import tiktoken

        ranks, names = shared.value
        coder = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        for b in (part for whole in batches for part in _pieces(whole, text)):
            ids = [None if t is None else coder.encode_ordinary(t) for t in b.column(text).to_pylist()]
            tokens = [None if x is None else [names[i] for i in x] for x in ids]
            cols = [b.column(n) for n in kept]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(ids, pa.list_(pa.int32())), pa.array(tokens, pa.list_(pa.string()))], names=[*kept, "token_ids", "tokens"])

    return docs.select(*kept).mapInArrow(run, schema)
