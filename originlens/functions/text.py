"""Per-row text and token expressions. Texts stay inside the JVM."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

# The code points Unicode counts as white space, as a character class that
# both Java and RE2 accept, and the same characters as a string.
WS_CLASS = (
    r"[\x{09}-\x{0d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)
WS_CHARS = "".join(
    chr(c)
    for c in [
        *range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680,
        *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
    ]
)


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(text) -> Column:
    """Remove white space of any kind from both ends (``trim`` removes spaces only)."""
    return F.btrim(_col(text), F.lit(WS_CHARS))


def words(text) -> Column:
    """White-space separated words without empty strings."""
    return F.filter(F.split(_col(text), WS_CLASS + "+"), lambda w: w != "")


def word_count(text) -> Column:
    return F.size(words(text))


def _head_size(n: Column, ratio) -> Column:
    return F.floor(n.cast("double") * (F.lit(float(ratio)) if isinstance(ratio, (int, float)) else ratio)).cast("int")


def word_prefix(text, ratio, floor: int = 10) -> Column:
    """The first ``max(floor, int(n * ratio))`` words, joined by single spaces."""
    w = words(text)
    return F.array_join(F.slice(w, F.lit(1), F.greatest(F.lit(floor), _head_size(F.size(w), ratio))), " ")


def continuation_split(text, ratio) -> Column:
    """STRUCT<prefix, rest>: the first ``int(n * ratio)`` words and what is held out."""
    w = words(text)
    cut = _head_size(F.size(w), ratio)
    return F.struct(
        F.array_join(F.slice(w, F.lit(1), cut), " ").alias("prefix"),
        F.array_join(F.slice(w, cut + 1, F.size(w) - cut), " ").alias("rest"),
    )


def first_words(text, n: int = 1000) -> Column:
    """The first ``n`` words, joined by single spaces."""
    return F.array_join(F.slice(words(text), 1, n), " ")


def char_start(text, length) -> Column:
    """The first ``length`` characters, the seed of a response."""
    return F.substring(_col(text), F.lit(1), length if isinstance(length, Column) else F.lit(length))


def lengths(text) -> list[Column]:
    """Characters and words of a text."""
    return [F.length(_col(text)).alias("n_chars"), word_count(text).alias("n_words")]


def word_overlap(original, generated) -> Column:
    """Percentage of the distinct lower-case words of ``original`` found in ``generated``."""
    a = F.array_distinct(words(F.lower(_col(original))))
    b = words(F.lower(_col(generated)))
    shared = F.size(F.array_intersect(a, b)).cast("double")
    return shared / F.greatest(F.size(a), F.lit(1)).cast("double") * F.lit(100.0)


def clean_response(text) -> Column:
    """Text after the last response marker and before the end marker, without unknown tokens."""
    t = _col(text)
    tail = F.element_at(F.split(t, r"### Response:"), -1)
    end = F.when(F.contains(t, F.lit("</s>")), F.lit("</s>")).otherwise(F.lit("<|endoftext|>"))
    return F.replace(strip(F.split_part(tail, end, F.lit(1))), F.lit("<unk>"), F.lit(""))


def detection_prompt(text) -> Column:
    """A text followed by the question put to a detector."""
    return F.concat(strip(text), F.lit("\n###\nIs the essay generated by AI?"))


def truncate_tokens(tokens, max_len: int, side: str = "right") -> Column:
    """At most ``max_len`` tokens, dropping from the right or the left end."""
    t = _col(tokens)
    if side == "right":
        return F.slice(t, 1, max_len)
    return F.slice(t, F.greatest(F.lit(1), F.size(t) - max_len + 1), F.lit(max_len))


def _starts(lengths: np.ndarray, limit: int) -> list[int]:
    """Positions of the sentences that begin a chunk.

    ``ends[i]`` is the length of all sentences to i, each with two characters behind it. A chunk goes on while it
    stays within the limit, so the next start is found by bisection in the ends; the sentence that opens a
    chunk counts without its two characters, unless it is the first of the text and fits."""
    ends = np.cumsum(lengths.astype(np.int64) + 2)
    out, at = [], 0
    while at < len(ends):
        out.append(at)
        before = int(ends[at - 1]) if at else 0
        room = limit + before + (0 if at == 0 and ends[0] <= limit else 2)
        at = max(at + 1, int(np.searchsorted(ends, room, side="right")))
    return out


def pack_sentences(text, max_chars: int = 5000) -> Column:
    """ARRAY<STRING> of chunks: sentences packed in order while they fit ``max_chars``.

    A text that fits stays whole. A sentence longer than the limit becomes its own chunk. The work is linear in the text;
    only the lengths of the sentences leave the JVM, as Arrow batches.
    """
    t = _col(text)
    sentences = F.filter(
        F.transform(F.split(F.translate(t, "!?", ".."), r"\."), strip), lambda s: s != ""
    )
    whole = F.length(t) <= max_chars

    @pandas_udf("array<int>")
    def starts(lengths: pd.Series) -> pd.Series:
        return pd.Series([None if n is None else _starts(np.asarray(n), max_chars) for n in lengths], dtype=object)

    first = starts(F.when(~whole, F.transform(sentences, F.length)))

    def chunk(parts, begin, end):
        return F.concat(F.array_join(F.slice(parts, begin + 1, end - begin), ". "), F.lit("."))

    # a transform over one struct evaluates the sentences once for all chunks
    def chunks(x):
        after = F.concat(F.slice(x["first"], F.lit(2), F.size(x["first"])), F.array(F.size(x["parts"])))
        ranges = F.arrays_zip(x["first"].alias("begin"), after.alias("end"))
        return F.transform(ranges, lambda r: chunk(x["parts"], r["begin"], r["end"]))

    both = F.array(F.struct(sentences.alias("parts"), first.alias("first")))
    packed = F.element_at(F.transform(both, chunks), 1)
    return F.when(whole, F.array(t)).when(F.size(first) == 0, F.array().cast("array<string>")).otherwise(packed)
