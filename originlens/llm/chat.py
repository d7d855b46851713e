"""Chat formatting with Spark expressions: sorted turns, merged roles, a reversible template, a loss mask."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from originlens.llm.common import text_of


#: Code points of a piece that spans are cut from when a text is read back.
PIECE = 1024


@dataclass(frozen=True)
class Template:
    """Marks of the formatted text. ``also`` are control strings of other templates that texts may not inject.

    A conversation is ``start role newline text (sep text)* end newline`` per run of turns with one role.
    In texts, every control string gets a backslash behind its first character, one more than it has:
    ``<s>`` becomes ``<\\s>``, ``<\\s>`` becomes ``<\\\\s>``; taking one away again is the exact inverse.
    """

    start: str = "<|im_start|>"
    sep: str = "<|im_sep|>"
    end: str = "<|im_end|>"
    also: tuple[str, ...] = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")

    def _parts(self) -> tuple[str, str]:
        marks = [self.start, self.sep, self.end, *self.also]
        heads = "[" + "".join(f"\\{h}" for h in sorted({m[0] for m in marks})) + "]"
        return f"({heads}" + r"\\*)", "(?=" + "|".join(f"\\Q{m[1:]}\\E" for m in marks) + ")"

    def escape(self, c: Column) -> Column:
        head, tail = self._parts()
        return F.regexp_replace(c, head + tail, r"$1\\")

    def unescape(self, c: Column) -> Column:
        head, tail = self._parts()
        return F.regexp_replace(c, head + r"\\" + tail, "$1")


def _role_out(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))


def _role_in(c: Column) -> Column:
    parts = F.transform(F.split(c, r"\\\\"), lambda p: F.replace(p, F.lit("\\n"), F.lit("\n")))
    return F.array_join(parts, "\\")


def format_chats(turns: DataFrame, template: Template = Template(), loss_role: str = "assistant") -> DataFrame:
    """One formatted text per conversation: conv_id, formatted, loss_spans.

    ``turns``: conv_id, turn, role, text; other columns are ignored. Turns are collected as structs and
    sorted by (turn, role, text), NULL first; neighbouring turns of one role become one block of the
    template, their texts kept apart by its separator. ``loss_spans`` are the start (from 0) and length,
    in code points of ``formatted``, of each text of ``loss_role``; marks and roles are never inside.

    Blocks are found by array functions over the borders between roles; no step copies or scans the whole
    conversation per turn (hence no ``slice``), so the work is linear in its turns. The result holds a conversation in one row; that is its shape.
    Defined cases: NULL text or role is empty; ties in ``turn`` go by role, then text; repeated rows stay;
    NULL conv_id is a conversation of its own; an empty table gives no rows.
    """
    t = turns.select(
        "conv_id", F.struct("turn", text_of("role").alias("role"), text_of("text").alias("text")).alias("_t")
    )
    g = t.groupBy("conv_id").agg(F.sort_array(F.collect_list("_t")).alias("_t"))
    at = F.expr("filter(sequence(0, size(_t) - 1), i -> i = 0 OR _t[i].role <> _t[i - 1].role)")
    g = g.withColumn("_from", at)
    runs = F.expr(
        "transform(_from, (a, k) -> struct(_t[a].role AS role, transform(sequence(a,"
        " coalesce(get(_from, k + 1), size(_t)) - 1), i -> _t[i].text) AS texts))"
    )
    g = g.withColumn("_runs", runs)

    def block(r: Column) -> Column:
        body = F.array_join(F.transform(r["texts"], template.escape), template.sep)
        head = F.concat(F.lit(template.start), template.escape(_role_out(r["role"])), F.lit("\n"))
        return F.struct(
            F.concat(head, body, F.lit(f"{template.end}\n")).alias("out"),
            F.length(head).alias("head"),
            (r["role"] == loss_role).alias("loss"),
            F.transform(r["texts"], lambda x: F.length(template.escape(x))).alias("lens"),
        )

    g = g.withColumn("_blocks", F.transform("_runs", block))
    # a text's place is the sum of what comes before it; a fold copies what it has gathered at each step, so texts
    # are cut into lists of 256, whose own places are found first
    sep, tail = len(template.sep), len(template.end) + 1
    texts = (
        "flatten(transform(_blocks, (b, k) -> transform(b.lens, (n, i) -> struct("
        f"CASE WHEN i > 0 THEN {sep} WHEN k > 0 THEN b.head + {tail} ELSE b.head END AS skip, n AS n, b.loss AS loss))))"
    )
    lists = (
        "t -> transform(sequence(0, cast((size(t) - 1) DIV 256 AS int)),"
        " c -> transform(sequence(c * 256, least(c * 256 + 255, size(t) - 1)), i -> t[i]))"
    )
    g = g.withColumn("_lists", F.expr(f"transform(array({texts}), {lists})[0]"))
    places = (
        "aggregate(_lists, struct(0L AS at, array() :: array<bigint> AS places), (a, l) -> struct("
        "a.at + aggregate(l, 0L, (p, e) -> p + e.skip + e.n) AS at, concat(a.places, array(a.at)) AS places)).places"
    )
    span = "struct(a.at + e.skip AS start, cast(e.n AS bigint) AS length)"
    starts = F.expr(
        f"flatten(zip_with(_lists, {places}, (l, at) -> aggregate(l,"
        " struct(at AS at, array() :: array<struct<start:bigint,length:bigint>> AS spans), (a, e) -> struct("
        f"a.at + e.skip + e.n AS at, if(e.loss, concat(a.spans, array({span})), a.spans) AS spans)).spans))"
    )
    return g.select(
        "conv_id", F.array_join(F.transform("_blocks", lambda b: b["out"]), "").alias("formatted"), starts.alias("loss_spans")
    )


def read_chats(formatted: DataFrame, template: Template = Template()) -> DataFrame:
    """The turns and the text under the loss mask, read back from :func:`format_chats`' output alone.

    conv_id, turns (array of role, text in order), loss_text, formatted."""
    close = f"\\Q{template.end}\n\\E"
    blocks = F.filter(F.split("formatted", close), lambda b: b != "")
    start = len(template.start) + 1

    def turns_of(b: Column) -> Column:
        cut = F.instr(b, "\n")
        role = _role_in(template.unescape(F.substr(b, F.lit(start), cut - start)))
        texts = F.split(F.substr(b, cut + 1), f"\\Q{template.sep}\\E")
        return F.transform(texts, lambda x: F.struct(role.alias("role"), template.unescape(x).alias("text")))

    # a substring is searched from the start of its string, so spans are cut from pieces of a fixed length
    # (bound by a lambda, they are made once per text, not once per span)
    pieces = f"regexp_extract_all(formatted, '(?s).{{1,{PIECE}}}', 0)"
    cut = (
        f"substr(array_join(slice(x.pieces, cast(s.start DIV {PIECE} AS int) + 1,"
        f" cast((s.start + s.length) DIV {PIECE} - s.start DIV {PIECE} AS int) + 1), ''),"
        f" cast(s.start % {PIECE} AS int) + 1, cast(s.length AS int))"
    )
    spans = f"transform(array(struct({pieces} AS pieces, loss_spans AS spans)), x -> transform(x.spans, s -> {cut}))[0]"
    loss = F.transform(F.expr(spans), template.unescape)
    return formatted.select(
        "conv_id",
        F.flatten(F.transform(blocks, turns_of)).alias("turns"),
        F.array_join(loss, "").alias("loss_text"),
        "formatted",
    )


def digest(formatted: DataFrame, template: Template = Template()) -> DataFrame:
    """Counts and hashes of what :func:`read_chats` reads back."""
    r = read_chats(formatted, template)
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return r.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
