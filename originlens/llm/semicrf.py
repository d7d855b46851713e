"""Personal data: fixed patterns, and a semi-Markov conditional random field over candidate spans."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterable
from dataclasses import dataclass, field
from itertools import accumulate

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from originlens.llm.common import slices, text_of

KINDS = ("email", "ip", "card", "phone")

# The base patterns.
_MAIL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a match always starts where a run of digits does; saying so keeps long runs linear
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

_DIGITS = re.compile(r"[0-9]+")
_RUN = re.compile(r"[0-9+(][0-9 ().+/-]*+")
_TOKEN = re.compile(r"[0-9]+|[A-Za-z]+|[^0-9A-Za-z]")
_WORD = re.compile(r"([^\W\d_]+)[^\w\n]{0,3}$")

MAX_TOKENS = 40  #: of an entity
LEAST_DIGITS, MOST_DIGITS = 7, 19  #: of a candidate without an @

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def _mails(text: str) -> Iterable[tuple[int, int]]:
    at, done = text.find("@"), 0
    while at >= 0:
        left = at
        while left > done and text[left - 1] in _MAIL_CHARS:
            left -= 1
        m = _DOMAIN.match(text, at + 1) if left < at else None
        if m:
            yield left, m.end()
        done = m.end() if m else at + 1
        at = text.find("@", done)


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each kind's pattern that pass its test, by start, then kind."""
    out = [("email", a, b) for a, b in _mails(text)]
    if _DIGITS.search(text):
        for m in _IP.finditer(text):
            if all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in m[0].split(".")):
                out.append(("ip", *m.span()))
        for m in _CARD.finditer(text):
            d = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(d) <= 19 and luhn(d):
                out.append(("card", *m.span()))
        for m in _PHONE.finditer(text) if "+" in text else ():
            if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append(("phone", *m.span()))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def regions(text: str) -> list[tuple[int, int]]:
    """Where candidate spans lie: runs of number characters with enough digits, and runs around an @."""
    out = []
    for m in _RUN.finditer(text):
        run = m[0].rstrip(" ().+/-")
        if len(run) >= LEAST_DIGITS and sum(map(run.count, "0123456789")) >= LEAST_DIGITS:
            out.append((m.start(), m.start() + len(run)))
    at = text.find("@")
    while at >= 0:
        a, b = at, at + 1
        while a > 0 and text[a - 1] in _MAIL_CHARS:
            a -= 1
        while b < len(text) and (text[b] in _MAIL_CHARS or text[b] == "@"):
            b += 1
        out.append((a, b))
        at = text.find("@", b)
    out.sort()
    merged: list[tuple[int, int]] = []
    for a, b in out:
        if merged and a < merged[-1][1]:
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
        else:
            merged.append((a, b))
    return merged


def _class(c: str) -> str:
    return "" if not c else "d" if c.isdigit() else "a" if c.isalpha() else "s" if c.isspace() else c if c in "+@.-()/%_" else "p"


def features(text: str, a: int, b: int) -> list[str]:
    """Features of the whole span [a, b): its shape, tests that it passes, its surroundings."""
    s = text[a:b]
    groups = _DIGITS.findall(s)
    n = sum(map(len, groups))
    seps = "".join(sorted(set(re.sub(r"[0-9A-Za-z]", "", s))))
    left, right = _class(text[a - 1 : a]), _class(text[b : b + 1])
    f = ["bias", f"left={left}", f"right={right}", f"first={_class(s[0])}", f"last={_class(s[-1])}"]
    if "@" in s:
        local, _, domain = s.partition("@")
        parts = domain.split(".")
        f += [f"at={s.count('@')}", f"local={bool(local)}", f"parts={min(len(parts), 4)}", f"whole={all(parts)}", f"tld={min(len(parts[-1]), 5)}"]
        return f
    f += [f"digits={n}", f"seps={seps}", f"shape={'-'.join(str(len(g)) for g in groups[:6])}", f"groups={min(len(groups), 7)}"]
    f.append(f"plus={s[0] == '+'}")
    f.append(f"balanced={s.count('(') == s.count(')')}")
    if len(groups) == 4 and seps == ".":
        f.append(f"octets={all(len(g) <= 3 and int(g) <= 255 for g in groups)}")
    if 14 <= n <= 19:
        f.append(f"luhn={luhn(''.join(groups))}")
    word = _WORD.search(text[max(0, a - 24) : a])
    if word:
        f.append(f"cue={word[1].lower()}")
    return f


def candidates(text: str, a: int, b: int) -> list[tuple[int, int]]:
    """Spans of a region that begin and end at token borders, within the bounds of an entity."""
    tokens = [(m.start(), m.end()) for m in _TOKEN.finditer(text, a, b)]
    out = []
    for i, (p, _) in enumerate(tokens):
        if text[p].isspace() or text[p] in ").-/%":
            continue
        digits = 0
        for q0, q in tokens[i : i + MAX_TOKENS]:
            digits += (q - q0) if "0" <= text[q0] <= "9" else 0
            if digits > MOST_DIGITS:
                break
            if not ("0" <= text[q - 1] <= "9" or text[q - 1].isalpha()):
                continue
            at = text.find("@", p, q)
            if at >= 0:
                if p < at and "." in text[at:q]:
                    out.append((p, q))
            elif digits >= LEAST_DIGITS and not any(c.isalpha() for c in text[p:q]):
                out.append((p, q))
    return out


def allowed(feats: list[str]) -> tuple[str, ...]:
    """The kinds that a span with these features may have: addresses are the spans with one @."""
    if any(f.startswith("at=") for f in feats):
        return ("email",)
    return ("ip", "card", "phone")


@dataclass
class SpanModel:
    """Weights of (kind, feature); a span's score for a kind is the sum of its features' weights."""

    weights: dict[tuple[str, str], float] = field(default_factory=dict)

    def score(self, kind: str, feats: list[str]) -> float:
        w = self.weights
        return sum(w.get((kind, f), 0.0) for f in feats)

    def decode(self, text: str, a: int, b: int) -> list[Span]:
        """The best segmentation of a region: non-overlapping spans with kinds, everything else outside.

        ``best[p]`` is the score of the text up to p; outside adds 0, a span its score. Entities are bounded
        by :func:`candidates`, so the work is linear in the region."""
        by_end: dict[int, list[tuple[int, str, float]]] = {}
        for p, q in candidates(text, a, b):
            feats = features(text, p, q)
            s, kind = max((self.score(k, feats), k) for k in allowed(feats))
            if s > 0:
                by_end.setdefault(q, []).append((p, kind, s))
        if not by_end:
            return []
        marks = [a, *sorted(by_end)]
        best, how = [0.0], [None]
        for q in marks[1:]:
            score, step = best[-1], None
            for p, kind, s in by_end[q]:
                before = bisect_right(marks, p) - 1
                if best[before] + s > score:
                    score, step = best[before] + s, (before, (kind, p, q))
            best.append(score)
            how.append(step)
        out, at = [], len(marks) - 1
        while at:
            if how[at]:
                out.append(how[at][1])
                at = how[at][0]
            else:
                at -= 1
        return out[::-1]


def _lse(x: list[float]) -> float:
    m = max(x)
    return m + float(np.log(sum(np.exp(v - m) for v in x)))


def fit(examples: list[tuple[str, int, int, list[Span]]], rounds: int = 60, rate: float = 0.5, l2: float = 0.003) -> SpanModel:
    """Weights by maximum likelihood over segmentations: regions (text, a, b) with their true spans.

    The gradient is observed minus expected features; expectations come from forward and backward sums over
    all segmentations into bounded spans. AdaGrad steps, fixed number of rounds.
    """
    names: dict[tuple[str, str], int] = {}
    ready = []
    for text, a, b, truth in examples:
        spans = candidates(text, a, b)
        if not spans:
            continue
        segs = []
        for p, q in spans:
            feats = features(text, p, q)
            for k in allowed(feats):
                segs.append((p, q, [names.setdefault((k, f), len(names)) for f in feats], (k, p, q) in truth))
        marks = sorted({a, b, *(s[0] for s in segs), *(s[1] for s in segs)})
        at = {m: i for i, m in enumerate(marks)}
        flat = np.array([j for s in segs for j in s[2]])
        rows = np.repeat(np.arange(len(segs)), [len(s[2]) for s in segs])
        ready.append(([(at[s[0]], at[s[1]]) for s in segs], flat, rows, np.array([s[3] for s in segs], float), len(marks)))
    w = np.zeros(len(names))
    seen = np.full(len(names), 1e-6)
    for _ in range(rounds):
        g = -l2 * len(ready) * w
        for ij, flat, rows, truth, n in ready:
            s = np.bincount(rows, w[flat], len(ij)).tolist()
            into: list[list[int]] = [[] for _ in range(n)]
            out: list[list[int]] = [[] for _ in range(n)]
            for e, (i, j) in enumerate(ij):
                into[j].append(e), out[i].append(e)
            f, r = [0.0] * n, [0.0] * n
            for j in range(1, n):
                f[j] = _lse([f[j - 1], *(f[ij[e][0]] + s[e] for e in into[j])])
            for i in range(n - 2, -1, -1):
                r[i] = _lse([r[i + 1], *(r[ij[e][1]] + s[e] for e in out[i])])
            p = np.array([np.exp(min(0.0, f[i] + s[e] + r[j] - f[-1])) for e, (i, j) in enumerate(ij)])
            g += np.bincount(flat, (truth - p)[rows], len(w))
        seen += g * g
        w += rate * g / np.sqrt(seen)
    return SpanModel({k: round(float(w[i]), 6) for k, i in names.items() if abs(w[i]) > 1e-4})


def _without_country(text: str, spans: list[Span]) -> tuple[str, list[Span]] | None:
    """The example with the country code of a phone number taken away: other formats of the same kind."""
    if len(spans) != 1 or spans[0][0] != "phone":
        return None
    _, p, q = spans[0]
    m = re.match(r"\+[0-9]{1,3}[ .-]?", text[p:q])
    if not m or sum(c.isdigit() for c in text[p + m.end() : q]) < LEAST_DIGITS:
        return None
    cut = text[:p] + text[p + m.end() :]
    return cut, [("phone", p, q - m.end())]


def train(docs: DataFrame, sample: int = 1500, seed: str = "pii") -> SpanModel:
    """A model from the regions of a bounded sample of ``docs``, with the base spans as truth.

    Phone numbers count a second time without their country code, so the model knows the shape alone.
    About ``sample`` regions, those with the smallest hashes of their surroundings, reach the driver.
    """
    src = docs.select(text_of("text").alias("text"))

    def run(batches: Iterable):
        import pyarrow as pa
        import xxhash

        for b in slices(batches):
            rows = []
            for text in b.column(0).to_pylist():
                for a, z in regions(text):
                    if z - a > 400:
                        continue  # long tables teach nothing about spans
                    lo, hi = max(0, a - 24), min(len(text), z + 1)
                    rows.append((xxhash.xxh32_intdigest((seed + text[lo:hi]).encode("utf-8", "surrogatepass")), text[lo:hi], a - lo, z - lo))
            yield pa.RecordBatch.from_pydict(
                {"h": pa.array([r[0] for r in rows], pa.int64()), "t": pa.array([r[1] for r in rows], pa.string()),
                 "a": pa.array([r[2] for r in rows], pa.int32()), "z": pa.array([r[3] for r in rows], pa.int32())}
            )

    got = src.mapInArrow(run, "h bigint, t string, a int, z int").distinct().orderBy("h", "t", "a").limit(sample).collect()
    examples = []
    for r in got:
        truth = [s for s in base_spans(r.t) if r.a <= s[1] and s[2] <= r.z]
        kept: list[Span] = []
        for s in truth:  # kinds may overlap in the base; the field's spans do not
            if not kept or s[1] >= kept[-1][2]:
                kept.append(s)
        examples.append((r.t, r.a, r.z, kept))
        other = _without_country(r.t, kept)
        if other:
            examples.append((other[0], r.a, r.z - (len(r.t) - len(other[0])), other[1]))
    return fit(examples) if examples else SpanModel()


def find(text: str, model: SpanModel) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans: the base and what the model adds beside it."""
    base = base_spans(text)
    starts, reach = [x for _, x, _ in base], list(accumulate((y for _, _, y in base), max))
    more = []
    for a, b in regions(text):
        for kind, p, q in model.decode(text, a, b):
            before = bisect_left(starts, q)
            if not before or reach[before - 1] <= p:
                more.append((kind, p, q))
    return base, sorted(base + more, key=lambda s: (s[1], KINDS.index(s[0]))) if more else base


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def spans(docs: DataFrame, model: SpanModel) -> DataFrame:
    """doc_id, base (array of kind:start:end), spans (the same of all) of every whole text.

    Positions are code points, the end exclusive. NULL and empty texts have no spans; repeated rows are
    looked at alike; an empty table gives no rows; other columns are ignored."""
    import pyarrow as pa

    src = docs.select("doc_id", text_of("text").alias("text"))
    schema = T.StructType([src.schema["doc_id"], T.StructField("base", T.StringType()), T.StructField("spans", T.StringType())])

    def run(batches: Iterable):
        for b in slices(batches):
            got = [find(t, model) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([_joined(g[0]) for g in got], pa.string()), pa.array([_joined(g[1]) for g in got], pa.string())],
                names=["doc_id", "base", "spans"],
            )

    return src.mapInArrow(run, schema)


def digest(found: DataFrame) -> DataFrame:
    """Counts of the base spans by kind, their hash, and all spans."""
    counts = [F.regexp_count("base", F.lit(rf"(^|,){k}:")).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2("base", 256).alias("base_sha256"), "spans")


def redact_text(text: str, found: list[Span]) -> str:
    """The text with every span replaced by its kind in brackets; overlapping spans become one."""
    out, done = [], 0
    for i, (kind, a, b) in enumerate(found):
        if a < done:
            if b > done:
                done = b
            continue
        out += [text[done:a], f"[{kind.upper()}]"]
        done = b
    return "".join(out) + text[done:]


def redact(docs: DataFrame, model: SpanModel) -> DataFrame:
    """``docs`` with all spans of ``text`` replaced and ``n_chars``, if there, counted anew; a NULL text stays."""
    text_at = docs.columns.index("text")

    def run(batches: Iterable):
        import pyarrow as pa

        for b in slices(batches):
            out = [None if t is None else redact_text(t, find(t, model)[1]) for t in b.column(text_at).to_pylist()]
            yield b.set_column(text_at, b.schema.field(text_at), pa.array(out, b.schema.field(text_at).type))

    out = docs.withColumn("text", F.col("text").cast("string")).mapInArrow(run, docs.withColumn("text", F.col("text").cast("string")).schema)
    if "n_chars" in docs.columns:
        n = F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType)
        out = out.withColumn("n_chars", n)
    return out
