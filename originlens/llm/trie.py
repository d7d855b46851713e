"""A compact n-gram level pair: Elias-Fano coded contexts, pointers and successors, quantised values.

Everything lies in one buffer of bytes. ``Trie.frombuffer`` makes views into it without a copy, so a trie
can be used from a memory-mapped file or from an Arrow batch alike.
"""

from __future__ import annotations

import numpy as np

SPAN = 1 << 16  #: values decoded at a time
GRID = 32  #: steps per power of ten of a quantised value


def quantise(p: np.ndarray) -> np.ndarray:
    """Codes 1 to 255 of probabilities on a fixed logarithmic grid; 0 for 0. Independent of the data."""
    with np.errstate(divide="ignore"):
        step = np.rint(-np.log10(p) * GRID)
    return np.where(p > 0, np.clip(step, 0, 254) + 1, 0).astype(np.uint8)


#: The value of each code.
VALUES = np.concatenate([[0.0], 10.0 ** (-np.arange(255) / GRID)])


class EliasFano:
    """A non-decreasing sequence of unsigned values: low bits packed, high parts in unary.

    Bits per value: about 2 plus the logarithm of the mean gap. ``starts`` has the bit position of every
    ``SPAN``-th value, so a span is decoded without what lies before it.
    """

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, starts: np.ndarray, firsts: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.starts, self.firsts = n, low_bits, low, high, starts, firsts

    @classmethod
    def encode(cls, x: np.ndarray) -> EliasFano:
        x = x.astype(np.uint64)
        n = len(x)
        top = int(x[-1]) if n else 0
        bits = max(0, (top // max(n, 1)).bit_length() - 1)
        planes = ((x[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
        low = np.packbits(planes.ravel(), bitorder="little")
        at = (x >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        ones = np.zeros(int(at[-1]) + 1 if n else 0, np.uint8)
        ones[at] = 1
        return cls(n, bits, low, np.packbits(ones, bitorder="little"), at[::SPAN].astype(np.int64), x[::SPAN])

    def span(self, s: int) -> np.ndarray:
        """The values s * SPAN and on, at most SPAN of them."""
        a = s * SPAN
        m = min(SPAN, self.n - a)
        begin = int(self.starts[s])
        end = int(self.starts[s + 1]) if s + 1 < len(self.starts) else len(self.high) * 8
        byte = begin // 8
        ones = np.unpackbits(self.high[byte : (end + 7) // 8], bitorder="little")
        ones[: begin - byte * 8] = 0
        at = np.flatnonzero(ones)[:m] + byte * 8
        out = (at - np.arange(a, a + m)).astype(np.uint64) << np.uint64(self.low_bits)
        if self.low_bits:
            first = a * self.low_bits
            flat = np.unpackbits(self.low[first // 8 : (first + m * self.low_bits + 7) // 8], bitorder="little")
            flat = flat[first % 8 : first % 8 + m * self.low_bits].reshape(m, self.low_bits)
            for i in range(self.low_bits):
                out |= flat[:, i].astype(np.uint64) << np.uint64(i)
        return out

    def at(self, index: np.ndarray) -> np.ndarray:
        """Values at ascending positions."""
        out = np.zeros(len(index), np.uint64)
        cut = np.searchsorted(index, np.arange(len(self.starts) + 1) * SPAN)
        for s in range(len(self.starts)):
            if cut[s] < cut[s + 1]:
                out[cut[s] : cut[s + 1]] = self.span(s)[index[cut[s] : cut[s + 1]] - s * SPAN]
        return out

    def successors(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For ascending ``x``: the position of the first value not below it, and whether that value equals it."""
        at = np.full(len(x), self.n, np.int64)
        equal = np.zeros(len(x), np.bool_)
        if not self.n or not len(x):
            return at, equal
        cut = np.concatenate([[0], np.searchsorted(x, self.firsts[1:], side="right"), [len(x)]])
        for s in range(len(self.starts)):
            q = x[cut[s] : cut[s + 1]]
            if len(q):
                v = self.span(s)
                i = np.searchsorted(v, q)
                at[cut[s] : cut[s + 1]] = i + s * SPAN
                found = v[np.minimum(i, len(v) - 1)]
                if s + 1 < len(self.firsts):  # behind the span: the next one's first
                    found = np.where(i < len(v), found, self.firsts[s + 1])
                equal[cut[s] : cut[s + 1]] = found == q
        return at, equal

    def parts(self) -> list[np.ndarray]:
        return [np.array([self.n, self.low_bits], np.int64), self.low, self.high, self.starts, self.firsts]


class Trie:
    """Contexts and their successors.

    Level 1: context ids (increasing), pointers to their first successor (monotone), codes of their back-off
    weights. Level 2: successor ids made monotone over all contexts by adding the last value of the context
    before, and codes of the discounted conditional probabilities.
    """

    def __init__(self, parts: list[np.ndarray]):
        self._parts = parts
        ef = [EliasFano(int(p[0][0]), int(p[0][1]), p[1], p[2], p[3], p[4]) for p in (parts[0:5], parts[5:10], parts[10:15])]
        self.contexts, self.pointers, self.successors = ef
        self.backoff, self.values = parts[15], parts[16]

    @classmethod
    def build(cls, context: np.ndarray, word: np.ndarray, p: np.ndarray, backoff: np.ndarray) -> Trie:
        """From bigrams sorted by (context, word), their probabilities and their contexts' back-off weights."""
        first = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]])) if len(context) else np.zeros(0, np.int64)
        last = np.append(first[1:], len(context)) - 1
        base = np.concatenate([[0], np.cumsum(word[last].astype(np.uint64) + np.uint64(1))[:-1]]) if len(first) else np.zeros(0)
        level = word.astype(np.uint64) + np.repeat(base, np.diff(np.append(first, len(context)))).astype(np.uint64)
        ef = [EliasFano.encode(x).parts() for x in (context[first], np.append(first, len(context)), level)]
        return cls([*ef[0], *ef[1], *ef[2], quantise(backoff[first]), quantise(p)])

    def tobytes(self) -> bytes:
        head = np.array([len(self._parts), *[x for p in self._parts for x in (p.nbytes, _KINDS.index(p.dtype.str))]], np.int64)
        return b"".join([head.tobytes(), *[p.tobytes() + bytes(-p.nbytes % 8) for p in self._parts]])

    @classmethod
    def frombuffer(cls, buf) -> Trie:
        n = int(np.frombuffer(buf, np.int64, 1)[0])
        head = np.frombuffer(buf, np.int64, 2 * n, 8).reshape(n, 2)
        at, parts = 8 + 16 * n, []
        for size, kind in head.tolist():
            dtype = np.dtype(_KINDS[kind])
            parts.append(np.frombuffer(buf, dtype, size // dtype.itemsize, at))
            at += size + -size % 8
        return cls(parts)

    def lookup(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Codes of bigrams sorted by (context, word); 0 for those not in the trie.

        A context is found by its successor in level 1; its words lie between two pointers, and are searched
        relative to the value that ends the context before."""
        out = np.zeros(len(context), np.uint8)
        i, known = self.contexts.successors(context.astype(np.uint64))
        if not known.any():
            return out
        own, back = np.unique(i[known], return_inverse=True)
        ends = self.pointers.at(np.stack([own, own + 1], axis=1).ravel()).reshape(-1, 2).astype(np.int64)
        before = np.maximum(ends[:, 0] - 1, 0)
        base = np.where(ends[:, 0] > 0, self.successors.at(before) + np.uint64(1), np.uint64(0))
        last = self.successors.at(ends[:, 1] - 1)  # of each context; a larger word is not there
        x = word[known].astype(np.uint64) + base[back]
        at, equal = self.successors.successors(np.minimum(x, last[back]))
        hit = equal & (x <= last[back])
        codes = np.zeros(len(at), np.uint8)
        codes[hit] = self.values[at[hit]]
        out[known] = codes
        return out


_KINDS = ["<i8", "<u8", "|u1"]
