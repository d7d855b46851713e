"""Features of token-probability sequences."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import zip_longest

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from originlens.functions import vectors as V
from originlens.session import materialise

# The vectors in their published order, and the column each one lives in.
VECTORS = {
    "llm1-probs": "llm1",
    "llm2-probs": "llm2",
    "trigram-probs": "trigram",
    "unigram-probs": "unigram",
}
# Statistics per series, ratio pairs, and limits of the fixed feature set.
STATISTICS = ["min", "max", "mean", "median", "q25", "q75", "q10", "q90", "l2", "var"]
QUANTILES = {"median": 0.5, "q25": 0.25, "q75": 0.75, "q10": 0.10, "q90": 0.90}
SERIES = ["llm1", "llm2", "unigram", "trigram"]
RATIOS = [
    ("llm1", "llm2"),
    ("llm1", "unigram"),
    ("llm1", "trigram"),
    ("llm2", "unigram"),
    ("llm2", "trigram"),
    ("unigram", "trigram"),
]
CLIP_MIN, CLIP_MAX = 1e-4, 1e5
IGNORE_FIRST = 25
TOP = 25  # of s-avg-top-25
BLOCK_VALUES = 1 << 20  # of vectors that are reduced at once, or one longer vector
OUT_VALUES = 1 << 17  # in a batch that a task returns, about


def vector_combinations() -> list[tuple[str, ...]]:
    """Every vector expression of depth one and two: ``(vec,)`` or ``(vec, op, vec)``.

    Division pairs any two vectors; the other operators only reach back to vectors listed
    before the first one.
    """
    names = list(VECTORS)
    combos: list[tuple[str, ...]] = []
    for i, left in enumerate(names):
        combos.append((left,))
        for j, right in enumerate(names):
            for op in V.VECTOR_OPS:
                if (op == "v-div" and i != j) or (op != "v-div" and j < i):
                    combos.append((left, op, right))
    return combos


def enumerate_expressions() -> list[str]:
    """All feature expressions: each vector expression under each scalar function."""
    return [" ".join([*combo, fn]) for combo in vector_combinations() for fn in V.SCALAR_OPS]


def sample_expressions(n: int, seed=0) -> list[str]:
    """``n`` expressions in seeded order."""
    import hashlib

    def rank(e):
        return hashlib.md5(f"{seed}:{e}".encode()).hexdigest()

    return sorted(enumerate_expressions(), key=rank)[:n]


def _applied(op: str, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """One of ``V.VECTOR_OPS`` on arrays; as in Spark, NaN is above all numbers and equals itself."""
    if op in ("v->", "v-<"):
        x, y = (x, y) if op == "v->" else (y, x)
        return ((x > y) | (np.isnan(x) & ~np.isnan(y))).astype("float64")
    with np.errstate(all="ignore"):
        if op == "v-div":
            return np.where(y == 0.0, 0.0, x / y)
        return {"v-add": np.add, "v-sub": np.subtract, "v-mul": np.multiply}[op](x, y)


def _scalars(m: np.ndarray) -> np.ndarray:
    """``V.SCALAR_OPS`` of the rows of a matrix with columns, one row for each function."""
    n = m.shape[1]
    with np.errstate(all="ignore"):
        avg = m.sum(axis=1) / n
        top = m if n <= TOP else np.partition(m, n - TOP, axis=1)[:, n - TOP :]
        of = {
            "s-max": m.max(axis=1),
            "s-min": np.fmin.reduce(m, axis=1),
            "s-avg": avg,
            "s-avg-top-25": top.mean(axis=1),
            "s-len": np.full(len(m), float(n)),
            "s-var": np.square(m - avg[:, None]).sum(axis=1) / n,
            "s-l2": np.sqrt(np.square(m).sum(axis=1)),
        }
    return np.stack([of[fn] for fn in V.SCALAR_OPS])


def _clipped(x: np.ndarray) -> np.ndarray:
    return np.where(np.isnan(x), CLIP_MAX, np.clip(x, CLIP_MIN, CLIP_MAX))


def _skipped(x: np.ndarray) -> np.ndarray:
    return x if len(x) <= IGNORE_FIRST else x[IGNORE_FIRST:]


def _statistics(m: np.ndarray, scale: float) -> np.ndarray:
    """STATISTICS of the rows of a matrix with columns, one row for each."""
    n = m.shape[1]
    with np.errstate(all="ignore"):
        m = np.sort(m, axis=1)
        avg = m.sum(axis=1) / n
        of = {
            "min": m[:, 0],
            "max": m[:, -1],
            "mean": avg,
            "l2": np.sqrt(np.square(m).sum(axis=1)),
            "var": np.square(m - avg[:, None]).sum(axis=1) / n,
        }
        for name, q in QUANTILES.items():
            at = (q if name == "median" else q * scale) * (n - 1)
            low = m[:, math.floor(at)]
            of[name] = low + (m[:, math.ceil(at)] - low) * (at - math.floor(at))
    return np.stack([of[name] for name in STATISTICS])


def _of_row(columns: list, row: int) -> list[np.ndarray | list | None]:
    """The vectors of a row of Arrow lists, as arrays; as lists, or None for NULL, where one is NULL, holds one or is longer than another."""
    own = [c[row].values for c in columns]
    if any(v is None or v.null_count for v in own) or len({len(v) for v in own}) > 1:
        return [None if v is None else v.to_pylist() for v in own]
    return [v.to_numpy() for v in own]


def _reduced(df: DataFrame, key: str, names: list[str], of_row: Callable[[list], np.ndarray | list]) -> DataFrame:
    """key and ``f``, what ``of_row`` makes of the vectors of a row, as one array. There is no shuffle."""

    def run(batches) -> Iterator:
        for batch in batches:
            columns = [batch.column(n) for n in names]
            held, at = [], 0
            for row in range(batch.num_rows):
                held.append(pa.array(of_row(_of_row(columns, row)), pa.float64()))
                size = len(held[0])
                if len(held) * size >= OUT_VALUES or row + 1 == batch.num_rows:
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(held) + 1) * size, pa.int32()), pa.concat_arrays(held))
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(held)), lists], names=["key", "f"])
                    held, at = [], row + 1

    schema = T.StructType([T.StructField("key", df.schema[key].dataType)]).add("f", T.ArrayType(T.DoubleType()))
    return df.select(F.col(key).alias("key"), *names).mapInArrow(run, schema).withColumnRenamed("key", key)


def _paired(op: str, x: list | None, y: list | None) -> list | None:
    """:func:`_applied` for lists; the shorter one is filled up with NULL."""
    if x is None or y is None:
        return None
    out = []
    for a, b in zip_longest(x, y):
        known = a is not None and b is not None
        out.append(0.0 if op == "v-div" and b == 0.0 else float(_applied(op, np.array(a), np.array(b))) if known else None)
    return out


def _odd_scalars(v: list | None) -> list[float | None]:
    """:func:`_scalars` of a list: NULL does not count for the extremes, comes last, and leaves no sum."""
    if v is None or not v:
        return [None if v is None or fn not in ("s-len", "s-l2") else 0.0 for fn in V.SCALAR_OPS]
    held = np.array([x for x in v if x is not None], "float64")
    of = dict(zip(V.SCALAR_OPS, _scalars(held[None])[:, 0].tolist())) if len(held) else {}
    if len(held) < len(v):
        top = of.get("s-avg-top-25") if len(held) >= min(TOP, len(v)) else None
        of = {"s-max": of.get("s-max"), "s-min": of.get("s-min"), "s-avg-top-25": top, "s-len": float(len(v))}
    return [of.get(fn) for fn in V.SCALAR_OPS]


def symbolic_features(df: DataFrame, key: str, expressions: list[str]) -> DataFrame:
    """Long form (key, expr, feat). Each vector is built once per row and shared by all the
    scalar functions that reduce it; there is no shuffle."""
    wanted: dict[tuple[str, ...], list[str]] = {}
    for e in expressions:
        *combo, fn = e.split(" ")
        wanted.setdefault(tuple(combo), []).append(fn)
    combos = list(wanted)
    asked = [(i, k) for i, c in enumerate(combos) for k, fn in enumerate(V.SCALAR_OPS) if fn in wanted[c]]
    labels = [" ".join([*combos[i], V.SCALAR_OPS[k]]) for i, k in asked]
    places = np.array([i * len(V.SCALAR_OPS) + k for i, k in asked], "int64")

    def of_row(vectors: list) -> np.ndarray | list:
        own = dict(zip(VECTORS, vectors))
        if any(v is None or isinstance(v, list) or not len(v) for v in vectors):
            own = {n: v if v is None else list(v) for n, v in own.items()}
            every = [_odd_scalars(own[c[0]] if len(c) == 1 else _paired(c[1], own[c[0]], own[c[2]])) for c in combos]
            return [every[i][k] for i, k in asked]
        step = max(1, BLOCK_VALUES // len(vectors[0]))
        out = []
        for start in range(0, len(combos), step):
            some = [own[c[0]] if len(c) == 1 else _applied(c[1], own[c[0]], own[c[2]]) for c in combos[start : start + step]]
            out.append(_scalars(np.stack(some)).T)
        return np.concatenate(out).ravel()[places]

    rows = _reduced(df, key, list(VECTORS.values()), of_row)
    named = F.arrays_zip(F.array(*[F.lit(x) for x in labels]).alias("expr"), F.col("f").alias("feat"))
    return rows.select(key, F.inline(named).alias("expr", "feat"))


def _odd_ratio(x: list | None, y: list | None) -> list | None:
    if x is None or y is None:
        return None
    x, y = ([float(_clipped(np.array(CLIP_MIN if e is None else e))) for e in v] for v in (x, y))
    return [None if a is None or b is None else a / b for a, b in zip_longest(x, y)]


def _odd_statistics(v: list | None, scale: float) -> list[float | None]:
    """:func:`_statistics` of a list: NULL comes first in its order and leaves no sum."""
    if not v:
        return [None] * len(STATISTICS)
    held = np.array([x for x in v if x is not None], "float64")
    if len(held) == len(v):
        return _statistics(held[None], scale)[:, 0].tolist()
    order = [None] * (len(v) - len(held)) + np.sort(held).tolist()
    of = {"min": order[0], "max": order[-1]}
    for name, q in QUANTILES.items():
        at = (q if name == "median" else q * scale) * (len(v) - 1)
        low, high = order[math.floor(at)], order[math.ceil(at)]
        of[name] = None if low is None or high is None else low + (high - low) * (at - math.floor(at))
    return [of.get(name) for name in STATISTICS]


def custom_features(df: DataFrame, key: str, compat: bool = False) -> DataFrame:
    """Long form (key, series, stat, value): ten statistics of four vectors and six clipped
    ratios, after the first 25 tokens of longer texts. A document without tokens keeps its rows; its
    values are NULL.

    ``compat`` reads the quantiles as percents (0.25 means the 0.25th percentile), as the
    published feature files do. A series is an array in its row, so there is no shuffle and
    each one is sorted once.
    """
    scale = 0.01 if compat else 1.0

    def of_row(vectors: list) -> np.ndarray | list:
        own = {n: v if v is None else _skipped(v) for n, v in zip(SERIES, vectors)}
        if any(v is None or isinstance(v, list) or not len(v) for v in own.values()):
            own = {n: v if v is None else list(v) for n, v in own.items()}
            series = [*own.values(), *[_odd_ratio(own[a], own[b]) for a, b in RATIOS]]
            return [x for v in series for x in _odd_statistics(v, scale)]
        cut = {n: _clipped(v) for n, v in own.items()}
        series = [*own.values(), *[cut[a] / cut[b] for a, b in RATIOS]]
        step = max(1, BLOCK_VALUES // len(series[0]))
        return np.concatenate([_statistics(np.stack(series[i : i + step]), scale).T.ravel() for i in range(0, len(series), step)])

    rows = _reduced(df, key, SERIES, of_row)
    names = [(s, t) for s in [*SERIES, *[f"{a}/{b}" for a, b in RATIOS]] for t in STATISTICS]
    columns = [F.array(*[F.lit(n[i]) for n in names]).alias(c) for i, c in enumerate(("series", "stat"))]
    return rows.select(key, F.inline(F.arrays_zip(*columns, F.col("f").alias("value"))).alias("series", "stat", "value"))


def feature_matrix(long: DataFrame, key: str) -> DataFrame:
    """One ARRAY<DOUBLE> of 100 features per key, in the published order."""
    order = [f"{s}:{t}" for s in [*SERIES, *[f"{a}/{b}" for a, b in RATIOS]] for t in STATISTICS]
    by_name = long.groupBy(key).agg(
        F.map_from_entries(F.collect_list(F.struct(F.concat_ws(":", "series", "stat"), "value"))).alias("_m")
    )
    return by_name.select(key, F.array(*[F.col("_m")[n] for n in order]).alias("features"))


def scaling(train: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """``mu`` and ``sigma`` (population) per feature, one row each; a table to be stored beside a model."""
    return train.groupBy(*by).agg(F.avg(value).alias("mu"), F.stddev_pop(value).alias("sigma"))


def zscore(
    long: DataFrame, train: DataFrame | None, by: list[str], value: str = "value", params: DataFrame | None = None
) -> DataFrame:
    """Add ``mu``, ``sigma`` (population) and ``z``. The parameters come from ``train`` only,
    or are those that :func:`scaling` gave earlier; there is one row of them per feature. A constant feature gives 0.

    The parameters are stored first: Spark then knows how few they are when it plans the join, and
    the rows need not gather by feature."""
    if params is None:
        params = materialise(scaling(train, by, value), "scaling")
    joined = long.join(params, by)
    z = F.when(F.col("sigma") == 0.0, F.lit(0.0)).otherwise((F.col(value) - F.col("mu")) / F.col("sigma"))
    return joined.withColumn("z", z)

