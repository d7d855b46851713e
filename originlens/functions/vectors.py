"""Element-wise and reducing expressions over ARRAY<DOUBLE>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of the element-wise and the reducing functions in expression strings.
VECTOR_OPS = ["v-add", "v-sub", "v-mul", "v-div", "v->", "v-<"]
SCALAR_OPS = ["s-max", "s-min", "s-avg", "s-avg-top-25", "s-len", "s-var", "s-l2"]


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def total(v) -> Column:
    return F.aggregate(_col(v), F.lit(0.0), lambda acc, x: acc + x)


def mean(v) -> Column:
    return F.try_divide(total(v), F.size(_col(v)).cast("double"))


def l2_norm(v) -> Column:
    return F.sqrt(F.aggregate(_col(v), F.lit(0.0), lambda acc, x: acc + x * x))


def l2_normalize(v) -> Column:
    """Unit-length copy; a zero vector is returned unchanged. The norm is repeated as an array: inside a lambda it
    would be computed for every value."""
    v = _col(v)
    norm = F.greatest(l2_norm(v), F.lit(1e-12))
    return F.zip_with(v, F.array_repeat(norm, F.size(v)), lambda x, n: x / n)


def variance(v, avg: Column | None = None) -> Column:
    """Population variance by the two-pass formula."""
    v = _col(v)
    m = mean(v) if avg is None else avg
    spread = F.aggregate(v, F.lit(0.0), lambda acc, x: acc + (x - m) * (x - m))
    return F.try_divide(spread, F.size(v).cast("double"))


def dot(a, b) -> Column:
    return total(F.zip_with(_col(a), _col(b), lambda x, y: x * y))


def vector_op(name: str, a, b) -> Column:
    """One of :data:`VECTOR_OPS`; division gives 0 where the divisor is 0."""
    fn = {
        "v-add": lambda x, y: x + y,
        "v-sub": lambda x, y: x - y,
        "v-mul": lambda x, y: x * y,
        "v-div": lambda x, y: F.when(y == 0.0, F.lit(0.0)).otherwise(x / y),
        "v->": lambda x, y: (x > y).cast("double"),
        "v-<": lambda x, y: (x < y).cast("double"),
    }[name]
    return F.zip_with(_col(a), _col(b), fn)


def scalar_op(name: str, v, avg: Column | None = None) -> Column:
    """One of :data:`SCALAR_OPS` as DOUBLE."""
    v = _col(v)
    if name == "s-max":
        return F.array_max(v)
    if name == "s-min":
        return F.array_min(v)
    if name == "s-avg":
        return mean(v) if avg is None else avg
    if name == "s-avg-top-25":
        return mean(F.slice(F.sort_array(v, asc=False), 1, 25))
    if name == "s-len":
        return F.size(v).cast("double")
    if name == "s-var":
        return variance(v, avg)
    if name == "s-l2":
        return l2_norm(v)
    raise ValueError(f"unknown scalar function {name!r}")


def quantile(sorted_v, q: float) -> Column:
    """Linearly interpolated quantile of an ascending array."""
    v = _col(sorted_v)
    at = F.lit(float(q)) * (F.size(v) - 1).cast("double")
    lo = F.floor(at).cast("int")
    hi = F.ceil(at).cast("int")
    low = F.try_element_at(v, lo + 1)
    return low + (F.try_element_at(v, hi + 1) - low) * (at - lo.cast("double"))
