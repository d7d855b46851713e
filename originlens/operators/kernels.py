"""Support-vector machines with a Gaussian kernel, by random Fourier features.

Products of the features approach the kernel exp(-gamma |x - y|^2) as their number grows, so a linear fit on
them is a kernel machine whose size depends on the number of features, not of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LinearSVC, LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from originlens.operators.sampling import stratified_kfold
from originlens.session import materialise

COMPONENTS = 256
SMOOTHING = (0.1, 0.01, 0.002)  #: widths of the bend that stands for the corner of a loss, the last one counts
PART_BYTES = 32 << 20
SLICE = 2048  #: rows whose mapped features a task holds at once
HINGE_STEPS = 30  #: of a hinge fit, at most
MEMORY = 10  #: steps that the quasi-Newton fit remembers


def _matrix(x: pa.Array) -> np.ndarray:
    """The arrays of a column as the rows of a matrix; they must have one length."""
    lengths = x.value_lengths()
    if lengths.null_count or len(lengths.unique()) > 1:
        raise ValueError("features must be arrays of one length")
    return x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1)


@dataclass(frozen=True)
class FourierFeatures:
    """sqrt(2/D) cos(x W + b) with seeded W, normal with variance 2 gamma, and uniform b."""

    weights: np.ndarray
    shifts: np.ndarray

    @classmethod
    def make(cls, dims: int, gamma: float, components: int = COMPONENTS, seed: int = 42) -> FourierFeatures:
        rng = np.random.default_rng(seed)
        w = rng.standard_normal((dims, components)) * np.sqrt(2.0 * gamma)
        return cls(w, rng.uniform(0.0, 2.0 * np.pi, components))

    def map(self, x: np.ndarray) -> np.ndarray:
        z = x @ self.weights
        z += self.shifts
        np.cos(z, out=z)
        z *= np.sqrt(2.0 / len(self.shifts))
        return z

    def slices(self, x: np.ndarray) -> Iterable[tuple[slice, np.ndarray]]:
        """The mapped rows of ``x``, SLICE at a time, with their places."""
        for at in range(0, len(x), SLICE):
            own = slice(at, at + SLICE)
            yield own, self.map(x[own])

    def column(self, features: str) -> Column:
        """The mapped features as an array."""

        @arrow_udf("array<double>")
        def mapped(x: pa.Array) -> pa.Array:
            d = len(self.shifts)
            z = np.empty((len(x), d))
            if len(x):
                for own, part in self.slices(_matrix(x)):
                    z[own] = part
            return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype="int32") * d), pa.array(z.reshape(-1)))

        return mapped(F.col(features))

    def margin(self, features: str, w: np.ndarray, intercept: float) -> Column:
        """The linear form of the mapped features; they stay inside the batch."""

        @arrow_udf("double")
        def margin(x: pa.Array) -> pa.Array:
            m = [z @ w + intercept for _, z in self.slices(_matrix(x))] if len(x) else []
            return pa.array(np.concatenate([np.empty(0), *m]))

        return margin(F.col(features))


def scale_gamma(df: DataFrame, features: str) -> tuple[int, int, float]:
    """Number of rows, number of features, and 1 / (their number x the variance of all entries); 1 if nothing varies."""
    x = F.col(features)
    total, square = (F.aggregate(x, F.lit(0.0), f) for f in (lambda s, v: s + v, lambda s, v: s + v * v))
    r = df.agg(F.max(F.size(x)).alias("d"), F.sum(F.size(x)).alias("n"), F.sum(total).alias("s"), F.sum(square).alias("q")).first()
    if not r.d:
        raise ValueError("no rows with features to fit on")
    var = r.q / r.n - (r.s / r.n) ** 2
    return int(r.n // r.d), int(r.d), 1.0 / (r.d * var) if var > 1e-12 else 1.0


def _stored(rows: DataFrame, n: int, components: int) -> DataFrame:
    """``rows`` in the shared folder, in files whose mapped features are about PART_BYTES, which every pass reads."""
    return materialise(rows.repartition(max(1, -(-n * components * 8 // PART_BYTES))), "fourier")


@dataclass(frozen=True)
class KernelMachine:
    """A fitted form over Fourier features; ``sigmoid`` (slope, shift) turns margins into probabilities."""

    features: FourierFeatures
    weights: np.ndarray
    intercept: float
    sigmoid: tuple[float, float] | None = None

    def score(self, df: DataFrame, features: str = "features") -> DataFrame:
        m = self.features.margin(features, self.weights, self.intercept)
        if self.sigmoid is None:
            return df.withColumn("score", m)
        z = F.lit(self.sigmoid[0]) * F.col("_m") + F.lit(self.sigmoid[1])
        return df.withColumn("_m", m).withColumn("score", F.lit(1.0) / (F.lit(1.0) + F.exp(-z))).drop("_m")


def _hinge(rows: DataFrame, label: str, c: float) -> tuple[np.ndarray, float]:
    m = LinearSVC(featuresCol="_v", labelCol=label, regParam=1.0 / (c * max(rows.count(), 1)), standardization=False, maxIter=HINGE_STEPS, tol=1e-4).fit(rows)
    return m.coefficients.toArray(), float(m.intercept)


def fit_svc(
    train: DataFrame, label: str = "y", features: str = "features", key: str = "id", c: float = 1.0, components: int = COMPONENTS, cv: int = 5, seed: int = 42
) -> KernelMachine:
    """A hinge-loss classifier; its probabilities come from a sigmoid over the margins of ``cv`` folds, each
    scored by a machine that was fitted on the others; ``cv=0`` gives margins instead. Rows with NULL features or label are an error in Spark's fit."""
    n, dims, gamma = scale_gamma(train, features)
    f = FourierFeatures.make(dims, gamma, components, seed)
    rows = train.select(key, label, features)
    folds = stratified_kfold(rows, str(seed), cv, label, key) if cv else rows.withColumn("fold", F.lit(0))
    mapped = _stored(folds.select("fold", F.col(label).cast("double").alias("y"), f.column(features).alias("z")), n, components)
    mapped = mapped.withColumn("_v", array_to_vector("z"))
    whole = _hinge(mapped, "y", c)
    if not cv:
        return KernelMachine(f, *whole)
    held = None
    for fold in range(cv):
        w, b = _hinge(mapped.filter(F.col("fold") != fold), "y", c)
        one = mapped.filter(F.col("fold") == fold).select("y", (_product("z", w) + F.lit(b)).alias("m"))
        held = one if held is None else held.unionByName(one)
    held = held.withColumn("_v", array_to_vector(F.array("m")))
    sigmoid = LogisticRegression(featuresCol="_v", labelCol="y", regParam=0.0).fit(held)
    return KernelMachine(f, *whole, (float(sigmoid.coefficients[0]), float(sigmoid.intercept)))


def _product(array: str, w: np.ndarray) -> Column:
    weights = F.array(*[F.lit(float(x)) for x in w])
    return F.aggregate(F.zip_with(array, weights, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def minimise(evaluate: Callable[[np.ndarray], tuple[float, np.ndarray]], start: np.ndarray, tolerance: float = 1e-5, passes: int = 150) -> np.ndarray:
    """A minimum by limited-memory quasi-Newton steps with halving; ``evaluate`` gives the value and the gradient
    at a point and is called ``passes`` times at most. Ends where no entry of the gradient exceeds ``tolerance``."""
    x = start
    value, g = evaluate(x)
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    used = 1
    while np.abs(g).max() > tolerance and used < passes:
        d, factors = -g, []
        for s, y in reversed(steps):
            a = (s @ d) / (s @ y)
            factors.append(a)
            d = d - a * y
        if steps:
            s, y = steps[-1]
            d = d * (s @ y) / (y @ y)
        for (s, y), a in zip(steps, reversed(factors)):
            d = d + s * (a - (y @ d) / (s @ y))
        if d @ g >= 0:
            d, steps = -g, []
        size = 1.0 if steps else min(1.0, 1.0 / np.abs(g).sum())
        while True:
            there, gradient = evaluate(x + size * d)
            used += 1
            if there <= value + 1e-4 * size * (d @ g) or used >= passes:
                break
            size /= 2
        if there > value:
            break
        s, y = size * d, gradient - g
        if s @ y > 1e-12:
            steps = [*steps, (s, y)][-MEMORY:]
        x, value, g = x + s, there, gradient
    return x


def _bend(t: np.ndarray, width: float) -> tuple[np.ndarray, np.ndarray]:
    """max(0, t) with a corner that is rounded over ``width``, and its derivative."""
    inside = np.clip(t, 0.0, width)
    return inside**2 / (2 * width) + np.maximum(t - width, 0.0), inside / width


def tube_loss(rows: DataFrame, f: FourierFeatures, w: np.ndarray, epsilon: float, width: float) -> tuple[float, np.ndarray, int]:
    """Sum of the epsilon-insensitive losses of ``rows`` (y, x) under the weights of the mapped x (the last one is the intercept),
    its gradient, and the number of rows. Tasks map SLICE rows at a time, so that a pass reads the few features and not
    the mapped ones; they return one row per weight, which Spark sums before the driver sees them."""

    def run(batches: Iterable):
        total = np.zeros(len(w) + 2)
        for b in batches:
            if b.num_rows:
                y = b.column(0).to_numpy()
                for own, z in f.slices(_matrix(b.column(1))):
                    off = z @ w[:-1] + w[-1] - y[own]
                    loss, slope = _bend(np.abs(off) - epsilon, width)
                    slope = slope * np.sign(off)
                    total += [*(z.T @ slope), slope.sum(), loss.sum(), len(off)]
        yield pa.RecordBatch.from_pydict({"pos": list(range(len(total))), "v": total.tolist()})

    sums = rows.select("y", "x").mapInArrow(run, "pos bigint, v double").groupBy("pos").agg(F.sum("v").alias("v")).collect()
    v = np.array([r.v for r in sorted(sums)])
    return float(v[-2]), v[:-2], int(v[-1])


def fit_svr(
    train: DataFrame, label: str = "y", features: str = "features", c: float = 1.0, epsilon: float = 0.1, components: int = COMPONENTS, seed: int = 42
) -> KernelMachine:
    """Epsilon-insensitive regression: least |w|^2 / 2 + C x the sum of max(0, |y - f(x)| - epsilon).

    A quasi-Newton fit, one distributed pass over the stored rows for each value and gradient. The corners of the
    loss are rounded, less with each of SMOOTHING, and the fit goes on from the one before; the loss ends within
    half the last width, per row, of the least."""
    n, dims, gamma = scale_gamma(train, features)
    f = FourierFeatures.make(dims, gamma, components, seed)
    rows = _stored(train.select(F.col(label).cast("double").alias("y"), F.col(features).alias("x")), n, components)
    w = np.zeros(components + 1)
    for width in SMOOTHING:

        def evaluate(w: np.ndarray, width: float = width) -> tuple[float, np.ndarray]:
            loss, g, n = tube_loss(rows, f, w, epsilon, width)
            own = np.append(w[:-1], 0.0) / (c * n)
            return loss / n + w[:-1] @ w[:-1] / (2 * c * n), g / n + own

        w = minimise(evaluate, w, width / 50)
    return KernelMachine(f, w[:-1], float(w[-1]))


def svr_gradient(machine: KernelMachine, train: DataFrame, label: str = "y", features: str = "features", c: float = 1.0, epsilon: float = 0.1) -> DataFrame:
    """weight (its position; the last is the intercept), gradient: the mean gradient of the rounded objective at the
    fitted weights, by Spark expressions. All are near 0 if the fit has converged."""
    width = SMOOTHING[-1]
    z = machine.features.column(features)
    scored = machine.score(train, features).withColumn("_off", F.col("score") - F.col(label).cast("double"))
    slope = F.signum("_off") * F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.abs("_off") - F.lit(epsilon)) / F.lit(width))
    long = scored.select(slope.alias("_s"), F.posexplode(F.concat(z, F.array(F.lit(1.0)))).alias("weight", "_z"))
    mean = long.groupBy("weight").agg(F.sum(F.col("_s") * F.col("_z")).alias("s"), F.count(F.lit(1)).alias("n"))
    own = F.array(*[F.lit(float(x) / c) for x in machine.weights], F.lit(0.0))
    return mean.select("weight", ((F.col("s") + F.element_at(own, F.col("weight") + 1)) / F.col("n")).alias("gradient"))
