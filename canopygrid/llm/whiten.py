"""Whitening of chip vectors by shifted CholeskyQR.

Chip values are stored as digital numbers (whole numbers, as rasters store bands). The
distinct vectors of the chips are the fit list. Each Gram pass over it is one Spark job:
rows are centred, carried through the triangular solves found so far and multiplied with
themselves per task; only the small sums come together. The Cholesky factor of the shifted sum
orthogonalises the rows further, until they are orthonormal; the product of the factors is the R
of the centred rows, and its singular vectors are the components. Small variances keep their relative
precision, which an eigenvalue routine on the covariance would lose.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from canopygrid.llm.common import need
from canopygrid.session import cut_lineage

EXACT = float(1 << 53)  # larger values have no exact digital number
BLOCK = 4096  # rows multiplied at once
PASSES = 12
TOLERANCE = 1e-11  # how far the Gram matrix of the orthogonalised rows may be from a projector
UNIT = np.finfo(float).eps / 2
PART = 26  # bits in the lower part of a sum


@dataclass(frozen=True)
class Whitening:
    """A fit: ``rows`` distinct vectors with per-dimension ``sums``; unit ``components`` (one per row) of
    falling ``variances``, those without variance left out; ``explained`` shares; ``identity_error`` is the largest absolute
    entry of the whitened fit list's covariance minus the identity; ``passes`` over the fit list."""

    rows: int
    sums: tuple[int, ...]
    components: np.ndarray
    variances: np.ndarray
    explained: np.ndarray
    identity_error: float
    passes: int

    @property
    def centre(self) -> Centre:
        return Centre.of(self.rows, self.sums)


@dataclass(frozen=True)
class Centre:
    """The mean as whole numbers plus ``rest / rows``, so that centring and deviations are exact."""

    rows: int
    whole: np.ndarray
    rest: np.ndarray

    @classmethod
    def of(cls, rows: int, sums: tuple[int, ...]) -> Centre:
        return cls(rows, np.array([s // rows for s in sums], dtype=np.int64), np.array([s % rows for s in sums], dtype=np.int64))

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole).astype(float) - self.rest / self.rows

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (rows * x - sum)^2; None where it is no 64-bit number."""
        z = x - self.whole
        most = self.rows * (int(np.abs(z).max(initial=0)) + 1)
        if z.shape[1] * most * most < 1 << 63:
            t = z * self.rows - self.rest
            return (t * t).sum(axis=1).tolist()
        t = z.astype(object) * self.rows - self.rest.astype(object)
        return [v if v < 1 << 63 else None for v in (t * t).sum(axis=1).tolist()]


def digital_numbers(chips: DataFrame, v: str = "v", scale: float = 64.0, offset: int = 1_000_000) -> DataFrame:
    """Chips with ``v`` as whole numbers, ``floor(scale * value) + offset``.

    Chips whose vector is null or empty, or holds a null, a non-finite value or one too large for an
    exact number, are left out. All other rows and columns stay.
    """
    need(chips, v)
    usable = lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double") * scale) < EXACT)
    kept = chips.where(F.col(v).isNotNull() & (F.size(v) > 0) & F.coalesce(F.forall(v, usable), F.lit(False)))
    return kept.withColumn(v, F.transform(v, lambda c: F.floor(c.cast("double") * scale).cast("long") + F.lit(offset).cast("long")))


def _rows(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _sums(fit: DataFrame, dims: int) -> tuple[int, ...]:
    """Exact per-dimension sums: high and low parts apart, so that no task overflows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        high, low = np.zeros(dims, dtype=np.int64), np.zeros(dims, dtype=np.int64)
        for b in batches:
            x = _rows(b.column(0), dims)
            high += (x >> PART).sum(axis=0)
            low += (x & ((1 << PART) - 1)).sum(axis=0)
        yield pa.RecordBatch.from_pydict({"i": np.arange(dims), "high": high, "low": low})

    parts = fit.select("x").mapInArrow(run, "i long, high long, low long")
    wide = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    got = {r.i: (int(r.high) << PART) + int(r.low) for r in parts.groupBy("i").agg(wide("high"), wide("low")).collect()}
    return tuple(got.get(i, 0) for i in range(dims))


def _gram(fit: DataFrame, centre: Centre, carry: Callable[[np.ndarray], np.ndarray], dims: int) -> np.ndarray:
    """Sum over the fit list of y'y, y a centred row after ``carry``, bordered by the sum of y in the last row."""
    width = len(centre.whole)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dims + 1, dims))
        for b in batches:
            x = _rows(b.column(0), width)
            for at in range(0, len(x), BLOCK):
                y = carry(centre.centred(x[at:at + BLOCK]))
                total[:dims] += y.T @ y
                total[dims] += y.sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims + 1)), pa.array(list(total), pa.list_(pa.float64()))], names=["i", "g"])

    parts = fit.select("x").mapInArrow(run, "i long, g array<double>").select("i", F.posexplode("g").alias("j", "g"))
    out = np.zeros((dims + 1, dims))
    for r in parts.groupBy("i", "j").agg(F.sum("g").alias("g")).collect():  # as many rows as the matrix has entries
        out[r.i, r.j] = r.g
    return out


def solve_right(y: np.ndarray, r: np.ndarray) -> np.ndarray:
    """q with q r = y, r upper triangular: a triangular solve for all rows of y at once."""
    q = np.empty_like(y)
    for j in range(y.shape[1]):
        q[:, j] = (y[:, j] - q[:, :j] @ r[:j, j]) / r[j, j]
    return q


def _through(factors: list[np.ndarray]) -> Callable[[np.ndarray], np.ndarray]:
    def carry(y: np.ndarray) -> np.ndarray:
        for r in factors:
            y = solve_right(y, r)
        return y
    return carry


def shifted_factor(gram: np.ndarray, shifted: bool) -> np.ndarray:
    """Upper triangular r with r'r = gram, plus a shift about as large as its rounding errors."""
    d = len(gram)
    shift = 11 * (2 * d * d + d) * UNIT * max(np.linalg.norm(gram, 2), np.finfo(float).tiny) if shifted else 0.0
    while True:
        try:
            return np.linalg.cholesky(gram + shift * np.eye(d)).T
        except np.linalg.LinAlgError:
            shift = max(10 * shift, UNIT * np.trace(gram))


def triangular_factor(fit: DataFrame, centre: Centre) -> tuple[np.ndarray, int]:
    """R of the centred fit list, and how many passes it took.

    Every pass multiplies the rows carried through all factors so far. It is over when that Gram matrix
    is a projector: the identity, or zero along directions in which the rows do not vary.
    """
    d = len(centre.whole)
    factors: list[np.ndarray] = []
    for n in range(1, PASSES + 1):
        gram = _gram(fit, centre, _through(factors), d)[:d]
        gram = (gram + gram.T) / 2
        values = np.linalg.eigvalsh(gram)
        if factors and np.minimum(np.abs(values - 1), np.abs(values)).max() < TOLERANCE:
            break
        factors.append(shifted_factor(gram, shifted=not factors or values[0] < 0.01))
    product = np.eye(d)
    for r in factors:
        product = r @ product
    return product, n


def fit_whitening(numbers: DataFrame, v: str = "v", components: int = 16) -> Whitening | None:
    """Fit on the distinct vectors of ``numbers`` (digital numbers), each once.

    Covariances are over the fit list, with its size as divisor. Vectors of the commonest length count (the
    shorter of two equally common), others have no part in the fit. None if there is nothing to fit.
    The driver sees sums per dimension and pair of dimensions, never vectors.
    """
    need(numbers, v)
    fit = cut_lineage(numbers.select(F.col(v).alias("x")).where(F.col("x").isNotNull()).groupBy("x").agg(F.lit(1).alias("_")).select("x"))
    sizes = fit.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    if not sizes:
        return None
    d, n = sizes[0]
    fit = fit.where(F.size("x") == d)
    sums = _sums(fit, d)
    if n == 1:  # nothing varies
        return Whitening(n, sums, np.zeros((0, d)), np.zeros(0), np.zeros(0), 0.0, 0)
    centre = Centre.of(n, sums)
    r, passes = triangular_factor(fit, centre)
    _, s, vt = np.linalg.svd(r)
    least = s[0] * d * 8 * UNIT  # below this a direction holds rounding errors only
    k = min(components, int((s > least).sum()))
    variances = s ** 2 / n
    for i in range(d):  # either sign will do: the largest entry is positive
        vt[i] *= np.sign(vt[i, np.abs(vt[i]).argmax()]) or 1.0
    explained = variances / variances.sum()
    done = Whitening(n, sums, vt[:k], variances[:k], explained[:k], 0.0, passes)
    got = _gram(fit, centre, _projection(done), k)
    mean = got[k] / n
    error = float(np.abs(got[:k] / n - np.outer(mean, mean) - np.eye(k)).max())
    return Whitening(n, sums, vt[:k], variances[:k], explained[:k], error, passes + 1)


def _projection(fit: Whitening) -> Callable[[np.ndarray], np.ndarray]:
    weights = (fit.components / np.sqrt(fit.variances)[:, None]).T
    return lambda y: y @ weights


def whiten(numbers: DataFrame, fit: Whitening, v: str = "v", whitened: str = "whitened", deviation: str = "deviation") -> DataFrame:
    """Every row with ``whitened`` (one value per component) and ``deviation`` (its exact squared distance
    from the sums, times the squared fit size; null beyond 64 bits).

    Row by row: repeated rows and null keys stay. Rows whose vector is null or of another length than
    the fit's get null in both. Columns of these names are replaced.
    """
    need(numbers, v)
    kept = numbers.drop(*{whitened, deviation} - {v})
    fields = [f for f in kept.schema.fields]
    schema = T.StructType([*fields, T.StructField(deviation, T.LongType()), T.StructField(whitened, T.ArrayType(T.DoubleType()))])
    at, centre, project, d = kept.columns.index(v), fit.centre, _projection(fit), len(fit.sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, BLOCK):
                b = batch.slice(low, BLOCK)
                column = b.column(at)
                fits = pa.compute.equal(pa.compute.list_value_length(column), d).fill_null(False)
                x = _rows(column.filter(fits), d)
                which = fits.to_numpy(zero_copy_only=False)
                values = np.full(len(which), None, dtype=object)
                dev = np.full(len(which), None, dtype=object)
                values[which] = [None] * len(x)
                y = project(centre.centred(x))
                for i, row, one in zip(np.flatnonzero(which).tolist(), y, centre.deviations(x), strict=True):
                    values[i], dev[i] = row, one
                yield pa.RecordBatch.from_arrays(
                    [*b.columns, pa.array(dev.tolist(), pa.int64()), pa.array(values.tolist(), pa.list_(pa.float64()))], names=schema.names)

    return kept.mapInArrow(run, schema)


def whiten_chips(chips: DataFrame, chip: str = "chip", v: str = "v", components: int = 16, scale: float = 64.0,
                 offset: int = 1_000_000) -> tuple[DataFrame, Whitening | None]:
    """``chip, deviation, whitened`` of every usable chip, and the fit. No fit, no rows.

    Usable chips are those of ``digital_numbers``; chips of another length than the fit's have nulls.
    """
    need(chips, chip, v)
    numbers = digital_numbers(chips.select(F.col(chip).alias("_chip"), F.col(v).alias("_v")), "_v", scale, offset)
    fit = fit_whitening(numbers, "_v", components)
    if fit is None:
        key = numbers.schema["_chip"].dataType.simpleString()
        return chips.sparkSession.createDataFrame([], f"`{chip}` {key}, deviation long, whitened array<double>"), None
    return whiten(numbers, fit, "_v").select(F.col("_chip").alias(chip), "deviation", "whitened"), fit
