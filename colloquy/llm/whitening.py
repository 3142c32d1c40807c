"""Whitening of embeddings along the leading eigenvectors of their covariance.

Entries become whole numbers (``SCALE`` to one), so that counts, sums and centred
products are exact whatever the order in which Spark adds them up. Every task reduces
its different vectors to the sums of products of their dimensions, centred by the
rounded mean; Spark adds these up by pair of dimensions, and what the rounding of the
mean left is taken out in whole numbers. Only sums by dimension and by pair of
dimensions reach the driver (the square of the vectors' width, however many there are),
where spectrum slicing finds the eigenpairs. The covariance of the whitened vectors is
then measured over the vectors themselves.

Edge cases: a vector that is null or holds null, NaN or infinity is dropped, as is one
whose length is not the commonest among different vectors (the longest of equally
common ones); repeated rows and ids each get their rows but count once in the
covariance, null ids are kept, vectors of fewer dimensions than components have fewer
components, components without variance get null as whitened (explained is null where
nothing varies), a deviation beyond a long is null, extra columns are ignored, an empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.llm import spectrum
from colloquy.llm.storage import spool

SCALE, COMPONENTS = 256, 4
ROWS = 1 << 12
_MOST_LONG = (1 << 63) - 1


def whole_numbers(vector: str = "embedding") -> Column:
    """x of a row, null where the vector can't be used."""
    good = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))
    x = F.transform(F.col(vector).cast("array<double>"), lambda c: F.floor(c * SCALE))
    return F.when(F.forall(vector, good), x)


def matrices(batches: Iterator[pa.RecordBatch], width: int, column: str = "x") -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices of at most ``ROWS`` rows with their vectors."""
    for b in batches:
        for a in range(0, b.num_rows, ROWS):
            part = b.slice(a, ROWS)
            x = part.column(part.schema.get_field_index(column)).flatten()
            yield part, x.to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)


def exact_products(y: np.ndarray) -> np.ndarray:
    """The sum over rows of products of whole numbers, as Python numbers: in doubles where those are exact."""
    small = (np.abs(y) < 1 << 20).all(1)  # ROWS products of 40 bits fit into 53
    a = y[small].astype(float)
    out = (a.T @ a).astype(np.int64).astype(object)
    for row in y[~small].astype(object):
        out += np.outer(row, row)
    return out


def _summed(rows: DataFrame, run, schema: str, keys: list[str]) -> list:
    """Sums of decimal s by the keys of what each task makes."""
    return rows.mapInArrow(run, f"{schema}, s decimal(38,0)").groupBy(*keys).agg(F.sum("s").alias("s")).collect()


def _sums(fit: DataFrame, width: int) -> tuple[int, np.ndarray]:
    def run(batches):
        n, total = 0, np.zeros(width, object)
        for _, x in matrices(batches, width):
            n += len(x)
            total += x.sum(0) if np.abs(x).max(initial=0) < 1 << 50 else x.astype(object).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(range(-1, width), pa.int32()), pa.array([Decimal(int(v)) for v in (n, *total)], pa.decimal128(38, 0))], ["i", "s"])

    got = {r.i: int(r.s) for r in _summed(fit, run, "i int", ["i"])}
    return got[-1], np.array([got[i] for i in range(width)], object)


def covariance(fit: DataFrame, width: int, n: int, total: np.ndarray) -> np.ndarray:
    """The covariance of the rows of ``fit`` (divisor n), each entry rounded once."""
    centre = np.array([(2 * int(s) + n) // (2 * n) for s in total], np.int64)
    upper = np.triu_indices(width)

    def run(batches):
        sums = np.zeros((width, width), object)
        for _, x in matrices(batches, width):
            sums += exact_products(x - centre)
        yield pa.RecordBatch.from_arrays([pa.array(upper[0].astype(np.int32)), pa.array(upper[1].astype(np.int32)), pa.array([Decimal(int(v)) for v in sums[upper]], pa.decimal128(38, 0))], ["i", "j", "s"])

    left = [int(s) - n * int(c) for s, c in zip(total, centre, strict=True)]
    v = np.zeros((width, width))
    for r in _summed(fit, run, "i int, j int", ["i", "j"]):
        v[r.i, r.j] = v[r.j, r.i] = (n * int(r.s) - left[r.i] * left[r.j]) / (n * n)
    return v


class Whitening:
    """What the tasks need to whiten a vector."""

    def __init__(self, n: int, total: np.ndarray, values: np.ndarray, vectors: np.ndarray, trace: float) -> None:
        self.n, self.total, self.values, self.vectors, self.trace = n, total, values, vectors, trace
        self.live = values > spectrum.EPS * len(total) * max(float(values.max(initial=0)), 0)

    def centred(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """n * x - S in whole numbers, and x - S / n."""
        if np.abs(x).max(initial=0) * self.n < 1 << 61 and max(map(abs, self.total), default=0) < 1 << 61:
            y = x * self.n - self.total.astype(np.int64)
        else:
            y = x.astype(object) * self.n - self.total
        return y, (y / self.n).astype(float)

    def deviation(self, y: np.ndarray) -> list[int | None]:
        top = int(np.abs(y).max(initial=0))
        s = (y if top * top * max(1, y.shape[1]) <= _MOST_LONG else y.astype(object)) ** 2
        return [int(v) if int(v) <= _MOST_LONG else None for v in s.sum(1)]

    def __call__(self, middle: np.ndarray) -> np.ndarray:
        """Whitened values, one column for each component; NaN where a component has no variance."""
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(self.live, middle @ self.vectors.T / np.sqrt(np.where(self.live, self.values, 1)), np.nan)


def identity_error(fit: DataFrame, width: int, by: Whitening) -> float | None:
    """The largest absolute entry of the whitened vectors' covariance minus the identity, measured over ``fit``."""
    k = int(by.live.sum())
    if k == 0:
        return None

    def run(batches):
        first, second = np.zeros(k), np.zeros((k, k))
        for _, x in matrices(batches, width):
            w = by(by.centred(x)[1])[:, by.live]
            first += w.sum(0)
            second += w.T @ w
        yield pa.RecordBatch.from_arrays([pa.array(range(k + k * k), pa.int32()), pa.array(np.concatenate([first, second.ravel()]))], ["i", "s"])

    got = {r.i: r.s / by.n for r in fit.mapInArrow(run, "i int, s double").groupBy("i").agg(F.sum("s").alias("s")).collect()}
    mean = np.array([got[i] for i in range(k)])  # nearly nothing, for the vectors are centred before
    v = np.array([got[k + i] for i in range(k * k)]).reshape(k, k) - np.outer(mean, mean)
    return float(np.abs(v - np.eye(k)).max())


def whiten(rows: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error for every usable row of ``rows`` (vec_id, embedding) and component."""
    kind = dict(rows.dtypes)["vec_id"]
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    usable = rows.select("vec_id", whole_numbers().alias("x")).where("x is not null")
    fit = spool(usable.select("x").distinct(), "vectors")
    lengths = fit.groupBy(F.size("x").alias("width")).agg(F.count("*").alias("k")).orderBy(F.desc("k"), F.desc("width")).first()
    if lengths is None or lengths.width == 0:
        return rows.sparkSession.createDataFrame([], schema)
    width = lengths.width
    fit, usable = fit.where(F.size("x") == width), usable.where(F.size("x") == width)
    n, total = _sums(fit, width)
    v = covariance(fit, width, n, total)
    values, vectors = spectrum.leading(v, components)
    by = Whitening(n, total, values, vectors, float(np.trace(v)))
    error, k = identity_error(fit, width, by), len(values)
    explained = [float(e) / by.trace if by.trace > 0 else None for e in values]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in matrices(batches, width):
            y, middle = by.centred(x)
            w = by(middle).ravel()
            m, ids = len(x), part.column(0)
            where = pa.array(np.repeat(np.arange(m), k))
            one = [pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n, np.int64)), pa.array(by.deviation(y), pa.int64()).take(where)]
            yield pa.RecordBatch.from_arrays([ids.take(where), *one, pa.array(w, mask=np.isnan(w)), pa.array(explained * m, pa.float64()), pa.array([error] * (m * k), pa.float64())], [f.split()[0] for f in schema.split(", ")])

    return usable.mapInArrow(run, schema)
