"""Whitening of embeddings from an exact, bit-sliced scatter matrix.

Method.  An entry c becomes the integer x = floor(64 * c) + 1000000.  Every task packs its rows block by block: of each
dimension the block's least value is taken off and the rest is cut into bit planes, one bit a row, 64 rows a word.  The
sum of products of two dimensions is the sum over their planes a, b of 2**(a + b) * popcount(a AND b), put back by the
values taken off; all of it in integers.  Tasks send one sum for each pair of dimensions, Spark adds those up exactly
(decimals of 38 digits), and the driver centres them as integers, n * sum(x * y) - sum(x) * sum(y), before the division
by n * n and numpy's eigh.  A last pass projects the rows.

Sent to all tasks: one matrix of dimensions by components, and the sums.  At the driver: one scatter matrix, d * (d + 1) / 2
numbers for vectors of d entries.  Neither grows with the rows.  No row is grouped by its values, so a vector that many
rows share makes no task larger.

Vectors that are null, empty or hold null or non-finite entries take no part, nor do those with an entry of 2**47 or more
in size, whose products would leave 38 digits.  Vectors of other lengths have no covariance with each other: each length
is a fit list of its own.  Rows that repeat, and rows without vec_id, count as often as they stand.  A component along
which nothing varies (at most 1e-11 of the trace) has no scale: whitened is null and it is left out of identity_error.
A deviation that does not fit a long is null there and whole in deviation_exact.  No vectors: no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE, OFFSET = 64, 1_000_000
#: Cells of a block of rows, so that wide vectors come in fewer rows at a time.
BLOCK_CELLS = 1 << 22
#: Share of the trace up to which a direction counts as one without variance.
FLAT = 1e-11

PARTIAL = "dim int, i int, j int, total decimal(38,0)"
PRODUCTS = "dim int, i int, j int, total double"
PROJECTED = "vec_id long, dim int, deviation long, deviation_exact decimal(38,0), whitened array<double>"


@dataclass
class Whitening:
    """What vectors of one length were fitted to: count, sums, components (columns) with their eigenvalues, trace."""

    n: int
    sums: list[int]
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float

    @property
    def live(self) -> np.ndarray:
        return self.eigenvalues > FLAT * self.trace

    def project(self, x: np.ndarray) -> np.ndarray:
        """Rows by components; not a number along flat ones."""
        with np.errstate(divide="ignore", invalid="ignore"):
            scaled = np.where(self.live, 1.0 / np.sqrt(np.maximum(self.eigenvalues, 0.0)), np.nan)
        return (self.from_mean(x) / float(self.n)).astype(np.float64) @ self.components * scaled

    def from_mean(self, x: np.ndarray) -> np.ndarray:
        """n * x - sums, exact: in 64 bits where that is enough."""
        largest = self.n * max(1, int(np.abs(x).max(initial=0))) + max(map(abs, self.sums))
        kind = np.int64 if largest < 2**62 else object
        return x.astype(kind) * self.n - np.array(self.sums, dtype=kind)

    def deviations(self, x: np.ndarray) -> list[int]:
        away = self.from_mean(x)
        if int(np.abs(away).max(initial=0)) ** 2 * x.shape[1] >= 2**62:
            away = away.astype(object)
        return [int(v) for v in (away * away).sum(axis=1)]


def fixed_point(vectors: DataFrame) -> DataFrame:
    """vec_id, dim and x, the entries as integers, of the rows that take part."""
    v = F.col("embedding").cast("array<double>")
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) >= float(2**47)))
    kept = vectors.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & ~bad)
    x = F.transform(v, lambda c: (F.floor(c * SCALE) + OFFSET).cast("long"))
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), F.size("embedding").alias("dim"), x.alias("x"))


def bit_sliced_products(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the columns and of the products of each two, as Python integers."""
    n, d = x.shape
    least = x.min(axis=0)
    shifted = (x - least).astype(np.uint64)
    widths = [max(1, int(m).bit_length()) for m in shifted.max(axis=0)]
    words = -(-n // 64)
    planes = np.zeros((sum(widths), words * 8), np.uint8)
    weights, place = [], 0
    for column, width in zip(shifted.T, widths, strict=True):
        bits = (column[None, :] >> np.arange(width, dtype=np.uint64)[:, None]) & np.uint64(1)
        packed = np.packbits(bits.astype(np.uint8), axis=1)
        planes[place:place + width, :packed.shape[1]] = packed
        weights += [1 << b for b in range(width)]
        place += width
    planes = planes.view(np.uint64)
    counts = np.zeros((len(planes), len(planes)), np.int64)
    for a in range(len(planes)):
        counts[a, a:] = np.bitwise_count(planes[a] & planes[a:]).sum(axis=1, dtype=np.int64)
        counts[a:, a] = counts[a, a:]
    weight = np.array(weights, dtype=object)
    starts = np.concatenate([[0], np.cumsum(widths)[:-1]])
    own = np.add.reduceat(np.diagonal(counts).astype(object) * weight, starts)
    scatter = np.add.reduceat(np.add.reduceat(counts.astype(object) * np.outer(weight, weight), starts, axis=0), starts, axis=1)
    off = least.astype(object)
    return own + n * off, scatter + np.outer(off, own) + np.outer(own, off) + n * np.outer(off, off)


def _lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """vec_id and x of the rows of one length, a bounded block at a time."""
    for batch in batches:
        dims = batch.column("dim").to_numpy()
        for d in np.unique(dims):
            rows = batch.filter(pa.array(dims == d))
            step = max(64, BLOCK_CELLS // int(d))
            for start in range(0, rows.num_rows, step):
                part = rows.slice(start, step)
                yield part.column("vec_id"), part.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, int(d))


def _scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's sums: a pair of places for each two dimensions, place -1 for the sums and the count."""
    totals: dict[int, list] = {}
    for _, x in _lengths(batches):
        sums, products = bit_sliced_products(x)
        held = totals.setdefault(x.shape[1], [0, 0, 0])
        totals[x.shape[1]] = [held[0] + len(x), held[1] + sums, held[2] + products]
    for d, (n, sums, products) in totals.items():
        upper = [(i, j, products[i, j]) for i in range(d) for j in range(i, d)]
        rows = [(-1, -1, n), *((i, -1, s) for i, s in enumerate(sums)), *upper]
        yield pa.RecordBatch.from_pydict({
            "dim": pa.array([d] * len(rows), pa.int32()),
            "i": pa.array([r[0] for r in rows], pa.int32()), "j": pa.array([r[1] for r in rows], pa.int32()),
            "total": pa.array([Decimal(int(r[2])) for r in rows], pa.decimal128(38, 0))})


def _collected(partial: DataFrame) -> dict[int, dict[tuple[int, int], int | float]]:
    """The tasks' sums added up: of each length one number for each pair of dimensions, whatever the rows."""
    found: dict[int, dict] = {}
    for r in partial.groupBy("dim", "i", "j").agg(F.sum("total").alias("total")).collect():
        found.setdefault(r.dim, {})[r.i, r.j] = r.total
    return found


def fit(vectors: DataFrame, components: int = 32) -> dict[int, Whitening]:
    """For each length of vector, up to that many components of the covariance of all of them."""
    fitted = {}
    for d, total in _collected(fixed_point(vectors).mapInArrow(_scatter, PARTIAL)).items():
        n, sums = int(total[-1, -1]), [int(total[i, -1]) for i in range(d)]
        covariance = np.zeros((d, d))
        for i in range(d):
            for j in range(i, d):
                covariance[i, j] = covariance[j, i] = (n * int(total[i, j]) - sums[i] * sums[j]) / (n * n)
        trace = sum(n * int(total[i, i]) - sums[i] ** 2 for i in range(d)) / (n * n)
        values, directions = np.linalg.eigh(covariance)
        order = np.argsort(-values, kind="stable")[:components]
        fitted[d] = Whitening(n, sums, directions[:, order], values[order], trace)
    return fitted


def _projector(fitted: dict[int, Whitening]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x in _lengths(batches):
            d = x.shape[1]
            away = fitted[d].deviations(x)
            values = fitted[d].project(x)
            offsets = np.arange(len(x) + 1, dtype=np.int32) * values.shape[1]
            whitened = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.ravel(), from_pandas=True))
            yield pa.RecordBatch.from_pydict({
                "vec_id": ids, "dim": pa.array([d] * len(x), pa.int32()),
                "deviation": pa.array([v if v < 2**63 else None for v in away], pa.int64()),
                "deviation_exact": pa.array([Decimal(v) for v in away], pa.decimal128(38, 0)),
                "whitened": whitened})

    return run


def _measurer(fitted: dict[int, Whitening]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of the whitened rows: sums, and products centred on each block's mean with the rest that this leaves."""
        totals: dict[int, list] = {}
        for _, x in _lengths(batches):
            w = np.nan_to_num(fitted[x.shape[1]].project(x))
            mean = w.mean(axis=0)
            held = totals.setdefault(x.shape[1], [0, 0])
            totals[x.shape[1]] = [held[0] + w.sum(axis=0), held[1] + (w - mean).T @ (w - mean) + len(w) * np.outer(mean, mean)]
        for d, (sums, products) in totals.items():
            k = len(sums)
            rows = [*((i, -1, sums[i]) for i in range(k)), *((i, j, products[i, j]) for i in range(k) for j in range(i, k))]
            yield pa.RecordBatch.from_pydict({
                "dim": pa.array([d] * len(rows), pa.int32()), "i": pa.array([r[0] for r in rows], pa.int32()),
                "j": pa.array([r[1] for r in rows], pa.int32()), "total": pa.array([float(r[2]) for r in rows], pa.float64())})

    return run


def identity_errors(vectors: DataFrame, fitted: dict[int, Whitening]) -> dict[int, float]:
    """For each length, how far the covariance of the whitened rows is from the identity, measured on all of them."""
    errors = {}
    for d, total in _collected(fixed_point(vectors).mapInArrow(_measurer(fitted), PRODUCTS)).items():
        model = fitted[d]
        live = np.flatnonzero(model.live)
        mean = {i: total[i, -1] / model.n for i in live}
        errors[d] = max((abs(total[i, j] / model.n - mean[i] * mean[j] - (i == j)) for i in live for j in live if i <= j), default=0.0)
    return errors


def whiten(vectors: DataFrame, fitted: dict[int, Whitening]) -> DataFrame:
    """vec_id, dim, deviation, deviation_exact and whitened, an array with one number for each component."""
    return fixed_point(vectors).where(F.col("dim").isin([*fitted])).mapInArrow(_projector(fitted), PROJECTED)


def whitened_components(vectors: DataFrame, components: int = 32) -> DataFrame:
    """The vectors whitened by their own fit, a row for each vector and component."""
    fitted = fit(vectors, components)
    errors = identity_errors(vectors, fitted)
    by_length = [(d, m.n, [max(0.0, float(e)) / m.trace if m.trace > 0 else None for e in m.eigenvalues], float(errors.get(d, 0.0)))
                 for d, m in fitted.items()]

    def of_length(field: int, kind: str):
        known = [F.when(F.col("dim") == row[0], F.array(*[F.lit(v).cast("double") for v in row[field]]) if field == 2 else F.lit(row[field])) for row in by_length]
        return reduce(lambda a, b: F.coalesce(a, b), known, F.lit(None).cast(kind)).cast(kind)

    rows = whiten(vectors, fitted).select("vec_id", "dim", "deviation", "deviation_exact", F.posexplode("whitened").alias("at", "whitened"))
    return rows.select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), of_length(1, "long").alias("n"), "deviation", "whitened",
        F.get(of_length(2, "array<double>"), F.col("at")).alias("explained"),
        of_length(3, "double").alias("identity_error"), "deviation_exact", "dim")
