"""Whitening of embeddings: pivoted Cholesky of the centred scatter, then one-sided Jacobi on the triangular factor.

Entries become whole numbers, x = floor(1024 * c) + 100000, so counts and sums are exact. V = P L L' P' with L lower
triangular and its pivots falling; rotations from the right make the columns of L orthogonal, without ever forming L'L.
The norms of the rotated columns are the roots of V's eigenvalues, the columns divided by them its eigenvectors.

Every pass reads the table once and shuffles only sums: a count and a sum per dimension and task, then the upper half of
a dimension x dimension matrix per task, added up pairwise in the shuffle. The driver holds that one matrix (8 MB at 1,000
dimensions) whatever the rows. All vectors are fitted, none is sampled.

Odd rows: a vector that is null, empty, or holds a null, a NaN, an infinity or an entry of 2^42 or more takes no part, nor
does one whose length is not the most common (of equally common ones the longest). Rows given twice count twice. Directions
along which all vectors agree (rank below the dimension) have no component, so fewer than eight may come out, and none
for one vector or an empty table. Ties of eigenvalues are in the order of the rotated columns. Columns of the caller are
kept in one struct `_row`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
# scaled entries stay below 2^52, where doubles are whole numbers
LARGEST = float(1 << 42)
EPSILON = np.finfo("f8").eps


@dataclass(frozen=True)
class Fit:
    """`components[k]` is a unit vector, `values[k]` its eigenvalue, falling; `sums` are exact."""

    n: int
    sums: list[int]
    components: np.ndarray
    values: np.ndarray
    trace: float

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) @ self.components.T / np.sqrt(self.values)


def entries(column: pa.Array, length: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, whole-number vectors) of the vectors that take part, one pair per length found."""
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    flat = column.flatten()
    holes = flat.is_null().to_numpy(zero_copy_only=False)
    values = flat.fill_null(0).to_numpy(zero_copy_only=False).astype("f8")
    good = ~holes & (np.abs(np.where(np.isnan(values), np.inf, values)) < LARGEST)
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]) if len(lengths) else lengths
    for size in np.unique(lengths) if length is None else [length]:
        rows = np.nonzero(lengths == size)[0] if size else []
        if len(rows):
            places = starts[rows][:, None] + np.arange(size)
            rows, places = rows[good[places].all(axis=1)], places[good[places].all(axis=1)]
        if len(rows):
            yield rows, np.floor(SCALE * values[places]) + SHIFT


def chunks(batches: Iterator[pa.RecordBatch], column: str, length: int | None = None):
    for batch in batches:
        yield from entries(batch.column(batch.schema.get_field_index(column)), length)


def counted(rows: DataFrame, column: str) -> tuple[int, list[int]]:
    """Number of vectors of the most common length, and their exact sums per dimension."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, tuple[int, np.ndarray]] = {}
        for _, x in chunks(batches, column):
            n, total = found.get(x.shape[1], (0, 0))
            # a batch of 2^10 rows of entries below 2^53 fits a long; the running total is of Python integers
            parts = [part.astype("i8").sum(axis=0).astype(object) for part in np.array_split(x, -(-len(x) // 1024))]
            found[x.shape[1]] = (n + len(x), total + sum(parts))
        out = [(size, d, n, str(t)) for size, (n, total) in found.items() for d, t in enumerate(total)]
        if out:
            size, d, n, total = zip(*out)
            yield pa.RecordBatch.from_arrays(
                [pa.array(size, pa.int32()), pa.array(d, pa.int32()), pa.array(n, pa.int64()), pa.array(total, pa.string())],
                ["size", "d", "n", "total"],
            )

    parts = rows.select(column).mapInArrow(sums, "size int, d int, n long, total string")
    per_dimension = parts.groupBy("size", "d").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    # one line per length first, so that only the lines of one length come to the driver
    per_length = per_dimension.groupBy("size").agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("d", "total"))).alias("s"))
    best = per_length.orderBy(F.desc("n"), F.desc("size")).limit(1).collect()
    return (best[0].n, [int(s.total) for s in best[0].s]) if best else (0, [])


def added_up(rows: DataFrame, column: str, size: int, mean: np.ndarray, width: int, of=lambda centred: centred) -> np.ndarray:
    """Sum over all vectors of y y', where y = `of`(x - mean) has `width` entries; plus, in row `width`, the sum of y."""
    upper = np.triu_indices(width)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, line, seen = np.zeros((width, width)), np.zeros(width), False
        for _, x in chunks(batches, column, size):
            y = of(x - mean)
            total, line, seen = total + y.T @ y, line + y.sum(axis=0), True
        if seen:
            values = np.concatenate([total[upper], line])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values), dtype="i4")), pa.array(values)], ["at", "value"])

    sums = rows.select(column).mapInArrow(products, "at int, value double").groupBy("at").agg(F.sum("value").alias("value"))
    flat = np.zeros(len(upper[0]) + width)
    for r in sums.collect():  # width * (width + 3) / 2 numbers
        flat[r["at"]] = r["value"]
    out = np.zeros((width + 1, width))
    out[upper] = flat[: len(upper[0])]
    out[:width] = np.triu(out[:width]) + np.triu(out[:width], 1).T
    out[width] = flat[len(upper[0]) :]
    return out


def pivoted_cholesky(v: np.ndarray) -> np.ndarray:
    """A factor f with f f' = v, one column per rank, rows in the order of v: f is a row-permuted lower triangle."""
    size, left = len(v), np.array(np.diag(v))
    order, factor = list(range(size)), np.zeros((size, size))
    least = size * EPSILON * max(left.max(initial=0.0), 0.0)
    for k in range(size):
        pivot = max(range(k, size), key=lambda i: left[order[i]])
        order[k], order[pivot] = order[pivot], order[k]
        p, rest = order[k], order[k + 1 :]
        if left[p] <= least:
            return factor[:, :k]
        factor[p, k] = np.sqrt(left[p])
        factor[rest, k] = (v[rest, p] - factor[rest, :k] @ factor[p, :k]) / factor[p, k]
        left[rest] -= factor[rest, k] ** 2
    return factor


def orthogonal_columns(factor: np.ndarray, sweeps: int = 60) -> np.ndarray:
    """One-sided Jacobi: the factor times rotations, its columns orthogonal to rounding.

    A sweep rotates every pair of columns once, in rounds of disjoint pairs (a round-robin), each round as one numpy step.
    """
    f = np.array(factor)
    count = f.shape[1]
    if count < 2:
        return f
    ring = list(range(count + count % 2))  # with an odd count, one column sits out each round
    for _ in range(sweeps):
        rotated = False
        for _ in range(len(ring) - 1):
            pairs = [(a, b) for a, b in zip(ring[: len(ring) // 2], ring[: len(ring) // 2 - 1 : -1]) if max(a, b) < count]
            ring = [ring[0], ring[-1], *ring[1:-1]]
            a, b = (np.array(side) for side in zip(*pairs))
            left, right = f[:, a], f[:, b]
            p, q, r = (left**2).sum(axis=0), (right**2).sum(axis=0), (left * right).sum(axis=0)
            turn = np.abs(r) > EPSILON * np.sqrt(p * q)
            if not turn.any():
                continue
            rotated = True
            zeta = np.where(turn, (q - p) / np.where(turn, 2 * r, 1), 0)
            tangent = np.where(turn, np.where(zeta < 0, -1, 1) / (np.abs(zeta) + np.sqrt(1 + zeta**2)), 0)
            cosine = 1 / np.sqrt(1 + tangent**2)
            sine = cosine * tangent
            f[:, a], f[:, b] = cosine * left - sine * right, sine * left + cosine * right
        if not rotated:
            break
    return f


def components(v: np.ndarray, most: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """Unit eigenvectors as rows and eigenvalues of a covariance, falling, without those of rank zero."""
    columns = orthogonal_columns(pivoted_cholesky(v))
    norms = np.sqrt((columns**2).sum(axis=0))
    order = np.argsort(-norms, kind="stable")[:most]
    order = order[norms[order] > 0]
    return (columns[:, order] / norms[order]).T, norms[order] ** 2


def fit(rows: DataFrame, column: str, most: int = COMPONENTS) -> Fit:
    n, sums = counted(rows, column)
    if not n:
        return Fit(0, [], np.zeros((0, 0)), np.zeros(0), 0.0)
    size, mean = len(sums), np.array([s / n for s in sums])
    found = added_up(rows, column, size, mean, size)
    # the mean was rounded: what its error adds to every product is taken out again
    v = found[:size] / n - np.outer(found[size] / n, found[size] / n)
    return Fit(n, sums, *components(v, most), float(np.trace(v)))


def identity_error(rows: DataFrame, column: str, model: Fit) -> float:
    """Largest absolute entry of the whitened vectors' covariance minus the identity, measured over all rows."""
    width = len(model.values)
    if not width:
        return 0.0
    turn = model.components.T / np.sqrt(model.values)
    found = added_up(rows, column, len(model.sums), model.mean, width, lambda centred: centred @ turn)
    covariance = found[:width] / model.n - np.outer(found[width] / model.n, found[width] / model.n)
    return float(np.abs(covariance - np.eye(width)).max())


def whitened(rows: DataFrame, column: str, model: Fit) -> DataFrame:
    """One row per vector that takes part: `_row`, `_whitened` (one entry per component), `_deviation` (sum over dimensions
    of (n * x - S)^2, exact; null where it is no long)."""
    n, sums, size = model.n, model.sums, len(model.sums)
    packed = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("_row"), F.col(f"`{column}`").alias("_vector"))
    schema = T.StructType([packed.schema["_row"]]).add("_whitened", T.ArrayType(T.DoubleType())).add("_deviation", "long")

    def distances(x: np.ndarray) -> list[int | None]:
        near = n * (np.abs(x).max(initial=0.0) + np.abs(model.mean).max())
        if size * near**2 < 2.0**62:
            return ((n * x.astype("i8") - np.array(sums)) ** 2).sum(axis=1).tolist()
        exact = ((n * x.astype("i8").astype(object) - np.array(sums, dtype=object)) ** 2).sum(axis=1)
        return [int(d) if d < 1 << 63 else None for d in exact]

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in entries(batch.column(1), size):
                lists = pa.array(list(model.whitened(x)), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(at)), lists, pa.array(distances(x), pa.int64())], ["_row", "_whitened", "_deviation"]
                )

    return (packed if n else packed.limit(0)).mapInArrow(project, schema)
