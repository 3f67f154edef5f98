"""Embedding whitening by matrix-free block Lanczos.

The covariance matrix is never formed: a pass over the vectors takes a block B
of directions to the sum of (x - m)((x - m)'B), one fixed-size partial sum a
task, added up by Spark. The driver keeps the Krylov basis (dimensions by at
most dimensions numbers, whatever the number of rows), orthogonalises each new
block against all of it twice, fills a block that breaks down with fresh random
directions, and stops when the residuals of the wanted Ritz pairs vanish and a
fresh random block finds nothing larger. Entries are whole numbers, so sums and
deviations are exact; the trace comes from the deviations.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import bound_batches

COMPONENTS, BLOCK, SCALE, SHIFT = 32, 8, 64, 1_000_000
#: Residuals, and the least eigenvalue that counts as one, as shares of the largest eigenvalue.
RESIDUAL, RANK = 1e-13, 1e-10
#: Entries beyond this have no exact whole number in 64 bits and count as non-finite.
LARGEST = 2.0**39
RESULT = ("component", "n", "deviation", "whitened", "explained", "identity_error")


def whole_numbers(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, x): vectors as whole numbers floor(64 c) + 1000000; vectors that are null, empty or hold null or non-finite entries are left out."""
    v = F.col("v")
    usable = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) <= LARGEST))
    source = rows.select(rows[id_col].alias("id"), F.transform(rows[vec_col], lambda c: c.cast("double")).alias("v")).filter(usable)
    return source.select("id", F.transform(v, lambda c: F.floor(c * SCALE) + F.lit(SHIFT).cast("bigint")).alias("x"))


def matrices(batches: Iterator[pa.RecordBatch], column: str = "x") -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Each batch with its vectors as one matrix of whole numbers."""
    for batch in batches:
        if batch.num_rows:
            yield batch, batch.column(column).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


class Centre:
    """The mean as a whole part and a share of n, so that centring loses nothing to the size of the entries."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.whole, self.rest = n, np.array([s // n for s in sums], np.int64), np.array([s % n for s in sums], object)
        self.share = np.array([float(r) / n for r in self.rest])

    def of(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole) - self.share

    def deviations(self, x: np.ndarray) -> list[int]:
        """Sums over dimensions of (n x - S)^2, exact."""
        moved = x - self.whole
        if (int(np.abs(moved).max()) + 1) ** 2 * self.n**2 * x.shape[1] < 1 << 62:
            return ((moved * self.n - self.rest.astype(np.int64)) ** 2).sum(1).tolist()
        return ((moved.astype(object) * self.n - self.rest) ** 2).sum(1).tolist()


def summed(vectors: DataFrame, length: int, part: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all rows of `part` (matrix of a batch to `length` doubles); a task sends one partial sum."""

    def run(batches):
        total = np.zeros(length)
        for _, x in matrices(batches):
            total += part(x)
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["part"])

    places = vectors.select("x").mapInArrow(run, "part array<double>").select(F.posexplode("part")).groupBy("pos").agg(F.sum("col").alias("s"))
    out = np.zeros(length)
    for row in places.collect():
        out[row.pos] = row.s
    return out


def integer_sums(vectors: DataFrame, d: int) -> tuple[int, list[int]]:
    """n and the exact sums of each dimension; a task sends `d` + 1 numbers."""

    def run(batches):
        n, totals = 0, [0] * d
        for _, x in matrices(batches):
            n += len(x)
            totals = [a + b for a, b in zip(totals, x.sum(0).tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(range(d + 1), pa.int32()), pa.array([str(t) for t in [*totals, n]])], names=["pos", "s"])

    places = vectors.select("x").mapInArrow(run, "pos int, s string").groupBy("pos").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    found = {r.pos: int(r.s) for r in places.collect()}
    return found[d], [found[k] for k in range(d)]


def trace_of(vectors: DataFrame, centre: Centre) -> float:
    """The trace of the covariance, from the exact sum of all deviations; a task sends one number."""

    def run(batches):
        yield pa.RecordBatch.from_arrays([pa.array([str(sum(sum(centre.deviations(x)) for _, x in matrices(batches)))])], names=["s"])

    total = sum(int(r.s) for r in vectors.select("x").mapInArrow(run, "s string").collect())
    return total / centre.n**3


def orthonormal(block: np.ndarray, basis: np.ndarray, rng: np.random.Generator, width: int, scale: float) -> np.ndarray:
    """Up to `width` directions orthogonal to the basis: those of `block`, and random ones in place of what broke down (below 1e-14 of `scale`)."""
    d = len(basis)
    kept = np.zeros((d, 0))
    for source, size in ((block, scale), (rng.normal(size=(d, width)), 1.0)):
        room = min(width, d - basis.shape[1]) - kept.shape[1]
        if room <= 0 or not source.shape[1]:
            continue
        before = np.hstack((basis, kept))
        for _ in range(2):
            source = source - before @ (before.T @ source)
        new, sizes, _ = np.linalg.svd(source, full_matrices=False)
        new = new[:, : min(room, int((sizes > 1e-14 * size).sum()))]
        new = np.linalg.qr(new - before @ (before.T @ new))[0]
        kept = np.hstack((kept, new - before @ (before.T @ new)))
    return kept


def block_lanczos(apply: Callable[[np.ndarray], np.ndarray], d: int, wanted: int, block: int = BLOCK, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The largest `wanted` eigenvalues, falling, and unit eigenvectors of a symmetric operator on d dimensions.

    `apply` takes d by b directions to their images; it is all that is known of
    the operator. Every new block is orthogonalised against the whole basis.
    Where a block breaks down (an invariant subspace is full), random directions
    take its place, so equal eigenvalues are found in any number. It ends when
    the wanted Ritz pairs have residuals below RESIDUAL of the largest and a
    fresh random block, followed to its own largest Ritz value, stays below the
    wanted ones, or when the basis is full.
    """
    wanted = min(wanted, d)
    rng = np.random.default_rng(seed)
    basis, images = np.zeros((d, 0)), np.zeros((d, 0))
    new = orthonormal(rng.normal(size=(d, block)), basis, rng, block, 1.0)
    checked = None  # where the block that checks for missed eigenvalues began
    while True:
        image = apply(new)
        basis, images = np.hstack((basis, new)), np.hstack((images, image))
        small = basis.T @ images
        values, turns = np.linalg.eigh((small + small.T) / 2)
        values, turns = values[::-1], turns[:, ::-1]
        scale = max(float(np.abs(values).max()), 1e-300)
        if basis.shape[1] == d:
            break
        residuals = np.linalg.norm(images @ turns[:, :wanted] - basis @ turns[:, :wanted] * values[:wanted], axis=0)
        done = len(values) >= wanted and bool((residuals <= RESIDUAL * scale).all())
        if done and checked is not None:
            rest, over = basis[:, checked:], images[:, checked:]
            inner, axes = np.linalg.eigh(rest.T @ over)
            far = np.linalg.norm(over @ axes[:, -1] - basis @ (basis.T @ (over @ axes[:, -1])))
            if inner[-1] + far < values[wanted - 1] or far <= 1e-9 * scale:
                break
        block_of = image
        if done and checked is None:
            checked, block_of = basis.shape[1], np.zeros((d, 0))
        elif not done:
            checked = None
        new = orthonormal(block_of, basis, rng, block, scale)
    return values[:wanted], basis @ turns[:, :wanted]


def whiten(rows: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vec_col: str = "embedding", block: int = BLOCK) -> DataFrame:
    """Per vector and component: its whitened coordinate, with n, the vector's deviation, the component's explained share and the error of the whole.

    Vectors are dropped that are null, empty, or hold null, non-finite or
    unrepresentable (over 2^39) entries, and those of another length than most
    have (of equally frequent lengths the longest counts). Components whose
    eigenvalue is below 1e-10 of the largest have no direction of their own and
    are left out, so equal vectors alone, or an empty table, give no rows. A
    deviation beyond 64 bits is null; the trace uses its exact value. Null ids
    and repeated rows are rows like any other; of equal eigenvalues any
    orthonormal directions may come, the same for all rows. Further columns are
    not read; an id named like a column of the result is an error.
    """
    if id_col in RESULT:
        raise ValueError(f"the id column needs another name than {id_col}")
    bound_batches(rows.sparkSession)
    kind = rows.schema[id_col].dataType
    vectors = whole_numbers(rows, id_col, vec_col)
    schema = f"`{id_col}` {kind.simpleString()}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    nothing = rows.sparkSession.createDataFrame([], schema)
    common = vectors.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if common is None:
        return nothing
    d = common.d
    vectors = vectors.filter(F.size("x") == d)
    n, sums = integer_sums(vectors, d)
    centre = Centre(n, sums)
    trace = trace_of(vectors, centre)
    if not trace:
        return nothing

    def covariance(directions: np.ndarray) -> np.ndarray:
        def part(x):
            y = centre.of(x)
            return (y.T @ (y @ directions)).ravel()

        return summed(vectors, directions.size, part).reshape(directions.shape) / n

    values, axes = block_lanczos(covariance, d, min(components, d), block)
    kept = values > RANK * values[0]
    values, axes = values[kept], axes[:, kept]
    turn, k = axes / np.sqrt(values), int(kept.sum())

    def moments(x):
        w = centre.of(x) @ turn
        return np.concatenate(((w.T @ w).ravel(), w.sum(0)))

    total = summed(vectors, k * k + k, moments) / n
    error = float(np.abs(total[: k * k].reshape(k, k) - np.outer(total[k * k :], total[k * k :]) - np.eye(k)).max())
    shares = values / trace
    id_type = to_arrow_type(kind)

    def run(batches):
        for batch, x in matrices(batches):
            m = len(x)
            deviation = [v if v < 1 << 63 else None for v in centre.deviations(x)]
            arrays = [
                batch.column("id").take(pa.array(np.repeat(np.arange(m), k))).cast(id_type),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                pa.array(np.full(m * k, n)),
                pa.array(deviation, pa.int64()).take(pa.array(np.repeat(np.arange(m), k))),
                pa.array((centre.of(x) @ turn).ravel()),
                pa.array(np.tile(shares, m)),
                pa.array(np.full(m * k, error)),
            ]
            yield pa.RecordBatch.from_arrays(arrays, names=[id_col, *RESULT])

    return vectors.mapInArrow(run, schema)
