"""Whitening of embeddings by matrix-free block subspace iteration.

The vectors are laid on a grid of integers, so that the sum of each dimension and the squared distance from the mean
are exact. A pass over the table centres each row, multiplies the rows with a block of directions Q and sums
``X^T (X Q)``; the covariance itself is never formed. On the driver stand ``d x b`` numbers only: QR keeps the block
orthonormal, Rayleigh-Ritz turns it to the best directions that it holds, and the residuals ``|V q - e q|`` of the first
``k`` say whether another pass is needed. Where the contraction measured shows that many passes would remain, the block is
widened by fresh directions: a pass over the table costs more than the arithmetic of a wider block. A block as wide as the
space holds every direction, so a flat spectrum ends there.

Edge cases: a vector that is null, empty, or holds nulls or entries that aren't finite is no vector and gives no row; so
does one whose length isn't the most frequent (on a tie the largest). Null ids, repeated rows and ties stay and count.
Entries outside the integers of 62 bits are cut to them. Components without variance (below ``RANK`` of the whole) are
left out, so there are fewer than ``k`` where the rows span less; no rows or one row give an empty result. Equal
eigenvalues have no order of their own; any orthonormal choice whitens. ``deviation`` is null where it exceeds a long.
Other columns of the table are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

SCALE, SHIFT, LIMIT = 1024, 100_000, float(1 << 62)
#: Residual (as a share of the largest eigenvalue) that certifies a component; variance below which there is none.
TOLERANCE, RANK = 1e-13, 1e-12
#: Passes that may remain before the block is widened, and the most that are run.
PATIENCE, PASSES = 4, 500


@dataclass(frozen=True)
class Whitener:
    """A fit: ``n`` rows, sums of their grid vectors, and unit ``components`` (columns) with their ``variances``."""

    n: int
    sums: tuple[int, ...]
    components: np.ndarray
    variances: np.ndarray
    total: float
    residuals: np.ndarray
    passes: int

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    def apply(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) @ self.components / np.sqrt(self.variances)

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sum of ``(n x - S)^2`` in whole numbers."""
        reach = max((int(abs(x).max()) if x.size else 0) * self.n, max(map(abs, self.sums), default=0)) * 2
        wide = object if reach >= 1 << 63 else np.int64
        off = self.n * x.astype(wide) - np.array(self.sums, dtype=wide)
        most = int(abs(off).max()) if x.size else 0
        squares = (off if most**2 * x.shape[1] < 1 << 63 else off.astype(object)) ** 2
        return [v if v < 1 << 63 else None for v in map(int, squares.sum(axis=1))]


def on_grid(vectors: DataFrame, id_col: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(vec_id, x array<bigint>) of the vectors that are whole, finite and of the common length; written once."""
    v = vectors.select(F.col(id_col).alias("vec_id"), F.col(column).alias("v"))
    v = v.where(F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf"))))
    within = lambda c: F.greatest(F.lit(-LIMIT), F.least(F.lit(LIMIT), c.cast("double") * SCALE))
    v = v.select("vec_id", F.transform("v", lambda c: F.floor(within(c)) + F.lit(SHIFT)).alias("x"))
    return materialise(v, "grid")


def rows_of(batch: pa.RecordBatch) -> np.ndarray:
    """The column x of a batch as a matrix."""
    x = batch.column("x")
    return x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1)


def summed(grid: DataFrame, size: int, part: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum over all rows of ``part(x)``, ``size`` numbers: a task adds up its own, Spark the tasks'."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                got = part(rows_of(b))
                total = got if total is None else total + got
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(total.ravel().astype(np.float64))], names=["pos", "value"])

    found = grid.select("x").mapInArrow(partial, "pos int, value double").groupBy("pos").agg(F.sum("value").alias("value"))
    out = np.zeros(size)
    for r in found.collect():  # size rows
        out[r["pos"]] = r["value"]
    return out


def fit(grid: DataFrame, k: int = 8, block: int | None = None, widest: int = 1024, seed: int = 7) -> Whitener | None:
    """The first ``k`` principal components of the grid vectors; None where there is no row."""
    lengths = grid.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    if not lengths:
        return None
    d = lengths[0]["d"]
    grid = grid.where(F.size("x") == d)
    n = lengths[0]["count"]
    sums = tuple(r["s"] for r in grid.select(F.posexplode("x")).groupBy("pos").agg(F.sum("col").alias("s")).orderBy("pos").collect())
    mean = np.array([s / n for s in sums])

    def centred(x: np.ndarray) -> np.ndarray:
        return x - mean

    total = float(summed(grid, 1, lambda x: np.array([(centred(x) ** 2).sum()]))[0] / n)
    none = np.zeros((d, 0))
    # less than rounding of the mean can make: no row differs
    if total <= d * (4e-16 * max(abs(mean))) ** 2:
        return Whitener(n, sums, none, np.zeros(0), 0.0, np.zeros(0), 0)
    rng = np.random.default_rng(seed)
    k, b = min(k, d), min(d, block or 2 * k, max(widest, k))
    q = np.linalg.qr(rng.standard_normal((d, b)))[0]
    before, tolerance = None, max(TOLERANCE, 4 * np.finfo(float).eps * d)
    for passes in range(1, PASSES + 1):
        z = summed(grid, d * q.shape[1], lambda x, q=q: (c := centred(x)).T @ (c @ q)).reshape(d, -1) / n
        h = q.T @ z
        values, turn = np.linalg.eigh((h + h.T) / 2)
        order = np.argsort(-values)
        values, turn = values[order], turn[:, order]
        ritz, image = q @ turn, z @ turn
        residuals = np.linalg.norm(image - ritz * values, axis=0)[:k]
        worst = float(residuals.max())
        if worst <= tolerance * values[0]:
            keep = values[:k] > RANK * total
            return Whitener(n, sums, ritz[:, :k][:, keep], values[:k][keep], total, residuals[keep], passes)
        # what a pass gains, and so how many more it would take
        gain = 1.0 if before is None else min(worst / before, 1.0)
        left = np.inf if gain >= 1 else np.log(tolerance * values[0] / worst) / np.log(gain)
        q = image
        if before is not None and left > PATIENCE and q.shape[1] < min(d, widest):
            q = np.hstack([q / np.linalg.norm(q, axis=0).clip(1e-300), rng.standard_normal((d, min(q.shape[1], min(d, widest) - q.shape[1])))])
            before = None
        else:
            before = worst
        q = np.linalg.qr(q)[0]
    raise RuntimeError(f"residual {worst} after {PASSES} passes")


def whitened(grid: DataFrame, fitted: Whitener) -> DataFrame:
    """(vec_id, deviation, whitened array<double>) of each grid vector."""
    d = len(fitted.sums)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = rows_of(b)
            out = fitted.apply(x)
            ends = pa.array(np.arange(len(x) + 1, dtype=np.int32) * out.shape[1])
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(fitted.deviation(x), pa.int64()), pa.ListArray.from_arrays(ends, pa.array(out.ravel()))], names=["vec_id", "deviation", "whitened"])

    kind = grid.schema["vec_id"].dataType.simpleString()
    return grid.where(F.size("x") == d).mapInArrow(project, f"vec_id {kind}, deviation bigint, whitened array<double>")


def identity_error(grid: DataFrame, fitted: Whitener) -> float:
    """Largest entry of the whitened rows' covariance less the identity, over all rows, centred first."""
    k = len(fitted.variances)
    if not k:
        return 0.0
    grid = grid.where(F.size("x") == len(fitted.sums))
    mean = summed(grid, k, lambda x: fitted.apply(x).sum(axis=0)) / fitted.n
    cov = summed(grid, k * k, lambda x: (y := fitted.apply(x) - mean).T @ y).reshape(k, k) / fitted.n
    return float(abs(cov - np.eye(k)).max())


def op13_whitening(vectors: DataFrame) -> DataFrame:
    """One row for each vector and component, by the contract of the query."""
    grid = on_grid(vectors)
    fitted = fit(grid)
    columns = "vec_id, component, n, deviation, whitened, explained, identity_error".split(", ")
    kind = grid.schema["vec_id"].dataType.simpleString()
    if fitted is None:
        return grid.sparkSession.createDataFrame([], f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    error = identity_error(grid, fitted)
    share = F.array(*[F.lit(float(v / fitted.total)) for v in fitted.variances]) if len(fitted.variances) else F.array().cast("array<double>")
    rows = whitened(grid, fitted).select("vec_id", "deviation", F.posexplode("whitened").alias("i", "whitened"))
    return rows.select("vec_id", (F.col("i") + 1).alias("component"), F.lit(fitted.n).cast("long").alias("n"), "deviation", "whitened", F.get(share, F.col("i")).alias("explained"), F.lit(error).alias("identity_error")).select(*columns)
