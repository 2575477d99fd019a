"""Whitening of embeddings: principal components by a matrix-free block Jacobi-Davidson method.

The covariance is never formed. It is known by its products with a few directions, each of which is one pass over the stored vectors:
a task multiplies its centred rows by the directions and back, and the sums of the tasks are added up by tasks. The driver
holds a search space of some dozens of directions, takes Ritz pairs from it, solves the projected correction equation of each
wanted pair by inner MINRES steps (all pairs in step, one pass per step), and adds the corrections to the space. A pair whose
residual has reached double precision is locked, and the others go on in its complement. Passes do not depend on the number of
rows; what the driver holds depends on the dimension alone.

Vectors are whole numbers, so sums, and n times a component less its sum, are exact; only then are they divided by n.

Defined results: rows whose vector is null, empty, or has a null or non-finite component take no part, nor do vectors shorter than the
longest. Repeated rows count and return as often as they are there; a null vec_id stays null. Ties between eigenvalues give some
orthonormal basis of their space, the same for all rows. A component without variance (copies of few vectors) has a null ``whitened``, and
is left out of ``identity_error``. A deviation beyond 63 bits is null. Other columns are ignored. No rows give no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .vectors import all_finite, matrix, of_full_length, summed, whole_numbers

SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
#: A residual of so many units of rounding, times the largest eigenvalue, is one of double precision.
ROUNDING_UNITS = 64
#: MINRES steps for a correction, and widest search space, as a multiple of the wanted components.
INNER_STEPS, SPACE = 6, 6
MOST_ROUNDS = 60
#: An eigenvalue of less than this part of the largest is none.
NO_VARIANCE = 1e-13

Product = Callable[[np.ndarray], np.ndarray]


def projected_minres(product: Product, shifts: np.ndarray, out: np.ndarray, right: np.ndarray, steps: int) -> np.ndarray:
    """Solutions t of (I - QQ')(V - shift I)(I - QQ') t = right, one per column, each by ``steps`` steps of MINRES.

    ``out`` is Q, orthonormal. All columns share one product per step.
    """

    def project(a):
        a = a - out @ (out.T @ a)
        return a - out @ (out.T @ a)

    def norms(a):
        return np.linalg.norm(a, axis=0)

    right = project(right)
    beta = norms(right)
    safe = np.where(beta > 0, beta, 1)
    v_old, v = np.zeros_like(right), right / safe
    w_older, w_old = np.zeros_like(right), np.zeros_like(right)
    t, eta = np.zeros_like(right), beta.copy()
    c_old, c, s_old, s = np.ones_like(beta), np.ones_like(beta), np.zeros_like(beta), np.zeros_like(beta)
    beta = np.zeros_like(beta)  # of the Lanczos recurrence: nothing before the first vector
    for _ in range(steps):
        lanczos = project(product(v) - v * shifts)
        alpha = np.sum(v * lanczos, axis=0)
        lanczos = lanczos - v * alpha - v_old * beta
        beta_next = norms(lanczos)
        delta, rho2, rho3 = c * alpha - c_old * s * beta, s * alpha + c_old * c * beta, s_old * beta
        rho1 = np.hypot(delta, beta_next)
        live = rho1 > 0
        divisor = np.where(live, rho1, 1)
        c_old, c = c, np.where(live, delta / divisor, 1)
        s_old, s = s, np.where(live, beta_next / divisor, 0)
        w = np.where(live, (v - w_older * rho3 - w_old * rho2) / divisor, 0)
        t = t + w * (c * eta)
        eta = -s * eta
        v_old, v = v, np.where(beta_next > 0, lanczos / np.where(beta_next > 0, beta_next, 1), 0)
        w_older, w_old, beta = w_old, w, beta_next
    return project(t)


def orthonormal(new: np.ndarray, *against: np.ndarray) -> np.ndarray:
    """The directions that ``new`` adds to the orthonormal columns of ``against``."""
    kept = [a for a in against if a.shape[1]]
    columns: list[np.ndarray] = []
    for column in new.T:
        size = np.linalg.norm(column)
        if not size > 0:
            continue
        column = column / size
        for _ in range(3):
            for a in kept:
                column = column - a @ (a.T @ column)
            for a in columns:
                column = column - a * (a @ column)
        left = np.linalg.norm(column)
        if left > 1e-10:
            column = column / left
            for a in [*kept, *[c[:, None] for c in columns]]:
                column = column - a @ (a.T @ column)
            columns.append(column / np.linalg.norm(column))
    return np.stack(columns, axis=1) if columns else np.zeros((len(new), 0))


def leading_pairs(product: Product, dimension: int, wanted: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues, falling, and their eigenvectors, of a symmetric matrix known by its products."""
    wanted = min(wanted, dimension)
    rng = np.random.default_rng(seed)
    locked, values = np.zeros((dimension, 0)), []
    space = orthonormal(rng.standard_normal((dimension, min(dimension, 2 * wanted))))
    image = product(space)
    for _ in range(MOST_ROUNDS):
        small = space.T @ image
        theta, s = np.linalg.eigh((small + small.T) / 2)
        theta, s = theta[::-1], s[:, ::-1]
        space, image = space @ s, image @ s
        left = wanted - len(values)
        residual = image - space * theta
        residual -= locked @ (locked.T @ residual)
        norms = np.linalg.norm(residual[:, :left], axis=0)
        largest = max([*values, float(theta[0])])
        done = norms <= ROUNDING_UNITS * np.finfo(float).eps * max(largest, np.finfo(float).tiny)
        # Lock from the top only: a pair below one that still moves may yet be overtaken.
        settled = int(np.argmin(done)) if not done.all() else left
        values += theta[:settled].tolist()
        locked = np.concatenate([locked, space[:, :settled]], axis=1)
        if len(values) == wanted:
            break
        space, image, theta, residual = space[:, settled:], image[:, settled:], theta[settled:], residual[:, settled:]
        left -= settled
        if space.shape[1] > SPACE * wanted - left:
            space, image = space[:, : 2 * wanted], image[:, : 2 * wanted]
        moving = np.flatnonzero(~done[settled:])
        q = np.concatenate([locked, space[:, :left]], axis=1)
        new = orthonormal(projected_minres(product, theta[moving], q, -residual[:, moving], INNER_STEPS), locked, space)
        if not new.shape[1]:  # nothing to add: the space is exhausted or the corrections are rounding
            new = orthonormal(rng.standard_normal((dimension, left)), locked, space)
        space = orthonormal(space, locked)  # rotations round; their images are made anew with the corrections
        space = np.concatenate([space, orthonormal(new, locked, space)], axis=1)
        image = product(space)
    else:
        raise RuntimeError(f"{wanted - len(values)} of {wanted} eigenpairs did not settle in {MOST_ROUNDS} rounds")
    order = np.argsort(values)[::-1]
    return np.array(values)[order], locked[:, order]


@dataclass(frozen=True)
class Fit:
    """What the vectors' rows are measured by: count, exact sums, components as columns, eigenvalues, trace."""

    n: int
    sums: tuple[int, ...]
    wide: bool
    vectors: np.ndarray
    values: np.ndarray
    trace: float

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exact."""
        if self.wide:
            return x.astype(object) * self.n - np.array(self.sums, dtype=object)
        return x * self.n - np.array(self.sums, np.int64)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S / n, rounded once."""
        return (self.deviations(x) / self.n).astype(float)

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """Projections over the root of the eigenvalue; zero where there is no variance."""
        live = self.live()
        return np.where(live, (self.centred(x) @ self.vectors) / np.sqrt(np.where(live, self.values, 1)), 0)

    def live(self) -> np.ndarray:
        return self.values > NO_VARIANCE * max(float(self.values[0]), 0)


def squares(deviations: np.ndarray) -> list[int | None]:
    """Sums of squares of the rows, exact; null beyond 63 bits."""
    if deviations.dtype == object or float(np.abs(deviations).max(initial=0)) ** 2 * deviations.shape[1] >= 2.0**62:
        exact = [sum(int(v) ** 2 for v in row) for row in deviations]
        return [v if v < 2**63 else None for v in exact]
    return np.sum(deviations * deviations, axis=1).tolist()


def fit(vectors: DataFrame, components: int = COMPONENTS) -> Fit | None:
    """The fit of stored rows (x array<long>); None without rows."""
    # Exact sums, one row per dimension.
    cells = vectors.select(F.posexplode("x").alias("i", "v")).groupBy("i")
    found = cells.agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("s"), F.max(F.abs("v")).alias("most"), F.count(F.lit(1)).alias("n")).collect()
    if not found:
        return None
    found.sort(key=lambda r: r["i"])
    n, sums = found[0]["n"], tuple(int(r["s"]) for r in found)
    wide = 2 * n * max(int(r["most"]) for r in found) >= 2**62
    d = len(sums)
    blank = Fit(n, sums, wide, np.zeros((d, 0)), np.zeros(0), 0.0)
    vectors, parts = vectors.select("x"), vectors.rdd.getNumPartitions()

    def product(directions: np.ndarray) -> np.ndarray:
        def partial(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
            total = np.zeros((d, directions.shape[1]))
            for batch in batches:
                if batch.num_rows:
                    c = blank.centred(matrix(batch.column(0)))
                    total += c.T @ (c @ directions)
            return total

        return summed(vectors, partial, parts).reshape(d, -1) / n

    def spread(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        return np.array([sum(float(np.sum(blank.centred(matrix(b.column(0))) ** 2)) for b in batches if b.num_rows)])

    trace = float(summed(vectors, spread, parts)[0]) / n
    values, axes = leading_pairs(product, d, components)
    return Fit(n, sums, wide, axes, np.maximum(values, 0), trace)


def identity_error(vectors: DataFrame, fitted: Fit) -> float:
    """The largest absolute entry of the whitened rows' covariance less the identity, over components with variance."""
    k, parts, vectors = len(fitted.values), vectors.rdd.getNumPartitions(), vectors.select("x")

    def total(of: Callable[[np.ndarray], np.ndarray]):
        def partial(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
            return sum((of(fitted.whitened(matrix(b.column(0)))) for b in batches if b.num_rows), of(np.zeros((0, k))))

        return summed(vectors, partial, parts) / fitted.n

    mean = total(lambda w: w.sum(axis=0))
    covariance = total(lambda w: (w - mean).T @ (w - mean)).reshape(k, k)
    live = fitted.live()
    return float(np.abs((covariance - np.eye(k))[np.ix_(live, live)]).max(initial=0))


def whiten(embeddings: DataFrame, column: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row per vector and component."""
    rows = embeddings.where(all_finite(F.col(column)))
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), whole_numbers(F.col(column), SCALE, SHIFT).alias("x"))
    rows = stored(of_full_length(rows))
    types = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    fitted = fit(rows, components)
    if fitted is None:
        return embeddings.sparkSession.createDataFrame([], types)
    error, k, live = identity_error(rows, fitted), len(fitted.values), fitted.live()
    explained = fitted.values / fitted.trace if fitted.trace > 0 else np.zeros(k)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = batch.num_rows
            if not m:
                continue
            x = matrix(batch.column(1))
            each = np.repeat(np.arange(m), k)
            columns = [
                batch.column(0).take(pa.array(each)),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                pa.array(np.full(m * k, fitted.n)),
                pa.array(squares(fitted.deviations(x)), pa.int64()).take(pa.array(each)),
                pa.array(fitted.whitened(x).ravel(), mask=np.tile(~live, m)),
                pa.array(np.tile(explained, m)),
                pa.array(np.full(m * k, error)),
            ]
            yield pa.record_batch(columns, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(project, types)
