"""Whitening of embeddings on the leading eigenvectors of their covariance, found by Jacobi-Davidson.

The covariance is never formed: all that is known of it is its product with a few vectors, a Spark job over the
written fit list in which each task centres its rows, multiplies, and returns one small sum. Around that product a
subspace is kept on the driver (a few dozen vectors of one embedding's length). Each round takes the leading
Rayleigh-Ritz pairs, locks those whose residual is at rounding level, and widens the subspace by the solutions of
the projected correction equations (I - UU')(V - theta I)(I - UU')t = -r, each found by a few MINRES steps. The
equations of all open pairs advance together, so that one job serves a step of each.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casekit.llm.text import map_batches
from casekit.sources.files import stage

COMPONENTS = 4
SCALE = 256
INNER_STEPS = 4
ROUNDS = 60
GUARD = 4
LARGEST_BASIS = 40
SAFE = 1 << 50  # sums of a batch below it fit a long
LONGEST = (1 << 63) - 1

Product = Callable[[np.ndarray], np.ndarray]


def valid_vectors(rows: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """(id, x) of the rows whose vector has only finite entries, x = floor(256 c) as longs.

    Vectors without entries go too, and those of another length than the commonest (of equally common, the longest).
    """
    entry = F.transform(F.col(vector_column), lambda c: c.cast("double"))
    finite = F.forall("c", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    x = F.transform("c", lambda c: F.floor(c * SCALE).cast("long"))
    own = rows.select(F.col(id_column).alias("id"), entry.alias("c")).where(F.col("c").isNotNull() & (F.size("c") > 0) & finite)
    own = stage(own.select("id", x.alias("x")), "vectors")
    lengths = own.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(2).collect()
    return own.where(F.size("x") == lengths[0]["d"]) if len(lengths) > 1 else own


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    flat = batch.column("x").flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(batch.num_rows, -1)


def moments(fit: DataFrame) -> tuple[int, list[int]]:
    """Number of rows and exact sums by dimension."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, 0
        for batch in batches:
            if batch.num_rows:
                own = _matrix(batch)
                wide = own if np.abs(own.astype(np.float64)).max() * len(own) < SAFE else own.astype(object)
                n, sums = n + len(own), sums + wide.sum(axis=0).astype(object)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([[str(s) for s in sums]])], ["n", "sums"])

    parts = map_batches(fit.select("x"), summed, "n long, sums array<string>").collect()
    return sum(r["n"] for r in parts), [sum(map(int, column)) for column in zip(*(r["sums"] for r in parts))]


def _over(fit: DataFrame, mean: np.ndarray, function: Callable[[np.ndarray], np.ndarray], n: int) -> np.ndarray:
    """The mean over the fit list of what `function` sums over centred rows; each task returns one small array."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                own = function(_matrix(batch).astype(np.float64) - mean)
                total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sum"])

    parts = [np.frombuffer(r["sum"]) for r in map_batches(fit.select("x"), summed, "sum binary").collect()]
    return np.sum(parts, axis=0) / n


def covariance_product(fit: DataFrame, mean: np.ndarray, n: int) -> Product:
    """The covariance times a block of vectors, as one job."""

    def product(block: np.ndarray) -> np.ndarray:
        return _over(fit, mean, lambda c: c.T @ (c @ block), n).reshape(block.shape)

    return product


def _expand(basis: np.ndarray, block: np.ndarray) -> np.ndarray:
    """What the block adds to an orthonormal basis: orthonormal, twice orthogonalised, without what vanishes."""
    out = np.zeros((len(block), 0))
    for v in block.T:
        size = np.linalg.norm(v)
        for _ in range(3):
            whole = np.hstack([basis, out])
            v = v - whole @ (whole.T @ v)
        if np.isfinite(size) and np.linalg.norm(v) > 1e-10 * size and size > 0 and whole.shape[1] < len(v):
            out = np.hstack([out, (v / np.linalg.norm(v))[:, None]])
    return out


def corrections(product: Product, thetas: np.ndarray, residuals: np.ndarray, locked: np.ndarray, steps: int) -> np.ndarray:
    """MINRES on the projected correction equation of each open pair, all advanced by one product a step.

    `locked` holds what the projection takes out: locked and current Ritz vectors, orthonormal.
    """

    def project(x: np.ndarray) -> np.ndarray:
        return x - locked @ (locked.T @ x)

    v = project(-residuals)
    beta = np.linalg.norm(v, axis=0)
    eta, beta_start = beta.copy(), np.where(beta > 0, beta, 1)
    v, old = v / beta_start, np.zeros_like(v)
    x, w, w_old = np.zeros_like(v), np.zeros_like(v), np.zeros_like(v)
    c = c_old = np.ones(len(thetas))
    s = s_old = np.zeros(len(thetas))
    beta = np.zeros(len(thetas))
    for _ in range(steps):
        if not np.any(np.abs(eta) > 1e-3 * beta_start):
            break
        av = project(product(v) - v * thetas)
        alpha = np.sum(v * av, axis=0)
        after = av - alpha * v - beta * old
        beta_next = np.linalg.norm(after, axis=0)
        d = c * alpha - c_old * s * beta
        r1 = np.hypot(d, beta_next)
        r1 = np.where(r1 > 0, r1, 1)
        r2, r3 = s * alpha + c_old * c * beta, s_old * beta
        c_old, s_old = c, s
        c, s = d / r1, beta_next / r1
        w, w_old = (v - r3 * w_old - r2 * w) / r1, w
        x = x + c * eta * w
        eta = -s * eta
        old, v = v, after / np.where(beta_next > 0, beta_next, 1)
        beta = beta_next
    return x


@dataclass(frozen=True)
class Eigenpairs:
    values: np.ndarray
    vectors: np.ndarray
    residuals: np.ndarray


def jacobi_davidson(product: Product, size: int, wanted: int, steps: int = INNER_STEPS, rounds: int = ROUNDS) -> Eigenpairs:
    """The leading eigenpairs of a symmetric positive operator, each with a residual at rounding level.

    Rounding level is 16 times the unit roundoff of the largest eigenvalue and the square root of the size. If a
    residual is still above it after `rounds` rounds, ArithmeticError says so: nothing unconverged is returned.
    """
    wanted = min(wanted, size)
    basis = _expand(np.zeros((size, 0)), np.random.default_rng(7).standard_normal((size, min(size, wanted + GUARD))))
    images = product(basis)
    locked = np.zeros((size, 0))
    for _ in range(rounds):
        inner = basis.T @ images
        values, turn = np.linalg.eigh((inner + inner.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        ritz, ritz_images = basis @ turn, images @ turn
        # A locked pair stays in the subspace, so it comes back as a Ritz pair; order is by value throughout.
        residuals = ritz_images[:, :wanted] - ritz[:, :wanted] * values[:wanted]
        norms = np.linalg.norm(residuals, axis=0)
        level = 16 * np.finfo(float).eps * max(values[0], 0) * np.sqrt(size)
        done = norms <= level
        locked = ritz[:, :wanted][:, done]
        if done.all():
            return Eigenpairs(values[:wanted], ritz[:, :wanted], norms)
        if basis.shape[1] + wanted > LARGEST_BASIS:
            basis, images = ritz[:, : wanted + GUARD], ritz_images[:, : wanted + GUARD]
        open_pairs = np.flatnonzero(~done)
        taken_out = np.hstack([locked, ritz[:, :wanted][:, open_pairs]])
        found = corrections(product, values[open_pairs], residuals[:, open_pairs], taken_out, steps)
        new = _expand(basis, found)
        if not new.shape[1]:  # the equations had nothing new: the residuals themselves, or any new direction
            new = _expand(basis, residuals[:, open_pairs])
        if not new.shape[1]:
            new = _expand(basis, np.random.default_rng(basis.shape[1]).standard_normal((size, 1)))
        basis, images = np.hstack([basis, new]), np.hstack([images, product(new)])
    raise ArithmeticError(f"residuals {norms} above {level} after {rounds} rounds")


def whiten(
    rows: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", components: int = COMPONENTS
) -> DataFrame:
    """For each valid row and leading component: the whitened coordinate and how the whole fits.

    Columns: the id, component (from 1, by falling eigenvalue), n (distinct vectors), deviation (sum over dimensions
    of (n x - S)^2, exact; null beyond a long), whitened, explained (the eigenvalue's share of the trace),
    identity_error (largest absolute entry of the whitened fit list's covariance minus the identity).

    Rows without a valid vector have no row here; see `valid_vectors`. Repeated rows and null ids are kept, each with
    its own rows; equal vectors count once in the fit. Components without variance, beyond rounding, are left out:
    a single distinct vector, or an empty table, gives no rows. Only the two named columns are read. Tied eigenvalues
    have eigenvectors that are one orthonormal choice among many. Two written tables, the valid rows and the distinct
    vectors, carry all jobs, so a lost executor costs its tasks only.
    """
    spark = rows.sparkSession
    valid = valid_vectors(rows, id_column, vector_column)
    fit = stage(valid.select("x").distinct(), "fit-list")
    n, sums = moments(fit)
    kind = rows.schema[id_column].dataType
    schema = (
        f"`{id_column}` {kind.simpleString()}, component int, n long, deviation long, whitened double, "
        "explained double, identity_error double"
    )
    empty = spark.createDataFrame([], schema)
    if n < 2:
        return empty
    mean = np.array([float(Fraction(s, n)) for s in sums])
    trace = float(_over(fit, mean, lambda c: np.array([np.sum(c * c)]), n)[0])
    pairs = jacobi_davidson(covariance_product(fit, mean, n), len(mean), components)
    kept = pairs.values > 1e-12 * trace
    if not kept.any():
        return empty
    scaled = pairs.vectors[:, kept] / np.sqrt(pairs.values[kept])
    explained = pairs.values[kept] / trace
    k = scaled.shape[1]

    def products(c: np.ndarray) -> np.ndarray:
        z = c @ scaled
        return np.concatenate([z.sum(axis=0), (z.T @ z).ravel()])

    got = _over(fit, mean, products, n)
    error = float(np.abs(got[k:].reshape(k, k) - np.outer(got[:k], got[:k]) - np.eye(k)).max())

    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1 << 13):
                part = batch.slice(at, 1 << 13)
                x = _matrix(part)
                z = (x.astype(np.float64) - mean) @ scaled
                largest = int(np.abs(x.astype(np.float64)).max()) + 1
                limit = n * largest + max(map(abs, sums))
                wide = x if limit * limit * len(sums) < LONGEST else x.astype(object)
                off = wide * n - np.array(sums, dtype=wide.dtype)
                total = [None if s > LONGEST else s for s in (off * off).sum(axis=1).tolist()]
                m = part.num_rows
                ids = part.column("id").take(pa.array(np.repeat(np.arange(m), k)))
                yield pa.RecordBatch.from_arrays(
                    [
                        ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n)),
                        pa.array([t for t in total for _ in range(k)], pa.int64()), pa.array(z.ravel()),
                        pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error)),
                    ],
                    [id_column, "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return map_batches(valid.select("id", "x"), projected, schema)
