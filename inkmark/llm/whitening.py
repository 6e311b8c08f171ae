"""Whitening of vectors along their leading components, which block Jacobi-Davidson finds without forming a matrix.

The covariance is only ever applied: a pass over the stored vectors gives V u for a block of vectors u, centred before
multiplying. What the driver holds is a few blocks of as many numbers as a vector has entries.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkmark.llm.common import stored

Product = Callable[[np.ndarray], np.ndarray]

#: Pairs that are corrected at once, steps of the inner solver, residuals of this share of the largest eigenvalue count
#: as double precision, rounds until the search is given up with an error, directions with less of the trace are none.
BLOCK, INNER, PRECISION, ROUNDS, NOTHING = 32, 4, 2.0**-44, 300, 1e-12


def _integers(batch: pa.RecordBatch, column: int, d: int | None = None) -> np.ndarray:
    """(rows, entries) of a column of arrays without nulls; arrays of unlike lengths are an error."""
    lists = batch.column(column)
    values, n = lists.flatten().to_numpy(zero_copy_only=False), len(lists)
    d = d or (len(values) // n if n else 0)
    if len(values) != n * d or n and (np.diff(lists.offsets.to_numpy()) != d).any():
        raise ValueError("vectors differ in length")
    return values.reshape(n, d)


@dataclass
class Moments:
    """Rows, sums by entry, and the integers next to the means: entries less those are small, so no digits are lost."""

    n: int
    sums: list[int]
    least: list[int]
    most: list[int]

    @property
    def near(self) -> np.ndarray:
        return np.array([(2 * s + self.n) // (2 * self.n) for s in self.sums], np.int64)

    @property
    def rest(self) -> np.ndarray:
        """Means less `near`, from exact integers."""
        return np.array([(s - self.n * int(m)) / self.n for s, m in zip(self.sums, self.near, strict=True)])


def moments(vectors: DataFrame) -> Moments | None:
    """Of vectors(x array<bigint>); None without rows. A row an entry comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, least, most = 0, None, None, None
        for x in (_integers(b, 0) for b in batches):
            if len(x):
                if n and x.shape[1] != len(sums):
                    raise ValueError("vectors differ in length")
                found = np.array([int(v) for v in x.sum(0)] if np.abs(x).max() < 2**40 else x.astype(object).sum(0).tolist(), object)
                low, high = x.min(0), x.max(0)
                n, sums, least, most = (n + len(x), sums + found, np.minimum(least, low), np.maximum(most, high)) if n else (len(x), found, low, high)
        if n:
            d = len(sums)
            rows = [pa.array(range(d), pa.int32()), pa.array([d] * d, pa.int32()), pa.array([n] * d, pa.int64()), pa.array([str(s) for s in sums]), pa.array(least, pa.int64()), pa.array(most, pa.int64())]
            yield pa.RecordBatch.from_arrays(rows, ["i", "d", "n", "s", "least", "most"])

    each = vectors.select("x").mapInArrow(run, "i int, d int, n long, s string, least long, most long")
    found = each.groupBy("i").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.min("least").alias("least"), F.max("most").alias("most"), F.min("d").alias("d0"), F.max("d").alias("d1")).orderBy("i").collect()
    if not found:
        return None
    if any(r.d0 != r.d1 for r in found):
        raise ValueError("vectors differ in length")
    return Moments(found[0].n, [int(r.s) for r in found], [r.least for r in found], [r.most for r in found])


def _summed(vectors: DataFrame, m: Moments, part: Callable[[np.ndarray], np.ndarray], shape: tuple[int, int]) -> np.ndarray:
    """The sum of part(centred rows) over all rows: one array a task, added up by entry in a shuffle."""
    near, rest, d = m.near, m.rest, len(m.sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for b in batches:
            total += part((_integers(b, 0, d) - near) - rest)
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel()], pa.list_(pa.float64()))], ["y"])

    parts = vectors.select("x").mapInArrow(run, "y array<double>").select(F.posexplode("y").alias("i", "y"))
    out = np.zeros(shape[0] * shape[1])
    for r in parts.groupBy("i").agg(F.sum("y").alias("y")).collect():
        out[r.i] = r.y
    return out.reshape(shape)


def covariance_product(vectors: DataFrame, m: Moments) -> Product:
    """u -> V u for a block of columns, one pass over the vectors."""
    return lambda u: _summed(vectors, m, lambda x: x.T @ (x @ u), u.shape) / m.n


def _orthonormal(new: np.ndarray, *others: np.ndarray) -> np.ndarray:
    """The part of new's columns outside the others' span, as orthonormal columns; those that lie within it go."""
    for _ in range(2):
        for q in others:
            new = new - q @ (q.T @ new)
        size = np.linalg.norm(new, axis=0)
        new = new[:, size > 1e-300] / size[size > 1e-300]
    q, r = np.linalg.qr(new)
    q = q[:, np.abs(np.diag(r)) > 1e-10]
    for other in others:
        q = q - other @ (other.T @ q)
    return np.linalg.qr(q)[0] if q.shape[1] else q


def minres(apply: Product, right: np.ndarray, steps: int = INNER, target: float = 0.05) -> np.ndarray:
    """Approximate solutions of symmetric systems, a column each, that share every application of their operators."""
    size = np.linalg.norm(right, axis=0)
    part = lambda a, b: np.divide(a, b, out=np.zeros_like(a), where=b != 0)
    x, v_old, v = np.zeros_like(right), np.zeros_like(right), part(right, np.broadcast_to(size, right.shape))
    w_old, w, left, beta = np.zeros_like(right), np.zeros_like(right), size.copy(), np.zeros_like(size)
    c_old, c, s_old, s = np.ones_like(size), np.ones_like(size), np.zeros_like(size), np.zeros_like(size)
    for _ in range(steps):
        p = apply(v)
        alpha = (v * p).sum(0)
        p = p - alpha * v - beta * v_old
        after = np.linalg.norm(p, axis=0)
        delta, second, third = c * alpha - c_old * s * beta, s * alpha + c_old * c * beta, s_old * beta
        first = np.hypot(delta, after)
        w_old, w = w, part(v - third * w_old - second * w, np.broadcast_to(first, right.shape))
        c_old, c, s_old, s = c, part(delta, first), s, part(after, first)
        x = x + c * left * w
        left = -s * left
        v_old, v, beta = v, part(p, np.broadcast_to(after, right.shape)), after
        if (np.abs(left) <= target * size).all():
            break
    return x


def jacobi_davidson(product: Product, d: int, k: int, block: int = BLOCK, seed: int = 0) -> tuple[np.ndarray, np.ndarray, int]:
    """(eigenvalues falling, unit eigenvectors as columns, rounds): the k largest pairs of a symmetric operator of d
    entries without negative eigenvalues.

    Each round takes Ritz pairs from the subspace, locks those at the top whose residual has reached double precision,
    and widens the subspace by corrections: the equations (1 - QQ')(V - theta)(1 - QQ') t = -r, with all locked and
    current vectors in Q, solved by a few steps of MINRES, a block of pairs at a time. Beyond its room the subspace
    restarts from its best Ritz vectors. Two pairs more than asked for are found, so that none at the edge is missed.
    """
    wanted = min(d, k + 2)
    room, keep = max(4 * block, 2 * wanted), wanted + block // 2
    locked, values = np.zeros((d, 0)), []
    basis = images = np.zeros((d, 0))
    new = np.random.default_rng(seed).standard_normal((d, min(d, wanted + block // 2)))
    for done in range(1, ROUNDS + 1):
        new = _orthonormal(new, locked, basis)
        if new.shape[1]:
            basis, images = np.hstack([basis, new]), np.hstack([images, product(new)])
        small = basis.T @ images
        theta, turn = np.linalg.eigh((small + small.T) / 2)
        theta, turn = theta[::-1], turn[:, ::-1]
        basis, images = basis @ turn, images @ turn
        residual = images - basis * theta
        residual -= locked @ (locked.T @ residual)
        small_enough = np.linalg.norm(residual, axis=0) <= PRECISION * max([abs(theta[0]), *values])
        n = min(wanted - len(values), len(theta) if small_enough.all() else int(np.argmin(small_enough)))
        locked, values = np.hstack([locked, basis[:, :n]]), [*values, *theta[:n]]
        if len(values) >= wanted:
            order = np.argsort(values)[::-1][:k]
            return np.array(values)[order], locked[:, order], done
        basis, images, theta, residual = basis[:, n:], images[:, n:], theta[n:], residual[:, n:]
        if basis.shape[1] > room - block:
            basis, images, theta, residual = basis[:, :keep], images[:, :keep], theta[:keep], residual[:, :keep]
        now = min(block, wanted - len(values), basis.shape[1])
        fixed = np.hstack([locked, basis[:, :now]])
        outside = lambda t, q=fixed: t - q @ (q.T @ t)
        new = minres(lambda t, at=theta[:now], p=outside: p(product(u := p(t)) - u * at), -outside(residual[:, :now]))
        if not new.any() or basis.shape[1] < 1:
            new = np.random.default_rng(seed + done).standard_normal((d, block))
    raise RuntimeError("the components have not converged")


@dataclass
class Whitening:
    """moments, eigenvalues and components (columns), trace of the covariance, and what the whitened vectors'
    covariance differs from the identity by; rounds of the search and passes over the vectors."""

    moments: Moments
    values: np.ndarray
    components: np.ndarray
    trace: float
    identity_error: float
    rounds: int
    passes: int

    @property
    def projection(self) -> np.ndarray:
        return self.components / np.sqrt(self.values)


def fit(vectors: DataFrame, k: int = 32) -> Whitening | None:
    """The first k components of vectors(x array<bigint>) that have variance; None without rows.

    x has no null, and all are of one length (an error otherwise). Equal vectors count as often as they occur; equal
    eigenvalues have any orthonormal vectors of their space. One vector, or equal ones only, have no component.
    """
    m = moments(vectors)
    if m is None:
        return None
    d, passes = len(m.sums), [2]
    one = covariance_product(vectors, m)

    def product(u: np.ndarray) -> np.ndarray:
        passes[0] += 1
        return one(u)

    trace = float(_summed(vectors, m, lambda x: (x * x).sum(0, keepdims=True), (1, d)).sum() / m.n)
    values, components, rounds = jacobi_davidson(product, d, k) if trace > 0 else (np.zeros(0), np.zeros((d, 0)), 0)
    some = values > NOTHING * trace
    values, components = values[some], components[:, some]
    w = components / np.sqrt(values)
    c, error = len(values), 0.0
    if c:
        each = _summed(vectors, m, lambda x: np.vstack([(y := x @ w).T @ y, y.sum(0)]), (c + 1, c)) / m.n
        error = float(np.abs(each[:c] - np.outer(each[c], each[c]) - np.eye(c)).max())
    return Whitening(m, values, components, trace, error, rounds, passes[0] + 1)


def apply(vectors: DataFrame, model: Whitening, id_col: str = "id") -> DataFrame:
    """vectors(id, x) -> (id, deviation, whitened array<double>): no shuffle.

    deviation is the sum of squares of n x - S, in integers (null if beyond 64 bits). Null and repeated ids stay.
    """
    m, w = model.moments, model.projection
    near, rest, d, n = m.near, m.rest, len(m.sums), m.n
    moved = np.array([s - n * int(a) for s, a in zip(m.sums, near, strict=True)], object)
    widest = max([n * max(int(h) - int(a), int(a) - int(x)) + abs(int(o)) for h, x, a, o in zip(m.most, m.least, near, moved, strict=True)], default=0)
    exact = widest * widest * d < 2**63  # in 64 bits; Python's integers beyond

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _integers(b, 1, d) - near
            scaled = x * n - moved.astype(np.int64) if exact else x.astype(object) * n - moved
            far = [int(v) for v in (scaled * scaled).sum(1)]
            white = (x - rest) @ w
            offsets = pa.array(np.arange(len(x) + 1) * w.shape[1], pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([v if v < 2**63 else None for v in far], pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(white.ravel(), pa.float64()))], ["id", "deviation", "whitened"])

    kind = vectors.schema[id_col].dataType.simpleString()
    return vectors.select(F.col(id_col).alias("id"), "x").mapInArrow(run, f"id {kind}, deviation long, whitened array<double>")


def whiten(rows: DataFrame, k: int = 32, id_col: str = "vec_id", vector_col: str = "x") -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error): a row for each vector and component.

    vector_col: integers; rows in which it is null, empty, or holds a null take no part, and vectors of unlike lengths
    are an error. Null ids stay, repeated rows count and are returned as often, other columns are left alone. Without
    rows, or without variance, no rows.
    """
    v = F.col(vector_col)
    own = rows.select(F.col(id_col).alias("id"), v.alias("x")).where(v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda c: c.isNotNull()))
    own = stored(own.withColumn("x", F.col("x").cast("array<bigint>")), "vectors")
    model = fit(own, k)
    kinds = {"component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double"}
    if model is None or not len(model.values):
        return own.limit(0).select("id", *[F.lit(None).cast(t).alias(c) for c, t in kinds.items()])
    share = F.array(*[F.lit(float(e / model.trace)) for e in model.values])
    each = apply(own, model).select("id", "deviation", F.posexplode("whitened").alias("i", "whitened"))
    return each.select("id", (F.col("i") + 1).alias("component"), F.lit(model.moments.n).cast("bigint").alias("n"), "deviation", "whitened", F.get(share, F.col("i")).alias("explained"), F.lit(model.identity_error).alias("identity_error"))


def whole(column: str, times: int, plus: int = 0) -> F.Column:
    """floor(times * entry) + plus of an array of finite numbers, as integers; null where an entry is null or not finite."""
    c = F.col(column)
    fine = c.isNotNull() & F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf")))
    return F.when(fine, F.transform(c, lambda v: F.floor(v.cast("double") * times).cast("bigint") + plus))
