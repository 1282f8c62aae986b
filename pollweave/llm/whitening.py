"""Whitening of embeddings along the leading components of their covariance.

The covariance is never formed. Its products with a few vectors at a time are sums over
the distinct vectors, centred before multiplying, taken by Spark in one pass. A block
Jacobi-Davidson method finds the components: Rayleigh-Ritz in a growing subspace, which each round
takes up the solutions of the projected correction equations of all wanted pairs, solved roughly by
MINRES. A pair whose residual has reached double precision is locked and projected out.
"""

from __future__ import annotations

from collections.abc import Callable, Generator, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .texts import arrow_schema, mapped, stored

COMPONENTS = 4
SCALE = 256
# Entries of one stored block of vectors.
BLOCK_ENTRIES = 500_000
# Partial sums that the driver adds up; more are added up by so many tasks before.
MOST_PARTIALS = 64
# A pair is locked when its residual, taken anew, is at most this share of the largest eigenvalue.
RESIDUAL = 64 * np.finfo(float).eps
# Sums over very many vectors may round too much for that; every failed try allows four times as much, up to here.
LOOSEST = 1e-12
# A component with a smaller share of the largest eigenvalue is rounding, and left out.
LEAST_SHARE = 1e-10
MOST_ROUNDS = 200
INNER_STEPS, INNER_SHARE = 10, 0.05  # MINRES ends at this many steps, or when the correction's residual is down to this share
MOST_BASIS, KEPT_BASIS = 96, 24  # vectors of the subspace, and what a restart keeps of them
START_EXTRA = 4
# Entries below this size are multiplied as 64-bit whole numbers with parts of this many bits of a sum; larger ones as Python's.
EXACT_BELOW, PART_BITS = 1 << 26, 16


# --- the fit list


def usable(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", dims: int | None = None) -> DataFrame:
    """``vec_id`` and ``vector`` of the rows whose vector has no null or non-finite entry and the length ``dims``.

    Without ``dims`` the length is the one that most such vectors have, the larger one of a tie.
    """
    vector = F.col(vector_column)
    finite = vectors.select(F.col(id_column).alias("vec_id"), vector.cast("array<double>").alias("vector")).where(
        F.col("vector").isNotNull() & F.forall("vector", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    )
    if dims is None:
        found = finite.groupBy(F.size("vector").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).first()
        dims = found.dims if found else 0
    return finite.where(F.size("vector") == dims)


def whole(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * c) of every entry; what exceeds a long is its least or largest value."""
    return F.transform(vector, lambda c: F.floor(c * F.lit(float(scale))))


@dataclass(frozen=True)
class FitList:
    """Every distinct vector once, in stored blocks; number, exact sums per dimension, and how many partitions the blocks have."""

    blocks: DataFrame
    n: int
    sums: list[int]
    n_partitions: int

    @property
    def mean(self) -> np.ndarray:
        return np.array([total / self.n for total in self.sums])


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column of equal lengths, as 64-bit whole numbers."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.int64, copy=False).reshape(len(column), -1)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = _matrix(batch.column(0))
        step = max(1, BLOCK_ENTRIES // max(1, rows.shape[1]))
        for start in range(0, len(rows), step):
            block = rows[start : start + step]
            low, high = int(block.min(initial=0)), int(block.max(initial=0))
            kind = next(k for k in ("<i2", "<i4", "<i8") if np.iinfo(k).min <= low and high <= np.iinfo(k).max)
            yield pa.RecordBatch.from_pydict({"n": [len(block)], "kind": [kind], "data": [block.astype(kind).tobytes()]})


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    for batch in batches:
        for n, kind, data in zip(*(column.to_pylist() for column in batch.columns)):
            yield np.frombuffer(data, kind).reshape(n, -1)


def fit_list(vectors: DataFrame, scale: int = SCALE) -> FitList:
    """The distinct whole-number vectors of ``usable`` rows; equal rows meet once per task before they are shuffled."""
    distinct = vectors.select(whole(F.col("vector"), scale).alias("x")).distinct()
    blocks = stored(mapped(distinct, _pack, "n long, kind string, data binary"), "fit-list")

    # A long is a high part and a low part of 32 bits, whose sums cannot overflow within a task's block.
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            x = block.astype(np.int64)
            yield pa.RecordBatch.from_pydict({"dim": pa.array(np.arange(x.shape[1], dtype=np.int32)), "high": (x >> 32).sum(axis=0), "low": (x & 0xFFFFFFFF).sum(axis=0)})

    exact = lambda name: F.sum(F.col(name).cast("decimal(38,0)")).alias(name)
    found = mapped(blocks, run, "dim int, high long, low long").groupBy("dim").agg(exact("high"), exact("low")).orderBy("dim").collect()
    n = blocks.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return FitList(blocks, n, [(int(row.high) << 32) + int(row.low) for row in found], blocks.rdd.getNumPartitions())


def summed(fit: FitList, work: Callable[[np.ndarray], np.ndarray], shape: tuple[int, int]) -> np.ndarray:
    """The sum over the fit list of ``work``, which gets a block of centred vectors and returns a matrix of ``shape``.

    One row leaves each task. Beyond ``MOST_PARTIALS`` tasks as many tasks add these up before they reach the driver.
    """
    mean = fit.mean

    def add(parts: Iterator[np.ndarray]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for part in parts:
            total += part
        yield pa.RecordBatch.from_pydict({"part": [total.tobytes()]})

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return add(work(block - mean) for block in _blocks(batches))

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return add(np.frombuffer(part).reshape(shape) for batch in batches for part in batch.column(0).to_pylist())

    parts = mapped(fit.blocks, first, "part binary")
    if fit.n_partitions > MOST_PARTIALS:
        parts = mapped(parts.repartition(MOST_PARTIALS), again, "part binary")
    return sum((np.frombuffer(row.part).reshape(shape) for row in parts.collect()), np.zeros(shape))


def covariance_product(fit: FitList, vectors: np.ndarray) -> np.ndarray:
    """Covariance (divisor n) times some columns."""
    return summed(fit, lambda x: x.T @ (x @ vectors), vectors.shape) / fit.n


# --- Jacobi-Davidson


def minres(b: np.ndarray, steps: int, share: float) -> Generator[np.ndarray, np.ndarray, np.ndarray]:
    """Solve M x = b for a symmetric M: yields vectors, is sent M times them, and returns x."""
    x, w, w_old, v_old = np.zeros_like(b), np.zeros_like(b), np.zeros_like(b), np.zeros_like(b)
    beta = start = left = float(np.linalg.norm(b))
    if start == 0:
        return x
    v, c, s, c_old, s_old = b / beta, 1.0, 0.0, 1.0, 0.0
    beta = 0.0
    for _ in range(steps):
        y = yield v
        alpha = float(v @ y)
        y = y - alpha * v - beta * v_old
        after = float(np.linalg.norm(y))
        # The new column of the tridiagonal matrix under the last two rotations, then a rotation of its own.
        top, rest = s_old * beta, c_old * beta
        middle, bottom = c * rest + s * alpha, c * alpha - s * rest
        size = float(np.hypot(bottom, after))
        if size == 0:
            return x
        c_old, s_old, c, s = c, s, bottom / size, after / size
        w, w_old = (v - middle * w - top * w_old) / size, w
        x = x + c * left * w
        left = -s * left
        if abs(left) <= share * start or after <= 1e-14 * start:
            return x
        v_old, v, beta = v, y / after, after
    return x


def corrections(product: Callable[[np.ndarray], np.ndarray], fixed: np.ndarray, values: np.ndarray, residuals: np.ndarray, steps: int, share: float) -> np.ndarray:
    """t orthogonal to ``fixed`` with (M - value) t = -residual there, for every column; one product a step serves all of them."""

    def off(y: np.ndarray) -> np.ndarray:
        return y - fixed @ (fixed.T @ y)

    solved = np.zeros_like(residuals)
    running = {}
    for j in range(residuals.shape[1]):
        solver = minres(off(-residuals[:, j]), steps, share)
        try:
            running[j] = (solver, next(solver))
        except StopIteration as end:
            solved[:, j] = end.value
    while running:
        images = product(np.column_stack([v for _, v in running.values()]))
        for (j, (solver, v)), image in zip(list(running.items()), images.T):
            try:
                running[j] = (solver, solver.send(off(image - values[j] * v)))
            except StopIteration as end:
                solved[:, j] = end.value
                del running[j]
    return solved


def orthonormal(vectors: np.ndarray, against: np.ndarray) -> np.ndarray:
    """Unit vectors for what the columns add to ``against``; columns that add nothing are dropped."""
    kept = against
    for v in vectors.T:
        size = np.linalg.norm(v)
        for _ in range(2):
            v = v - kept @ (kept.T @ v)
        left = np.linalg.norm(v)
        if left > 1e-10 * size and size > 0:
            v = v / left
            v = v - kept @ (kept.T @ v)
            kept = np.column_stack([kept, v / np.linalg.norm(v)])
    return kept[:, against.shape[1] :]


def leading_pairs(product: Callable[[np.ndarray], np.ndarray], dims: int, wanted: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues, falling, and their unit eigenvectors of a symmetric positive semidefinite matrix.

    ``product`` multiplies it with the columns it is given. The largest entry of each vector is positive.
    Raises ``RuntimeError`` if residuals stay above double precision for ``MOST_ROUNDS`` rounds.
    """
    wanted = min(wanted, dims)
    locked, values = np.zeros((dims, 0)), np.zeros(0)
    basis = orthonormal(np.random.default_rng(seed).standard_normal((dims, min(dims, wanted + START_EXTRA))), locked)
    image, allowed = product(basis) if dims else basis, RESIDUAL
    for _ in range(MOST_ROUNDS):
        if not basis.shape[1]:
            break
        inner = basis.T @ image
        theta, turn = np.linalg.eigh((inner + inner.T) / 2)
        theta, turn = theta[::-1], turn[:, ::-1]
        basis, image = basis @ turn, image @ turn
        norm = max(theta[0], values.max(initial=0.0))
        need = wanted - len(values)
        if need <= 0:
            # Nothing in the subspace may exceed what is locked; if it does, it is a pair that was passed over.
            if theta[0] <= np.sort(values)[-wanted] + allowed * norm:
                break
            need = 1
        need = min(need, basis.shape[1])
        residuals = image[:, :need] - basis[:, :need] * theta[:need]
        ready = np.linalg.norm(residuals, axis=0) <= allowed * norm
        n_ready = need if ready.all() else int(np.argmin(ready))
        if n_ready:
            fresh = product(basis[:, :n_ready])
            own = np.einsum("ij,ij->j", basis[:, :n_ready], fresh)
            reached = np.linalg.norm(fresh - basis[:, :n_ready] * own, axis=0) <= allowed * norm
            n_locked = n_ready if reached.all() else int(np.argmin(reached))
            image[:, :n_ready] = fresh
            if n_locked:
                locked, values = np.column_stack([locked, basis[:, :n_locked]]), np.append(values, own[:n_locked])
                basis, image = basis[:, n_locked:], image[:, n_locked:]
            else:
                allowed = min(4 * allowed, LOOSEST)
            continue
        fixed = np.column_stack([locked, basis[:, :need]])
        steps = corrections(product, fixed, theta, residuals, INNER_STEPS, INNER_SHARE)
        if basis.shape[1] + need > MOST_BASIS:
            basis, image = basis[:, : KEPT_BASIS + need], image[:, : KEPT_BASIS + need]
        added = orthonormal(steps, np.column_stack([locked, basis]))
        if added.shape[1]:
            basis, image = np.column_stack([basis, added]), np.column_stack([image, product(added)])
        else:
            image, allowed = product(basis), min(4 * allowed, LOOSEST)
    else:
        raise RuntimeError(f"only {len(values)} of {wanted} eigenpairs reached double precision in {MOST_ROUNDS} rounds")
    order = np.argsort(-values, kind="stable")[:wanted]
    locked, values = locked[:, order], values[order]
    signs = np.sign(locked[np.abs(locked).argmax(axis=0), np.arange(len(order))]) if dims else np.ones(0)
    return values, locked * signs


# --- whitening


@dataclass(frozen=True)
class Whitening:
    """What ``transform`` needs of a fit list: its size and sums, eigenvalues, unit vectors, trace, and the largest error against the identity."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float


def fit(vectors: DataFrame, components: int = COMPONENTS, scale: int = SCALE) -> Whitening:
    """Learn the whitening from ``usable`` rows. Components without variance are left out, so there may be fewer."""
    held = fit_list(vectors, scale)
    dims = len(held.sums)
    if held.n < 2 or dims == 0:
        return Whitening(held.n, held.sums, np.zeros(0), np.zeros((dims, 0)), 0.0, 0.0)
    trace = float(summed(held, lambda x: (x * x).sum(axis=0)[:, None], (dims, 1)).sum()) / held.n
    values, found = leading_pairs(lambda columns: covariance_product(held, columns), dims, components)
    able = values > LEAST_SHARE * values.max(initial=0.0)
    values, found = values[able], found[:, able]
    k, turned = len(values), found / np.sqrt(values)
    middle = summed(held, lambda x: (x @ turned).sum(axis=0)[None, :], (1, k)) / held.n

    def square(x: np.ndarray) -> np.ndarray:
        z = x @ turned - middle
        return z.T @ z

    error = float(np.abs(summed(held, square, (k, k)) / held.n - np.eye(k)).max(initial=0.0))
    return Whitening(held.n, held.sums, values, found, trace, error)


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int]:
    """The sum over the dimensions of (n * x - sum) squared, exact, for every row of whole numbers."""
    if not x.size:
        return [0] * len(x)
    if int(np.abs(x).max()) < EXACT_BELOW and int(x.min()) > -EXACT_BELOW:
        own = (x * x).sum(axis=1).tolist()
        parts = max(total.bit_length() for total in sums) // PART_BITS + 1
        cross = [0] * len(x)
        for p in range(parts):
            part = np.array([(total >> PART_BITS * p) & ((1 << PART_BITS) - 1) if p < parts - 1 else total >> PART_BITS * p for total in sums], np.int64)
            cross = [held + (more << PART_BITS * p) for held, more in zip(cross, (x @ part).tolist())]
        last = sum(total * total for total in sums)
        return [n * n * a - 2 * n * b + last for a, b in zip(own, cross)]
    return [sum((n * c - total) ** 2 for c, total in zip(row, sums)) for row in x.tolist()]


def transform(vectors: DataFrame, fitted: Whitening, scale: int = SCALE) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error: a row for every ``usable`` row and component.

    ``deviation`` is a decimal, null from 10^38 on. Repeated rows are returned as often as they occur.
    """
    schema = f"vec_id {vectors.schema['vec_id'].dataType.simpleString()}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    arrow = arrow_schema(schema)
    k, n, sums = len(fitted.values), fitted.n, fitted.sums
    mean, turned = np.array([total / n for total in sums]), fitted.vectors / np.sqrt(fitted.values)
    explained = (fitted.values / fitted.trace).tolist() if k else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not k or not batch.num_rows:
                continue
            step = max(1, BLOCK_ENTRIES // len(sums))
            for start in range(0, batch.num_rows, step):
                block = batch.slice(start, step)
                x = _matrix(block.column(1))
                whitened = (x - mean) @ turned
                exact = [Decimal(value) if value < 10**38 else None for value in deviations(x, n, sums)]
                ids = block.column(0).take(pa.array(np.repeat(np.arange(len(x)), k)))
                rows = len(x) * k
                columns = [
                    ids,
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                    pa.array(np.full(rows, n)),
                    pa.array([value for value in exact for _ in range(k)], pa.decimal128(38, 0)),
                    pa.array(whitened.ravel()),
                    pa.array(explained * len(x)),
                    pa.array(np.full(rows, fitted.identity_error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return mapped(vectors.select("vec_id", whole(F.col("vector"), scale).alias("x")), run, schema)


def whiten(
    frame: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", components: int = COMPONENTS, scale: int = SCALE, dims: int | None = None
) -> DataFrame:
    """``transform`` of every row of ``frame`` that has a usable vector, fitted on all of them.

    Rows with a null vector, null or non-finite entries, or another length than ``dims`` are dropped. An entry c
    counts as floor(scale * c). The covariance is that of the distinct vectors, with their number as divisor. There are no rows where nothing
    varies: for an empty table, a single distinct vector, or vectors of no length. Other columns play no part; a null id is kept.
    """
    rows = usable(frame, id_column, vector_column, dims)
    return transform(rows, fit(rows, components, scale), scale)
