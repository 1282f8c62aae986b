"""Least squares on numeric predictors and factors from sparse normal equations.

The complete rows are read once and reduced to a row for every combination of labels with its
moments. From these the normal equations are summed as (term, term, value) rows. They are solved in the
order of the terms, so that a term which depends on those before it drops out. A factor with
more levels than the equations may have is taken out of them first, level by level.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from .margins import Indexed, index_levels
from .sizing import attach, settle_counted, store

# Equations that are solved on the driver: 1,000 terms are 8 MB.
MOST_TERMS = 1_000
# A term is dropped when what the terms before it leave of its sum of squares is below this share.
DEPENDENT = 1e-10
# Cells with at most so many rows are kept in one partition.
SMALL_TABLE = 100_000


@dataclass(frozen=True)
class Regression:
    """A fitted model.

    ``terms`` lists (term, estimate, standard error), both None for a dropped term. A prediction is ``start`` plus slope times value of every
    predictor in ``slopes``, plus the ``effect`` of the row's label in each frame of ``effects``. A factor in ``absorbed`` has its effects
    there, and no terms.
    """

    terms: list[tuple[str, float | None, float | None]]
    start: float
    slopes: dict[str, float]
    effects: dict[str, DataFrame]
    absorbed: str | None
    r2: float
    sigma: float
    n: int


def solve_in_order(matrix: np.ndarray, right: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(kept, solution, inverse): elimination from the first term on; a term whose pivot is a ``DEPENDENT`` share of ``whole`` is left out."""
    left, kept = matrix.copy(), np.zeros(len(right), bool)
    for j in range(len(right)):
        pivot = left[j, j]
        if pivot > DEPENDENT * whole[j] and whole[j] > 0:
            kept[j] = True
            rest = left[j, j + 1 :].copy()
            left[j + 1 :, j + 1 :] -= np.outer(rest, rest) / pivot
    own = matrix[np.ix_(kept, kept)]
    scale = 1 / np.sqrt(np.diag(own))
    inverse = np.linalg.inv(own * scale[:, None] * scale) * scale[:, None] * scale
    return kept, inverse @ right[kept], inverse


def _cells(df: DataFrame, variables: Sequence[str], categorical: Sequence[str]) -> DataFrame:
    """A row per combination of labels: n, mean of each variable, and n times the covariance of each pair."""
    k = range(len(variables))
    complete = df.na.drop(subset=[*variables, *categorical]).select(*categorical, *[F.col(v).cast("double").alias(f"_x{q}") for q, v in enumerate(variables)])
    return complete.groupBy(*categorical).agg(
        F.count(F.lit(1)).cast("double").alias("_n"),
        *[F.avg(f"_x{q}").alias(f"_m{q}") for q in k],
        *[(F.covar_pop(f"_x{q}", f"_x{r}") * F.count(F.lit(1))).alias(f"_c{q}_{r}") for q in k for r in k if q <= r],
    )


def _entries(indexed: Indexed, means: Sequence[float]) -> list[tuple[Column, Column]]:
    """(number of a term, its sum in the cell): the cell's levels, then the variables less their means."""
    size = indexed.first[-1]
    levels = [(index, F.col("_n")) for index in indexed.indexes]
    return levels + [(F.lit(size + q), F.col("_n") * (F.col(f"_m{q}") - m)) for q, m in enumerate(means)]


def _summed(rows: DataFrame, size: int) -> np.ndarray:
    """Symmetric matrix of (i, j, v) rows."""
    matrix = np.zeros((size, size))
    for row in rows.groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        matrix[row.i, row.j] = matrix[row.j, row.i] = row.v
    return matrix


def _entry(i: Column, j: Column, v: Column) -> Column:
    return F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), v.cast("double").alias("v"))


def _cross_products(indexed: Indexed, means: Sequence[float], size: int) -> np.ndarray:
    """Sums over all rows of the products of any two of the terms."""
    marks, base, n = indexed.indexes, indexed.first[-1], F.col("_n")
    off = [F.col(f"_m{q}") - m for q, m in enumerate(means)]
    found = [_entry(a, b, n) for k, a in enumerate(marks) for b in marks[k:]]
    found += [_entry(a, F.lit(base + q), n * off[q]) for a in marks for q in range(len(means))]
    found += [_entry(F.lit(base + q), F.lit(base + r), F.col(f"_c{q}_{r}") + n * off[q] * off[r]) for q in range(len(means)) for r in range(q, len(means))]
    return _summed(indexed.cells.select(F.inline(F.array(*found))), size)


def _level_sums(indexed: Indexed, factor: str, means: Sequence[float]) -> DataFrame:
    """For every level of the absorbed factor: n, and its nonzero sums as an array of (i, s)."""
    entries = F.array(*[F.struct(i.cast("int").alias("i"), s.cast("double").alias("s")) for i, s in _entries(indexed, means)])
    parts = indexed.cells.select(factor, F.inline(entries)).groupBy(factor, "i").agg(F.sum("s").alias("s"))
    sizes = indexed.cells.groupBy(factor).agg(F.sum("_n").alias("_n"))
    held = parts.groupBy(factor).agg(F.sort_array(F.collect_list(F.struct("i", "s"))).alias("held"))  # at most a number per term
    return store(held.join(sizes, factor))


def _between_levels(levels: DataFrame, size: int) -> np.ndarray:
    """What the absorbed factor explains of the cross products: products of a level's sums over its rows, summed over the levels."""
    pairs = F.flatten(
        F.transform("held", lambda a: F.transform(F.filter("held", lambda b: b["i"] >= a["i"]), lambda b: _entry(a["i"], b["i"], a["s"] * b["s"] / F.col("_n"))))
    )
    return _summed(levels.select(F.inline(pairs)), size)


def fit_factors(df: DataFrame, y: str, numeric: Sequence[str], categorical: Sequence[str] = (), max_terms: int = MOST_TERMS) -> Regression:
    """Least squares of ``y`` on the predictors; rows with a NULL among them are left out.

    Terms are the intercept, the numeric predictors and, for each factor, its labels in order but the first, which is the reference. A term
    that is a linear combination of terms before it is dropped. With more than ``max_terms`` levels the factor with most of
    them is absorbed: its levels take the place of the intercept and count as before all other terms. All other levels
    together must stay within ``max_terms``, else ``ValueError``. Without a complete row every term is dropped.
    """
    variables = [*numeric, y]
    k = len(variables)
    cells, rows = settle_counted(_cells(df, variables, categorical))
    totals = cells.agg(F.sum("_n"), *[F.sum(F.col("_n") * F.col(f"_m{q}")) for q in range(k)]).first()
    n = int(totals[0] or 0)
    if n == 0:
        return Regression([("(intercept)", None, None), *[(x, None, None) for x in numeric]], float("nan"), {}, {}, None, float("nan"), float("nan"), 0)
    means = [total / n for total in totals[1:]]
    factors, absorbed, levels = list(categorical), None, None

    def numbered() -> Indexed | None:
        true, zero = {c: F.lit(True) for c in factors}, {c: F.lit(0.0) for c in factors}
        return index_levels(cells, factors, true, zero, max_terms, rows <= SMALL_TABLE) if factors else Indexed(cells, np.zeros(0), (0,))

    indexed = numbered()
    if indexed is None:
        sizes = cells.agg(*[F.approx_count_distinct(c) for c in factors]).first()
        absorbed = factors.pop(int(np.argmax(sizes)))
        indexed = numbered()
        if indexed is None:
            raise ValueError(f"more than {max_terms} levels besides those of {absorbed}")
    size = indexed.first[-1]
    whole = _cross_products(indexed, means, size + k)
    matrix, groups = whole, 0
    if absorbed is not None:
        levels = _level_sums(indexed, absorbed, means)
        matrix, groups = whole - _between_levels(levels, size + k), levels.count()

    # Terms in order: intercept (in front, if there is one), numeric predictors, levels but the first of each factor.
    firsts = set(indexed.first[:-1])
    order = [*range(size, size + k - 1), *[i for i in range(size) if i not in firsts]]
    names = [*numeric, *[f"{factors[int(np.searchsorted(indexed.first, i, side='right')) - 1]}{indexed.levels[i]}" for i in order[k - 1 :]]]
    system, right, own = matrix[np.ix_(order, order)], matrix[order, size + k - 1], np.diag(whole)[order]
    if absorbed is None:
        counts = np.array([0.0 if i >= size else whole[i, i] for i in order])
        system, right, own = np.block([[np.array([[float(n)]]), counts[None, :]], [counts[:, None], system]]), np.append(0.0, right), np.append(n, own)
    kept, solution, inverse = solve_in_order(system, right, own)
    full = np.zeros(len(kept))
    full[kept] = solution
    total, explained = matrix[size + k - 1, size + k - 1], float(solution @ right[kept])
    freedom = n - int(kept.sum()) - groups
    rss = max(0.0, float(total) - explained)
    sigma2 = rss / freedom if freedom > 0 else float("nan")
    r2 = 1 - rss / whole[-1, -1] if whole[-1, -1] > 0 else float("nan")

    shift = 0 if absorbed is not None else 1
    slopes = {x: full[shift + q] for q, x in enumerate(numeric)}
    start = means[-1] + (full[0] if shift else 0.0) - sum(slopes[x] * means[q] for q, x in enumerate(numeric))
    errors = np.full(len(kept), np.nan)
    errors[kept] = np.sqrt(sigma2 * np.diag(inverse))
    terms = [(name, float(full[shift + j]), float(errors[shift + j])) if kept[shift + j] else (name, None, None) for j, name in enumerate(names)]
    if shift:
        turn = np.zeros(len(kept))
        turn[0], turn[1 : 1 + len(numeric)] = 1.0, [-m for m in means[:-1]]
        terms.insert(0, ("(intercept)", float(start), float(np.sqrt(sigma2 * (turn[kept] @ inverse @ turn[kept])))))
    weight = dict(zip(order, full[shift:]))
    effects = {}
    for f, factor in enumerate(factors):
        schema = T.StructType([T.StructField(factor, df.schema[factor].dataType), T.StructField("effect", T.DoubleType())])
        found = [(indexed.levels[i], float(weight.get(i, 0.0))) for i in range(*indexed.first[f : f + 2])]
        effects[factor] = df.sparkSession.createDataFrame(found, schema)
    if absorbed is not None:
        # What the other terms leave of a level's mean; variables count from their means, as in ``start``.
        taken = [-weight.get(i, 0.0) for i in range(size + k - 1)] + [1.0]
        coefficients = F.expr("array(" + ", ".join(f"{float(w)!r}D" for w in taken) + ")")
        rest = F.aggregate("held", F.lit(0.0), lambda sum_, e: sum_ + e["s"] * F.get(coefficients, e["i"]))
        effects[absorbed] = levels.select(absorbed, (rest / F.col("_n")).alias("effect"))
    return Regression(terms, float(start), slopes, effects, absorbed, float(r2), float(np.sqrt(sigma2)), n)


def with_prediction(df: DataFrame, model: Regression, name: str) -> DataFrame:
    """Add the prediction; NULL where a predictor is missing, a label is in no complete row, or nothing was fitted."""
    value, out = F.lit(model.start if model.n else None).cast("double"), df
    for x, slope in model.slopes.items():
        value = value + F.lit(float(slope)) * F.col(x)
    for f, (factor, effects) in enumerate(model.effects.items()):
        effects = effects.withColumnRenamed("effect", f"_effect{f}")
        # All factors but an absorbed one have at most MOST_TERMS levels together.
        out = attach(out, effects, [factor]) if factor == model.absorbed else out.join(F.broadcast(effects), [factor], "left")
        value = value + F.col(f"_effect{f}")
    return out.withColumn(name, value).select(*df.columns, name)
