"""Linear systems over the levels of several margins, summed by Spark from a table of margin cells.

A level is one value of one margin column. The matrix of such a system, the Gram matrix of the
levels' indicators, has a row and a column for every level and holds the weight of the cells that two levels share.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from .sizing import join_null_safe, settle

# The matrix is solved on the driver, so the levels of all margins are bounded: 1,000 of them are 8 MB.
MOST_LEVELS = 1_000
# Eigenvalues of the scaled matrix below this share of the largest belong to dependent levels.
DEPENDENT = 1e-12


@dataclass(frozen=True)
class Indexed:
    """Cells with a column ``_i0``, ``_i1``, ... for every margin: the number of the cell's level, NULL for one that is left out.

    ``targets`` holds a number for every level, ``first`` the number of each margin's first level, and their count at the end,
    ``levels`` the values in the order of their numbers.
    """

    cells: DataFrame
    targets: np.ndarray
    first: tuple[int, ...]
    levels: tuple = ()

    @property
    def indexes(self) -> list[Column]:
        return [F.col(f"_i{k}") for k in range(len(self.first) - 1)]

    def along(self, values: np.ndarray) -> Column:
        """The sum of the values of a cell's levels."""
        held = F.expr("array(" + ", ".join(f"{float(v)!r}D" for v in values) + ")") if len(values) else F.array().cast("array<double>")
        total = F.lit(0.0)
        for index in self.indexes:
            total = total + F.coalesce(F.get(held, index), F.lit(0.0))
        return total


def index_levels(cells: DataFrame, columns: Sequence[str], able: Mapping[str, Column], targets: Mapping[str, Column], most: int = MOST_LEVELS, small: bool = False) -> Indexed | None:
    """Number the levels of the cells where ``able`` holds, or None if there are more than ``most``; NULL is a level.

    A ``small`` table is kept in one partition, so that summing it over and over takes no shuffle.
    """
    marks = [F.when(able[c], F.struct(F.col(c).alias("level"), targets[c].cast("double").alias("target"))) for c in columns]
    # Counted roughly before they are gathered, then exactly.
    if sum(cells.agg(*[F.approx_count_distinct(mark) for mark in marks]).first()) > 1.2 * most:
        return None
    sets = cells.agg(*[F.array_sort(F.collect_set(mark)) for mark in marks]).first()
    first = [0]
    for found in sets:
        first.append(first[-1] + len(found))
    if first[-1] > most:
        return None
    for k, (column, found) in enumerate(zip(columns, sets)):
        schema = T.StructType([T.StructField(column, cells.schema[column].dataType), T.StructField(f"_i{k}", T.IntegerType())])
        numbers = cells.sparkSession.createDataFrame([(row.level, first[k] + n) for n, row in enumerate(found)], schema)
        cells = join_null_safe(cells, F.broadcast(numbers), [column])
    return Indexed(settle(cells.coalesce(1) if small else cells), np.array([row.target for found in sets for row in found], float), tuple(first), tuple(row.level for found in sets for row in found))


def level_system(indexed: Indexed, weight: Column, value: Column | None = None) -> tuple[np.ndarray, np.ndarray, float]:
    """Gram matrix of the levels, the sum of ``value`` for each of them, and the weight of all cells; one pass over the cells."""
    held, marks = F.lit(0.0) if value is None else value, indexed.indexes
    pairs = [F.struct(a.alias("i"), b.alias("j"), (held if n == 0 else F.lit(0.0)).alias("v")) for k, a in enumerate(marks) for n, b in enumerate(marks[k:])]
    pairs.append(F.struct(F.lit(-1).alias("i"), F.lit(-1).alias("j"), F.lit(0.0).alias("v")))
    rows = indexed.cells.select(weight.alias("w"), F.explode(F.array(*pairs)).alias("p")).where("p.i IS NOT NULL AND p.j IS NOT NULL")
    size = indexed.first[-1]
    matrix, sums, total = np.zeros((size, size)), np.zeros(size), 0.0
    for row in rows.groupBy("p.i", "p.j").agg(F.sum("w").alias("w"), F.sum("p.v").alias("v")).collect():
        if row.i < 0:
            total = row.w
            continue
        matrix[row.i, row.j] = matrix[row.j, row.i] = row.w
        if row.i == row.j:
            sums[row.i] = row.v
    return matrix, sums, total


def solve_levels(matrix: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The solution of least norm in scaled levels; the levels of several margins always depend on each other."""
    if not len(right):
        return right
    scale = 1 / np.sqrt(np.where(np.diag(matrix) > 0, np.diag(matrix), 1.0))
    values, vectors = np.linalg.eigh(matrix * scale[:, None] * scale)
    kept = values > DEPENDENT * values[-1]
    return scale * (vectors[:, kept] @ ((vectors[:, kept].T @ (scale * right)) / values[kept]))
