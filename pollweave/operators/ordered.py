"""Row-order operators that do not put a whole series into one task.

A window over few, long series runs on as many tasks as there are series. When
the largest series fits a task the plain window is used. Otherwise the rows are
range-partitioned and sorted by (series, order), and chunk number and position
are fixed by writing them to the shared folder. A summary per chunk (first and
last position, last known value) then completes each chunk from the chunks
before it.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.window import WindowSpec

from ..functions import quoted
from .sizing import ROWS_PER_TASK, attach, chunks_for, group_sizes, join_null_safe, settle, store

CHUNK = "_chunk"
POSITION = "_position"
# monotonically_increasing_id holds the partition above this bit and the position below it.
POSITION_BITS = 33


@dataclass(frozen=True)
class Ordered:
    """Rows grouped by ``keys`` and ordered by ``order`` (ascending, NULL last)."""

    frame: DataFrame
    keys: tuple[str, ...]
    order: tuple[str, ...]
    chunked: bool

    @property
    def ascending(self) -> list[Column]:
        return [F.col(c).asc_nulls_last() for c in self.order]

    @property
    def descending(self) -> list[Column]:
        return [F.col(c).desc_nulls_first() for c in self.order]

    @property
    def groups(self) -> list[str]:
        return [*self.keys, CHUNK] if self.chunked else list(self.keys)

    def window(self) -> WindowSpec:
        return Window.partitionBy(*self.groups).orderBy(*self.ascending)


def in_order(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    rows_per_task: int = ROWS_PER_TASK,
    sizes: tuple[int, int] | None = None,
) -> Ordered:
    """Prepare ``df`` for the functions below; ``order`` should be unique within ``keys``.

    ``sizes`` may pass an upper bound of (rows, rows of the largest group) that
    is cheaper to get than counting ``df`` itself.
    """
    total, largest = sizes or group_sizes(df, keys)
    if largest <= rows_per_task:
        return Ordered(df, tuple(keys), tuple(order), chunked=False)
    sort = [F.col(c).asc_nulls_last() for c in (*keys, *order)]
    placed = store(
        df.repartitionByRange(chunks_for(total, rows_per_task), *sort)
        .sortWithinPartitions(*sort)
        .withColumn("_place", F.monotonically_increasing_id())
    ).selectExpr(
        *map(quoted, df.columns),
        f"shiftright(_place, {POSITION_BITS}) AS {CHUNK}",
        f"_place & {2**POSITION_BITS - 1} AS {POSITION}",
    )
    return Ordered(placed, tuple(keys), tuple(order), chunked=True)


def _spans(rows: Ordered) -> DataFrame:
    """First and last position of every (series, chunk)."""
    return rows.frame.groupBy(*rows.groups).agg(
        F.min(POSITION).alias("_first"), F.max(POSITION).alias("_last")
    )


def _earlier_chunks(rows: Ordered) -> WindowSpec:
    """Over one row per (series, chunk): the chunks before this one."""
    return Window.partitionBy(*rows.keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)


def trailing(
    rows: Ordered, lookback: int, columns: dict[str, Callable[[WindowSpec], Column]]
) -> DataFrame:
    """Add columns computed over the current row and the ``lookback`` rows before it."""
    window = rows.window().rowsBetween(-lookback, 0)
    added = {name: make(window) for name, make in columns.items()}
    if not rows.chunked:
        return rows.frame.withColumns(added)
    stored = rows.frame.drop(POSITION)
    both = stored.withColumn("_carried", F.lit(False)).unionByName(
        _rows_before_chunks(rows, lookback).withColumn("_carried", F.lit(True))
    )
    return both.withColumns(added).filter(~F.col("_carried")).drop("_carried", CHUNK)


def _rows_before_chunks(rows: Ordered, lookback: int) -> DataFrame:
    """For each chunk the ``lookback`` rows before its first row, labelled with that chunk."""
    tails = (
        attach(rows.frame, _spans(rows), rows.groups, null_safe=True)
        .filter(F.col(POSITION) > F.col("_last") - lookback)
        .drop("_first", "_last", POSITION)
    )
    # At most lookback rows per chunk are left, so this window stays small.
    series = Window.partitionBy(*rows.keys).orderBy(*rows.ascending)
    tails = settle(tails.withColumn("_rank", F.row_number().over(series)))
    starts = tails.groupBy(*rows.groups).agg(F.min("_rank").alias("_next"))
    wanted = tails.drop(CHUNK).withColumn(
        "_next", F.explode(F.sequence(F.col("_rank") + 1, F.col("_rank") + lookback))
    )
    return join_null_safe(wanted, starts, [*rows.keys, "_next"], "inner").drop("_rank", "_next")


def number_rows(rows: Ordered, name: str) -> DataFrame:
    """Add a dense 1..n row number per key."""
    if not rows.chunked:
        return rows.frame.withColumn(name, F.row_number().over(rows.window()).cast("long"))
    size = F.col("_last") - F.col("_first") + 1
    before = F.coalesce(F.sum(size).over(_earlier_chunks(rows)), F.lit(0))
    offsets = _spans(rows).select(*rows.groups, (before - F.col("_first") + 1).alias("_offset"))
    return (
        attach(rows.frame, offsets, rows.groups, null_safe=True)
        .withColumn(name, F.col(POSITION) + F.col("_offset"))
        .drop("_offset", CHUNK, POSITION)
    )


def carry_forward(rows: Ordered, value: str, name: str) -> DataFrame:
    """Add the latest non-NULL ``value`` at or before each row."""
    here = rows.window().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = rows.frame.withColumn(name, F.last(value, ignorenulls=True).over(here))
    if not rows.chunked:
        return filled
    known = F.when(F.col(value).isNotNull(), F.col(POSITION))
    before = (
        rows.frame.groupBy(*rows.groups)
        .agg(F.max_by(F.col(value), known).alias("_here"))
        .select(*rows.groups, F.last("_here", ignorenulls=True).over(_earlier_chunks(rows)).alias("_before"))
    )
    return (
        attach(filled, before, rows.groups, null_safe=True)
        .withColumn(name, F.coalesce(F.col(name), F.col("_before")))
        .drop("_before", CHUNK, POSITION)
    )


def carry_both(rows: Ordered, value: str, before: str, after: str) -> DataFrame:
    """Add the latest non-NULL ``value`` at or before each row, and the first one at or after it.

    The second one is carried along the reversed order, because a frame that ends with the series is read anew for every row.
    """
    upto = Window.unboundedPreceding, Window.currentRow
    back = Window.partitionBy(*rows.groups).orderBy(*rows.descending).rowsBetween(*upto)
    filled = rows.frame.withColumn(before, F.last(value, ignorenulls=True).over(rows.window().rowsBetween(*upto)))
    filled = filled.withColumn(after, F.last(value, ignorenulls=True).over(back))
    if not rows.chunked:
        return filled
    known = F.when(F.col(value).isNotNull(), F.col(POSITION))
    ends = rows.frame.groupBy(*rows.groups).agg(F.max_by(F.col(value), known).alias("_last"), F.min_by(F.col(value), known).alias("_first"))
    later = Window.partitionBy(*rows.keys).orderBy(F.desc(CHUNK)).rowsBetween(Window.unboundedPreceding, -1)
    outside = ends.select(
        *rows.groups,
        F.last("_last", ignorenulls=True).over(_earlier_chunks(rows)).alias("_before"),
        F.last("_first", ignorenulls=True).over(later).alias("_after"),
    )
    return (
        attach(filled, outside, rows.groups, null_safe=True)
        .withColumns({before: F.coalesce(before, "_before"), after: F.coalesce(after, "_after")})
        .drop("_before", "_after", CHUNK, POSITION)
    )
