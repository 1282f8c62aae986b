"""Column selection, names, labels by position, and filters that need more than one row."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .ordered import in_order, number_rows
from .sizing import ROWS_PER_TASK, attach, settle_counted


def columns_first(df: DataFrame, *front: str) -> DataFrame:
    """Move the named columns to the front, keep the rest in order."""
    return df.select(*front, *[c for c in df.columns if c not in front])


def columns_matching(df: DataFrame, pattern: str, keep: Sequence[str] = ()) -> DataFrame:
    """``keep`` plus every column whose name matches the regular expression."""
    return df.select(*keep, *[c for c in df.columns if c not in keep and re.search(pattern, c)])


def rename_by_rules(df: DataFrame, rules: Sequence[tuple[str, str]], lower: bool = False) -> DataFrame:
    """Rewrite every column name by (pattern, replacement) rules, first match each."""

    def rewritten(name: str) -> str:
        for pattern, replacement in rules:
            name = re.sub(pattern, replacement, name, count=1)
        return name.lower() if lower else name

    return df.toDF(*[rewritten(c) for c in df.columns])


def rename_positions(df: DataFrame, names: Mapping[int, str]) -> DataFrame:
    """Rename columns by position (from 0)."""
    return df.toDF(*[names.get(i, c) for i, c in enumerate(df.columns)])


def complete_rows(df: DataFrame, *columns: str) -> DataFrame:
    """Rows without NULL in the given columns (all columns by default)."""
    return df.na.drop(subset=list(columns) or df.columns)


def relabel_by_position(df: DataFrame, column: str, labels: Sequence[str], out: str) -> DataFrame:
    """Give the k-th distinct value in sort order the k-th label.

    The distinct values are a category list; they are numbered apart from the
    rows and attached to them. More values than labels give NULL.
    """
    levels, count = settle_counted(df.select(column).filter(F.col(column).isNotNull()).distinct())
    numbered = number_rows(in_order(levels, (), (column,), sizes=(count, count)), "_level")
    names = F.array(*[F.lit(x) for x in labels])
    lookup = numbered.select(column, F.get(names, (F.col("_level") - 1).cast("int")).alias(out))
    return attach(df, lookup, [column])


def category_rank(column: Column, levels: Sequence[str]) -> Column:
    """Position (from 1) of a category in its declared order; NULL if undeclared."""
    return F.nullif(F.array_position(F.array(*[F.lit(x) for x in levels]), column), F.lit(0).cast("long"))


def add_row_number(
    df: DataFrame, order: Sequence[str], name: str = "identifier", rows_per_task: int = ROWS_PER_TASK
) -> DataFrame:
    """Dense 1..n identifier in sort order."""
    return number_rows(in_order(df, (), order, rows_per_task), name)


def label_blocks(
    df: DataFrame,
    order: Sequence[str],
    labels: Sequence[str],
    block_rows: int,
    name: str,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Label each run of ``block_rows`` rows with the next label, starting over at the end."""
    numbered = number_rows(in_order(df, (), order, rows_per_task), "_row")
    block = F.floor((F.col("_row") - 1) / block_rows) % len(labels)
    names = F.array(*[F.lit(x) for x in labels])
    return numbered.withColumn(name, F.get(names, block.cast("int"))).drop("_row")


def latest_rows(df: DataFrame, day: str) -> DataFrame:
    """Every row of the latest day, ties included."""
    return df.filter(F.col(day) == df.agg(F.max(day)).scalar())


def latest_rows_per_group(df: DataFrame, groups: Sequence[str], day: str) -> DataFrame:
    """Per group every row of its latest day, ties included.

    The latest days are aggregated first (combined before the shuffle), so a
    group that holds most of the rows is never gathered in one place.
    """
    newest = df.groupBy(*groups).agg(F.max(day).alias("_newest"))
    return attach(df, newest, groups, "inner", null_safe=True).filter(F.col(day) == F.col("_newest")).drop("_newest")


def first_row(df: DataFrame, *order: Column) -> DataFrame:
    """The first row in sort order."""
    return df.orderBy(*order).limit(1)


def drop_rows_by_index(df: DataFrame, order: Sequence[str], indexes: Sequence[int] | DataFrame, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Drop the rows with these numbers (from 1) in sort order; numbers that no row has are passed over.

    ``order`` should end with a key. ``indexes`` is a list, or a frame whose first column holds the numbers.
    """
    numbered = number_rows(in_order(df, (), order, rows_per_task), "_index")
    if isinstance(indexes, DataFrame):
        wanted = indexes.select(F.col(indexes.columns[0]).cast("long").alias("_index")).distinct().withColumn("_gone", F.lit(True))
        return attach(numbered, wanted, ["_index"]).filter(F.col("_gone").isNull()).select(*df.columns)
    return numbered.filter(~F.col("_index").isin([int(n) for n in indexes])).select(*df.columns)
