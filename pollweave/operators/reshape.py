"""Long and wide forms, appending rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import quoted


def to_long(
    df: DataFrame, ids: Sequence[str], values: Sequence[str] | None = None, name: str = "variable", value: str = "value"
) -> DataFrame:
    """One row per id and measure column."""
    measures = list(values) if values is not None else [c for c in df.columns if c not in ids]
    return df.unpivot([quoted(c) for c in ids], [quoted(c) for c in measures], name, value)


def to_wide(df: DataFrame, ids: Sequence[str], name: str, levels: Sequence[str], value: Column) -> DataFrame:
    """One column per level; ``value`` is the aggregate that fills the cells.

    The levels are given, so no extra pass looks them up.
    """
    return df.groupBy(*ids).pivot(name, list(levels)).agg(value)


def flip(df: DataFrame, header: str, levels: Sequence[str], name: str = "variable") -> DataFrame:
    """Transpose a table: the values of ``header`` become columns, the columns become rows."""
    long = to_long(df, [header], name=name, value="_value")
    return to_wide(long, [name], header, levels, F.first("_value", ignorenulls=True))


def append_rows(*frames: DataFrame, fill_missing: bool = False) -> DataFrame:
    """Append by column name; ``fill_missing`` fills absent columns with NULL."""
    result = frames[0]
    for other in frames[1:]:
        result = result.unionByName(other, allowMissingColumns=fill_missing)
    return result


def append_rows_by_position(*frames: DataFrame) -> DataFrame:
    result = frames[0]
    for other in frames[1:]:
        result = result.union(other)
    return result


def add_residual(
    df: DataFrame, ids: Sequence[str], category: str, value: str, label: str = "Other", whole: float = 100.0
) -> DataFrame:
    """Add the category that fills each group up to ``whole`` where it is absent or NULL."""
    rest = (
        df.groupBy(*ids)
        .agg(
            F.sum(value).alias("_sum"),
            F.count(F.when((F.col(category) == label) & F.col(value).isNotNull(), 1)).alias("_given"),
        )
        .filter(F.col("_given") == 0)
        .select(
            *ids,
            F.lit(label).alias(category),
            (whole - F.coalesce(F.col("_sum"), F.lit(0.0))).alias(value),
        )
    )
    kept = df.filter((F.col(category) != label) | F.col(value).isNotNull())
    return kept.select(*ids, category, value).unionByName(rest)
