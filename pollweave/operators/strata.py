"""Counts per stratum and the tables built from them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import safe_ratio, sum_policy
from .ordered import in_order, number_rows
from .sizing import attach, join_null_safe, settle


# Levels of a category that may travel as one array.
MOST_LEVELS = 100_000


def strata_counts(df: DataFrame, keys: Sequence[str], weight: str | None = None, name: str = "n") -> DataFrame:
    """Rows, or the sum of weights (0 when all are NULL), per stratum."""
    if weight is None:
        return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))
    return df.groupBy(*keys).agg(F.coalesce(F.sum(weight), F.lit(0.0)).alias(name))


def sum_measures(
    df: DataFrame, keys: Sequence[str], measures: Sequence[str], na_policy: str | Mapping[str, str] = "skip"
) -> DataFrame:
    """Sum every measure per group; the policy on NULL is one for all, or one by measure."""
    policies = dict.fromkeys(measures, na_policy) if isinstance(na_policy, str) else na_policy
    return df.groupBy(*keys).agg(*[sum_policy(F.col(m), policies[m]).alias(m) for m in measures])


def share_of_total(
    df: DataFrame,
    value: str = "n",
    name: str = "share",
    within: Sequence[str] = (),
    scale: float = 100.0,
    na_policy: str = "skip",
) -> DataFrame:
    """``value`` as a share of its total, over the table or within groups.

    The total is an aggregate of its own (a scalar subquery or a join), because
    a window over the whole table would gather it in one task.
    """
    total = sum_policy(F.col(value), na_policy)
    if not within:
        whole = df.agg(total.alias("_total")).scalar()
        return df.withColumn(name, scale * safe_ratio(F.col(value), whole))
    totals = df.groupBy(*within).agg(total.alias("_total"))
    return (
        join_null_safe(df, totals, within)
        .withColumn(name, scale * safe_ratio(F.col(value), F.col("_total")))
        .drop("_total")
    )


def complete_strata(
    counts: DataFrame, dims: Sequence[str], value: str = "n", fill: float = 0
) -> DataFrame:
    """Add the combinations of observed levels that have no row, filled with ``fill``.

    NULL is a level like any other. The counts are computed once. The levels of the first dimension stay
    distributed; the other level lists are categories, at most ``MOST_LEVELS`` each (checked), and travel as arrays.
    """
    counts = settle(counts)
    grid = counts.select(dims[0]).distinct()
    for dim in dims[1:]:
        distinct = settle(counts.select(dim).distinct())
        if (n := distinct.count()) > MOST_LEVELS:
            raise ValueError(f"{dim} has {n} levels: put the dimension with most levels first")
        levels = distinct.agg(F.sort_array(F.collect_list(F.struct(dim)))).scalar()
        grid = grid.withColumn("_level", F.explode(levels)).withColumn(dim, F.col(f"_level.{dim}")).drop("_level")
    return join_null_safe(grid, counts, dims).withColumn(value, F.coalesce(F.col(value), F.lit(fill)))


def collapse_strata(
    counts: DataFrame, column: str, mapping: Mapping[str, str], measures: Sequence[str] = ("n",)
) -> DataFrame:
    """Merge levels of one dimension and sum the measures again."""
    merged = counts.replace(dict(mapping), subset=[column])
    return sum_measures(merged, [c for c in counts.columns if c not in measures], measures)


def expand_strata(df: DataFrame, column: str, merged: str, labels: Sequence[str]) -> DataFrame:
    """Copy the rows of a merged level once for each level it stands for."""
    target = F.when(F.col(column) == merged, F.array(*[F.lit(x) for x in labels])).otherwise(
        F.array(F.col(column))
    )
    return df.withColumn(column, F.explode(target))


def split_category(
    df: DataFrame, column: str, source: str, part: str, ratio: Column, measures: Sequence[str]
) -> DataFrame:
    """Give ``ratio`` of every measure of ``source`` to the new category ``part``."""
    pieces = F.when(
        F.col(column) == source,
        F.array(
            F.struct(F.lit(part).alias("label"), ratio.cast("double").alias("factor")),
            F.struct(F.lit(source).alias("label"), (1 - ratio).cast("double").alias("factor")),
        ),
    ).otherwise(F.array(F.struct(F.col(column).alias("label"), F.lit(1.0).alias("factor"))))
    return (
        df.withColumn("_piece", F.explode(pieces))
        .withColumns({m: F.col(m) * F.col("_piece.factor") for m in measures})
        .withColumn(column, F.col("_piece.label"))
        .drop("_piece")
    )


def crosstab(
    df: DataFrame,
    rows: str,
    columns: str,
    levels: Sequence[str],
    weight: str | None = None,
    keep_null: bool = False,
) -> DataFrame:
    """Contingency table with zero cells, one column per level."""
    kept = df if keep_null else df.filter(F.col(rows).isNotNull() & F.col(columns).isNotNull())
    measure = F.count(F.lit(1)) if weight is None else F.sum(weight)
    table = kept.groupBy(rows).pivot(columns, list(levels)).agg(measure)
    return table.na.fill(0, subset=list(levels))


# Columns that a table may have before it stays in long form.
MOST_COLUMNS = 500


@dataclass(frozen=True)
class Crosstab:
    """A contingency table and its levels: (level, ordinal, n), numbered from 1 in sort order.

    A ``wide`` table has one column per level, zero cells included. The other form holds (rows, ordinal, n) for the cells that occur.
    """

    table: DataFrame
    dictionary: DataFrame
    wide: bool


def crosstab_found(
    df: DataFrame, rows: str, columns: str, weight: str | None = None, keep_null: bool = False, most: int = MOST_COLUMNS
) -> Crosstab:
    """``crosstab`` with the levels found in the data, which is read once: the levels are those of its stored cells.

    With ``keep_null`` a NULL row label is kept; a NULL column label is never a level. Beyond ``most`` levels the table stays in long form.
    """
    kept = df.filter(F.col(columns).isNotNull()) if keep_null else df.filter(F.col(rows).isNotNull() & F.col(columns).isNotNull())
    measure = F.count(F.lit(1)) if weight is None else F.sum(weight)
    cells = settle(kept.groupBy(rows, columns).agg(measure.alias("n")))
    counted = cells.groupBy(F.col(columns).alias("level")).agg(F.sum("n").alias("n"))
    dictionary = settle(number_rows(in_order(counted, (), ("level",)), "ordinal").select("level", "ordinal", "n"))
    levels = [row.level for row in dictionary.limit(most + 1).collect()]
    if len(levels) > most:
        table = attach(cells.withColumnRenamed(columns, "level"), dictionary.select("level", "ordinal"), ["level"])
        return Crosstab(table.select(rows, "ordinal", "n"), dictionary, False)
    wide = cells.groupBy(rows).pivot(columns, sorted(levels)).agg(F.sum("n")) if levels else cells.select(rows).distinct()
    return Crosstab(wide.na.fill(0, subset=wide.columns[1:]), dictionary, True)


def proportions(df: DataFrame, column: str, keep_null: bool = False) -> DataFrame:
    """One-way table with counts and proportions; NULL is dropped unless kept."""
    kept = df if keep_null else df.filter(F.col(column).isNotNull())
    return share_of_total(strata_counts(kept, [column]), scale=1.0, name="prop")


def cross_shares(
    df: DataFrame, rows: str, columns: str, margin: str = "cell", weight: str | None = None
) -> DataFrame:
    """Cross table in long form with percentages of the cell, row or column total."""
    within = {"cell": [], "row": [rows], "column": [columns]}[margin]
    return share_of_total(strata_counts(df, [rows, columns], weight), within=within)


def joint_share(
    conditional: DataFrame, margin: DataFrame, on: Sequence[str], share: str, margin_share: str, name: str
) -> DataFrame:
    """Share within a group (percent) times the share of the group."""
    return conditional.join(margin, list(on), "left").withColumn(
        name, F.col(share) / 100 * F.col(margin_share)
    )


def ratio_to_row(df: DataFrame, value: str, of: str, where: Column, name: str) -> DataFrame:
    """``value`` divided by the ``of`` of the one row (for example "Total") that ``where`` selects.

    ``df`` is a summary table that is already computed or cheap to read twice.
    """
    reference = df.filter(where).agg(F.max(of)).scalar()
    return df.withColumn(name, safe_ratio(F.col(value), reference))
