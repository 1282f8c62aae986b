"""Voter transitions between two answers of the same person."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions import nth_choice, safe_ratio
from .sizing import settle
from .strata import share_of_total, strata_counts


def first_and_last(df: DataFrame, person: str, answer: str, order: Sequence[str]) -> DataFrame:
    """First and last answer of every person.

    ``min_by``/``max_by`` combine before the shuffle, so a person with very many
    rows costs one row per input partition.
    """
    position = F.struct(*order)
    return df.groupBy(person).agg(
        F.min_by(answer, position).alias("from"), F.max_by(answer, position).alias("to")
    )


def ranking_columns(df: DataFrame, ranking: str, places: int, prefix: str = "ranking") -> DataFrame:
    """Split a delimited ranking into one column per place."""
    return df.withColumns({f"{prefix}{k}": nth_choice(F.col(ranking), k) for k in range(1, places + 1)})


def flows(df: DataFrame, source: str = "from", target: str = "to") -> DataFrame:
    """Long transition table: (from, to, n)."""
    known = df.filter(F.col(source).isNotNull() & F.col(target).isNotNull())
    return strata_counts(known, [source, target])


def loyalty(table: DataFrame, source: str = "from", target: str = "to") -> DataFrame:
    """Share of each origin that stays, over all of its targets."""
    return (
        table.groupBy(source)
        .agg(
            F.coalesce(F.sum(F.when(F.col(source) == F.col(target), F.col("n"))), F.lit(0)).alias("stayed"),
            F.sum("n").alias("total"),
        )
        .withColumn("loyalty", safe_ratio(F.col("stayed"), F.col("total")))
    )


def without_stayers(table: DataFrame, source: str = "from", target: str = "to") -> DataFrame:
    """Flow table with the diagonal set to 0."""
    return table.withColumn("n", F.when(F.col(source) == F.col(target), F.lit(0)).otherwise(F.col("n")))


def margins(table: DataFrame, source: str = "from", target: str = "to") -> DataFrame:
    """Proportion of every box before and after, in long form (side, box, prop)."""
    table = settle(table)
    sides = []
    for side, column in (("start", source), ("end", target)):
        boxes = table.groupBy(F.col(column).alias("box")).agg(F.sum("n").alias("n"))
        sides.append(share_of_total(boxes, name="prop", scale=1.0).select(F.lit(side).alias("side"), "box", "prop"))
    return sides[0].unionByName(sides[1])


def scaled_flows(
    table: DataFrame, within_origin: bool = False, smallest: float = 0.0, largest: float = 1.0, source: str = "from"
) -> DataFrame:
    """Flow width between ``smallest`` and ``largest``, relative to the largest flow overall or of its origin."""
    table = settle(table)
    if within_origin:
        peaks = table.groupBy(source).agg(F.max("n").alias("_peak"))
        table = table.join(peaks, [source])
        peak = F.col("_peak")
    else:
        peak = table.agg(F.max("n")).scalar()
    width = F.lit(smallest) + (largest - smallest) * safe_ratio(F.col("n"), peak)
    return table.withColumn("width", width).drop("_peak")


def check_square(table: DataFrame, source: str = "from", target: str = "to") -> DataFrame:
    """Boxes that occur on one side only; empty for a square transition table."""
    starts = table.select(F.col(source).alias("box"), F.lit(1).alias("s"), F.lit(0).alias("e"))
    ends = table.select(F.col(target).alias("box"), F.lit(0).alias("s"), F.lit(1).alias("e"))
    sides = starts.unionByName(ends).groupBy("box").agg(F.max("s").alias("s"), F.max("e").alias("e"))
    return sides.filter(F.col("s") != F.col("e")).select("box")


def counts_by_variable(df: DataFrame, ids: Sequence[str], variables: Sequence[str]) -> DataFrame:
    """Counts per (variable, value) over several answer columns."""
    return strata_counts(df.unpivot(list(ids), list(variables), "variable", "value"), ["variable", "value"])
