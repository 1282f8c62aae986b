"""Scoring estimates against a benchmark."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DateType

from ..functions import mean_date
from .sizing import settle


def mean_measures(df: DataFrame, keys: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """Mean of every measure per group; the mean of dates is a date."""
    types = {f.name: f.dataType for f in df.schema.fields}
    return df.groupBy(*keys).agg(
        *[
            (mean_date(F.col(m)) if isinstance(types[m], DateType) else F.avg(m)).alias(m)
            for m in measures
        ]
    )


def rmse_against(
    estimates: DataFrame,
    reference_method: str,
    method: str = "method",
    day: str = "date",
    party: str = "party",
    value: str = "pct",
) -> DataFrame:
    """Root mean squared error of each (method, day) over the parties of the reference.

    Only parties that both have count; their number is reported. The estimates
    are a small table and are computed once for both sides of the join.
    """
    estimates = settle(estimates)
    truth = estimates.filter(F.col(method) == reference_method).select(day, party, F.col(value).alias("_truth"))
    gap = F.col(value) - F.col("_truth")
    return (
        estimates.join(truth, [day, party])
        .groupBy(method, day)
        .agg(F.sqrt(F.avg(gap * gap)).alias("rmse"), F.count(gap).alias("parties"))
    )


def result_table(
    estimates: DataFrame,
    scores: DataFrame,
    parties: Sequence[str],
    labels: Mapping[str, str],
    method: str = "method",
    day: str = "date",
    party: str = "party",
    value: str = "pct",
    digits: int = 1,
) -> DataFrame:
    """Wide table for reading: method label, day, one column per party, RMSE."""
    wide = (
        estimates.groupBy(method, day)
        .pivot(party, list(parties))
        .agg(F.round(F.first(value, ignorenulls=True), digits))
    )
    label = F.col(method)
    for pattern, text in reversed(labels.items()):
        label = F.when(F.col(method).rlike(pattern), text).otherwise(label)
    return (
        wide.join(scores.select(method, day, "rmse"), [method, day], "left")
        .select(label.alias("Method"), F.col(day).alias("Date"), *parties, F.col("rmse").alias("RMSE"))
        .orderBy(F.col("Date").desc(), F.col("Method").desc())
    )
