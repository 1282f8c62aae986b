"""From stored poll pages to the benchmark series, and from there to scores."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions import recode
from ..operators.evaluate import mean_measures, result_table, rmse_against
from ..operators.polls import latest_benchmark, rolling_benchmark
from ..operators.reshape import add_residual
from ..operators.sizing import settle
from ..sources import clean_poll_rows, table_rows
from ..sources.pages import POLL_HEADERS, SHIFTED_CELLS, main_parties
from . import fixed_values as fixed

# Parties of the benchmark as the poll pages write them, and their labels in results.
BENCHMARK_PARTIES = ("CDU/CSU", "SPD", "Grüne", "Linke", "AfD", "FDP")
RESULT_LABELS = {"CDU/CSU": "Union", "Grüne": "Gruene"}


def polls_from_pages(pages: DataFrame) -> DataFrame:
    """Long poll table from pages (institut, html)."""
    return clean_poll_rows(table_rows(pages, "institut", POLL_HEADERS, shifted=SHIFTED_CELLS))


def benchmark(polls: DataFrame, variant: str = "latest") -> DataFrame:
    """Benchmark series: latest poll of each source, or the rolling mean of ten polls."""
    kept = main_parties(polls, BENCHMARK_PARTIES)
    if variant == "latest":
        return latest_benchmark(kept)
    if variant == "rolling":
        return rolling_benchmark(kept)
    raise ValueError(f"unknown variant {variant!r}")


def benchmark_estimates(series: DataFrame, days: Sequence[str], method: str = "rolling average") -> DataFrame:
    """Benchmark values on the given days as estimates; days of one year are averaged, dates included."""
    wanted = series.filter(F.col("datum").isin(*[F.lit(d).cast("date") for d in days]))
    yearly = mean_measures(
        wanted.select(
            F.year("datum").alias("year"),
            recode(F.col("partei"), RESULT_LABELS).alias("party"),
            F.col("datum").alias("date"),
            (100 * F.col("rolling_average")).alias("pct"),
        ),
        ["year", "party"],
        ["date", "pct"],
    )
    return yearly.select(F.lit(method).alias("method"), "date", "party", "pct")


def scored_table(
    estimates: DataFrame, reference: DataFrame, labels: Mapping[str, str], reference_method: str = "rolling average"
) -> DataFrame:
    """Wide result table with the RMSE of every method against the reference.

    Estimates and reference are matched by year, because the reference is an
    average over days near the wave. Shares are rounded to one decimal first, as
    published, and the reference is filled up to 100 with Other.
    """
    full = add_residual(reference, ["method", "date"], "party", "pct")
    both = settle(
        estimates.select("method", "date", "party", "pct")
        .unionByName(full.select("method", "date", "party", "pct"))
        .withColumns({"pct": F.round("pct", 1), "year": F.year("date")})
    )
    scores = rmse_against(both, reference_method, day="year")
    return result_table(both, scores, fixed.PARTIES, labels, day="year").withColumnRenamed("Date", "Year")
