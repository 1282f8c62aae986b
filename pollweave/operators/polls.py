"""Poll series: trailing windows, the latest poll of each source, interpolation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import half_width, round_to, safe_ratio, standard_error
from .ordered import in_order, trailing
from .sizing import BROADCAST_ROWS, ROWS_PER_TASK, group_sizes, settle, settle_counted

# Sums that are taken apart and put together again (running totals of changes)
# are kept as decimals: double rounding would build up along the series.
EXACT = "decimal(30,12)"


def with_errors(
    polls: DataFrame, share: str = "anteil", size: str = "befragte", digits: int | None = None, ties: str = "up"
) -> DataFrame:
    """Add standard error ``se``, half-width ``delta`` and the interval bounds of every poll.

    ``digits`` rounds all but ``se``, with ties away from zero or to the even digit.
    """
    p, n = F.col(share), F.col(size)
    width = half_width(p, n)
    columns = {"se": standard_error(p, n), "delta": width, "ci_lower": p - width, "ci_higher": p + width}
    if digits is not None:
        columns = {k: v if k == "se" else round_to(v, digits, ties) for k, v in columns.items()}
    return polls.withColumns(columns)


def rolling_mean(
    polls: DataFrame,
    value: str = "anteil",
    series: str = "partei",
    order: Sequence[str] = ("datum", "befragte", "anteil"),
    width: int = 10,
    name: str = "rolling_average",
    rows_per_task: int = ROWS_PER_TASK,
    sizes: tuple[int, int] | None = None,
) -> DataFrame:
    """Mean of the last ``width`` distinct polls of a series; NULL until there are that many, or while one of them has no value.

    ``order`` starts with the day and must go on with tie-breaks. ``sizes`` are
    the known row counts (all polls, longest series), else they are counted.
    """
    average = lambda w: F.avg(value).over(w)
    return _rolling(polls, value, series, order, width, name, rows_per_task, sizes, average)


def rolling_error(
    polls: DataFrame,
    value: str = "delta",
    series: str = "partei",
    order: Sequence[str] = ("datum", "delta"),
    width: int = 10,
    name: str = "rolling_error",
    rows_per_task: int = ROWS_PER_TASK,
    sizes: tuple[int, int] | None = None,
) -> DataFrame:
    """Error of a mean of independent polls: sqrt(sum of squares)/count over the last ``width``."""
    squares = F.col(value) * F.col(value)
    spread = lambda w: F.sqrt(F.sum(squares).over(w)) / width
    return _rolling(polls, value, series, order, width, name, rows_per_task, sizes, spread)


def _rolling(polls, value, series, order, width, name, rows_per_task, sizes, make) -> DataFrame:
    columns = list(dict.fromkeys([series, *order, value]))
    # Counted before distinct rows are taken: an upper bound from one cheap pass.
    sizes = sizes or group_sizes(polls, [series])
    rows = in_order(polls.select(*columns).distinct(), (series,), order, rows_per_task, sizes)
    return trailing(
        rows,
        width - 1,
        {name: lambda w: F.when(F.count(value).over(w) == width, make(w))},
    )


def latest_per_source(
    polls: DataFrame,
    measures: Mapping[str, tuple[str, str]],
    source: str = "institut",
    series: str = "partei",
    day: str = "datum",
    size: str = "befragte",
    distinct_on: Sequence[str] | None = None,
) -> DataFrame:
    """As of each day: size-weighted mean over the latest poll(s) of every source.

    ``measures`` maps an output name to (column, method): ``"linear"`` gives
    sum(n*x)/sum(n), ``"gauss"`` gives sqrt(sum(n^2 x^2))/sum(n). All polls of a
    source on its latest day count, and a source's last poll counts for ever.
    A poll without a size, or without a value of a measure, is no poll: the one before it stays the latest.

    Looking back from every day over all earlier polls would compare each row
    with every other. Instead each poll day is reduced to one row per source,
    the change against the source's previous poll day is taken, and the changes
    are added up along the days. The windows run over poll days, not over polls.
    """
    known = polls.na.drop(subset=[size, *[column for column, _ in measures.values()]])
    base = known.select(*(distinct_on or polls.columns)).distinct()
    n = F.col(size).cast("double")
    numerators = {
        name: (n * F.col(column)) if method == "linear" else (n * F.col(column)) ** 2
        for name, (column, method) in measures.items()
    }
    parts = ["_n", *[f"_{name}" for name in measures]]
    daily = base.groupBy(series, source, day).agg(
        F.sum(n).cast(EXACT).alias("_n"),
        *[F.sum(x).cast(EXACT).alias(f"_{name}") for name, x in numerators.items()],
    )
    of_source = Window.partitionBy(series, source).orderBy(day)
    changes = daily.select(
        series,
        day,
        *[
            (F.coalesce(F.col(p), F.lit(0)) - F.coalesce(F.lag(p).over(of_source), F.lit(0))).alias(p)
            for p in parts
        ],
    )
    per_day = changes.groupBy(series, day).agg(*[F.sum(p).alias(p) for p in parts])
    so_far = Window.partitionBy(series).orderBy(day)
    running = per_day.select(
        series, day, *[F.sum(p).over(so_far).cast("double").alias(p) for p in parts]
    )
    results = []
    for name, (_, method) in measures.items():
        numerator = F.col(f"_{name}") if method == "linear" else F.sqrt(f"_{name}")
        results.append(safe_ratio(numerator, F.col("_n")).alias(name))
    return running.select(series, day, *results)


def error_band(df: DataFrame, centre: str = "rolling_average", error: str = "poll_err") -> DataFrame:
    """Add ``ci_lower`` and ``ci_higher`` around a series."""
    return df.withColumns(
        {"ci_higher": F.col(centre) + F.col(error), "ci_lower": F.col(centre) - F.col(error)}
    )


def spine_with_neighbours(
    polls: DataFrame,
    value: str | Sequence[str],
    keys: Sequence[str],
    day: str = "datum",
    days: DataFrame | None = None,
    struct: str | None = None,
) -> DataFrame:
    """For every series and every poll day of any series: the observation at or before it and the next after it.

    Columns: keys, day, prev_day, prev_value, next_day, next_value. Several
    observations of one series on one day are averaged. With ``struct`` the values are several: the fields of
    that column, averaged each for itself and carried together. Each observation covers
    the days up to the next one, so the days come from ``sequence`` and are
    matched to the list of poll days; no series is joined to itself.
    """
    if days is None:
        days = polls.select(day).distinct()
    days, day_count = settle_counted(days.filter(F.col(day).isNotNull()))
    if struct is None:
        observed = polls.filter(F.col(value).isNotNull()).groupBy(*keys, day).agg(F.avg(value).alias("_value"))
    else:
        means = [F.avg(f"{struct}.{field}").alias(field) for field in value]
        observed = polls.groupBy(*keys, day).agg(F.struct(*means).alias("_value"))
    along = Window.partitionBy(*keys).orderBy(day)
    neighbours = observed.select(
        *keys,
        F.col(day).alias("_at"),
        F.col("_value"),
        F.lag(day).over(along).alias("_before"),
        F.lead(day).over(along).alias("_after"),
        F.lead("_value").over(along).alias("_after_value"),
    )
    start = days.agg(F.min(day)).scalar()
    end = days.agg(F.max(day)).scalar()
    from_here = F.sequence(
        F.col("_at"), F.when(F.col("_after").isNull(), F.greatest(end, F.col("_at"))).otherwise(F.date_sub("_after", 1))
    )
    # Days before the first observation belong to it too, without a predecessor.
    before_first = F.when(
        F.col("_before").isNull() & (start < F.col("_at")), F.sequence(start, F.date_sub("_at", 1))
    ).otherwise(F.array().cast("array<date>"))
    covered = neighbours.withColumn(day, F.explode(F.concat(before_first, from_here)))
    # One row per calendar day, counted above.
    if day_count <= BROADCAST_ROWS:
        days = F.broadcast(days)
    early = F.col(day) < F.col("_at")
    return covered.join(days, [day], "left_semi").select(
        *keys,
        day,
        F.when(~early, F.col("_at")).alias("prev_day"),
        F.when(~early, F.col("_value")).alias("prev_value"),
        F.when(early, F.col("_at")).otherwise(F.col("_after")).alias("next_day"),
        F.when(early, F.col("_value")).otherwise(F.col("_after_value")).alias("next_value"),
    )


def interpolate(
    polls: DataFrame,
    value: str,
    keys: Sequence[str] = ("institut", "partei"),
    day: str = "datum",
    days: DataFrame | None = None,
) -> DataFrame:
    """Linear interpolation by days between observations; NULL outside the observed range."""
    spine = spine_with_neighbours(polls, value, keys, day, days)
    return spine.select(*keys, day, interpolated(day).alias(value))


def interpolated(day: str, field: str | None = None) -> Column:
    """Value at ``day`` on the line between the previous and the next observation; ``field`` of it, if it is a struct."""
    before, after = (F.col(name) if field is None else F.col(name)[field] for name in ("prev_value", "next_value"))
    rise = safe_ratio(after - before, F.datediff("next_day", "prev_day").cast("double"))
    return F.when(F.col("prev_day") == F.col(day), before).otherwise(before + rise * F.datediff(F.col(day), F.col("prev_day")))


def envelope(
    polls: DataFrame,
    low: str = "ci_lower",
    high: str = "ci_higher",
    source: str = "institut",
    series: str = "partei",
    day: str = "datum",
) -> DataFrame:
    """Smallest lower and largest upper bound over all sources, interpolated to every poll day.

    The bounds of a poll stay in one row: they have the same neighbours, so a struct of
    both is carried along the days.
    """
    days = polls.select(day).distinct()
    both = polls.withColumn("_x", F.struct(F.col(low).cast("double").alias("low"), F.col(high).cast("double").alias("high")))
    spine = spine_with_neighbours(both.filter(f"{low} IS NOT NULL AND {high} IS NOT NULL"), ("low", "high"), (series, source), day, days, "_x")
    return spine.groupBy(day, series).agg(
        F.min(interpolated(day, "low")).alias(low),
        F.max(interpolated(day, "high")).alias(high),
    )


def ranked_snapshot(
    series_table: DataFrame, value: str = "rolling_average", day: str = "datum", series: str = "partei"
) -> DataFrame:
    """Latest day of a series table with the rank of each series, largest first.

    The table has one row per series and day, so one day is as small as the
    number of series.
    """
    series_table = settle(series_table)
    latest = series_table.filter(F.col(day) == series_table.agg(F.max(day)).scalar()).distinct()
    place = F.row_number().over(Window.partitionBy(day).orderBy(F.col(value).desc_nulls_last(), series))
    return latest.withColumn("y", place.cast("long"))


def rolling_benchmark(
    polls: DataFrame, width: int = 10, digits: int = 5, rows_per_task: int = ROWS_PER_TASK
) -> DataFrame:
    """Rolling mean with a band from the rolling error of independent polls, one row per (day, party).

    Both windows run over their own distinct rows and give one value per poll.
    They are averaged per day before they are joined: pairing the polls of a day
    with each other and averaging afterwards gives the same numbers.
    """
    errors = with_errors(polls, digits=digits)
    sizes = group_sizes(polls, ["partei"])
    means = rolling_mean(errors, width=width, rows_per_task=rows_per_task, sizes=sizes)
    spreads = rolling_error(errors, width=width, rows_per_task=rows_per_task, sizes=sizes)
    daily = means.groupBy("datum", "partei").agg(F.avg("rolling_average").alias("rolling_average"))
    daily_error = spreads.groupBy("datum", "partei").agg(F.avg("rolling_error").alias("rolling_error"))
    return error_band(daily.join(daily_error, ["datum", "partei"], "left"), error="rolling_error")


def latest_benchmark(polls: DataFrame, digits: int = 5) -> DataFrame:
    """Benchmark series from the latest poll of each source, with its linear error band."""
    base = with_errors(polls, digits=digits)
    series = latest_per_source(
        base,
        {"rolling_average": ("anteil", "linear"), "poll_err": ("delta", "linear")},
        distinct_on=("institut", "datum", "partei", "anteil", "befragte", "delta"),
    )
    return error_band(series)
