"""Estimates with their errors."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import nonresponse_range, safe_ratio
from .margins import MOST_LEVELS, index_levels, level_system, solve_levels
from .sizing import CELLS_PER_TASK, ROWS_PER_TASK, attach, chunks_for, join_null_safe, settle, settle_counted, store
from .strata import share_of_total, strata_counts


def outcome_shares(
    df: DataFrame, outcome: str, weight: str | None = None, where: Column | None = None
) -> DataFrame:
    """Counts and percentages per outcome; weighted when a weight column is named."""
    kept = df if where is None else df.filter(where)
    return share_of_total(strata_counts(kept, [outcome], weight))


def weighted_mean(value: Column, weight: Column) -> Column:
    """Weighted mean over rows where both are known (aggregate)."""
    known = value.isNotNull() & weight.isNotNull()
    return safe_ratio(F.sum(F.when(known, value * weight)), F.sum(F.when(known, weight)))


def turnout_rate(
    df: DataFrame, vote: str, in_scope: Column, no_vote: str, not_able: str, unknown_counts: bool = False
) -> DataFrame:
    """1 - non-voters / those able to vote, from a past-vote column (one row).

    With ``unknown_counts`` a row whose vote is unknown enters both counts, as
    element counting on an unknown condition does.
    """
    return turnout_rates(df, vote, in_scope, no_vote, not_able).filter(
        F.col("mode") == ("unknown_counts" if unknown_counts else "known")
    ).drop("mode")


def turnout_rates(df: DataFrame, vote: str, in_scope: Column, no_vote: str, not_able: str) -> DataFrame:
    """``turnout_rate`` both ways from one pass: (mode, no_vote, able, turnout), mode known or unknown_counts."""
    stayed_home = in_scope & (F.col(vote) == no_vote)
    able = in_scope & (F.col(vote) != not_able)
    counts = df.agg(
        *[F.count_if(test).alias(name) for name, test in (("a", stayed_home), ("b", able))],
        *[F.count_if(F.coalesce(test, F.lit(True))).alias(name) for name, test in (("c", stayed_home), ("d", able))],
    )
    rows = counts.selectExpr("stack(2, 'known', a, b, 'unknown_counts', c, d) AS (mode, no_vote, able)")
    return rows.withColumn("turnout", 1 - safe_ratio(F.col("no_vote"), F.col("able")))


def nonresponse_bounds(df: DataFrame, groups: Sequence[str], answer: str) -> DataFrame:
    """Bounds of a 0/1 share per group when ``answer`` is NULL for non-respondents."""
    base = df.groupBy(*groups).agg(
        (F.count(answer) / F.count(F.lit(1))).alias("response_rate"), F.avg(answer).alias("p_obs")
    )
    low, high = nonresponse_range(F.col("response_rate"), F.col("p_obs"))
    return base.withColumns({"p_min": low, "p_max": high})


@dataclass(frozen=True)
class Design:
    """Which columns describe the sample.

    ``clusters`` holds no, one or two stages of cluster ids. ``populations`` holds,
    per stage, the column with the number of units in the population at that
    stage (finite population correction). Without ``weight`` it is derived from
    the populations where they are given, else it is 1.
    """

    clusters: tuple[str, ...] = ()
    populations: tuple[str, ...] = ()
    weight: str | None = None


def with_design_weight(df: DataFrame, design: Design, name: str = "design_weight") -> DataFrame:
    """Add the sampling weight: the given one, or population over sampled units, multiplied over the stages."""
    if design.weight is not None:
        return df.withColumn(name, F.col(design.weight).cast("double"))
    factor = F.lit(1.0)
    for depth, population in enumerate(design.populations):
        units = design.clusters[: depth + 1]
        if not units:
            sampled = df.agg(F.count(F.lit(1)).alias("_n")).scalar()
        elif depth == 0:
            sampled = df.agg(F.count_distinct(units[0]).alias("_n")).scalar()
        else:
            parent = units[:depth]
            per_parent = df.groupBy(*parent).agg(F.count_distinct(units[depth]).alias("_sampled"))
            df = attach(df, per_parent, parent, null_safe=True)
            sampled = F.col("_sampled")
        factor = safe_ratio(factor * F.col(population).cast("double"), sampled)
    return df.withColumn(name, factor).drop("_sampled")


# Where residuals are swept over margins of very many levels: until nothing moves by more than this share, at most so often.
STILL, MOST_SWEEPS, SWEEPS_PER_CHECKPOINT = 1e-12, 500, 5
LONELY = ("fail", "certainty", "adjust")


def design_mean(
    df: DataFrame,
    value: str,
    design: Design,
    poststrata: Sequence[str] = (),
    keep_unobserved: bool = False,
    margins: Sequence[str] = (),
    lonely: str = "fail",
) -> DataFrame:
    """Design-based mean and standard error (one row).

    Rows with a NULL value are removed; with ``keep_unobserved`` their units still
    belong to the sample, so they count in its size and contribute nothing. The
    linearised residual of a unit is w(y - centre)/sum(w): its sum over a cluster
    needs only sum(w*y) and sum(w) of the cluster, so the variance is computed on the cluster table. With ``poststrata``
    the centre is the stratum mean; with ``margins``, after raking to these columns, it is the additive least-squares
    fit of the margins' levels. Values are taken as differences from their plain
    mean, which is read first, so that sums of squares do not cancel.

    ``lonely`` says what a first-stage unit with a single sampled unit, of more in the population, adds to the second
    stage: ``"fail"`` raises, ``"certainty"`` adds nothing, ``"adjust"`` takes its deviation from the mean of all units.
    ``lonely_clusters`` counts them.
    """
    if lonely not in LONELY:
        raise ValueError(f"lonely is one of {', '.join(LONELY)}")
    if poststrata and margins:
        raise ValueError("give post-strata or raked margins")
    if not keep_unobserved:
        df = df.filter(F.col(value).isNotNull())
    shift = df.agg(F.avg(value).cast("double")).scalar()
    df = df.withColumn("_shift", shift).withColumn("_y", F.col(value).cast("double") - F.col("_shift"))
    result = _mean_of_clusters(df, design, poststrata, margins, lonely) if design.clusters or margins else _mean_of_units(df, design, poststrata)
    return result.withColumn("_shift", shift).selectExpr("mean + coalesce(_shift, 0.0D) AS mean", "se")


def _mean_of_clusters(df: DataFrame, design: Design, poststrata: Sequence[str], margins: Sequence[str], lonely: str) -> DataFrame:
    if not design.clusters:
        df = df.withColumn("_unit", F.monotonically_increasing_id())
        design = Design(("_unit",), design.populations, design.weight)
    sizes = [f"_size{i}" for i in range(len(design.populations))]
    groups = [*poststrata, *margins]
    cells = store(_cluster_cells(df, design, groups, sizes))
    if design.weight is None:
        cells = _weighted_by_fractions(cells, design, sizes)
    totals = cells.agg(F.expr("struct(sum(_wy) AS wy, sum(_w) AS w)")).scalar()
    if poststrata:
        means = cells.groupBy(*poststrata).agg(F.expr("try_divide(sum(_wy), sum(_w)) AS _centre"))
        cells = attach(cells, means, poststrata, null_safe=True).withColumn("_total", totals)
    elif margins:
        cells = attach(cells, _projected(cells, margins), margins, null_safe=True).withColumn("_total", totals)
    else:
        cells = cells.withColumn("_total", totals).withColumn("_centre", F.expr("_total.wy / _total.w"))
    scores = cells.withColumn("_z", F.expr("coalesce(_wy - _centre * _w, 0.0D) / _total.w"))
    keep = [F.max(c).alias(c) for c in sizes]
    n, n1 = F.count(F.lit(1)), F.count(F.lit(1)).cast("double")
    within = F.lit(0.0)
    # One row per unit of the last stage, whatever the groups of its cells.
    scores = scores.groupBy(*design.clusters).agg(F.sum("_z").alias("_z"), *keep)
    if len(design.clusters) > 1:
        rest = 1 - n1 / F.max(sizes[1]) if len(sizes) > 1 else F.lit(1.0)
        spread = F.coalesce(safe_ratio(n, n - 1) * F.var_pop("_z") * n, F.lit(0.0))
        single = (n == 1) & (F.max(sizes[1]) > 1 if len(sizes) > 1 else F.lit(True))
        if lonely == "fail":
            spread = F.when(single, F.raise_error(F.lit("a cluster has a single sampled unit; choose what it adds by lonely=")).cast("double")).otherwise(spread)
        elif lonely == "adjust":
            scores = scores.withColumn("_mean_z", scores.agg(F.avg("_z")).scalar())
            spread = F.when(single, F.pow(F.max("_z") - F.max("_mean_z"), 2)).otherwise(spread)
        within = rest * spread
    firsts = scores.groupBy(design.clusters[0]).agg(F.sum("_z").alias("_z"), within.alias("_within"), *keep)
    # Without a first-stage population the sampling fraction is taken as 0.
    fraction = F.coalesce(n1 / F.max(sizes[0]), F.lit(0.0)) if sizes else F.lit(0.0)
    variance = (1 - fraction) * safe_ratio(n, n - 1) * F.var_pop("_z") * n + fraction * F.sum("_within")
    return (
        firsts.agg(F.sqrt(variance).alias("se"))
        .withColumn("_total", totals)
        .selectExpr("_total.wy / _total.w AS mean", "se")
    )


def lonely_clusters(df: DataFrame, design: Design) -> DataFrame:
    """How many first-stage units have a single sampled unit of the second stage (one row)."""
    first, second = design.clusters
    per_first = df.groupBy(first).agg(F.count_distinct(F.struct(second)).alias("_n"))
    return per_first.agg(F.count_if(F.col("_n") == 1).alias("lonely"), F.count(F.lit(1)).alias("clusters"))


def _projected(cells: DataFrame, margins: Sequence[str], max_levels: int = MOST_LEVELS) -> DataFrame:
    """(margins, _centre): what the margins explain of the value, additively, by weighted least squares.

    Works on the table of margin cells, which is as large as the product of the categories: the normal equations of the
    levels are summed over it and solved. Beyond ``max_levels`` levels it is swept over one margin after another until nothing moves.
    """
    table = cells.groupBy(*margins).agg(F.sum("_wy").alias("_wy"), F.sum("_w").alias("_w"))
    table, size = settle_counted(table)
    indexed = index_levels(table, margins, {m: F.col("_w") > 0 for m in margins}, {m: F.lit(0.0) for m in margins}, max_levels, size <= CELLS_PER_TASK)
    if indexed is None:
        return _swept(table, margins, size)
    matrix, sums, _ = level_system(indexed, F.col("_w"), F.coalesce(F.col("_wy"), F.lit(0.0)))
    return indexed.cells.select(*margins, indexed.along(solve_levels(matrix, sums)).alias("_centre"))


def _swept(table: DataFrame, margins: Sequence[str], size: int) -> DataFrame:
    """The same by sweeps; ends when no centre moves by more than ``STILL`` of the largest, raises after ``MOST_SWEEPS``."""
    table, small = table.withColumn("_centre", F.lit(0.0)), size <= CELLS_PER_TASK
    for _ in range(MOST_SWEEPS // SWEEPS_PER_CHECKPOINT):
        table = table.coalesce(1) if small else table
        for _ in range(SWEEPS_PER_CHECKPOINT):
            table = table.withColumn("_old", F.col("_centre"))
            for margin in margins:
                level = "coalesce(try_divide(sum(_wy - _centre * _w) {0}, sum(_w) {0}), 0.0D)"
                if small:
                    table = table.withColumn("_centre", F.expr(f"_centre + {level.format(f'OVER (PARTITION BY {margin})')}"))
                else:
                    moves = table.groupBy(margin).agg(F.expr(level.format("")).alias("_move"))
                    table = join_null_safe(table, moves, [margin]).withColumn("_centre", F.expr("_centre + coalesce(_move, 0.0D)")).drop("_move")
        table = settle(table)
        moved, largest = table.agg(F.expr("max(abs(_centre - _old))"), F.expr("max(abs(_centre))")).first()
        if not moved or moved <= STILL * largest:
            return table.select(*margins, "_centre")
    raise RuntimeError(f"the residuals still move after {MOST_SWEEPS} sweeps")


def _cluster_cells(df: DataFrame, design: Design, groups: Sequence[str], sizes: Sequence[str]) -> DataFrame:
    """sum(w*y) and sum(w) of the known values per cluster; unweighted sums when weights are derived."""
    weight = f"CAST({design.weight} AS DOUBLE)" if design.weight is not None else "1.0D"
    return df.groupBy(*dict.fromkeys([*design.clusters, *groups])).agg(
        F.expr(f"sum({weight} * _y) AS _wy"),
        F.expr(f"coalesce(sum(IF(_y IS NOT NULL, {weight}, NULL)), 0.0D) AS _w"),
        *[F.max(p).cast("double").alias(size) for p, size in zip(design.populations, sizes)],
    )


def _weighted_by_fractions(cells: DataFrame, design: Design, sizes: Sequence[str]) -> DataFrame:
    """Apply population over sampled units per stage; the first stage's sample size cancels out."""
    factor = F.lit(1.0)
    for depth, size in enumerate(sizes):
        factor = factor * F.col(size)
        if depth > 0:
            parent = design.clusters[:depth]
            sampled = (
                cells.select(*design.clusters[: depth + 1])
                .distinct()
                .groupBy(*parent)
                .agg(F.count(F.lit(1)).alias(f"_sampled{depth}"))
            )
            cells = attach(cells, sampled, parent, null_safe=True)
            factor = safe_ratio(factor, F.col(f"_sampled{depth}"))
    return cells.withColumn("_factor", factor).withColumns(
        {"_wy": F.col("_wy") * F.col("_factor"), "_w": F.col("_w") * F.col("_factor")}
    )


def _mean_of_units(df: DataFrame, design: Design, poststrata: Sequence[str]) -> DataFrame:
    """Element sampling: every unit is its own cluster, so a few moments per stratum are enough.

    A derived weight is the population over the sample size, which cancels out. The residuals w(y - centre) of a stratum add up to
    zero, so their squares are n times a variance, which Spark's moments give without cancellation.
    """
    population = design.populations[0] if design.populations else "NULL"
    weight = design.weight if design.weight is not None else "1.0D"
    units = df.selectExpr(
        *poststrata,
        "_y AS y",
        f"IF(_y IS NOT NULL, CAST({weight} AS DOUBLE), NULL) AS w",
        f"CAST({population} AS DOUBLE) AS size",
    )
    sums = units.groupBy(*poststrata).agg(
        F.expr("sum(w * y) AS wy"),
        F.expr("sum(w) AS w"),
        F.expr("var_pop(w * y) AS var_wy"),
        F.expr("covar_pop(w * y, w) AS cov"),
        F.expr("var_pop(w) AS var_w"),
        F.expr("count(w) AS known"),
        F.expr("count(*) AS n"),
        F.expr("max(size) AS size"),
    )
    squares = "known * (var_wy - 2 * try_divide(wy, w) * cov + try_divide(wy, w) * try_divide(wy, w) * var_w)"
    whole = sums.selectExpr("*", f"{squares} AS squares").agg(
        *[F.sum(x).alias(x) for x in ("wy", "w", "n", "squares")], F.max("size").alias("size")
    )
    variance = "coalesce(1 - try_divide(n, size), 1.0D) * try_divide(n, n - 1) * try_divide(squares, w * w)"
    return whole.selectExpr("try_divide(wy, w) AS mean", f"sqrt({variance}) AS se")


def summary_statistics(df: DataFrame, value: str, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Minimum, quartiles, mean, maximum and NULL count of a column (one row, exact).

    The values are reduced to (value, rows), so a value that most rows share is one row. These are
    range-partitioned and stored; the rows in front of each partition come from the partitions' totals, and the quartiles are read
    off at the values whose running count passes their place.
    """
    counts = df.groupBy(F.col(value).cast("double").alias("x")).agg(F.count(F.lit(1)).alias("n"))
    counts, distinct = settle_counted(counts)
    parts = chunks_for(distinct, rows_per_task)
    placed = store(counts.filter("x IS NOT NULL").repartitionByRange(parts, "x").withColumn("part", F.spark_partition_id()))
    before = F.sum("rows").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))  # a row per partition
    fronts = placed.groupBy("part").agg(F.sum("n").alias("rows")).withColumn("before", F.coalesce(before, F.lit(0))).drop("rows")
    upto = F.sum("n").over(Window.partitionBy("part").orderBy("x"))
    ranked = placed.join(fronts, "part").withColumn("upto", F.col("before") + upto)
    basics = counts.agg(
        F.min("x").alias("min"),
        F.expr("try_divide(sum(x * n), sum(IF(x IS NULL, 0, n))) AS mean"),
        F.max("x").alias("max"),
        F.expr("coalesce(sum(IF(x IS NULL, 0, n)), 0) AS n"),
        F.expr("coalesce(sum(IF(x IS NULL, n, 0)), 0) AS n_null"),
    )
    total = counts.filter("x IS NOT NULL").agg(F.sum("n")).scalar()
    points = {"q1": 0.25, "median": 0.5, "q3": 0.75}
    # The value at a place is the smallest whose running count reaches it.
    picks = [
        F.min(F.expr(f"IF(upto >= {step}(1 + (total - 1) * {place}D), x, NULL)")).alias(f"{name}_{step}")
        for name, place in points.items()
        for step in ("floor", "ceil")
    ]
    found = settle(ranked.withColumn("total", total).agg(*picks, F.max("total").alias("total")))
    part = "((total - 1) * {0}D - floor((total - 1) * {0}D))"
    quartiles = found.selectExpr(*[f"{q}_floor + (({q}_ceil - {q}_floor) * {part.format(p)}) AS {q}" for q, p in points.items()])
    return basics.withColumns({q: quartiles.select(q).scalar() for q in points})
