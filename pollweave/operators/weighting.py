"""Post-stratification and raking weights."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import safe_ratio
from .margins import MOST_LEVELS, Indexed, index_levels, level_system, solve_levels
from .sizing import CELLS_PER_TASK, attach, join_null_safe, settle, settle_counted
from .strata import share_of_total, strata_counts


def _sides(sample_counts: DataFrame, population_counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sample and population counts side by side: (keys, _s, _p), NULL where a side has no row."""
    sample = sample_counts.selectExpr(*keys, "n AS _s", "CAST(NULL AS BIGINT) AS _p")
    population = population_counts.selectExpr(*keys, "CAST(NULL AS BIGINT) AS _s", "n AS _p")
    return sample.unionByName(population)


def stratum_weights(
    sample_counts: DataFrame, population_counts: DataFrame, keys: Sequence[str], name: str = "weight"
) -> DataFrame:
    """Population share over sample share for every population stratum.

    Both inputs hold one row per stratum with the count ``n``. A stratum without
    sample rows (or with 0) has a NULL weight. The sides are stacked and grouped
    once instead of joined.
    """
    strata = (
        _sides(sample_counts, population_counts, keys)
        .groupBy(*keys)
        .agg(F.sum("_s").alias("_s"), F.sum("_p").alias("_p"))
    )
    totals = strata.agg(F.struct(F.sum("_s").alias("s"), F.sum("_p").alias("p"))).scalar()
    return (
        strata.filter("_p IS NOT NULL")
        .withColumn("_total", totals)
        .selectExpr(
            *keys,
            "try_divide(100.0D * _p, _total.p) AS population_share",
            "try_divide(100.0D * _s, _total.s) AS sample_share",
            f"try_divide(try_divide(100.0D * _p, _total.p), try_divide(100.0D * _s, _total.s)) AS {name}",
        )
    )


def poststratify(
    sample: DataFrame,
    population_counts: DataFrame,
    sample_keys: Sequence[str],
    attach_keys: Sequence[str] | None = None,
    name: str = "weight",
) -> DataFrame:
    """Attach post-stratification weights to every respondent; a NULL key is a stratum like any other.

    ``population_counts`` uses the names of ``sample_keys``. With ``attach_keys``
    the strata are counted on one set of columns and attached through another.
    """
    weights = stratum_weights(
        strata_counts(sample, sample_keys), population_counts, sample_keys, name
    ).select(*sample_keys, name)
    if attach_keys:
        weights = weights.toDF(*attach_keys, name)
    return attach(sample, weights, attach_keys or sample_keys, null_safe=True)


def weighted_outcome_shares(
    sample: DataFrame,
    population_counts: DataFrame,
    keys: Sequence[str],
    outcome: str,
    counted: Column | None = None,
    attach_keys: Sequence[str] | None = None,
) -> DataFrame:
    """Weighted outcome counts and shares after post-stratification.

    Respondents are reduced to (stratum, outcome) cells in one pass; weights are
    constant within a stratum, so they are applied to the cells and never to the
    respondents. ``counted`` limits the rows that enter the shares, not those
    that define the strata.
    """
    flag = F.lit(True) if counted is None else counted
    dims = list(dict.fromkeys([*keys, *(attach_keys or ()), outcome]))
    cells = sample.groupBy(*dims).agg(F.count(F.lit(1)).alias("n"), F.count_if(flag).alias("_counted"))
    if attach_keys:
        weighted = _weighted_cells_by_join(cells, population_counts, keys, attach_keys)
    else:
        weighted = _weighted_cells(cells, population_counts, keys, outcome)
    counts = (
        weighted.filter("_counted > 0")
        .groupBy(outcome)
        .agg(F.expr("coalesce(sum(weight * _counted), 0.0D)").alias("n"))
    )
    return share_of_total(counts)


def outcome_shares_by_method(
    sample: DataFrame,
    population_counts: DataFrame,
    keys: Sequence[str],
    outcome: str,
    methods: Mapping[str, tuple[bool, Column]],
) -> DataFrame:
    """(method, outcome, n, share) for several estimates from one pass over the respondents.

    ``methods`` maps a name to (whether it is weighted, which rows count). The cells hold a count per
    method, so what the methods share is read and joined once.
    """
    flags = {f"_m{i}": condition for i, (_, condition) in enumerate(methods.values())}
    counts = [F.count_if(condition).alias(flag) for flag, condition in flags.items()]
    cells = sample.groupBy(*dict.fromkeys([*keys, outcome])).agg(F.count(F.lit(1)).alias("n"), *counts)
    weighted = _weighted_cells(cells, population_counts, keys, outcome, list(flags))
    rows = [
        F.struct(
            F.lit(name).alias("method"),
            (F.col("weight") * F.col(flag) if by_weight else F.col(flag).cast("double")).alias("n"),
            F.col(flag).alias("rows"),
        )
        for flag, (name, (by_weight, _)) in zip(flags, methods.items())
    ]
    long = weighted.select(outcome, F.explode(F.array(*rows)).alias("_row")).filter("_row.rows > 0")
    totals = long.groupBy("_row.method", outcome).agg(F.expr("coalesce(sum(_row.n), 0.0D) AS n"))
    # A row per method and outcome.
    return totals.withColumn("share", 100 * safe_ratio(F.col("n"), F.sum("n").over(Window.partitionBy("method"))))


def _weighted_cells(
    cells: DataFrame,
    population_counts: DataFrame,
    keys: Sequence[str],
    outcome: str,
    counted: Sequence[str] = ("_counted",),
) -> DataFrame:
    """Weights next to the cells: population rows are stacked under the cells of their stratum.

    A stratum holds one row per outcome here, so the window groups are small.
    """
    if outcome in keys:
        cells = cells.withColumn("_outcome", F.col(outcome))
    else:
        cells = cells.withColumnRenamed(outcome, "_outcome")
    rows = cells.selectExpr(*keys, "_outcome", "n AS _s", *counted, "CAST(NULL AS BIGINT) AS _p").unionByName(
        population_counts.selectExpr(*keys, "n AS _p"), allowMissingColumns=True
    )
    # The sums of the counted columns are not used; with them both scans of the cells are one exchange.
    unused = ", ".join(f"sum({c}) AS {c}" for c in counted)
    totals = rows.agg(F.expr(f"struct(sum(_s) AS s, sum(_p) AS p, {unused})")).scalar()
    stratum = Window.partitionBy(*keys)
    return (
        rows.withColumns({"_ps": F.sum("_p").over(stratum), "_ss": F.sum("_s").over(stratum), "_total": totals})
        .selectExpr(
            f"_outcome AS {outcome}",
            *counted,
            "try_divide(try_divide(100.0D * _ps, _total.p), try_divide(100.0D * _ss, _total.s)) AS weight",
        )
    )


def _weighted_cells_by_join(
    cells: DataFrame, population_counts: DataFrame, keys: Sequence[str], attach_keys: Sequence[str]
) -> DataFrame:
    cells = settle(cells)
    weights = stratum_weights(cells.groupBy(*keys).agg(F.sum("n").alias("n")), population_counts, keys)
    weights = weights.select(*keys, "weight").toDF(*attach_keys, "weight")
    return join_null_safe(cells, weights, attach_keys)


def poststratify_design(
    sample: DataFrame, population_counts: DataFrame, keys: Sequence[str], weight: str, name: str = "weight_ps"
) -> DataFrame:
    """Scale existing design weights so that they sum to the known stratum sizes."""
    estimated = sample.groupBy(*keys).agg(F.sum(weight).alias("_estimated"))
    factors = join_null_safe(estimated, population_counts, keys).select(
        *keys, safe_ratio(F.col("n"), F.col("_estimated")).alias("_factor")
    )
    return (
        attach(sample, factors, keys, null_safe=True).withColumn(name, F.col(weight) * F.col("_factor")).drop("_factor")
    )


def stratified_mean(
    sample: DataFrame, population_counts: DataFrame, keys: Sequence[str], value: str
) -> DataFrame:
    """Mean of stratum means weighted by population size (one row)."""
    means = sample.groupBy(*keys).agg(F.avg(value).alias("_mean"))
    return join_null_safe(means, population_counts, keys, "inner").agg(
        safe_ratio(F.sum(F.col("n") * F.col("_mean")), F.sum("n")).alias("estimate")
    )


def empty_strata(sample_counts: DataFrame, population_counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Population strata that no respondent represents."""
    present = sample_counts.filter(F.col("n") > 0)
    return join_null_safe(population_counts.filter(F.col("n") > 0), present.select(*keys), keys, "left_anti")


# Rounds between two checkpoints while raking.
ROUNDS_PER_CHECKPOINT = 5
# Newton steps, and rounds of plain fitting where there are too many levels for them, before raking gives up.
MOST_STEPS, MOST_ROUNDS = 60, 1_000
HALVINGS = 40


class NotRaked(ValueError):
    """The weights do not meet the margins."""


@dataclass(frozen=True)
class Raked:
    """Cell table with raked weights, the rounds used and the largest relative gap between a fitted and a target margin.

    ``gap`` is None if it was not asked for. ``vanishing`` holds the cells (margins, total) that the margins leave no weight: they
    can only be met in the limit, in which these cells are empty. It is None where it was not looked for.
    """

    cells: DataFrame
    rounds: int
    gap: float | None
    vanishing: DataFrame | None = None


def rake_cells(
    sample: DataFrame,
    margins: Mapping[str, DataFrame],
    weight: str | None = None,
    max_rounds: int | None = None,
    tolerance: float | None = 1e-9,
    window_cells: int = CELLS_PER_TASK,
    max_levels: int = MOST_LEVELS,
) -> Raked:
    """Weights of the margin cells that meet several margins and stay proportional to the sample within them.

    The respondents are read once and reduced to cells of the margin columns;
    the targets are joined to the cells once. A cell's weight is its start times one factor for each of its levels. The logarithms of
    the factors are found by Newton steps: each sums the fitted margins and their matrix over the cells, as (level, level, weight)
    rows, and solves for all levels at once, so margins that depend on each other, or that leave some cells no weight, are met
    in a few rounds too. It ends when the largest relative gap is at most ``tolerance``, when nothing moves although a gap is left
    (then the margins contradict each other, or a level with a target has no respondents), or
    after ``max_rounds`` (``MOST_STEPS``). The caller sees this in ``gap``. Margins with different totals are scaled to the total of the last
    one; a last round of plain fitting then meets the last margin.

    With ``tolerance=None`` exactly ``max_rounds`` rounds of plain iterative fitting run: each scales the cells to one margin
    after another. So it is done, with a tolerance and at most ``max_rounds`` (``MOST_ROUNDS``), where the margins have more than ``max_levels``
    levels. ``margins`` maps a column to a frame (column, n). A level without a target keeps its weight, NULL is a level.
    """
    if max_rounds is None and tolerance is None:
        raise ValueError("give a tolerance or a number of rounds")
    columns = list(margins)
    start = "count(*)" if weight is None else f"sum({weight})"
    cells = sample.groupBy(*columns).agg(F.expr(f"CAST({start} AS DOUBLE)").alias("_base"))
    for column, margin in margins.items():
        target = margin.selectExpr(column, f"CAST(n AS DOUBLE) AS _target_{column}")
        cells = join_null_safe(cells, target, [column])
    cells, size = settle_counted(cells)
    if tolerance is not None:
        able = {c: (F.col(f"_target_{c}") > 0) & (F.col("_base") > 0) for c in columns}
        indexed = index_levels(cells, columns, able, {c: F.col(f"_target_{c}") for c in columns}, max_levels, size <= window_cells)
        if indexed is not None:
            return _raked_by_newton(indexed, margins, max_rounds or MOST_STEPS, tolerance, size <= window_cells)
    return _raked_in_turn(cells, size <= window_cells, margins, max_rounds, tolerance)


def _raked_in_turn(cells: DataFrame, small: bool, margins: Mapping[str, DataFrame], max_rounds: int | None, tolerance: float | None) -> Raked:
    """Iterative proportional fitting.

    A small cell table (it is as large as the product of the categories, not as the sample) sits in one
    partition, so that its windows need no shuffle. Every few rounds the cells are written to the
    shared folder, which cuts the lineage, and the fitted margins are compared with the targets.
    """
    columns, rounds, gap = list(margins), 0, None
    cells = cells.selectExpr("*", "_base AS _w", "_base AS _old")
    limit = max_rounds or MOST_ROUNDS
    while rounds < limit:
        if small:
            cells = cells.coalesce(1)
        for _ in range(min(ROUNDS_PER_CHECKPOINT, limit - rounds)):
            cells = cells.withColumn("_old", F.col("_w"))
            for column in columns:
                cells = _fit_margin(cells, column, small)
            rounds += 1
        cells = settle(cells)
        if tolerance is not None:
            moved = cells.agg(F.expr("max(abs(try_divide(_w - _old, _old)))")).scalar()
            found = _gaps(cells.withColumnRenamed("_w", "total"), margins).agg(F.max("gap")).withColumn("moved", moved).first()
            gap, change = found[0] or 0.0, found[1] or 0.0
            if gap <= tolerance or change <= tolerance / 10:
                break
    return Raked(cells.selectExpr(*columns, "_w AS total", "try_divide(_w, _base) AS factor"), rounds, gap)


def _common_totals(indexed: Indexed, columns: Sequence[str]) -> np.ndarray:
    """Targets of the levels, scaled to the total of the last margin; margins that leave cells out are not scaled, nor scaled to."""
    free = indexed.cells.where("_base > 0").agg(*[F.count_if(F.col(f"_target_{c}").isNull()) for c in columns]).first()
    targets, ends = indexed.targets.copy(), list(zip(indexed.first, indexed.first[1:]))
    whole = [k for k in range(len(columns)) if not free[k]]
    for k in whole[:-1]:
        own, last = slice(*ends[k]), slice(*ends[whole[-1]])
        if targets[own].sum() > 0:
            targets[own] *= targets[last].sum() / targets[own].sum()
    return targets


def _raked_by_newton(indexed: Indexed, margins: Mapping[str, DataFrame], most_steps: int, tolerance: float, small: bool) -> Raked:
    """Maximise sum(target * log factor) - sum(weight of the cells), which is concave, over the log factors of all levels."""
    columns = list(margins)
    # A level with target 0 empties its cells.
    emptied = " OR ".join(f"coalesce(_target_{c} = 0, false)" for c in columns)
    base = F.expr(f"IF({emptied}, 0.0D, _base)")
    targets = _common_totals(indexed, columns)

    def at(logs: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        matrix, _, total = level_system(indexed, F.when(base > 0, base * F.exp(indexed.along(logs))).otherwise(0.0))
        return matrix, targets - np.diag(matrix), float(targets @ logs) - (total or 0.0)

    logs = np.zeros(len(targets))
    matrix, missing, height = at(logs)
    # The first margin is met at once; this takes the scale of the targets out of the steps.
    own = slice(*indexed.first[:2])
    logs[own] = np.log(targets[own] / np.maximum(np.diag(matrix)[own], np.finfo(float).tiny))
    matrix, missing, height = at(logs)
    rounds, step = 1, np.zeros(len(targets))
    while rounds < most_steps and len(targets) and np.max(np.abs(missing) / targets) > tolerance:
        step = solve_levels(matrix, missing)
        rise = float(missing @ step)
        if rise <= (tolerance / 10) ** 2 * targets.sum():
            break
        share = 1.0
        for _ in range(HALVINGS):
            found = at(logs + share * step)
            if found[2] >= height + 1e-4 * share * rise - 1e-13 * abs(height):
                break
            share /= 2
        else:
            break
        logs = logs + share * step
        matrix, missing, height = found
        rounds += 1
    weight = F.when(base > 0, base * F.exp(indexed.along(logs))).otherwise(0.0)
    kept = [*columns, "_base", *[f"_target_{c}" for c in columns]]
    # A settled cell does not move in the last step; one that vanishes goes on losing most of its weight in each.
    cells = settle(indexed.cells.select(*kept, weight.alias("_w"), ((base > 0) & (indexed.along(step) <= -0.5)).alias("_vanishing")))
    vanishing = cells.where("_vanishing").selectExpr(*columns, "_w AS total")
    gap = _largest_gap(cells, margins)
    if gap > tolerance:
        cells = cells.coalesce(1) if small else cells
        for column in columns:
            cells = _fit_margin(cells, column, small)
        cells = settle(cells)
        gap = _largest_gap(cells, margins)
    return Raked(cells.selectExpr(*columns, "_w AS total", "try_divide(_w, _base) AS factor"), rounds, gap, vanishing)


def _largest_gap(cells: DataFrame, margins: Mapping[str, DataFrame]) -> float:
    return _gaps(cells.withColumnRenamed("_w", "total"), margins).agg(F.max("gap")).first()[0] or 0.0


def _gaps(cells: DataFrame, margins: Mapping[str, DataFrame]) -> DataFrame:
    """(margin, level, target, fitted, gap): fitted against target sums, relative; a target without cells has gap 1."""
    parts = []
    for column, margin in margins.items():
        fitted = cells.groupBy(column).agg(F.sum("total").alias("_fitted"))
        target = margin.selectExpr(column, "CAST(n AS DOUBLE) AS target")
        parts.append(
            join_null_safe(target, fitted, [column]).selectExpr(
                f"'{column}' AS margin", f"CAST({column} AS STRING) AS level", "target", "coalesce(_fitted, 0.0D) AS fitted"
            )
        )
    both = parts[0]
    for part in parts[1:]:
        both = both.unionByName(part)
    return both.withColumn("gap", F.expr("IF(target = 0 AND fitted = 0, 0.0D, try_divide(abs(fitted - target), target))"))


def margin_gaps(raked: Raked, margins: Mapping[str, DataFrame]) -> DataFrame:
    """How far the raked weights are from each margin: (margin, level, target, fitted, gap)."""
    return _gaps(raked.cells, margins)


def _fit_margin(cells: DataFrame, column: str, small: bool) -> DataFrame:
    """Scale the cells so that they add up to the target of every level; a level without target stays."""
    scaled = F.expr(f"_w * coalesce(try_divide(_target_{column}, _current), 1.0D)")
    if small:
        current = F.sum("_w").over(Window.partitionBy(column))
        return cells.withColumn("_current", current).withColumn("_w", scaled).drop("_current")
    sums = cells.groupBy(column).agg(F.sum("_w").alias("_current"))
    return join_null_safe(cells, sums, [column]).withColumn("_w", scaled).drop("_current").select(*cells.columns)


def rake(
    sample: DataFrame,
    margins: Mapping[str, DataFrame],
    weight: str | None = None,
    name: str = "weight_rake",
    max_rounds: int | None = None,
    tolerance: float | None = 1e-9,
    strict: bool = True,
) -> DataFrame:
    """Attach raked weights to every respondent.

    Raises ``NotRaked`` if the weights miss a margin by more than ``tolerance``; with ``strict=False`` the best
    weights are attached all the same (``rake_cells`` and ``margin_gaps`` tell what they miss).
    """
    raked = rake_cells(sample, margins, weight, max_rounds, tolerance)
    if strict and tolerance is not None and raked.gap > tolerance:
        raise NotRaked(f"after {raked.rounds} rounds a margin is missed by {raked.gap:.3g} of its target")
    factors = raked.cells.select(*margins, F.col("factor").alias("_factor"))
    base = F.lit(1.0) if weight is None else F.col(weight)
    return attach(sample, factors, list(margins), null_safe=True).withColumn(name, base * F.col("_factor")).drop("_factor")
