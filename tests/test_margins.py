"""Raking by Newton steps and residuals from the additive fit of the margins, against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pollweave.operators.estimate import _projected
from pollweave.operators.weighting import NotRaked, rake, rake_cells


def cells_of(spark, table, names=("a", "b")):
    rows = [(f"a{i}", f"b{j}") for (i, j), n in np.ndenumerate(table) for _ in range(int(n))]
    return spark.createDataFrame(rows, ", ".join(f"{name} STRING" for name in names))


def margin(spark, name, targets):
    return spark.createDataFrame([(f"{name}{k}", float(t)) for k, t in enumerate(targets)], f"{name} STRING, n DOUBLE")


def totals(raked):
    return {(r.a, r.b): r.total for r in raked.cells.collect()}


def test_margins_that_empty_a_cell_are_met(spark):
    sample = cells_of(spark, np.array([[1, 1], [1, 0]]))
    raked = rake_cells(sample, {"a": margin(spark, "a", [1, 1]), "b": margin(spark, "b", [1, 1])})
    assert raked.rounds <= 30 and raked.gap <= 1e-9
    assert [(r.a, r.b) for r in raked.vanishing.collect()] == [("a0", "b0")]
    found = totals(raked)
    assert found[("a0", "b0")] < 1e-8 and found[("a0", "b1")] == pytest.approx(1) and found[("a1", "b0")] == pytest.approx(1)


def test_larger_boundary(spark):
    """Rows 0 and 1 need all of column 2, so their other cells vanish."""
    table = np.array([[5, 4, 9], [3, 2, 1], [7, 8, 0], [4, 4, 0]])
    rows, columns = [30, 20, 25, 25], [20, 30, 50]
    raked = rake_cells(cells_of(spark, table), {"a": margin(spark, "a", rows), "b": margin(spark, "b", columns)})
    assert raked.gap <= 1e-9 and raked.rounds <= 40
    assert {(r.a, r.b) for r in raked.vanishing.collect()} == {(f"a{i}", f"b{j}") for i in (0, 1) for j in (0, 1)}


def test_newton_equals_fitting_in_turn(spark):
    dice = np.random.default_rng(6)
    table = dice.integers(1, 30, (6, 5))
    rows, columns = dice.uniform(10, 1000, 6), dice.uniform(10, 1000, 5)
    margins = {"a": margin(spark, "a", rows), "b": margin(spark, "b", columns * rows.sum() / columns.sum())}
    sample = cells_of(spark, table)
    one, two = rake_cells(sample, margins), rake_cells(sample, margins, max_levels=3)
    assert one.rounds < 15 and one.vanishing.count() == 0 and two.vanishing is None
    other = totals(two)
    assert all(total == pytest.approx(other[key], rel=1e-7) for key, total in totals(one).items())


def test_three_margins_with_gaps(spark):
    """A level without a target keeps its share of the others, a target of zero empties its cells, NULL is a level."""
    dice = np.random.default_rng(7)
    rows = [(str(k % 3) if k % 7 else None, str(k % 4), str(dice.integers(2)), 1.0 + k % 5) for k in range(400)]
    sample = spark.createDataFrame(rows, "a STRING, b STRING, c STRING, w DOUBLE")
    margins = {
        "a": spark.createDataFrame([("0", 10.0), ("1", 20.0), ("2", 30.0), (None, 40.0)], "a STRING, n DOUBLE"),
        "b": spark.createDataFrame([("0", 25.0), ("1", 0.0), ("2", 30.0)], "b STRING, n DOUBLE"),
        "c": spark.createDataFrame([("0", 50.0), ("1", 50.0)], "c STRING, n DOUBLE"),
    }
    raked = rake_cells(sample, margins, "w")
    assert raked.gap <= 1e-9
    again = rake_cells(sample, margins, "w", max_levels=1)
    key = lambda r: (r.a or "", r.b, r.c)
    other = {key(r): r.total for r in again.cells.collect()}
    assert again.gap <= 1e-9 and all(r.total == pytest.approx(other[key(r)], rel=1e-6, abs=1e-6) for r in raked.cells.collect())
    assert all(r.total == 0 for r in raked.cells.where("b = '1'").collect())


def test_margins_that_cannot_be_met_end(spark):
    sample = cells_of(spark, np.array([[1, 0], [1, 1]]))
    margins = {"a": margin(spark, "a", [60, 40]), "b": margin(spark, "b", [40, 60])}
    with pytest.raises(NotRaked):
        rake(sample, margins)
    raked = rake_cells(sample, margins)
    assert raked.rounds <= 60 and raked.gap > 0.1
    assert {r.b: round(r.n, 6) for r in raked.cells.groupBy("b").agg(F.sum("total").alias("n")).collect()} == {"b0": 40, "b1": 60}


def test_few_rounds_when_few_are_allowed(spark):
    sample = cells_of(spark, np.array([[1, 90], [80, 2]]))
    margins = {"a": margin(spark, "a", [1, 1000]), "b": margin(spark, "b", [1000, 1])}
    raked = rake_cells(sample, margins, max_rounds=2)
    assert raked.rounds == 2 and raked.gap > 1e-9


def test_no_respondents(spark):
    none = spark.createDataFrame([], "a STRING, b STRING")
    raked = rake_cells(none, {"a": margin(spark, "a", [1, 1]), "b": margin(spark, "b", [2])})
    assert raked.cells.count() == 0 and raked.gap == 1


@pytest.mark.parametrize("max_levels", [1000, 1])
def test_additive_fit_is_least_squares(spark, max_levels):
    dice = np.random.default_rng(8)
    cells = [(f"a{i}" if i else None, f"b{j}", float(dice.normal()), float(dice.uniform(0.1, 5))) for i in range(7) for j in range(6) if dice.random() < 0.5]
    frame = spark.createDataFrame([(a, b, y * w, w) for a, b, y, w in cells], "a STRING, b STRING, _wy DOUBLE, _w DOUBLE")
    found = {(r.a, r.b): r._centre for r in _projected(frame, ("a", "b"), max_levels).collect()}
    names = sorted({a or "" for a, *_ in cells}), sorted({b for _, b, *_ in cells})
    x = np.array([[(a or "") == name for name in names[0]] + [b == name for name in names[1]] for a, b, _, _ in cells], float)
    y, w = np.array([c[2] for c in cells]), np.sqrt([c[3] for c in cells])
    beta = np.linalg.lstsq(x * w[:, None], y * w, rcond=None)[0]
    for (a, b, *_), centre in zip(cells, x @ beta):
        assert found[(a, b)] == pytest.approx(centre, abs=1e-9)
