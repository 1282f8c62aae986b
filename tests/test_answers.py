"""Transitions, imputation, scoring, reshaping."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from pollweave.operators.evaluate import mean_measures, result_table, rmse_against
from pollweave.operators.frames import category_rank, complete_rows, first_row, latest_rows, latest_rows_per_group, relabel_by_position
from pollweave.operators.impute import fit_linear, impute_mean, impute_regression, impute_rule, impute_stochastic, impute_value, line_fit
from pollweave.operators.reshape import add_residual, append_rows, flip, to_long, to_wide
from pollweave.operators.strata import cross_shares, crosstab, proportions, share_of_total
from pollweave.operators.transition import check_square, counts_by_variable, first_and_last, loyalty, margins, scaled_flows, without_stayers

PARTIES = ["Union", "SPD", "FDP", "Gruene", "Linke", "AfD", "Other"]
# Published shares and their published error against the reference of the wave.
PUBLISHED = {
    ("Dec", "reference"): ([35.5, 22.2, 5.7, 10.6, 9.7, 11.6, 4.7], 0.0),
    ("Dec", "exit-poll"): ([32.5, 21.1, 8.7, 8.6, 9.6, 11.7, 7.8], 2.1660),
    ("Dec", "census"): ([24.6, 21.6, 5.5, 10.6, 9.5, 14.0, 14.2], 5.5454),
    ("Dec", "unweighted"): ([23.8, 20.9, 6.1, 10.5, 10.5, 13.8, 14.4], 5.8349),
    ("Mar", "reference"): ([33.1, 31.4, 5.8, 7.6, 7.7, 9.3, 5.1], 0.0),
    ("Mar", "exit-poll"): ([36.7, 28.1, 4.9, 7.5, 8.6, 7.8, 6.4], 2.0501),
    ("Mar", "census"): ([23.1, 30.0, 5.8, 8.4, 9.0, 13.8, 10.0], 4.6067),
    ("Mar", "unweighted"): ([23.6, 28.4, 5.6, 7.7, 9.8, 14.5, 10.3], 4.7478),
}


@pytest.fixture(scope="module")
def estimates(spark):
    rows = [(m, w, p, x) for (w, m), (shares, _) in PUBLISHED.items() for p, x in zip(PARTIES, shares)]
    return spark.createDataFrame(rows, "method STRING, date STRING, party STRING, pct DOUBLE")


def test_published_errors(estimates):
    found = {(r.date, r.method): r.rmse for r in rmse_against(estimates, "reference").collect()}
    assert found == {k: pytest.approx(v, abs=5e-5) for k, (_, v) in PUBLISHED.items()}


def test_result_table(estimates):
    table = result_table(estimates, rmse_against(estimates, "reference"), PARTIES, {"^exit": "Exit polls", "^ref": "Benchmark"})
    rows = table.collect()
    assert table.columns == ["Method", "Date", *PARTIES, "RMSE"]
    assert [(r.Date, r.Method) for r in rows] == sorted(((r.Date, r.Method) for r in rows), reverse=True)
    assert rows[0].Date == "Mar" and {r.Method for r in rows} == {"Exit polls", "Benchmark", "census", "unweighted"}


def test_residual(spark):
    rows = [("m", "A", 60.0), ("m", "Other", None), ("k", "A", 50.0), ("k", "Other", 49.0)]
    found = add_residual(spark.createDataFrame(rows, "method STRING, party STRING, pct DOUBLE"), ["method"], "party", "pct")
    assert {tuple(r) for r in found.collect()} == {("m", "A", 60.0), ("m", "Other", 40.0), ("k", "A", 50.0), ("k", "Other", 49.0)}


def test_long_and_wide_are_inverse(estimates):
    wide = to_wide(estimates, ["method", "date"], "party", PARTIES, F.first("pct"))
    back = to_long(wide, ["method", "date"], PARTIES, "party", "pct")
    assert {tuple(r) for r in back.collect()} == {tuple(r) for r in estimates.collect()}


def test_flip(spark):
    table = spark.createDataFrame([("A", 1.0, 10.0), ("B", 2.0, 20.0)], "p STRING, n DOUBLE, share DOUBLE")
    assert {tuple(r) for r in flip(table, "p", ["A", "B"]).collect()} == {("n", 1.0, 2.0), ("share", 10.0, 20.0)}


def test_append_with_missing_columns(spark):
    a, b = spark.createDataFrame([(1, 2)], "x INT, y INT"), spark.createDataFrame([(3,)], "x INT")
    assert {tuple(r) for r in append_rows(a, b, fill_missing=True).collect()} == {(1, 2), (3, None)}


def test_mean_of_dates(spark):
    rows = [("a", dt.date(2017, 3, 18), 1.0), ("a", dt.date(2017, 3, 22), 3.0)]
    found = mean_measures(spark.createDataFrame(rows, "k STRING, d DATE, v DOUBLE"), ["k"], ["d", "v"]).first()
    assert (found.d, found.v) == (dt.date(2017, 3, 20), 2.0)


@pytest.fixture(scope="module")
def flow(spark):
    # 200, 540 and 340 voters spread over three boxes.
    spread = [(200, (0.5, 0.25, 0.25)), (540, (0.75, 0.10, 0.15)), (340, (0, 0.2, 0.8))]
    rows = [(f"b{i}", f"b{j}", total * part) for i, (total, parts) in enumerate(spread) for j, part in enumerate(parts)]
    return spark.createDataFrame([(a, b, float(n)) for a, b, n in rows], "from STRING, to STRING, n DOUBLE")


def test_flow_tables(flow):
    assert {r["from"]: r.loyalty for r in loyalty(flow).collect()} == {"b0": pytest.approx(0.5), "b1": pytest.approx(0.1), "b2": pytest.approx(0.8)}
    found = {(r.side, r.box): r.prop for r in margins(flow).collect()}
    assert found["start", "b1"] == pytest.approx(540 / 1080)
    assert found["end", "b0"] == pytest.approx((100 + 405) / 1080)
    assert without_stayers(flow).filter("from = to AND n <> 0").count() == 0
    overall = {(r["from"], r.to): r.width for r in scaled_flows(flow, False, 1, 10).collect()}
    assert overall["b1", "b0"] == pytest.approx(10) and overall["b0", "b0"] == pytest.approx(1 + 9 * 100 / 405)
    origin = {(r["from"], r.to): r.width for r in scaled_flows(flow, True, 1, 10).collect()}
    assert origin["b0", "b0"] == pytest.approx(10) and origin["b2", "b0"] == pytest.approx(1)
    assert check_square(flow).count() == 0
    assert [r.box for r in check_square(flow.filter("from <> 'b2'")).collect()] == ["b2"]


def test_first_and_last(spark):
    rows = [(1, 3, "C"), (1, 1, "A"), (2, 5, "B")]
    found = first_and_last(spark.createDataFrame(rows, "p INT, t INT, a STRING"), "p", "a", ["t"])
    assert {tuple(r) for r in found.collect()} == {(1, "A", "C"), (2, "B", "B")}


def test_counts_by_variable(spark):
    df = spark.createDataFrame([(1, "A", "B"), (2, "A", "A")], "id INT, vote STRING, rank1 STRING")
    found = {(r.variable, r.value): r.n for r in counts_by_variable(df, ["id"], ["vote", "rank1"]).collect()}
    assert found == {("vote", "A"): 2, ("rank1", "B"): 1, ("rank1", "A"): 1}


def test_tables_with_null(spark):
    df = spark.createDataFrame([("a", "x"), ("a", None), (None, "x"), ("b", "x")], "k STRING, l STRING")
    assert {tuple(r) for r in crosstab(df, "k", "l", ["x", "y"]).collect()} == {("a", 1, 0), ("b", 1, 0)}
    assert {r.k: r.prop for r in proportions(df, "k").collect()} == {"a": pytest.approx(2 / 3), "b": pytest.approx(1 / 3)}
    assert {r.k for r in proportions(df, "k", keep_null=True).collect()} == {"a", "b", None}
    shares = cross_shares(df, "k", "l", "column").collect()
    assert {(r.k, r.l): r.share for r in shares} == {
        ("a", "x"): pytest.approx(100 / 3), ("b", "x"): pytest.approx(100 / 3), (None, "x"): pytest.approx(100 / 3), ("a", None): 100.0,
    }


def test_shares_of_nothing_are_null(spark):
    zero = spark.createDataFrame([("a", 0), ("b", 0)], "k STRING, n INT")
    assert [r.share for r in share_of_total(zero).collect()] == [None, None]


def test_latest_keeps_ties(spark):
    rows = [("a", 1, 1), ("a", 2, 2), ("a", 2, 3), ("b", 1, 4), (None, 1, 5)]
    df = spark.createDataFrame(rows, "g STRING, d INT, id INT")
    assert {r.id for r in latest_rows(df, "d").collect()} == {2, 3}
    assert {r.id for r in latest_rows_per_group(df, ["g"], "d").collect()} == {2, 3, 4, 5}
    assert first_row(df, F.col("d").desc(), F.col("id")).first().id == 2


def test_labels_by_position_and_order(spark):
    df = spark.createDataFrame([("c",), ("a",), ("b",), (None,)], "x STRING")
    assert {tuple(r) for r in relabel_by_position(df, "x", ["1", "2"], "y").collect()} == {("a", "1"), ("b", "2"), ("c", None), (None, None)}
    assert [r[0] for r in df.select(category_rank(F.col("x"), ["b", "a"])).collect()] == [None, 2, 1, None]
    assert complete_rows(df).count() == 3


@pytest.fixture(scope="module")
def incomes(spark):
    draw = np.random.default_rng(2)
    rows = []
    for i in range(300):
        age, rooms, sex = float(draw.integers(18, 80)), float(draw.integers(1, 7)), str(draw.choice(["f", "m", "x"]))
        income = 500 + 20 * age + 100 * rooms + {"f": 0, "m": 150, "x": -80}[sex] + float(draw.normal(0, 50))
        rows.append((i, income if i % 4 else None, age, rooms if i % 50 else None, sex))
    return spark.createDataFrame(rows, "id INT, income DOUBLE, age DOUBLE, rooms DOUBLE, sex STRING")


def test_regression_equals_numpy(incomes):
    data = incomes.toPandas()
    known = data.dropna()
    x = np.column_stack([np.ones(len(known)), known.age, known.rooms, known.sex == "m", known.sex == "x"]).astype(float)
    beta = np.linalg.lstsq(x, known.income.to_numpy(), rcond=None)[0]
    filled = impute_regression(incomes, "income", ["age", "rooms"], ["sex"], "y").toPandas().set_index("id")
    assert len(filled) == 300
    for _, row in data.iterrows():
        got = filled.loc[row.id].y
        if not np.isnan(row.income):
            assert got == row.income
        elif np.isnan(row.rooms):
            assert np.isnan(got)
        else:
            assert got == pytest.approx(beta @ [1, row.age, row.rooms, row.sex == "m", row.sex == "x"], rel=1e-10)
    assert fit_linear(incomes, "income", ["age"]).stages[-1].coefficients.size == 1


def test_unseen_label_is_not_predicted(incomes):
    odd = incomes.withColumn("sex", F.when(F.col("id") == 4, "new").otherwise(F.col("sex")))
    filled = impute_regression(odd, "income", ["age"], ["sex"], "y")
    assert filled.count() == 300
    assert [r.id for r in filled.filter("y IS NULL").collect()] == [4]


def test_simple_fills(incomes, spark):
    line = line_fit(incomes, "income", "age").first()
    known = incomes.toPandas().dropna(subset=["income"])
    slope, intercept = np.polyfit(known.age, known.income, 1)
    assert (line.slope, line.intercept) == (pytest.approx(slope), pytest.approx(intercept))
    residual = known.income - intercept - slope * known.age
    assert line.sigma == pytest.approx(np.sqrt((residual**2).sum() / (len(known) - 2)))
    means = impute_mean(incomes, "income", ["sex"], "y").toPandas()
    expected = known.groupby("sex").income.mean()
    for _, r in means[means.income.isna()].iterrows():
        assert r.y == pytest.approx(expected[r.sex])
    rows = [(16, None), (40, None), (16, "full time")]
    df = spark.createDataFrame(rows, "age INT, emp STRING")
    assert [r[0] for r in df.select(impute_rule(F.col("emp"), F.col("age") < 18, "not employed")).collect()] == ["not employed", None, "full time"]
    assert [r[0] for r in df.select(impute_value(F.col("emp"), F.lit("?"))).collect()] == ["?", "?", "full time"]


def test_stochastic_noise_has_the_asked_deviation(spark):
    draw = np.random.default_rng(9)
    rows = [(float(i % 50), None if i % 2 else float(3 * (i % 50) + draw.normal(0, 40))) for i in range(20000)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id BIGINT, x DOUBLE, y DOUBLE")
    fit = line_fit(df, "y", "x").first()
    noise = impute_stochastic(df, "y", ["x"], "z", ["id"], seed=4).filter("y IS NULL").toPandas()
    gap = noise.z - fit.intercept - fit.slope * noise.x
    assert gap.std() == pytest.approx(fit.sigma / 20, rel=0.05) and abs(gap.mean()) < 0.1
