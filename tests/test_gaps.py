"""Data with gaps: contradicting margins, NULL strata, lonely clusters, files with different heads."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from pollweave.operators.estimate import Design, design_mean, lonely_clusters, summary_statistics
from pollweave.operators.impute import impute_stochastic
from pollweave.operators.polls import rolling_error, rolling_mean
from pollweave.operators.sizing import chunks_for
from pollweave.operators.strata import complete_strata
from pollweave.operators.weighting import NotRaked, empty_strata, margin_gaps, poststratify, rake, rake_cells
from pollweave.plans import fixed_values as fixed
from pollweave.plans.estimate_plan import election_totals
from pollweave.sources import read_two_row_header


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_contradicting_margins_are_told(spark):
    sample = frame(spark, [("a", "x"), ("b", "y")], "g STRING, p STRING")
    margins = {
        "g": frame(spark, [("a", 50.0), ("b", 50.0)], "g STRING, n DOUBLE"),
        "p": frame(spark, [("x", 10.0), ("y", 90.0)], "p STRING, n DOUBLE"),
    }
    raked = rake_cells(sample, margins)
    assert raked.gap == pytest.approx(0.8)
    gaps = {(r.margin, r.level): r.gap for r in margin_gaps(raked, margins).collect()}
    assert gaps == {("g", "a"): pytest.approx(0.8), ("g", "b"): pytest.approx(0.8), ("p", "x"): 0, ("p", "y"): 0}
    with pytest.raises(NotRaked):
        rake(sample, margins)
    assert rake(sample, margins, strict=False).count() == 2


def test_a_level_without_respondents_is_a_gap(spark):
    sample = frame(spark, [("a",), (None,)], "g STRING")
    margin = {"g": frame(spark, [("a", 3.0), ("b", 2.0), (None, 5.0)], "g STRING, n DOUBLE")}
    assert rake_cells(sample, margin).gap == 1
    whole = {"g": frame(spark, [("a", 3.0), (None, 5.0)], "g STRING, n DOUBLE")}
    assert {r.g: r.weight_rake for r in rake(sample, whole).collect()} == {"a": 3, None: 5}


def test_densifying_keeps_the_sum(spark):
    counts = frame(spark, [("a", "x", 1), ("a", None, 5), (None, "y", 7)], "g STRING, p STRING, n LONG")
    full = complete_strata(counts, ["g", "p"])
    assert full.count() == 6 and full.agg(F.sum("n")).first()[0] == 13


def test_a_null_stratum_is_a_stratum(spark):
    sample = frame(spark, [("a",), (None,), (None,)], "g STRING")
    census = frame(spark, [("a", 5), (None, 5)], "g STRING, n LONG")
    assert sorted((r.g or "", round(r.weight, 6)) for r in poststratify(sample, census, ["g"]).collect()) == [("", 0.75), ("", 0.75), ("a", 1.5)]
    assert empty_strata(sample.groupBy("g").agg(F.count("*").alias("n")), census, ["g"]).count() == 0


def test_errors_do_not_cancel(spark):
    shifted = spark.range(10_000).selectExpr("1e9D + id % 2 AS y")
    found = design_mean(shifted, "y", Design()).first()
    assert found.se == pytest.approx(0.5 / 9_999**0.5, rel=1e-9) and found.mean == pytest.approx(1e9 + 0.5, abs=1e-6)


def test_lonely_clusters_follow_the_policy(spark):
    rows = [(c, f"{c}{u}", float(y), 3, 5) for c, u, y in [(1, 0, 1), (1, 1, 4), (2, 0, 2), (3, 0, 9), (3, 1, 3)]]
    sample = frame(spark, rows, "c INT, u STRING, y DOUBLE, m INT, n INT")
    design = Design(("c", "u"), ("m", "n"))
    assert tuple(lonely_clusters(sample, design).first()) == (1, 3)
    with pytest.raises(PySparkException):
        design_mean(sample, "y", design).collect()
    errors = [design_mean(sample, "y", design, lonely=policy).first().se for policy in ("certainty", "adjust")]
    assert 0 < errors[0] < errors[1]
    with pytest.raises(ValueError):
        design_mean(sample, "y", design, lonely="hope")


def test_a_window_with_a_gap_has_no_value(spark):
    rows = [("p", d, 100.0 + d, None if d == 4 else 0.1 * (d % 5), 0.01) for d in range(16)]
    polls = frame(spark, rows, "partei STRING, datum INT, befragte DOUBLE, anteil DOUBLE, delta DOUBLE")
    means = {r.datum: r.rolling_average for r in rolling_mean(polls).collect()}
    assert [d for d, mean in sorted(means.items()) if mean is not None] == [14, 15]
    errors = rolling_error(polls.withColumn("delta", F.when(F.col("datum") != 4, F.col("delta"))))
    assert {r.datum for r in errors.filter("rolling_error IS NOT NULL").collect()} == {14, 15}


def test_noise_does_not_depend_on_partitions(spark):
    rows = spark.range(60).selectExpr("id", "CAST(id % 7 AS DOUBLE) AS x", "CAST(id % 3 AS DOUBLE) AS z", "IF(id % 2 = 0, NULL, CAST(id * id % 11 AS DOUBLE)) AS y")
    for predictors in (["x"], ["x", "z"]):
        one, two = (
            {r.id: round(r.w, 9) for r in impute_stochastic(rows.repartition(n), "y", predictors, "w", ["id"], seed=3).collect()} for n in (1, 7)
        )
        assert one == two and len(set(one.values())) > 30


def test_a_hot_value_is_one_row_of_the_quartiles(spark):
    values = spark.range(20_000).selectExpr("IF(id % 10 < 9, 7.0D, CAST(id AS DOUBLE)) AS x")
    small, large = (summary_statistics(values, "x", rows_per_task=n).first() for n in (100, 10**9))
    assert small == large and (small.q1, small.median, small.n) == (7.0, 7.0, 20_000)
    assert summary_statistics(values.limit(0), "x").first().median is None


def test_chunks_keep_their_size():
    assert 10**12 / chunks_for(10**12, 1_000) <= 1_000


def test_two_row_heads_of_several_files(spark, tmp_path):
    head = 't\n"A;B";x;\n;u;v\n'
    for name, body in (("a", "r;1;2\n"), ("b", "s;3;4\n")):
        (tmp_path / name).write_text(head + body)
    df = read_two_row_header(spark, str(tmp_path), 1, 2, 3)
    assert df.columns == ["file", "line", "A;B", "x.u", "x.v"]
    assert sorted(tuple(r)[2:] for r in df.collect()) == [("r", "1", "2"), ("s", "3", "4")]
    (tmp_path / "c").write_text("t\nC;x;\n;u;v\nq;5;6\n")
    with pytest.raises(ValueError):
        read_two_row_header(spark, str(tmp_path), 1, 2, 3)


def test_ballot_rows_are_no_party(spark):
    rows = [(fixed.BALLOT_ROWS[0], 100, 100.0, 100.0), ("CDU", 40, 40.0, 39.0), ("PIRATEN", 2, 2.2, 2.0)]
    totals = election_totals(frame(spark, rows, "Parteien STRING, Zweitstimmen_n LONG, Zweitstimmen_pct DOUBLE, Erststimmen_pct DOUBLE"))
    assert {r.party: r.Zweitstimmen_pct for r in totals.collect()} == {"CDU": 40.0, "Other": 2.2}
