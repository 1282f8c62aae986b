"""Weights, raking and design-based errors against known values and numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pollweave.operators.estimate import Design, design_mean, nonresponse_bounds, outcome_shares, turnout_rate, with_design_weight
from pollweave.operators.strata import complete_strata, split_category, strata_counts
from pollweave.operators.weighting import (
    empty_strata,
    poststratify,
    poststratify_design,
    rake,
    rake_cells,
    stratified_mean,
    stratum_weights,
    weighted_outcome_shares,
)


@pytest.fixture(scope="module")
def sample(spark):
    draw = np.random.default_rng(5)
    rows = [
        (i, str(draw.choice(["E", "H", "M"], p=[0.6, 0.25, 0.15])), str(draw.choice(["No", "Yes"], p=[0.3, 0.7])), int(i % 15), float(draw.normal(500, 120)))
        for i in range(600)
    ]
    return spark.createDataFrame(rows, "id INT, stype STRING, wide STRING, dnum INT, enroll DOUBLE")


@pytest.fixture(scope="module")
def margins(spark):
    # Known population sizes of the two margins; both add up to 6194.
    return {
        "stype": spark.createDataFrame([("E", 4421), ("H", 755), ("M", 1018)], "stype STRING, n BIGINT"),
        "wide": spark.createDataFrame([("No", 1072), ("Yes", 5122)], "wide STRING, n BIGINT"),
    }


def test_four_percent_of_people_two_percent_of_sample_weigh_two(spark):
    sample = spark.createDataFrame([("a", 2), ("b", 98)], "k STRING, n BIGINT")
    people = spark.createDataFrame([("a", 4), ("b", 96)], "k STRING, n BIGINT")
    found = {r.k: r.weight for r in stratum_weights(sample, people, ["k"]).collect()}
    assert found["a"] == pytest.approx(2.0) and found["b"] == pytest.approx(96 / 98)


def test_empty_stratum_has_no_weight_and_is_reported(spark):
    sample = spark.createDataFrame([("a", 2), ("b", 0), ("d", 1)], "k STRING, n BIGINT")
    people = spark.createDataFrame([("a", 4), ("b", 5), ("c", 6)], "k STRING, n BIGINT")
    found = {r.k: r.weight for r in stratum_weights(sample, people, ["k"]).collect()}
    assert set(found) == {"a", "b", "c"} and found["b"] is None and found["c"] is None
    assert {r.k for r in empty_strata(sample, people, ["k"]).collect()} == {"b", "c"}


def test_weighted_strata_have_population_shares(sample, margins):
    weighted = poststratify(sample, margins["stype"], ["stype"])
    total = weighted.agg(F.sum("weight")).first()[0]
    found = {r.stype: r.w / total for r in weighted.groupBy("stype").agg(F.sum("weight").alias("w")).collect()}
    assert found == {k: pytest.approx(n / 6194) for k, n in (("E", 4421), ("H", 755), ("M", 1018))}


def test_weights_do_not_depend_on_population_scale(sample, margins):
    once = poststratify(sample, margins["stype"], ["stype"]).select("id", "weight")
    scaled = margins["stype"].withColumn("n", F.col("n") * 1000)
    again = poststratify(sample, scaled, ["stype"]).select("id", F.col("weight").alias("w2"))
    assert once.join(again, "id").filter("abs(weight - w2) > 1e-12").count() == 0


def test_cells_and_respondents_give_the_same_shares(sample, margins):
    by_cells = {r.wide: r.share for r in weighted_outcome_shares(sample, margins["stype"], ["stype"], "wide").collect()}
    by_rows = {
        r.wide: r.share for r in outcome_shares(poststratify(sample, margins["stype"], ["stype"]), "wide", "weight").collect()
    }
    assert by_cells == {k: pytest.approx(v) for k, v in by_rows.items()}
    assert sum(by_cells.values()) == pytest.approx(100)


def test_mixed_key_shares_equal_attached_weights(sample, spark):
    people = spark.createDataFrame([("No", 40), ("Yes", 60)], "wide STRING, n BIGINT")
    answers = sample.withColumn("past", F.when(F.col("id") % 3 == 0, "No").otherwise("Yes"))
    cells = weighted_outcome_shares(answers, people, ["wide"], "stype", attach_keys=["past"])
    rows = outcome_shares(poststratify(answers, people, ["wide"], ["past"]), "stype", "weight")
    assert {r.stype: round(r.share, 9) for r in cells.collect()} == {r.stype: round(r.share, 9) for r in rows.collect()}


def test_weighting_on_the_outcome_returns_the_population(sample, margins):
    found = weighted_outcome_shares(sample, margins["stype"], ["stype"], "stype")
    assert {r.stype: round(r.share, 9) for r in found.collect()} == {
        k: round(100 * n / 6194, 9) for k, n in (("E", 4421), ("H", 755), ("M", 1018))
    }


def test_design_weights_sum_to_known_sizes(sample, margins):
    weighted = poststratify_design(sample.withColumn("pw", F.col("enroll") + 1), margins["stype"], ["stype"], "pw")
    sums = {r.stype: r.w for r in weighted.groupBy("stype").agg(F.sum("weight_ps").alias("w")).collect()}
    assert sums == {"E": pytest.approx(4421), "H": pytest.approx(755), "M": pytest.approx(1018)}


@pytest.mark.parametrize("window_cells", [0, 1000])
def test_raking_meets_both_margins(sample, margins, window_cells):
    raked = rake_cells(sample, margins, window_cells=window_cells)
    assert raked.gap <= 1e-9 and raked.rounds < 50
    for column, target in margins.items():
        sums = raked.cells.groupBy(column).agg(F.sum("total").alias("total"))
        assert sums.join(target, column).filter("abs(total - n) > 1e-4").count() == 0


def test_raking_equals_numpy(sample, margins):
    table = np.zeros((3, 2))
    for r in sample.groupBy("stype", "wide").count().collect():
        table["EHM".index(r.stype), ["No", "Yes"].index(r.wide)] = r["count"]
    for _ in range(3):
        table *= (np.array([4421, 755, 1018]) / table.sum(1))[:, None]
        table *= (np.array([1072, 5122]) / table.sum(0))[None, :]
    raked = rake_cells(sample, margins, max_rounds=3, tolerance=None)
    assert raked.rounds == 3
    for r in raked.cells.collect():
        assert r.total == pytest.approx(table["EHM".index(r.stype), ["No", "Yes"].index(r.wide)], rel=1e-12)


def test_raked_respondent_weights(sample, margins):
    weighted = rake(sample.withColumn("pw", F.lit(2.0)), margins, "pw")
    assert weighted.count() == 600
    assert weighted.agg(F.sum("weight_rake")).first()[0] == pytest.approx(6194)


def _cluster_se(y, w, cluster, centre, f=0.0):
    z = np.array([(w * (y - centre))[cluster == c].sum() for c in np.unique(cluster)]) / w.sum()
    n = len(z)
    return np.sqrt((1 - f) * n / (n - 1) * ((z - z.mean()) ** 2).sum())


def test_design_means(sample):
    data = sample.toPandas()
    y, ones = data.enroll.to_numpy(), np.ones(600)
    srs = design_mean(sample, "enroll", Design()).first()
    assert (srs.mean, srs.se) == (pytest.approx(y.mean()), pytest.approx(y.std(ddof=1) / np.sqrt(600)))
    finite = design_mean(sample.withColumn("N", F.lit(2400)), "enroll", Design((), ("N",))).first()
    assert finite.se == pytest.approx(np.sqrt(0.75) * y.std(ddof=1) / np.sqrt(600))
    clusters = data.dnum.to_numpy()
    found = design_mean(sample.withColumn("N", F.lit(60)), "enroll", Design(("dnum",), ("N",))).first()
    assert found.se == pytest.approx(_cluster_se(y, ones, clusters, y.mean(), 15 / 60))
    w = 1 + (data.id.to_numpy() % 4)
    weighted = sample.withColumn("pw", 1 + F.col("id") % 4)
    found = design_mean(weighted, "enroll", Design(("dnum",), (), "pw")).first()
    mean = np.average(y, weights=w)
    assert found["mean"] == pytest.approx(mean)
    assert found.se == pytest.approx(_cluster_se(y, w, clusters, mean))


def test_poststratified_error_uses_stratum_means(sample):
    data = sample.toPandas()
    y, w = data.enroll.to_numpy(), np.ones(600)
    centre = data.groupby("stype").enroll.transform("mean").to_numpy()
    one = sample.withColumn("pw", F.lit(1.0))
    clustered = design_mean(one, "enroll", Design(("dnum",), (), "pw"), ["stype"]).first()
    assert clustered.se == pytest.approx(_cluster_se(y, w, data.dnum.to_numpy(), centre))
    single = design_mean(one, "enroll", Design((), (), "pw"), ["stype"]).first()
    assert single.se == pytest.approx(_cluster_se(y, w, data.id.to_numpy(), centre))


def test_missing_values_are_left_out(sample):
    gaps = sample.withColumn("enroll", F.when(F.col("id") % 5 > 0, F.col("enroll")))
    known = sample.filter("id % 5 > 0")
    assert design_mean(gaps, "enroll", Design(("dnum",))).first() == design_mean(known, "enroll", Design(("dnum",))).first()


def test_unobserved_units_still_belong_to_the_sample(sample):
    gaps = sample.withColumn("enroll", F.when(F.col("id") % 5 > 0, F.col("enroll")))
    data = gaps.toPandas()
    y = data.enroll.to_numpy()
    mean = np.nanmean(y)
    z = np.nan_to_num(y - mean) / np.sum(~np.isnan(y))
    found = design_mean(gaps, "enroll", Design(), keep_unobserved=True).first()
    assert found["mean"] == pytest.approx(mean)
    assert found.se == pytest.approx(np.sqrt(600 / 599 * (z**2).sum()))


def test_derived_weights(sample):
    sized = sample.withColumns({"N1": F.lit(60), "N2": F.lit(100)})
    weighted = with_design_weight(sized, Design(("dnum", "id"), ("N1", "N2")))
    assert weighted.count() == 600
    assert weighted.filter("abs(design_weight - 60 / 15 * 100 / 40) > 1e-9").count() == 0
    plain = with_design_weight(sized.withColumn("N", F.lit(2400)), Design((), ("N",)))
    assert plain.filter("design_weight <> 4.0").count() == 0
    given = with_design_weight(sized.withColumn("pw", F.lit(2)), Design((), (), "pw"))
    assert given.filter("design_weight <> 2.0").count() == 0


def test_two_stage_error_equals_numpy(sample):
    sized = sample.withColumns({"N1": F.lit(60), "N2": F.lit(100)})
    found = design_mean(sized, "enroll", Design(("dnum", "id"), ("N1", "N2"))).first()
    data = sample.toPandas()
    y, c = data.enroll.to_numpy(), data.dnum.to_numpy()
    z = (y - y.mean()) / 600
    first = np.array([z[c == k].sum() for k in range(15)])
    v1 = (1 - 15 / 60) * 15 / 14 * ((first - first.mean()) ** 2).sum()
    v2 = sum((1 - 40 / 100) * 40 / 39 * ((z[c == k] - z[c == k].mean()) ** 2).sum() for k in range(15))
    assert found.se == pytest.approx(np.sqrt(v1 + 15 / 60 * v2))


def test_stratified_mean(spark):
    sample = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 10.0)], "k STRING, y DOUBLE")
    people = spark.createDataFrame([("a", 75), ("b", 25)], "k STRING, n BIGINT")
    assert stratified_mean(sample, people, ["k"], "y").first().estimate == pytest.approx(4.0)


def test_bounds_under_nonresponse(spark):
    rows = [("g", 1)] * 5 + [("g", 0)] * 5 + [("g", None)] * 90
    found = nonresponse_bounds(spark.createDataFrame(rows, "g STRING, a INT"), ["g"], "a").first()
    assert (found.p_min, found.p_max) == (pytest.approx(0.05), pytest.approx(0.95))


def test_turnout_modes(spark):
    rows = [(30, "A"), (30, "No vote"), (30, "Not able"), (30, None), (20, None)]
    df = spark.createDataFrame(rows, "age INT, v STRING")
    known = turnout_rate(df, "v", F.col("age") > 22, "No vote", "Not able").first()
    counted = turnout_rate(df, "v", F.col("age") > 22, "No vote", "Not able", unknown_counts=True).first()
    assert (known.no_vote, known.able, known.turnout) == (1, 2, 0.5)
    assert (counted.no_vote, counted.able) == (2, 3)


def test_split_and_complete(spark):
    table = spark.createDataFrame([("x", "Other", 10.9), ("x", "SPD", 25.7)], "g STRING, p STRING, n DOUBLE")
    parts = {r.p: r.n for r in split_category(table, "p", "Other", "AfD", F.lit(4.7 / 10.9), ["n"]).collect()}
    assert parts == {"AfD": pytest.approx(4.7), "Other": pytest.approx(6.2), "SPD": pytest.approx(25.7)}
    counts = strata_counts(spark.createDataFrame([("a", "x"), ("b", "y"), ("b", "y")], "k STRING, l STRING"), ["k", "l"])
    full = {(r.k, r.l): r.n for r in complete_strata(counts, ["k", "l"]).collect()}
    assert full == {("a", "x"): 1, ("a", "y"): 0, ("b", "x"): 0, ("b", "y"): 2}
