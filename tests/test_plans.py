"""Whole analyses on small invented waves, and the shape of the physical plans."""

import datetime as dt
import io
import re
from contextlib import redirect_stdout

import numpy as np
import pytest
from pyspark.sql import functions as F

from pollweave.plans.catalog import QUERIES
from pollweave.plans import fixed_values as fixed
from pollweave.plans.benchmark_plan import benchmark, benchmark_estimates, scored_table
from pollweave.plans.estimate_plan import (
    all_estimates,
    census_strata,
    clean_wave,
    election_totals,
    exit_poll_shares,
    exit_poll_strata,
    part_of_other,
    turnout_table,
    voters,
)
from pollweave.session import shared_folder

TEXTS = {
    "Union": "Yes, I voted for CDU/CSU – Christlich Demokratische Union/Christlich Soziale Union",
    "SPD": "Yes, I voted for SPD – Sozialdemokratische Partei Deutschlands",
    "FDP": "Yes, I voted for FDP - Freie Demokratische Partei",
    "Gruene": "Yes, I voted for Bündnis 90 / Die Grünen",
    "Linke": "Yes, I voted for Die Linke",
    "AfD": "Yes, I voted for AfD – Alternative für Deutschland",
    "Other": "Yes, but I voted for another party",
    "Not able": "I wanted to vote but I wasn't able to",
    "No vote": "No, I did not vote",
}


@pytest.fixture(scope="module")
def raw(spark):
    draw = np.random.default_rng(1)
    rows = []
    for i in range(1200):
        past, following = draw.choice(list(TEXTS), 2)
        following = "I would not vote" if following in ("No vote", "Not able") else TEXTS[following]
        rows.append(
            (
                f"u{i}", 1.0, float(draw.integers(15, 90)), "DE" if i % 20 else "FR",
                str(draw.choice(list(fixed.EDUCATION))), str(draw.choice(["female", "male"])),
                str(draw.choice(["No religious", "Roman Catholic", "Protestant", "Muslim", "Orthodox Catholicism"])),
                "employed", str(draw.choice(list(fixed.TURNOUT))), TEXTS[past],
                following if i % 15 else None, "Yes, as a citizen" if i % 9 else "No", "city",
            )
        )
    names = (
        "uuid STRING, weight DOUBLE, age DOUBLE, country_code STRING, education_level STRING, gender STRING, religion STRING, "
        "employment_status STRING, vote_next_national_election STRING, voted_party_last_election_de STRING, "
        "vote_nextelection_de STRING, residency STRING, degree_of_urbanisation STRING"
    )
    return spark.createDataFrame(rows, names)


@pytest.fixture(scope="module")
def wave(raw):
    return clean_wave(raw).cache()


def test_cleaning(raw, wave):
    data = wave.toPandas()
    assert sorted(data.identifier) == list(range(1, len(data) + 1))
    assert set(data.past_vote) == set(TEXTS) and set(data.next_vote.dropna()) == set(TEXTS) - {"Not able"}
    assert set(data.religion_cat) == {"None", "Roman Catholicism", "Protestantism", "Other"}
    assert set(data.edu_cat) == set(fixed.EDUCATION_ORDER) and set(data.turnout_exp) == {"0", "1"}
    assert set(data.gender) == {"Female", "Male"} and data.age.min() > 16
    original = raw.toPandas()
    kept = original[(original.country_code == "DE") & (original.residency == fixed.CITIZEN) & (original.age > 16) & (original.vote_next_national_election != fixed.NOT_ELIGIBLE)]
    assert set(data.uuid) == set(kept.uuid)
    assert clean_wave(raw, eligible_only=False, numbered=False).count() == (original.country_code == "DE").sum()


def test_voters(wave):
    data = voters(wave).toPandas()
    assert not set(data.past_vote) & {fixed.NO_VOTE, fixed.NOT_ABLE} and data.next_vote.notna().all()


@pytest.fixture(scope="module")
def exit_poll(spark):
    parties = ["CDU", "CSU", "SPD", "FDP", "Gruene", "Linke", "Other"]
    ages = [
        (p, g, *[float(10 + i + j + k) for k in range(5)])
        for i, p in enumerate(parties)
        for j, g in enumerate(("Total", "Male", "Female"))
    ]
    columns = ", ".join(f"`{c}` DOUBLE" for c in fixed.AGE_COLUMN_GROUPS)
    by_age = spark.createDataFrame(ages, f"party STRING, gender STRING, {columns}")
    votes = [(g, *[float(5 + i + j) for i in range(7)]) for j, g in enumerate(("Total", "Male", "Female"))]
    by_gender = spark.createDataFrame(votes, "gender STRING, " + ", ".join(f"{p} DOUBLE" for p in parties))
    turnout = turnout_table(
        spark.createDataFrame([("Total", 200.0, 150.0), ("Male", 95.0, 70.0), ("Female", 105.0, 80.0)], "gender STRING, eligible DOUBLE, voters DOUBLE")
    )
    return exit_poll_strata(by_age, by_gender, turnout, F.lit(0.4)).cache()


def test_exit_poll_strata(exit_poll):
    found = {(r.gender, r.age_group, r.party): r.n for r in exit_poll.collect()}
    assert len(found) == 2 * 5 * 7 and {k[0] for k in found} == {"Male", "Female"}
    cdu = (10 + 0 + 1 + 0) / 100 * ((5 + 0 + 1) / 100 * (70 / 150)) * 100
    # The margin is in percent; the age share applies to it, and percent again on top.
    csu = (10 + 1 + 1 + 0) / 100 * ((5 + 1 + 1) / 100 * (70 / 150)) * 100
    assert found["Male", "18-25", "Union"] == pytest.approx(cdu + csu)
    other = (10 + 6 + 1 + 0) / 100 * ((5 + 6 + 1) / 100 * (70 / 150)) * 100
    assert found["Male", "18-25", "AfD"] == pytest.approx(other * 0.4)
    assert found["Male", "18-25", "Other"] == pytest.approx(other * 0.6)


def test_turnout_table(spark):
    rows = [("Total", 61946900, 44309925), ("Male", 30000000, 21000000)]
    found = {r.gender: r for r in turnout_table(spark.createDataFrame(rows, "gender STRING, eligible BIGINT, voters BIGINT")).collect()}
    assert found["Total"].turnout_overall == pytest.approx(0.715289, abs=1e-6)
    assert found["Male"].voter_share == pytest.approx(21000000 / 44309925)


def test_election_totals(spark):
    rows = [
        ("Wahlberechtigte", None, None), ("CDU", 37.2, 34.1), ("SPD", 29.4, 25.7), ("DIE LINKE", 8.2, 8.6), ("GRUENE", 7.3, 8.4),
        ("CSU", 8.1, 7.4), ("FDP", 2.4, 4.8), ("AfD", 1.9, 4.7), ("PIRATEN", 2.2, 2.2), ("NPD", 1.5, 1.3), ("FREIE WÄHLER", 1.0, 2.7),
    ]
    totals = election_totals(spark.createDataFrame(rows, "Parteien STRING, Erststimmen_pct DOUBLE, Zweitstimmen_pct DOUBLE"))
    found = {r.party: r.Zweitstimmen_pct for r in totals.collect()}
    assert found == {"CDU": 34.1, "SPD": 25.7, "Linke": 8.6, "Gruene": 8.4, "CSU": 7.4, "FDP": 4.8, "AfD": 4.7, "Other": pytest.approx(6.2)}
    assert spark.range(1).select(part_of_other(totals)).first()[0] == pytest.approx(0.431193, abs=1e-6)


@pytest.fixture(scope="module")
def census(spark):
    rows = [
        ("Römisch-katholische Kirche", "10,5", "20", "30", "1", "2", "3"),
        ("Evangelische Kirche", "11", "21", "31", None, "3", "4"),
        ("Jüdische Gemeinden", "1", "2", "3", "4", "5", "6"),
        ("Sonstige", "1", "1", "1", "1", "1", "1"),
        ("Keiner öffentlich-rechtlichen Religionsgesellschaft zugehörig", "7", "8", "9", "7", "8", "9"),
        ("Insgesamt", "99", "99", "99", "99", "99", "99"),
    ]
    ages = ("Unter 10", "20 - 29", "80 und älter")
    names = [f"{g}.{a}" for g in ("Männlich", "Weiblich") for a in ages]
    return spark.createDataFrame(rows, "religion STRING, " + ", ".join(f"`{n}` STRING" for n in names))


def test_census_strata(census):
    found = {(r.gender, r.age_group30, r.religion_cat): r.n for r in census_strata(census).collect()}
    assert found["Male", "10.29", "Roman Catholicism"] == 20 and found["Female", "50p", "Other"] == 7
    assert {k[1] for k in found} == {"10.29", "50p"} and {k[2] for k in found} == {"Roman Catholicism", "Protestantism", "Other", "None"}


def test_all_estimates(wave, exit_poll, census):
    whole_census = census_strata(census).unionByName(census_strata(census).filter("age_group30 = '50p'").withColumn("age_group30", F.lit("30.49")))
    dec, mar = "2016-12-10", "2017-03-20"
    found = all_estimates({dec: wave, mar: wave}, exit_poll, whole_census, merged_waves=[dec], mixed_waves=[mar])
    sums = found.groupBy("method", "date").agg(F.sum("pct").alias("whole"), F.count("*").alias("parties")).collect()
    assert len(sums) == 6
    for row in sums:
        assert row.whole == pytest.approx(100) and row.parties == 7
    assert {r.date for r in sums} == {dt.date(2016, 12, 10), dt.date(2017, 3, 20)}


def test_merged_classes_equal_pandas(wave, exit_poll):
    data = voters(wave).toPandas()
    data["age_group"] = data.age_group.replace(fixed.AGE_MERGED)
    people = exit_poll.toPandas()
    people["age_group"] = people.age_group.replace(fixed.AGE_MERGED)
    people = people.groupby(["gender", "age_group", "party"]).n.sum()
    people = people / people.sum()
    sample = data.groupby(["gender", "age_group", "past_vote"]).size() / len(data)
    weights = data.apply(lambda r: people.get((r.gender, r.age_group, r.past_vote), np.nan) / sample[r.gender, r.age_group, r.past_vote], axis=1)
    counted = data.next_vote != fixed.NO_VOTE
    expected = weights[counted].groupby(data.next_vote[counted]).sum()
    found = {r.next_vote: (r.n, r.share) for r in exit_poll_shares(wave, exit_poll, merge_oldest=True).collect()}
    assert set(found) == set(expected.index)
    for party, total in expected.items():
        assert found[party] == (pytest.approx(total), pytest.approx(100 * total / expected.sum()))


def test_scoring_against_the_benchmark(spark):
    days = [dt.date(2016, 12, 10), dt.date(2017, 3, 18), dt.date(2017, 3, 22)]
    shares = {"CDU/CSU": 0.35, "SPD": 0.25, "Grüne": 0.1, "Linke": 0.09, "AfD": 0.1, "FDP": 0.06}
    polls = spark.createDataFrame(
        [(i, d, p, s, 1000.0) for i in ("a", "b") for d in days for p, s in [*shares.items(), ("sonstige", 0.05)]],
        "institut STRING, datum DATE, partei STRING, anteil DOUBLE, befragte DOUBLE",
    )
    series = benchmark(polls)
    assert {r.partei for r in series.select("partei").distinct().collect()} == set(shares)
    assert benchmark(polls, "rolling").count() == series.count()
    with pytest.raises(ValueError):
        benchmark(polls, "other")
    reference = benchmark_estimates(series, [str(d) for d in days])
    assert {r.date for r in reference.select("date").distinct().collect()} == {dt.date(2016, 12, 10), dt.date(2017, 3, 20)}
    estimates = spark.createDataFrame(
        [("census", days[0], p, x) for p, x in zip(fixed.PARTIES, (30.0, 25.0, 6.0, 10.0, 9.0, 10.0, 10.0))],
        "method STRING, date DATE, party STRING, pct DOUBLE",
    )
    rows = {(r.Method, r.Year): r for r in scored_table(estimates, reference, {"^census": "Census"}).collect()}
    assert rows["rolling average", 2017].RMSE == 0 and rows["rolling average", 2016].Other == pytest.approx(5.0)
    assert rows["Census", 2016].RMSE == pytest.approx(((5**2 + 5**2) / 7) ** 0.5)


FORBIDDEN = re.compile(r"CartesianProduct|BroadcastNestedLoopJoin|BatchEvalPython|ArrowEvalPython|MapInPandas|FlatMapGroups|PythonUDF")


def plan_of(df):
    text = io.StringIO()
    with redirect_stdout(text):
        df.explain("formatted")
    return text.getvalue()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cross_join_and_no_python_in_any_plan(spark, name):
    found = FORBIDDEN.search(plan_of(QUERIES[name](spark, "/root/testdata/sf0.001")))
    assert found is None, found


def test_filters_and_columns_reach_the_scan(spark):
    plan = plan_of(QUERIES["filter_range"](spark, "/root/testdata/sf0.001"))
    assert re.search(r"PushedFilters: \[.*GreaterThan\(o_totalprice,22000.0\)", plan)
    assert "o_orderpriority" not in plan
    assert "l_extendedprice" not in plan_of(QUERIES["join_inner"](spark, "/root/testdata/sf0.001"))


def test_shared_folder_is_the_configured_one(spark):
    configured = spark.conf.get("spark.checkpoint.dir", None)
    assert shared_folder(spark) == (configured or spark.sparkContext.getCheckpointDir())
