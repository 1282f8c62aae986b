"""From raw survey waves and official statistics to vote shares by method.

Every step is lazy; the waves are reduced to strata in one pass per estimate.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import band, decimal_comma, extract, recode, replace_first, safe_ratio
from ..operators.estimate import outcome_shares
from ..operators.frames import add_row_number
from ..operators.reshape import append_rows, to_long
from ..operators.strata import collapse_strata, joint_share, split_category
from ..operators.weighting import weighted_outcome_shares
from . import fixed_values as fixed


def label_by_pattern(text: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """Label of the first rule whose pattern occurs; text without a hit stays."""
    labelled = text
    for pattern, label in reversed(rules):
        labelled = F.when(text.rlike(pattern), label).otherwise(labelled)
    return labelled


def clean_wave(
    raw: DataFrame, country: str = "DE", eligible_only: bool = True, numbered: bool = True
) -> DataFrame:
    """Recode one wave: labels, age classes, education and religion groups, turnout flag.

    ``eligible_only`` keeps citizens who may vote and are of age. ``numbered``
    adds a dense identifier in sort order.
    """
    wave = raw.filter(F.col("country_code") == country)
    if eligible_only:
        wave = wave.filter(
            (F.col("vote_next_national_election") != fixed.NOT_ELIGIBLE)
            & (F.col("residency") == fixed.CITIZEN)
            & (F.col("age") > fixed.OLDEST_MINOR)
        )
    education = {**fixed.EDUCATION, **fixed.EDUCATION_CODES}
    religion = recode(F.col("religion"), fixed.RELIGIONS)
    cleaned = wave.withColumns(
        {
            "gender": recode(F.col("gender"), fixed.GENDERS),
            "edu_cat": recode(F.col("education_level").cast("string"), education, keep_unmapped=False),
            "past_vote": label_by_pattern(F.col("voted_party_last_election_de"), fixed.VOTE_PATTERNS),
            "next_vote": label_by_pattern(F.col("vote_nextelection_de"), fixed.VOTE_PATTERNS),
            "turnout_exp": recode(F.col("vote_next_national_election"), fixed.TURNOUT),
            "age_group": band(F.col("age"), fixed.AGE_BREAKS, fixed.AGE_GROUPS),
            "age_group30": band(F.col("age"), fixed.AGE30_BREAKS, fixed.AGE30_GROUPS),
            "religion_cat": religion,
        }
    )
    kept = [
        "uuid", "weight", "age", "country_code", "education_level", "edu_cat", "gender", "religion",
        "religion_cat", "employment_status", "vote_next_national_election", "past_vote", "next_vote",
        "turnout_exp", "age_group", "age_group30",
    ]
    if not numbered:
        return cleaned.select(*kept)
    order = ["age", "gender", "degree_of_urbanisation", "education_level", "uuid"]
    return add_row_number(cleaned.select(*kept, "degree_of_urbanisation"), order).select("identifier", *kept)


def voters(wave: DataFrame) -> DataFrame:
    """Respondents who voted last time and answered both vote questions."""
    return wave.filter(
        ~F.col("past_vote").isin(fixed.NO_VOTE, fixed.NOT_ABLE) & F.col("next_vote").isNotNull()
    )


def election_totals(results: DataFrame) -> DataFrame:
    """Party totals of an election: (party, and every numeric column summed), small parties as Other.

    ``results`` has one row per party in ``Parteien``; the rows on eligible people, voters, invalid and
    valid ballots (``fixed.BALLOT_ROWS``) are not parties and are left out by name, as are rows without percentages.
    """
    results = results.filter(~F.coalesce(F.trim("Parteien").isin(*fixed.BALLOT_ROWS), F.lit(False)))
    measures = [f.name for f in results.schema.fields if f.name != "Parteien"]
    party = F.when(F.col("Parteien").isin(*fixed.ELECTION_PARTIES), F.col("Parteien")).otherwise("Other")
    return (
        results.filter(F.col("Zweitstimmen_pct").isNotNull() & F.col("Erststimmen_pct").isNotNull())
        .withColumn("party", recode(party, fixed.ELECTION_LABELS))
        .groupBy("party")
        .agg(*[F.sum(m).alias(m) for m in measures])
    )


def part_of_other(totals: DataFrame, part: str = "AfD", share: str = "Zweitstimmen_pct") -> Column:
    """Share of one party in itself plus Other, as a scalar."""
    whole = F.sum(F.when(F.col("party").isin(part, "Other"), F.col(share)))
    return totals.agg(safe_ratio(F.sum(F.when(F.col("party") == part, F.col(share))), whole)).scalar()


def turnout_table(counts: DataFrame) -> DataFrame:
    """Turnout overall and share of all voters, from (gender, eligible, voters) with a Total row."""
    total = counts.filter("gender = 'Total'").agg(
        F.struct(F.max("eligible").alias("eligible"), F.max("voters").alias("voters"))
    ).scalar()
    return counts.withColumn("_t", total).selectExpr(
        "gender",
        "try_divide(voters, _t.eligible) AS turnout_overall",
        "try_divide(voters, _t.voters) AS voter_share",
    )


def exit_poll_strata(
    party_by_age: DataFrame, vote_by_gender: DataFrame, turnout: DataFrame, afd_share: Column
) -> DataFrame:
    """Population strata (gender, age_group, party, n) from the election statistics, in percent.

    ``party_by_age``: party, gender and one percent column per age class.
    ``vote_by_gender``: gender and one percent column per party. ``turnout``: see
    ``turnout_table``. Parties missing from either table drop out; CDU and CSU
    are added up; the AfD is cut out of Other.
    """
    by_gender = to_long(vote_by_gender, ["gender"], name="party", value="pct")
    margins = by_gender.join(turnout.select("gender", "voter_share"), "gender").select(
        "gender", "party", (F.col("pct") / 100 * F.col("voter_share")).alias("gender_vote")
    )
    ages = to_long(party_by_age, ["party", "gender"], list(fixed.AGE_COLUMN_GROUPS), "age_column", "age_pct")
    joint = (
        joint_share(ages, margins, ["gender", "party"], "age_pct", "gender_vote", "n")
        .filter(F.col("gender_vote").isNotNull() & (F.col("gender") != "Total"))
        .select(
            "gender",
            recode(F.col("age_column"), fixed.AGE_COLUMN_GROUPS).alias("age_group"),
            "party",
            (100 * F.col("n")).alias("n"),
        )
    )
    parts = split_category(joint, "party", "Other", "AfD", afd_share, ["n"])
    return collapse_strata(parts, "party", {"CDU": "Union", "CSU": "Union"})


def census_strata(census: DataFrame, na_policy: str = "skip") -> DataFrame:
    """Population strata (gender, age_group30, religion_cat, n) from the census table.

    ``census``: religion and one text column per ``gender.age class``. Suppressed
    cells are NULL and skipped, or make their stratum NULL with ``"propagate"``.
    """
    long = to_long(census.filter("religion != 'Insgesamt'"), ["religion"], name="label", value="cell")
    label = F.col("label")
    for pattern, text in fixed.CENSUS_GENDERS.items():
        label = replace_first(label, pattern, text)
    label = replace_first(replace_first(label, r"\s-\s", "."), r"\s.+ter", "p")
    cells = long.select(
        # Published labels carry a remark in brackets.
        recode(F.trim(F.regexp_replace("religion", r"\(.*\)", "")), fixed.CENSUS_RELIGIONS).alias("religion_cat"),
        extract(label, "^.*male").alias("gender"),
        F.regexp_replace(label, r"^.*male\.", "").alias("age"),
        decimal_comma(F.col("cell")).alias("n"),
    )
    clusters = cells.filter(F.col("gender").isNotNull()).select(
        recode(F.col("gender"), fixed.GENDERS).alias("gender"),
        recode(F.col("age"), fixed.CENSUS_AGES, keep_unmapped=False).alias("age_group30"),
        "religion_cat",
        "n",
    )
    total = F.sum("n") if na_policy == "skip" else F.when(F.count(F.lit(1)) == F.count("n"), F.sum("n"))
    return (
        clusters.filter(F.col("age_group30").isNotNull())
        .groupBy("gender", "age_group30", "religion_cat")
        .agg(total.alias("n"))
    )


def exit_poll_shares(wave: DataFrame, strata: DataFrame, merge_oldest: bool = False, mixed_key: bool = False) -> DataFrame:
    """Shares weighted on gender, age and past vote.

    ``merge_oldest`` merges the two oldest classes on both sides, for waves with
    empty strata. ``mixed_key`` counts the sample strata by the next vote and
    attaches the weights by the past vote.
    """
    sample = voters(wave).filter(F.col("next_vote") != fixed.NO_VOTE) if mixed_key else voters(wave)
    if merge_oldest:
        sample = sample.replace(fixed.AGE_MERGED, subset=["age_group"])
        strata = collapse_strata(strata, "age_group", fixed.AGE_MERGED)
    counted = F.col("next_vote") != fixed.NO_VOTE
    vote = "next_vote" if mixed_key else "past_vote"
    population = strata.withColumnRenamed("party", vote)
    return weighted_outcome_shares(
        sample,
        population,
        ("gender", "age_group", vote),
        "next_vote",
        counted,
        ("gender", "age_group", "past_vote") if mixed_key else None,
    )


def census_shares(wave: DataFrame, strata: DataFrame) -> DataFrame:
    """Shares of likely voters weighted on gender, three age classes and religion."""
    return weighted_outcome_shares(
        voters(wave),
        strata,
        ("gender", "age_group30", "religion_cat"),
        "next_vote",
        (F.col("next_vote") != fixed.NO_VOTE) & (F.col("turnout_exp") == "1"),
    )


def unweighted_shares(wave: DataFrame) -> DataFrame:
    return outcome_shares(voters(wave), "next_vote", where=F.col("next_vote") != fixed.NO_VOTE)


def all_estimates(waves: dict[str, DataFrame], exit_poll: DataFrame, census: DataFrame, merged_waves: Sequence[str] = (), mixed_waves: Sequence[str] = ()) -> DataFrame:
    """Every method for every wave (keyed by ISO date): (method, date, party, n, pct)."""
    parts = []
    for date, wave in waves.items():
        methods = {
            "unweighted": unweighted_shares(wave),
            "exit-poll": exit_poll_shares(wave, exit_poll, date in merged_waves, date in mixed_waves),
            "census": census_shares(wave, census),
        }
        for method, shares in methods.items():
            parts.append(
                shares.select(
                    F.lit(method).alias("method"),
                    F.lit(date).cast("date").alias("date"),
                    F.col("next_vote").alias("party"),
                    F.col("n").cast("double").alias("n"),
                    F.col("share").alias("pct"),
                )
            )
    return append_rows(*parts)
