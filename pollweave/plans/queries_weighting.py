"""Registered queries: weights, weighted shares, design-based estimates."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import band, recode
from ..operators.estimate import (
    Design,
    design_mean,
    nonresponse_bounds,
    summary_statistics,
    turnout_rates,
    weighted_mean,
)
from ..operators.strata import strata_counts
from ..operators.weighting import (
    empty_strata,
    outcome_shares_by_method,
    poststratify,
    poststratify_design,
    rake,
    rake_cells,
    stratified_mean,
    stratum_weights,
    weighted_outcome_shares,
)
from .registry import query
from .views import INTENT_LEVELS, PAST_LEVELS, PEOPLE_SQL, RESP_SQL, STRATA, people, population, respondents, table

NO_VOTE = "5-LOW"


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def _weights_sql(keys: str) -> str:
    return f"""s AS (SELECT {keys}, count(*) AS n FROM resp GROUP BY {keys}),
p AS (SELECT {keys}, count(*) AS n FROM people GROUP BY {keys}),
w AS (
  SELECT {keys}, 100.0 * p.n / (SELECT sum(n) FROM p) AS population_share,
         100.0 * s.n / (SELECT sum(n) FROM s) AS sample_share,
         (100.0 * p.n / (SELECT sum(n) FROM p)) / (100.0 * s.n / (SELECT sum(n) FROM s)) AS weight
  FROM p LEFT JOIN s USING ({keys}))"""


_STRATA_SQL = "gender, agegroup, past"


@query(
    "poststratify_shares",
    f"""WITH {RESP_SQL}, {_weights_sql(_STRATA_SQL)},
x AS (SELECT intent, sum(weight) AS n FROM resp LEFT JOIN w USING ({_STRATA_SQL})
      WHERE intent <> '{NO_VOTE}' GROUP BY intent)
SELECT intent, round(n, 6) AS n, round(100 * n / (SELECT sum(n) FROM x), 8) AS share FROM x""",
)
def poststratify_shares(spark, folder):
    shares = weighted_outcome_shares(
        respondents(spark, folder),
        population(spark, folder, *STRATA),
        STRATA,
        "intent",
        counted=F.col("intent") != NO_VOTE,
    )
    return rounded(shares, 6, "n").withColumn("share", F.round("share", 8))


@query(
    "likely_voter_share",
    f"""WITH {RESP_SQL}, {_weights_sql(_STRATA_SQL)},
x AS (SELECT intent, sum(weight) AS n FROM resp LEFT JOIN w USING ({_STRATA_SQL})
      WHERE intent <> '{NO_VOTE}' AND turnout = 1 GROUP BY intent)
SELECT intent, round(n, 6) AS n, round(100 * n / (SELECT sum(n) FROM x), 8) AS share FROM x""",
)
def likely_voter_share(spark, folder):
    shares = weighted_outcome_shares(
        respondents(spark, folder),
        population(spark, folder, *STRATA),
        STRATA,
        "intent",
        counted=(F.col("intent") != NO_VOTE) & (F.col("turnout") == 1),
    )
    return rounded(shares, 6, "n").withColumn("share", F.round("share", 8))


@query(
    "poststratify_weights",
    f"""WITH {RESP_SQL}, {_weights_sql(_STRATA_SQL)}
SELECT {_STRATA_SQL}, round(population_share, 9) AS population_share,
       round(sample_share, 9) AS sample_share, round(weight, 9) AS weight FROM w""",
)
def poststratify_weights(spark, folder):
    counts = strata_counts(respondents(spark, folder), STRATA)
    weights = stratum_weights(counts, population(spark, folder, *STRATA), STRATA)
    return rounded(weights, 9, "population_share", "sample_share", "weight")


_THREE_BANDS = "CASE WHEN balance < 3000 THEN '10.29' WHEN balance < 6000 THEN '30.49' ELSE '50p' END"


@query(
    "poststratify_three_bands",
    f"""WITH {RESP_SQL.replace("people AS", "people0 AS").replace("people p ON", "people0 p ON")},
people AS (SELECT *, {_THREE_BANDS} AS ageband FROM people0),
r AS (SELECT *, {_THREE_BANDS} AS ageband FROM resp),
s AS (SELECT gender, ageband, past, count(*) AS n FROM r GROUP BY ALL),
p AS (SELECT gender, ageband, past, count(*) AS n FROM people GROUP BY ALL)
SELECT id, round((100.0 * p.n / (SELECT sum(n) FROM p)) / (100.0 * s.n / (SELECT sum(n) FROM s)), 9) AS weight
FROM r LEFT JOIN p USING (gender, ageband, past) LEFT JOIN s USING (gender, ageband, past)""",
)
def poststratify_three_bands(spark, folder):
    """Weights per respondent on gender, three age bands and a third trait."""
    ageband = band(F.col("balance"), (3000, 6000), ("10.29", "30.49", "50p"))
    keys = ("gender", "ageband", "past")
    census = strata_counts(people(spark, folder).withColumn("ageband", ageband), keys)
    sample = respondents(spark, folder).withColumn("ageband", ageband)
    return poststratify(sample, census, keys).select("id", F.round("weight", 9).alias("weight"))


# Both answers get one vocabulary, so that one can be used for the other.
_PARTY_OF_PAST = dict(zip(PAST_LEVELS, "ABCDE"))
_PARTY_OF_INTENT = dict(zip(INTENT_LEVELS, "ABCDE"))


def _case(column: str, mapping: dict[str, str]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in mapping.items()) + " END"


@query(
    "poststratify_mixed_key",
    f"""WITH {RESP_SQL},
r AS (SELECT id, gender, agegroup, {_case("past", _PARTY_OF_PAST)} AS past_party,
             {_case("intent", _PARTY_OF_INTENT)} AS next_party FROM resp),
pp AS (SELECT gender, agegroup, {_case("past", _PARTY_OF_PAST)} AS party, count(*) AS n FROM people GROUP BY ALL),
s AS (SELECT gender, agegroup, next_party AS party, count(*) AS n FROM r GROUP BY ALL),
w AS (SELECT gender, agegroup, party,
             (100.0 * pp.n / (SELECT sum(n) FROM pp)) / (100.0 * s.n / (SELECT sum(n) FROM s)) AS weight
      FROM pp LEFT JOIN s USING (gender, agegroup, party))
SELECT r.id, round(w.weight, 9) AS weight
FROM r LEFT JOIN w ON r.gender = w.gender AND r.agegroup = w.agegroup AND r.past_party = w.party""",
)
def poststratify_mixed_key(spark, folder):
    """Strata counted by next vote, weights attached by past vote."""
    voters = respondents(spark, folder).select(
        "id",
        "gender",
        "agegroup",
        recode(F.col("past"), _PARTY_OF_PAST).alias("past_party"),
        recode(F.col("intent"), _PARTY_OF_INTENT).alias("next_party"),
    )
    electorate = people(spark, folder).withColumn("next_party", recode(F.col("past"), _PARTY_OF_PAST))
    weighted = poststratify(
        voters,
        strata_counts(electorate, ("gender", "agegroup", "next_party")),
        ("gender", "agegroup", "next_party"),
        ("gender", "agegroup", "past_party"),
    )
    return weighted.select("id", F.round("weight", 9).alias("weight"))


@query(
    "poststrat_identity",
    f"""WITH {PEOPLE_SQL}, p AS (SELECT past, count(*) AS n FROM people GROUP BY past)
SELECT past, round(100.0 * n / (SELECT sum(n) FROM p), 8) AS share FROM p""",
)
def poststrat_identity(spark, folder):
    """Weights keyed on the outcome itself give back the population shares."""
    shares = weighted_outcome_shares(
        respondents(spark, folder), population(spark, folder, *STRATA), STRATA, "past"
    )
    return shares.select("past", F.round("share", 8).alias("share"))


@query(
    "poststrat_estimator",
    f"""WITH {RESP_SQL},
m AS (SELECT {_STRATA_SQL}, avg(w0) AS y FROM resp GROUP BY ALL),
p AS (SELECT {_STRATA_SQL}, count(*) AS n FROM people GROUP BY ALL)
SELECT round(sum(n * y) / sum(n), 6) AS estimate FROM m JOIN p USING ({_STRATA_SQL})""",
)
def poststrat_estimator(spark, folder):
    result = stratified_mean(respondents(spark, folder), population(spark, folder, *STRATA), STRATA, "w0")
    return rounded(result, 6, "estimate")


@query(
    "poststratify_base_w",
    f"""WITH {RESP_SQL},
e AS (SELECT past, sum(w0) AS estimated FROM resp GROUP BY past),
p AS (SELECT past, count(*) AS n FROM people GROUP BY past)
SELECT id, round(w0 * n / estimated, 10) AS weight_ps FROM resp JOIN e USING (past) LEFT JOIN p USING (past)""",
)
def poststratify_base_w(spark, folder):
    weighted = poststratify_design(
        respondents(spark, folder), population(spark, folder, "past"), ("past",), "w0"
    )
    return weighted.select("id", F.round("weight_ps", 10).alias("weight_ps"))


@query(
    "empty_strata",
    f"""WITH {RESP_SQL},
p AS (SELECT nation, agegroup, past, count(*) AS n FROM people GROUP BY ALL)
SELECT nation, agegroup, past, n FROM p
WHERE NOT EXISTS (SELECT 1 FROM resp r WHERE r.nation = p.nation AND r.agegroup = p.agegroup AND r.past = p.past
                  AND r.status = 'F' AND r.intent = '1-URGENT')""",
)
def unrepresented_strata(spark, folder):
    """Population strata without an urgent, finished answer."""
    keys = ("nation", "agegroup", "past")
    answers = respondents(spark, folder).filter((F.col("status") == "F") & (F.col("intent") == "1-URGENT"))
    return empty_strata(strata_counts(answers, keys), population(spark, folder, *keys), keys)


def _raked_round_sql(number: int) -> str:
    parts = []
    for step, column in enumerate(("gender", "agegroup", "past")):
        source = f"r{number}_{step}"
        parts.append(
            f"""r{number}_{step + 1} AS (
  SELECT c.gender, c.agegroup, c.past, c.base, c.w * t.n / (sum(c.w) OVER (PARTITION BY c.{column})) AS w
  FROM {source} c JOIN (SELECT {column}, count(*) AS n FROM people GROUP BY {column}) t USING ({column}))"""
        )
    parts.append(f"r{number + 1}_0 AS (SELECT * FROM r{number}_3)")
    return ", ".join(parts)


@query(
    "rake_fixed_iter",
    f"""WITH {RESP_SQL},
r1_0 AS (SELECT gender, agegroup, past, CAST(count(*) AS DOUBLE) AS base, CAST(count(*) AS DOUBLE) AS w
         FROM resp GROUP BY gender, agegroup, past),
{_raked_round_sql(1)}, {_raked_round_sql(2)}, {_raked_round_sql(3)}
SELECT gender, agegroup, past, round(w, 6) AS total, round(w / base, 9) AS factor FROM r4_0""",
)
def rake_fixed_iter(spark, folder):
    """Three rounds of raking to three margins."""
    margins = {c: population(spark, folder, c) for c in STRATA}
    raked = rake_cells(respondents(spark, folder), margins, max_rounds=3, tolerance=None)
    return rounded(raked.cells, 6, "total").withColumn("factor", F.round("factor", 9))


@query(
    "rake_margins",
    f"""WITH {PEOPLE_SQL}
SELECT 'gender' AS margin, gender AS level, CAST(count(*) AS DOUBLE) AS total FROM people GROUP BY gender
UNION ALL SELECT 'agegroup', agegroup, CAST(count(*) AS DOUBLE) FROM people GROUP BY agegroup
UNION ALL SELECT 'past', past, CAST(count(*) AS DOUBLE) FROM people GROUP BY past""",
)
def rake_margins(spark, folder):
    """Raked to convergence, the weights of the respondents add up to every margin."""
    margins = {c: population(spark, folder, c) for c in STRATA}
    weighted = rake(respondents(spark, folder), margins, weight="w0")
    long = weighted.select("weight_rake", *STRATA).unpivot(["weight_rake"], list(STRATA), "margin", "level")
    return long.groupBy("margin", "level").agg(F.round(F.sum("weight_rake"), 3).alias("total"))


@query(
    "svymean_srs",
    "SELECT round(avg(o_totalprice), 6) AS mean, round(stddev_samp(o_totalprice) / sqrt(count(*)), 6) AS se FROM orders",
)
def svymean_srs(spark, folder):
    orders = table(spark, folder, "orders").select("o_totalprice")
    return rounded(design_mean(orders, "o_totalprice", Design()), 6, "mean", "se")


@query(
    "svymean_cluster",
    f"""WITH {RESP_SQL},
t AS (SELECT sum(w0) / count(*) AS mean, count(*) * 30.0 / 25 AS w FROM resp),
z AS (SELECT nation, sum(30.0 / 25 * (w0 - t.mean)) / any_value(t.w) AS z FROM resp, t GROUP BY nation)
SELECT round((SELECT mean FROM t), 6) AS mean,
       round(sqrt((1 - count(*) / 30.0) * count(*) / (count(*) - 1.0) * sum((z - zbar) * (z - zbar))), 6) AS se
FROM z, (SELECT avg(z) AS zbar FROM z)""",
)
def svymean_cluster(spark, folder):
    """25 nations sampled out of 30: weights follow from the sampling fraction."""
    sample = respondents(spark, folder).withColumn("fpc", F.lit(30))
    return rounded(design_mean(sample, "w0", Design(("nation",), ("fpc",))), 6, "mean", "se")


@query(
    "svymean_two_stage",
    f"""WITH {RESP_SQL},
n2 AS (SELECT nation, count(*) AS size2 FROM people GROUP BY nation),
s2 AS (SELECT nation, count(DISTINCT person) AS sampled FROM resp GROUP BY nation),
u AS (SELECT r.nation, r.person, r.w0 AS y, n2.size2, 30.0 / 25 * n2.size2 / s2.sampled AS w
      FROM resp r JOIN n2 USING (nation) JOIN s2 USING (nation)),
t AS (SELECT sum(w * y) / sum(w) AS mean, sum(w) AS w FROM u),
z2 AS (SELECT nation, person, any_value(size2) AS size2, sum(u.w * (y - t.mean)) / any_value(t.w) AS z
       FROM u, t GROUP BY nation, person),
z1 AS (SELECT nation, sum(z) AS z FROM z2 GROUP BY nation),
v1 AS (SELECT (1 - count(*) / 30.0) * count(*) / (count(*) - 1.0) * count(*) * var_pop(z) AS v FROM z1),
v2 AS (SELECT nation, (1 - count(*) * 1.0 / any_value(size2)) * count(*) / (count(*) - 1.0) * count(*) * var_pop(z) AS v
       FROM z2 GROUP BY nation)
SELECT round((SELECT mean FROM t), 6) AS mean,
       round(sqrt((SELECT v FROM v1) + 25 / 30.0 * (SELECT sum(v) FROM v2)), 6) AS se""",
)
def svymean_two_stage(spark, folder):
    """Nations, then people within nations."""
    sizes = people(spark, folder).groupBy("nation").agg(F.count(F.lit(1)).alias("size2"))
    sample = respondents(spark, folder).withColumn("size1", F.lit(30)).join(sizes, "nation")
    design = Design(("nation", "person"), ("size1", "size2"))
    return rounded(design_mean(sample, "w0", design), 6, "mean", "se")


@query(
    "svymean_poststrat",
    f"""WITH {RESP_SQL},
f AS (SELECT past, (SELECT count(*) FROM people p WHERE p.past = r.past) * 1.0 / count(*) AS w FROM resp r GROUP BY past),
u AS (SELECT nation, past, w0 AS y, w FROM resp JOIN f USING (past)),
m AS (SELECT past, sum(w * y) / sum(w) AS centre FROM u GROUP BY past),
t AS (SELECT sum(w * y) / sum(w) AS mean, sum(w) AS w FROM u),
z AS (SELECT nation, sum(u.w * (y - centre)) / any_value(t.w) AS z FROM u JOIN m USING (past), t GROUP BY nation)
SELECT round((SELECT mean FROM t), 6) AS mean,
       round(sqrt(count(*) / (count(*) - 1.0) * count(*) * var_pop(z)), 6) AS se FROM z""",
)
def svymean_poststrat(spark, folder):
    """Mean after post-stratification, residuals from the stratum means."""
    sample = respondents(spark, folder).withColumn("one", F.lit(1.0))
    weighted = poststratify_design(sample, population(spark, folder, "past"), ("past",), "one")
    result = design_mean(weighted, "w0", Design(("nation",), (), "weight_ps"), ("past",))
    return rounded(result, 6, "mean", "se")


@query(
    "nonresponse_bounds",
    f"""WITH {RESP_SQL},
a AS (SELECT gender, CASE status WHEN 'F' THEN 1 WHEN 'O' THEN 0 END AS answer FROM resp),
b AS (SELECT gender, count(answer) * 1.0 / count(*) AS response_rate, avg(answer) AS p_obs FROM a GROUP BY gender)
SELECT gender, round(response_rate, 9) AS response_rate, round(p_obs, 9) AS p_obs,
       round(response_rate * p_obs, 9) AS p_min,
       round(response_rate * p_obs + (1 - response_rate), 9) AS p_max FROM b""",
)
def bounds_under_nonresponse(spark, folder):
    answers = respondents(spark, folder).select(
        "gender", F.when(F.col("status") == "F", 1).when(F.col("status") == "O", 0).alias("answer")
    )
    return rounded(
        nonresponse_bounds(answers, ["gender"], "answer"), 9, "response_rate", "p_obs", "p_min", "p_max"
    )


@query(
    "turnout_rate",
    f"""WITH {RESP_SQL},
v AS (SELECT balance > 2200 AS of_age, nullif(past, 'BUILDING') AS vote FROM resp),
k AS (SELECT 'known' AS mode, count(*) FILTER (WHERE of_age AND vote = 'MACHINERY') AS no_vote,
             count(*) FILTER (WHERE of_age AND vote <> 'FURNITURE') AS able FROM v
      UNION ALL
      SELECT 'unknown_counts', count(*) FILTER (WHERE (of_age AND vote = 'MACHINERY') IS NOT FALSE),
             count(*) FILTER (WHERE (of_age AND vote <> 'FURNITURE') IS NOT FALSE) FROM v)
SELECT mode, no_vote, able, round(1 - no_vote * 1.0 / able, 9) AS turnout FROM k""",
)
def turnout(spark, folder):
    votes = respondents(spark, folder).select(
        (F.col("balance") > 2200).alias("of_age"), F.nullif(F.col("past"), F.lit("BUILDING")).alias("vote")
    )

    return rounded(turnout_rates(votes, "vote", F.col("of_age"), "MACHINERY", "FURNITURE"), 9, "turnout")


@query(
    "weighted_mean",
    f"""WITH {RESP_SQL},
v AS (SELECT intent, balance AS x, CASE WHEN status <> 'P' THEN w0 END AS w FROM resp)
SELECT intent, round(sum(w * x) / sum(w), 6) AS mean FROM v WHERE w IS NOT NULL GROUP BY intent""",
)
def weighted_means(spark, folder):
    frame = respondents(spark, folder).select(
        "intent", "balance", F.when(F.col("status") != "P", F.col("w0")).alias("w")
    )
    return frame.groupBy("intent").agg(
        F.round(weighted_mean(F.col("balance"), F.col("w")), 6).alias("mean")
    )


@query(
    "summary_stats",
    """WITH v AS (SELECT CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS x FROM orders)
SELECT min(x) AS min, round(avg(x), 6) AS mean, max(x) AS max, count(x) AS n,
       count(*) FILTER (WHERE x IS NULL) AS n_null,
       round(quantile_cont(x, 0.25), 6) AS q1, round(quantile_cont(x, 0.5), 6) AS median,
       round(quantile_cont(x, 0.75), 6) AS q3 FROM v""",
)
def summary_stats(spark, folder):
    prices = table(spark, folder, "orders").select(
        F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("x")
    )
    return rounded(summary_statistics(prices, "x"), 6, "mean", "q1", "median", "q3")


@query(
    "estimates_by_method",
    f"""WITH {RESP_SQL}, {_weights_sql(_STRATA_SQL)},
x AS (
  SELECT 'unweighted' AS method, intent, count(*) AS n FROM resp WHERE intent <> '{NO_VOTE}' GROUP BY intent
  UNION ALL
  SELECT 'weighted', intent, sum(weight) FROM resp LEFT JOIN w USING ({_STRATA_SQL})
  WHERE intent <> '{NO_VOTE}' GROUP BY intent
  UNION ALL
  SELECT 'likely voters', intent, sum(weight) FROM resp LEFT JOIN w USING ({_STRATA_SQL})
  WHERE intent <> '{NO_VOTE}' AND turnout = 1 GROUP BY intent)
SELECT method, intent, round(n, 6) AS n, round(100 * n / sum(n) OVER (PARTITION BY method), 8) AS share FROM x""",
)
def estimates_by_method(spark, folder):
    """Unweighted, weighted and likely-voter estimates stacked in one table."""
    voting = F.col("intent") != NO_VOTE
    methods = {
        "unweighted": (False, voting),
        "weighted": (True, voting),
        "likely voters": (True, voting & (F.col("turnout") == 1)),
    }
    shares = outcome_shares_by_method(
        respondents(spark, folder), population(spark, folder, *STRATA), STRATA, "intent", methods
    )
    return rounded(shares, 6, "n").withColumn("share", F.round("share", 8))
