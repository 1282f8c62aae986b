"""Registered queries: strata, tables, shares."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import safe_ratio
from ..operators.evaluate import mean_measures, result_table, rmse_against
from ..operators.reshape import add_residual, flip, to_long, to_wide
from ..operators.strata import (
    collapse_strata,
    complete_strata,
    cross_shares,
    crosstab,
    expand_strata,
    joint_share,
    proportions,
    ratio_to_row,
    share_of_total,
    split_category,
    strata_counts,
    sum_measures,
)
from ..operators.sizing import settle
from .queries_weighting import rounded
from .registry import query
from .views import INTENT_LEVELS, PAST_LEVELS, PEOPLE_SQL, RESP_SQL, STRATA, people, respondents, table


@query("strata_counts", f"WITH {RESP_SQL} SELECT gender, agegroup, past, count(*) AS n FROM resp GROUP BY ALL")
def counts(spark, folder):
    return strata_counts(respondents(spark, folder), STRATA)


_PENDING_UNWEIGHTED = "CASE WHEN status <> 'P' THEN w0 END"


@query(
    "weighted_counts",
    f"""WITH {RESP_SQL}
SELECT status, past, round(coalesce(sum({_PENDING_UNWEIGHTED}), 0), 4) AS n FROM resp GROUP BY ALL""",
)
def weighted_counts(spark, folder):
    """Groups whose weights are all NULL count 0."""
    sample = respondents(spark, folder).withColumn("w", F.when(F.col("status") != "P", F.col("w0")))
    return rounded(strata_counts(sample, ["status", "past"], "w"), 4, "n")


@query(
    "share_of_total",
    """WITH c AS (SELECT o_orderpriority AS intent, count(*) AS n FROM orders GROUP BY ALL)
SELECT intent, n, round(100.0 * n / (SELECT sum(n) FROM c), 9) AS share FROM c""",
)
def shares(spark, folder):
    answers = table(spark, folder, "orders").select(F.col("o_orderpriority").alias("intent"))
    return rounded(share_of_total(strata_counts(answers, ["intent"])), 9, "share")


@query(
    "sum_all",
    f"""WITH {RESP_SQL}
SELECT past, agegroup, round(sum(w0), 3) AS w0_skip,
       round(CASE WHEN count(*) = count(nullif(nation, 7)) THEN CAST(sum(nullif(nation, 7)) AS DOUBLE) END, 3) AS nation_propagate
FROM resp GROUP BY past, agegroup""",
)
def sums(spark, folder):
    """One measure skips NULL, the other is NULL as soon as one value is."""
    sample = respondents(spark, folder).withColumns(
        {"w0_skip": F.col("w0"), "nation_propagate": F.nullif(F.col("nation"), F.lit(7)).cast("double")}
    )
    policies = {"w0_skip": "skip", "nation_propagate": "propagate"}
    return rounded(sum_measures(sample, ["past", "agegroup"], list(policies), policies), 3, *policies)


@query(
    "strata_densify",
    f"""WITH {RESP_SQL},
c AS (SELECT nation, agegroup, past, count(*) AS n FROM resp GROUP BY ALL)
SELECT a.nation, b.agegroup, d.past, coalesce(c.n, 0) AS n
FROM (SELECT DISTINCT nation FROM c) a, (SELECT DISTINCT agegroup FROM c) b, (SELECT DISTINCT past FROM c) d
LEFT JOIN c ON c.nation = a.nation AND c.agegroup = b.agegroup AND c.past = d.past""",
)
def densified(spark, folder):
    keys = ["nation", "agegroup", "past"]
    return complete_strata(strata_counts(respondents(spark, folder), keys), keys)


_OLD = {"46-60": "45Plus", "60+": "45Plus"}


@query(
    "strata_collapse",
    f"""WITH {RESP_SQL}
SELECT gender, CASE WHEN agegroup IN ('46-60', '60+') THEN '45Plus' ELSE agegroup END AS agegroup,
       past, count(*) AS n FROM resp GROUP BY ALL""",
)
def collapsed(spark, folder):
    return collapse_strata(strata_counts(respondents(spark, folder), STRATA), "agegroup", _OLD).select(*STRATA, "n")


@query(
    "strata_expand",
    f"""WITH {RESP_SQL},
c AS (SELECT gender, CASE WHEN agegroup IN ('46-60', '60+') THEN '45Plus' ELSE agegroup END AS agegroup,
             past, count(*) AS n FROM resp GROUP BY ALL)
SELECT gender, agegroup, past, n FROM c WHERE agegroup <> '45Plus'
UNION ALL SELECT gender, '46-60', past, n FROM c WHERE agegroup = '45Plus'
UNION ALL SELECT gender, '60+', past, n FROM c WHERE agegroup = '45Plus'""",
)
def expanded(spark, folder):
    merged = collapsed(spark, folder)
    return expand_strata(merged, "agegroup", "45Plus", ["46-60", "60+"])


@query(
    "category_split",
    f"""WITH {RESP_SQL},
c AS (SELECT gender, past, count(*) AS n, sum(w0) AS w0 FROM resp GROUP BY ALL),
r AS (SELECT (SELECT count(*) FROM people WHERE past = 'BUILDING') * 1.0
             / (SELECT count(*) FROM people WHERE past IN ('BUILDING', 'MACHINERY')) AS r)
SELECT gender, past, round(n, 6) AS n, round(w0, 3) AS w0 FROM c WHERE past <> 'MACHINERY'
UNION ALL SELECT gender, 'MACHINERY', round(n * (1 - r), 6), round(w0 * (1 - r), 3) FROM c, r WHERE past = 'MACHINERY'
UNION ALL SELECT gender, 'NEW', round(n * r, 6), round(w0 * r, 3) FROM c, r WHERE past = 'MACHINERY'""",
)
def split(spark, folder):
    """Part of one category becomes a new one; the ratio is read from the population."""
    measured = respondents(spark, folder).groupBy("gender", "past").agg(
        F.count(F.lit(1)).alias("n"), F.sum("w0").alias("w0")
    )
    ratio = (
        people(spark, folder)
        .agg(
            safe_ratio(
                F.count_if(F.col("past") == "BUILDING"), F.count_if(F.col("past").isin("BUILDING", "MACHINERY"))
            ).alias("r")
        )
        .scalar()
    )
    parts = split_category(measured, "past", "MACHINERY", "NEW", ratio, ["n", "w0"])
    return rounded(parts, 6, "n").withColumn("w0", F.round("w0", 3))


@query(
    "crosstab_dense",
    f"""WITH {RESP_SQL}
SELECT past, {", ".join(f"count(*) FILTER (WHERE intent = '{x}') AS \"{x}\"" for x in INTENT_LEVELS)}
FROM (SELECT nullif(past, 'BUILDING') AS past, intent FROM resp) WHERE past IS NOT NULL GROUP BY past""",
)
def contingency(spark, folder):
    answers = respondents(spark, folder).select(F.nullif(F.col("past"), F.lit("BUILDING")).alias("past"), "intent")
    return crosstab(answers, "past", "intent", INTENT_LEVELS)


@query(
    "prop_table",
    f"""WITH {PEOPLE_SQL}, c AS (SELECT nullif(past, 'BUILDING') AS past, count(*) AS n FROM people GROUP BY ALL)
SELECT past, n, round(n * 1.0 / (SELECT sum(n) FROM c), 9) AS prop FROM c""",
)
def proportion_table(spark, folder):
    answers = people(spark, folder).select(F.nullif(F.col("past"), F.lit("BUILDING")).alias("past"))
    return rounded(proportions(answers, "past", keep_null=True), 9, "prop")


@query(
    "xtab_weighted",
    f"""WITH {RESP_SQL}, c AS (SELECT agegroup, intent, sum(w0) AS n FROM resp GROUP BY ALL)
SELECT agegroup, intent, round(n, 3) AS n, round(100 * n / sum(n) OVER (PARTITION BY agegroup), 8) AS share FROM c""",
)
def cross_table(spark, folder):
    return rounded(
        cross_shares(respondents(spark, folder), "agegroup", "intent", "row", "w0"), 3, "n"
    ).withColumn("share", F.round("share", 8))


@query(
    "joint_from_conditional",
    f"""WITH {RESP_SQL},
a AS (SELECT gender, agegroup, 100.0 * count(*) / sum(count(*)) OVER (PARTITION BY gender) AS share
      FROM resp GROUP BY gender, agegroup),
g AS (SELECT gender, count(*) * 1.0 / (SELECT count(*) FROM people) AS gender_share FROM people GROUP BY gender)
SELECT gender, agegroup, round(share, 8) AS share, round(gender_share, 9) AS gender_share,
       round(share / 100 * gender_share, 9) AS joint FROM a JOIN g USING (gender)""",
)
def joint(spark, folder):
    """Age share within gender times the share of the gender."""
    ages = cross_shares(respondents(spark, folder), "gender", "agegroup", "row").drop("n")
    genders = share_of_total(strata_counts(people(spark, folder), ["gender"]), name="gender_share", scale=1.0)
    result = joint_share(ages, genders.drop("n"), ["gender"], "share", "gender_share", "joint")
    return rounded(result, 8, "share").withColumns({c: F.round(c, 9) for c in ("gender_share", "joint")})


@query(
    "scalar_ratio",
    f"""WITH {RESP_SQL},
t AS (SELECT coalesce(gender, 'Total') AS gender, count(*) AS eligible, count(*) FILTER (WHERE turnout = 1) AS voters
      FROM resp GROUP BY GROUPING SETS ((gender), ()))
SELECT gender, eligible, voters, round(voters * 1.0 / (SELECT eligible FROM t WHERE gender = 'Total'), 9) AS turnout_overall,
       round(voters * 1.0 / (SELECT voters FROM t WHERE gender = 'Total'), 9) AS turnout_gender FROM t""",
)
def turnout_by_gender(spark, folder):
    """Ratios to the cells of the Total row."""
    base = respondents(spark, folder).select("gender", "turnout")
    measures = [F.count(F.lit(1)).alias("eligible"), F.count_if(F.col("turnout") == 1).alias("voters")]
    by_gender = base.groupBy("gender").agg(*measures)
    by_gender = settle(by_gender)
    total = by_gender.agg(F.sum("eligible").alias("eligible"), F.sum("voters").alias("voters")).withColumn(
        "gender", F.lit("Total")
    )
    rows = settle(by_gender.unionByName(total))
    is_total = F.col("gender") == "Total"
    rows = ratio_to_row(rows, "voters", "eligible", is_total, "turnout_overall")
    rows = ratio_to_row(rows, "voters", "voters", is_total, "turnout_gender")
    return rounded(rows, 9, "turnout_overall", "turnout_gender")


@query(
    "mean_incl_date",
    f"""WITH {RESP_SQL}
SELECT wave, intent, CAST(DATE '1970-01-01' + CAST(floor(avg(datediff('day', DATE '1970-01-01', day))) AS INTEGER) AS DATE) AS day,
       round(avg(w0), 6) AS w0 FROM resp GROUP BY wave, intent""",
)
def means(spark, folder):
    return rounded(mean_measures(respondents(spark, folder), ["wave", "intent"], ["day", "w0"]), 6, "w0")


# Shares per (method, wave, party): the order status is the method, the order year the wave.
_EST_SQL = """c AS (SELECT o_orderstatus AS method, CAST(year(o_orderdate) AS INTEGER) AS date, o_orderpriority AS party,
             count(*) AS n FROM orders GROUP BY ALL),
est AS (SELECT method, date, party, 100.0 * n / sum(n) OVER (PARTITION BY method, date) AS pct FROM c)"""


def estimates(spark, folder) -> DataFrame:
    answers = table(spark, folder, "orders").select(
        F.col("o_orderstatus").alias("method"),
        F.year("o_orderdate").alias("date"),
        F.col("o_orderpriority").alias("party"),
    )
    counted = strata_counts(answers, ["method", "date", "party"])
    return share_of_total(counted, name="pct", within=["method", "date"]).drop("n")


_PCT_COLUMNS = ", ".join(f"round(max(pct) FILTER (WHERE party = '{x}'), 8) AS \"{x}\"" for x in INTENT_LEVELS)


@query(
    "rmse_vs_reference",
    f"""WITH {_EST_SQL}
SELECT e.method, e.date, round(sqrt(avg((e.pct - r.pct) * (e.pct - r.pct))), 8) AS rmse, count(*) AS parties
FROM est e JOIN est r ON r.method = 'F' AND r.date = e.date AND r.party = e.party GROUP BY e.method, e.date""",
)
def rmse(spark, folder):
    return rounded(rmse_against(estimates(spark, folder), "F"), 8, "rmse")


@query(
    "residual_category",
    f"""WITH {_EST_SQL}
SELECT method, date, party, round(pct, 8) AS pct FROM est WHERE party <> '5-LOW'
UNION ALL SELECT method, date, 'Other', round(100 - sum(pct), 8) FROM est WHERE party <> '5-LOW' GROUP BY method, date""",
)
def residual(spark, folder):
    """The fifth category is not reported and is filled up as the rest."""
    reported = estimates(spark, folder).filter(F.col("party") != "5-LOW")
    return rounded(add_residual(reported, ["method", "date"], "party", "pct"), 8, "pct")


@query(
    "result_table",
    f"""WITH {_EST_SQL},
s AS (SELECT e.method, e.date, sqrt(avg((e.pct - r.pct) * (e.pct - r.pct))) AS rmse
      FROM est e JOIN est r ON r.method = 'F' AND r.date = e.date AND r.party = e.party GROUP BY e.method, e.date)
SELECT CASE method WHEN 'F' THEN 'Rolling average' WHEN 'O' THEN 'Unweighted' ELSE 'Weighted' END AS "Method",
       date AS "Date", {_PCT_COLUMNS.replace(", 8)", ", 1)")}, round(any_value(rmse), 8) AS "RMSE"
FROM est JOIN s USING (method, date) GROUP BY method, date""",
)
def presented(spark, folder):
    found = settle(estimates(spark, folder))
    labels = {"^F": "Rolling average", "^O": "Unweighted", "^P": "Weighted"}
    return rounded(result_table(found, rmse_against(found, "F"), INTENT_LEVELS, labels), 8, "RMSE")


@query("pivot_shares", f"WITH {_EST_SQL} SELECT method, date, {_PCT_COLUMNS} FROM est GROUP BY method, date")
def wide_shares(spark, folder):
    value = F.round(F.max("pct"), 8)
    return to_wide(estimates(spark, folder), ["method", "date"], "party", INTENT_LEVELS, value)


@query("unpivot_shares", f"WITH {_EST_SQL} SELECT method, date, party, round(pct, 8) AS pct FROM est")
def long_shares(spark, folder):
    """Wide and back to long."""
    wide = to_wide(estimates(spark, folder), ["method", "date"], "party", INTENT_LEVELS, F.max("pct"))
    return rounded(to_long(wide, ["method", "date"], INTENT_LEVELS, "party", "pct"), 8, "pct")


@query(
    "transpose_table",
    f"""WITH {RESP_SQL}, c AS (SELECT past, count(*) AS n, sum(w0) AS w0 FROM resp GROUP BY past)
SELECT 'n' AS measure, {", ".join(f"round(max(n) FILTER (WHERE past = '{x}'), 3) AS \"{x}\"" for x in PAST_LEVELS)} FROM c
UNION ALL
SELECT 'w0', {", ".join(f"round(max(w0) FILTER (WHERE past = '{x}'), 3)" for x in PAST_LEVELS)} FROM c""",
)
def transposed(spark, folder):
    """First column becomes the header, the measures become rows."""
    measured = respondents(spark, folder).groupBy("past").agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.sum("w0").alias("w0")
    )
    return rounded(flip(measured, "past", PAST_LEVELS, "measure"), 3, *PAST_LEVELS)
