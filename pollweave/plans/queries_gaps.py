"""Registered queries on data with gaps: NULL keys and values, shifted values, margins that contradict each other."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators.estimate import Design, design_mean, summary_statistics, with_design_weight
from ..operators.impute import impute_stochastic, regression_summary
from ..operators.polls import latest_per_source, rolling_error, rolling_mean, with_errors
from ..operators.strata import complete_strata, strata_counts
from ..operators.weighting import (
    empty_strata,
    margin_gaps,
    poststratify,
    poststratify_design,
    rake,
    rake_cells,
    weighted_outcome_shares,
)
from .queries_weighting import rounded
from .registry import query
from .views import PEOPLE_SQL, POLLS_SQL, RESP_SQL, STRATA, people, polls, population, respondents, table

GAP = "BUILDING"
_KEYS = "gender, agegroup, past"
_GAPS_SQL = f"""{RESP_SQL},
gp AS (SELECT * REPLACE (nullif(past, '{GAP}') AS past) FROM people),
gr AS (SELECT * REPLACE (nullif(past, '{GAP}') AS past) FROM resp)"""


def _gaps(df: DataFrame) -> DataFrame:
    return df.withColumn("past", F.nullif(F.col("past"), F.lit(GAP)))


def _same(a: str, b: str, *keys: str) -> str:
    return " AND ".join(f"{a}.{k} IS NOT DISTINCT FROM {b}.{k}" for k in keys)


@query(
    "strata_densify_null",
    f"""WITH {_GAPS_SQL},
c AS (SELECT nation, agegroup, past, count(*) AS n FROM gr WHERE intent = '1-URGENT' GROUP BY ALL)
SELECT a.nation, b.agegroup, d.past, coalesce(c.n, 0) AS n
FROM (SELECT DISTINCT nation FROM c) a, (SELECT DISTINCT agegroup FROM c) b, (SELECT DISTINCT past FROM c) d
LEFT JOIN c ON c.nation = a.nation AND c.agegroup = b.agegroup AND c.past IS NOT DISTINCT FROM d.past""",
)
def densified_with_gaps(spark, folder):
    keys = ["nation", "agegroup", "past"]
    answers = _gaps(respondents(spark, folder)).filter("intent = '1-URGENT'")
    return complete_strata(strata_counts(answers, keys), keys)


_NULL_WEIGHTS_SQL = f"""s AS (SELECT {_KEYS}, count(*) AS n FROM gr GROUP BY ALL),
p AS (SELECT {_KEYS}, count(*) AS n FROM gp GROUP BY ALL),
w AS (SELECT p.gender, p.agegroup, p.past, (100.0 * p.n / (SELECT sum(n) FROM p)) / (100.0 * s.n / (SELECT sum(n) FROM s)) AS weight
      FROM p LEFT JOIN s ON {_same("p", "s", *STRATA)})"""


@query(
    "poststratify_null_key",
    f"""WITH {_GAPS_SQL}, {_NULL_WEIGHTS_SQL}
SELECT id, round(weight, 9) AS weight FROM gr LEFT JOIN w ON {_same("gr", "w", *STRATA)}""",
)
def poststratify_null_key(spark, folder):
    census = strata_counts(_gaps(people(spark, folder)), STRATA)
    return poststratify(_gaps(respondents(spark, folder)), census, STRATA).select("id", F.round("weight", 9).alias("weight"))


@query(
    "poststratify_shares_null_key",
    f"""WITH {_GAPS_SQL}, {_NULL_WEIGHTS_SQL},
x AS (SELECT intent, sum(weight) AS n FROM gr LEFT JOIN w ON {_same("gr", "w", *STRATA)} GROUP BY intent)
SELECT intent, round(n, 6) AS n, round(100 * n / (SELECT sum(n) FROM x), 8) AS share FROM x""",
)
def shares_null_key(spark, folder):
    census = strata_counts(_gaps(people(spark, folder)), STRATA)
    shares = weighted_outcome_shares(_gaps(respondents(spark, folder)), census, STRATA, "intent")
    return rounded(shares, 6, "n").withColumn("share", F.round("share", 8))


@query(
    "poststratify_base_w_null",
    f"""WITH {_GAPS_SQL},
e AS (SELECT past, sum(w0) AS estimated FROM gr GROUP BY past),
p AS (SELECT past, count(*) AS n FROM gp GROUP BY past)
SELECT id, round(w0 * n / estimated, 10) AS weight_ps
FROM gr JOIN e ON {_same("gr", "e", "past")} LEFT JOIN p ON {_same("gr", "p", "past")}""",
)
def poststratify_base_w_null(spark, folder):
    census = strata_counts(_gaps(people(spark, folder)), ("past",))
    weighted = poststratify_design(_gaps(respondents(spark, folder)), census, ("past",), "w0")
    return weighted.select("id", F.round("weight_ps", 10).alias("weight_ps"))


@query(
    "empty_strata_null",
    f"""WITH {_GAPS_SQL},
p AS (SELECT nation, agegroup, past, count(*) AS n FROM gp GROUP BY ALL)
SELECT nation, agegroup, past, n FROM p
WHERE NOT EXISTS (SELECT 1 FROM gr r WHERE {_same("r", "p", "nation", "agegroup", "past")} AND r.status = 'F' AND r.intent = '1-URGENT')""",
)
def unrepresented_with_gaps(spark, folder):
    keys = ("nation", "agegroup", "past")
    answers = _gaps(respondents(spark, folder)).filter((F.col("status") == "F") & (F.col("intent") == "1-URGENT"))
    return empty_strata(strata_counts(answers, keys), strata_counts(_gaps(people(spark, folder)), keys), keys)


@query(
    "rake_margin_gap",
    f"""WITH {PEOPLE_SQL},
g AS (SELECT gender AS level, CAST(count(*) AS DOUBLE) AS n FROM people GROUP BY gender),
p AS (SELECT past AS level, 0.75 * count(*) AS n FROM people GROUP BY past)
SELECT 'gender' AS margin, level, round(n, 4) AS target, round(0.75 * n, 4) AS fitted, 0.25::DOUBLE AS gap FROM g
UNION ALL SELECT 'past', level, round(n, 4), round(n, 4), 0::DOUBLE FROM p""",
)
def rake_margin_gap(spark, folder):
    """Margins with different totals: the last one is met, the other is missed by the same share everywhere."""
    margins = {
        "gender": population(spark, folder, "gender"),
        "past": population(spark, folder, "past").selectExpr("past", "0.75D * n AS n"),
    }
    raked = rake_cells(respondents(spark, folder), margins)
    return rounded(margin_gaps(raked, margins), 4, "target", "fitted").withColumn("gap", F.round("gap", 6))


@query(
    "rake_boundary",
    f"""WITH {PEOPLE_SQL}, n AS (SELECT gender, count(*) AS n FROM people GROUP BY gender)
SELECT 'Female' AS gender, 'a' AS side, 0.0::DOUBLE AS total, true AS vanishes
UNION ALL SELECT 'Female', 'b', n::DOUBLE, false FROM n WHERE gender = 'Female'
UNION ALL SELECT 'Male', 'a', n::DOUBLE, false FROM n WHERE gender = 'Male'""",
)
def rake_boundary(spark, folder):
    """No man answered on side b, whose target equals that of the women: only an empty cell (women, a) meets the margins."""
    side = F.when(F.col("past").isin("AUTOMOBILE", "BUILDING"), "a").otherwise("b")
    answers = respondents(spark, folder).withColumn("side", side).where("NOT (gender = 'Male' AND side = 'b')")
    gender = population(spark, folder, "gender")
    margins = {"gender": gender, "side": gender.selectExpr("IF(gender = 'Male', 'a', 'b') AS side", "n")}
    raked = rake_cells(answers, margins)
    empty = raked.vanishing.selectExpr("gender", "side", "true AS vanishes")
    cells = raked.cells.join(empty, ["gender", "side"], "left")
    return cells.select("gender", "side", F.round("total", 3).alias("total"), F.coalesce("vanishes", F.lit(False)).alias("vanishes"))


@query(
    "svymean_srs_shifted",
    """SELECT round(avg(o_totalprice) + 1e9, 3) AS mean, round(stddev_samp(o_totalprice) / sqrt(count(*)), 6) AS se FROM orders""",
)
def svymean_srs_shifted(spark, folder):
    """A large constant on every value moves the mean and leaves the error alone."""
    orders = table(spark, folder, "orders").selectExpr("o_totalprice + 1e9D AS y")
    return rounded(design_mean(orders, "y", Design()), 3, "mean").withColumn("se", F.round("se", 6))


@query(
    "svymean_weighted_shifted",
    f"""WITH {RESP_SQL},
f AS (SELECT past, (SELECT count(*) FROM people p WHERE p.past = r.past) / sum(1.0 + id % 5) AS f FROM resp r GROUP BY past),
u AS (SELECT r.past, w0 AS y, (1.0 + id % 5) * f AS w FROM resp r JOIN f USING (past)),
m AS (SELECT past, sum(w * y) / sum(w) AS centre FROM u GROUP BY past)
SELECT round(sum(w * y) / sum(w) + 1e9, 3) AS mean,
       round(sqrt(count(*) / (count(*) - 1.0) * sum(w * w * (y - centre) * (y - centre))) / sum(w), 4) AS se
FROM u JOIN m USING (past)""",
)
def svymean_weighted_shifted(spark, folder):
    """The same with weights and post-strata."""
    sample = respondents(spark, folder).selectExpr("past", "w0 + 1e9D AS y", "1.0D + id % 5 AS w")
    weighted = poststratify_design(sample, population(spark, folder, "past"), ("past",), "w")
    result = design_mean(weighted, "y", Design((), (), "weight_ps"), ("past",))
    return rounded(result, 3, "mean").withColumn("se", F.round("se", 4))


def _rake_sql(rounds: int) -> str:
    """Cells of (gender, past), raked in turn; and the additive fit of the value, whose only free coefficient is that of one gender within past."""
    steps = ["k0 AS (SELECT gender, past, CAST(count(*) AS DOUBLE) AS w FROM resp GROUP BY gender, past)"]
    for n in range(2 * rounds):
        column = ("gender", "past")[n % 2]
        steps.append(
            f"k{n + 1} AS (SELECT c.gender, c.past, c.w * t.n / sum(c.w) OVER (PARTITION BY c.{column}) AS w "
            f"FROM k{n} c JOIN (SELECT {column}, count(*) AS n FROM people GROUP BY {column}) t USING ({column}))"
        )
    steps.append(
        f"v AS (SELECT r.gender, r.past, any_value(k.w) AS w, avg(r.w0) AS y, CASE WHEN r.gender = 'Male' THEN 1.0 ELSE 0.0 END AS x FROM resp r JOIN k{2 * rounds} k USING (gender, past) GROUP BY r.gender, r.past)"
    )
    steps.append("m AS (SELECT past, sum(w * y) / sum(w) AS ym, sum(w * x) / sum(w) AS xm FROM v GROUP BY past)")
    steps.append("b AS (SELECT sum(w * (x - xm) * (y - ym)) / sum(w * (x - xm) * (x - xm)) AS b FROM v JOIN m USING (past))")
    steps.append("e AS (SELECT gender, past, w, ym + b * (x - xm) AS c FROM v JOIN m USING (past), b)")
    return ",\n".join(steps)


@query(
    "svymean_raked",
    f"""WITH {RESP_SQL}, {_rake_sql(12)},
n AS (SELECT gender, past, count(*) AS n FROM resp GROUP BY gender, past),
u AS (SELECT r.nation, r.w0 AS y, e.w / n.n AS w, e.c FROM resp r JOIN e USING (gender, past) JOIN n USING (gender, past)),
t AS (SELECT sum(w * y) / sum(w) AS mean, sum(w) AS w FROM u),
z AS (SELECT nation, sum(u.w * (y - c)) / any_value(t.w) AS z FROM u, t GROUP BY nation)
SELECT round((SELECT mean FROM t), 5) AS mean, round(sqrt(count(*) / (count(*) - 1.0) * count(*) * var_pop(z)), 5) AS se FROM z""",
)
def svymean_raked(spark, folder):
    """Mean and error after raking: residuals from the additive fit of the margins."""
    margins = {c: population(spark, folder, c) for c in ("gender", "past")}
    weighted = rake(respondents(spark, folder), margins, tolerance=1e-10)
    result = design_mean(weighted, "w0", Design(("nation",), (), "weight_rake"), margins=("gender", "past"))
    return rounded(result, 5, "mean", "se")


@query(
    "svymean_two_stage_poststrat",
    f"""WITH {RESP_SQL},
n2 AS (SELECT nation, count(*) AS size2 FROM people GROUP BY nation),
s2 AS (SELECT nation, count(DISTINCT person) AS sampled FROM resp GROUP BY nation),
d AS (SELECT r.nation, r.person, r.past, r.w0 AS y, n2.size2, 30.0 / 25 * n2.size2 / s2.sampled AS w
      FROM resp r JOIN n2 USING (nation) JOIN s2 USING (nation)),
f AS (SELECT past, (SELECT count(*) FROM people p WHERE p.past = d.past) / sum(w) AS f FROM d GROUP BY past),
u AS (SELECT nation, person, past, y, size2, w * f AS w FROM d JOIN f USING (past)),
m AS (SELECT past, sum(w * y) / sum(w) AS centre FROM u GROUP BY past),
t AS (SELECT sum(w * y) / sum(w) AS mean, sum(w) AS w FROM u),
z2 AS (SELECT nation, person, any_value(size2) AS size2, sum(u.w * (y - centre)) / any_value(t.w) AS z
       FROM u JOIN m USING (past), t GROUP BY nation, person),
z1 AS (SELECT nation, sum(z) AS z FROM z2 GROUP BY nation),
v1 AS (SELECT (1 - count(*) / 30.0) * count(*) / (count(*) - 1.0) * count(*) * var_pop(z) AS v FROM z1),
v2 AS (SELECT nation, (1 - count(*) * 1.0 / any_value(size2)) * count(*) / (count(*) - 1.0) * count(*) * var_pop(z) AS v
       FROM z2 GROUP BY nation)
SELECT round((SELECT mean FROM t), 5) AS mean, round(sqrt((SELECT v FROM v1) + 25 / 30.0 * (SELECT sum(v) FROM v2)), 5) AS se""",
)
def svymean_two_stage_poststrat(spark, folder):
    """Two stages with population sizes, weights post-stratified."""
    sizes = people(spark, folder).groupBy("nation").agg(F.count(F.lit(1)).alias("size2"))
    sample = respondents(spark, folder).withColumn("size1", F.lit(30)).join(sizes, "nation")
    sampled = sample.agg(F.count_distinct("nation")).scalar()
    design = Design(("nation", "person"), ("size1", "size2"))
    weighted = with_design_weight(sample, design).withColumn("design_weight", F.col("design_weight") * sampled / 25)
    adjusted = poststratify_design(weighted, population(spark, folder, "past"), ("past",), "design_weight")
    result = design_mean(adjusted, "w0", Design(design.clusters, design.populations, "weight_ps"), ("past",))
    return rounded(result, 5, "mean", "se")


_GAP_POLLS_SQL = POLLS_SQL.replace("polls AS", "polls0 AS") + """, polls AS (
  SELECT * REPLACE (CASE WHEN event_id % 7 = 0 THEN NULL ELSE anteil END AS anteil) FROM polls0),
err AS (SELECT *, round(1.96 * sqrt(anteil * (1 - anteil) / befragte), 5) AS delta FROM polls)"""


def _gap_polls(spark, folder):
    return polls(spark, folder).withColumn("anteil", F.when(F.col("event_id") % 7 != 0, F.col("anteil")))


@query(
    "rolling_mean10_null",
    f"""WITH {_GAP_POLLS_SQL}, d AS (SELECT DISTINCT partei, datum, befragte, anteil FROM polls),
w AS (SELECT *, avg(anteil) OVER t AS m, count(anteil) OVER t AS k FROM d
      WINDOW t AS (PARTITION BY partei ORDER BY datum, befragte, anteil NULLS LAST ROWS BETWEEN 9 PRECEDING AND CURRENT ROW))
SELECT partei, datum, befragte, anteil, CASE WHEN k = 10 THEN round(m, 9) END AS rolling_average FROM w""",
)
def rolling_mean10_null(spark, folder):
    """A window with a missing share has no mean."""
    return rounded(rolling_mean(_gap_polls(spark, folder)), 9, "rolling_average")


@query(
    "rolling_gauss_error_null",
    f"""WITH {_GAP_POLLS_SQL}, d AS (SELECT DISTINCT partei, datum, delta FROM err),
w AS (SELECT *, sqrt(sum(delta * delta) OVER t) / 10 AS e, count(delta) OVER t AS k FROM d
      WINDOW t AS (PARTITION BY partei ORDER BY datum, delta NULLS LAST ROWS BETWEEN 9 PRECEDING AND CURRENT ROW))
SELECT partei, datum, delta, CASE WHEN k = 10 THEN round(e, 9) END AS rolling_error FROM w""",
)
def rolling_gauss_error_null(spark, folder):
    return rounded(rolling_error(with_errors(_gap_polls(spark, folder), digits=5)), 9, "rolling_error")


@query(
    "latest_poll_avg_null",
    f"""WITH {_GAP_POLLS_SQL},
base AS (SELECT DISTINCT institut, datum, partei, anteil, befragte FROM polls WHERE anteil IS NOT NULL),
points AS (SELECT DISTINCT partei, datum FROM base),
seen AS (SELECT points.partei, points.datum, b.anteil, b.befragte,
                rank() OVER (PARTITION BY points.partei, points.datum, b.institut ORDER BY b.datum DESC) AS age
         FROM points JOIN base b ON b.partei = points.partei AND b.datum <= points.datum)
SELECT partei, datum, round(sum(befragte * anteil) / sum(befragte), 8) AS rolling_average FROM seen WHERE age = 1 GROUP BY partei, datum""",
)
def latest_poll_avg_null(spark, folder):
    """Polls without a share are left out before the latest one is looked for."""
    found = latest_per_source(
        _gap_polls(spark, folder), {"rolling_average": ("anteil", "linear")}, distinct_on=("institut", "datum", "partei", "anteil", "befragte")
    )
    return rounded(found, 8, "rolling_average")


_LINES_SQL = """v AS (SELECT l_orderkey, l_linenumber, l_quantity AS x, l_discount AS b,
  CASE WHEN l_returnflag <> 'N' THEN l_extendedprice END AS y FROM lineitem)"""


def _line_rows(spark, folder):
    return table(spark, folder, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber", "l_quantity AS x", "l_discount AS b", "IF(l_returnflag != 'N', l_extendedprice, NULL) AS y"
    )


_NOISE_SQL = """md5('1997|' || l_orderkey || '|' || l_linenumber) AS h"""


@query(
    "impute_stochastic",
    f"""WITH {_LINES_SQL},
fit AS (SELECT regr_slope(y, x) AS s, regr_intercept(y, x) AS i, sqrt((regr_syy(y, x) - regr_slope(y, x) * regr_sxy(y, x)) / (regr_count(y, x) - 2)) AS sigma FROM v),
u AS (SELECT *, (CAST('0x' || substr(h, 1, 12) AS BIGINT) + 0.5) / 281474976710656.0 AS u1,
        (CAST('0x' || substr(h, 13, 12) AS BIGINT) + 0.5) / 281474976710656.0 AS u2 FROM (SELECT *, {_NOISE_SQL} FROM v))
SELECT l_orderkey, l_linenumber, x, y, round(coalesce(y, i + s * x + sqrt(-2 * ln(u1)) * cos(2 * pi() * u2) * sigma / 20), 4) AS y_imp FROM u, fit""",
)
def fill_stochastic(spark, folder):
    """Noise from a digest of the row's key."""
    filled = impute_stochastic(_line_rows(spark, folder), "y", ["x"], "y_imp", ["l_orderkey", "l_linenumber"], seed=1997)
    return filled.select("l_orderkey", "l_linenumber", "x", "y", F.round("y_imp", 4).alias("y_imp"))


_TWO_SQL = f"""{_LINES_SQL},
c AS (SELECT count(*) AS n, count(*) * var_pop(x) AS xx, count(*) * var_pop(b) AS bb, count(*) * covar_pop(x, b) AS xb,
  count(*) * covar_pop(x, y) AS xy, count(*) * covar_pop(b, y) AS by_, count(*) * var_pop(y) AS yy, avg(x) AS mx, avg(b) AS mb, avg(y) AS my
  FROM v WHERE y IS NOT NULL),
s AS (SELECT *, xx * bb - xb * xb AS det, (xy * bb - by_ * xb) / (xx * bb - xb * xb) AS sx, (by_ * xx - xy * xb) / (xx * bb - xb * xb) AS sb FROM c),
r AS (SELECT *, yy - sx * xy - sb * by_ AS rss FROM s),
q AS (SELECT *, rss / (n - 3) AS s2 FROM r)"""


@query(
    "ols_summary",
    f"""WITH {_TWO_SQL},
t AS (
  SELECT '(intercept)' AS term, my - sx * mx - sb * mb AS estimate, sqrt(s2 * (1.0 / n + (mx * mx * bb - 2 * mx * mb * xb + mb * mb * xx) / det)) AS std_error FROM q
  UNION ALL SELECT 'x', sx, sqrt(s2 * bb / det) FROM q
  UNION ALL SELECT 'b', sb, sqrt(s2 * xx / det) FROM q)
SELECT term, round(estimate, 3) AS estimate, round(std_error, 4) AS std_error, round(1 - rss / yy, 9) AS r2, round(sqrt(s2), 4) AS sigma, n FROM t, q""",
)
def ols_summary(spark, folder):
    """Coefficients with their errors, R2 and the residual deviation."""
    found = regression_summary(_line_rows(spark, folder), "y", ["x", "b"])
    return rounded(rounded(rounded(found, 3, "estimate"), 4, "std_error", "sigma"), 9, "r2")


@query(
    "impute_stochastic_two",
    f"""WITH {_TWO_SQL},
u AS (SELECT *, (CAST('0x' || substr(h, 1, 12) AS BIGINT) + 0.5) / 281474976710656.0 AS u1,
        (CAST('0x' || substr(h, 13, 12) AS BIGINT) + 0.5) / 281474976710656.0 AS u2 FROM (SELECT *, {_NOISE_SQL} FROM v))
SELECT l_orderkey, l_linenumber,
  round(coalesce(y, my + sx * (u.x - mx) + sb * (u.b - mb) + sqrt(-2 * ln(u1)) * cos(2 * pi() * u2) * sqrt(s2) / 20), 2) AS y_imp FROM u, q""",
)
def fill_stochastic_two(spark, folder):
    """The same from a model with two predictors."""
    filled = impute_stochastic(_line_rows(spark, folder), "y", ["x", "b"], "y_imp", ["l_orderkey", "l_linenumber"], seed=1997)
    return filled.select("l_orderkey", "l_linenumber", F.round("y_imp", 2).alias("y_imp"))


@query(
    "summary_stats_hot",
    """WITH v AS (SELECT CASE WHEN o_orderkey % 10 < 9 THEN 1000.0 WHEN o_orderstatus <> 'P' THEN o_totalprice END AS x FROM orders)
SELECT min(x) AS min, round(avg(x), 6) AS mean, max(x) AS max, count(x) AS n,
       count(*) FILTER (WHERE x IS NULL) AS n_null,
       round(quantile_cont(x, 0.25), 6) AS q1, round(quantile_cont(x, 0.5), 6) AS median,
       round(quantile_cont(x, 0.75), 6) AS q3 FROM v""",
)
def summary_stats_hot(spark, folder):
    """Most rows share one value."""
    prices = table(spark, folder, "orders").selectExpr(
        "CASE WHEN o_orderkey % 10 < 9 THEN 1000.0D WHEN o_orderstatus != 'P' THEN o_totalprice END AS x"
    )
    return rounded(summary_statistics(prices, "x"), 6, "mean", "q1", "median", "q3")
