"""Registered queries: transitions, imputation, regression."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.impute import (
    fit_linear,
    impute_hotdeck,
    impute_line,
    impute_mean,
    impute_regression,
    impute_rule,
    impute_value,
    line_fit,
)
from ..operators.transition import (
    counts_by_variable,
    first_and_last,
    flows,
    loyalty,
    margins,
    scaled_flows,
    without_stayers,
)
from ..operators.sizing import settle
from .queries_weighting import rounded
from .registry import query
from .views import RESP_SQL, respondents, table

_FLOWS_SQL = """p AS (
  SELECT o_custkey AS person, min_by(o_orderpriority, (o_orderdate, o_orderkey)) AS "from",
         max_by(o_orderpriority, (o_orderdate, o_orderkey)) AS "to" FROM orders GROUP BY o_custkey),
f AS (SELECT "from", "to", count(*) AS n FROM p GROUP BY ALL)"""


def _people_flows(spark, folder):
    answers = table(spark, folder, "orders").select("o_custkey", "o_orderpriority", "o_orderdate", "o_orderkey")
    return first_and_last(answers, "o_custkey", "o_orderpriority", ["o_orderdate", "o_orderkey"])


def _flow_table(spark, folder):
    return flows(_people_flows(spark, folder))


@query("transition_counts", f'WITH {_FLOWS_SQL} SELECT "from", "to", n FROM f')
def transition_counts(spark, folder):
    return _flow_table(spark, folder)


@query(
    "loyalty_rate",
    f"""WITH {_FLOWS_SQL}
SELECT "from", CAST(coalesce(sum(n) FILTER (WHERE "from" = "to"), 0) AS BIGINT) AS stayed, CAST(sum(n) AS BIGINT) AS total,
       round(coalesce(sum(n) FILTER (WHERE "from" = "to"), 0) * 1.0 / sum(n), 9) AS loyalty FROM f GROUP BY "from\"""",
)
def loyalty_rate(spark, folder):
    return rounded(loyalty(_flow_table(spark, folder)), 9, "loyalty")


@query(
    "flows_offdiag",
    f"""WITH {_FLOWS_SQL} SELECT "from", "to", CASE WHEN "from" = "to" THEN 0 ELSE n END AS n FROM f""",
)
def flows_offdiag(spark, folder):
    return without_stayers(_flow_table(spark, folder))


@query(
    "flow_margins",
    f"""WITH {_FLOWS_SQL}
SELECT 'start' AS side, "from" AS box, round(sum(n) * 1.0 / (SELECT sum(n) FROM f), 9) AS prop FROM f GROUP BY "from"
UNION ALL SELECT 'end', "to", round(sum(n) * 1.0 / (SELECT sum(n) FROM f), 9) FROM f GROUP BY "to\"""",
)
def flow_margins(spark, folder):
    return rounded(margins(_flow_table(spark, folder)), 9, "prop")


@query(
    "flow_widths",
    f"""WITH {_FLOWS_SQL}
SELECT 'all' AS mode, "from", "to", n, round(1.0 + 9.0 * n / (SELECT max(n) FROM f), 9) AS width FROM f
UNION ALL
SELECT 'origin', "from", "to", n, round(1.0 + 9.0 * n / max(n) OVER (PARTITION BY "from"), 9) FROM f""",
)
def flow_widths(spark, folder):
    """Flow widths relative to the largest flow, and to the largest of the same origin."""
    counted = settle(_flow_table(spark, folder))
    overall = scaled_flows(counted, False, 1.0, 10.0).withColumn("mode", F.lit("all"))
    origin = scaled_flows(counted, True, 1.0, 10.0).withColumn("mode", F.lit("origin"))
    return rounded(overall.unionByName(origin), 9, "width")


@query(
    "melt_counts",
    f"""WITH {_FLOWS_SQL}
SELECT 'from' AS variable, "from" AS value, count(*) AS n FROM p GROUP BY "from"
UNION ALL SELECT 'to', "to", count(*) FROM p GROUP BY "to\"""",
)
def melt_counts(spark, folder):
    return counts_by_variable(_people_flows(spark, folder), ["o_custkey"], ["from", "to"])


# Answers with gaps: no weight while pending, no past vote for one segment.
_GAPS_SQL = """gaps AS (SELECT id, gender, agegroup, intent, balance, past,
  CASE WHEN status <> 'P' THEN w0 END AS income, nullif(past, 'BUILDING') AS emp FROM resp)"""


def _gaps(spark, folder):
    return respondents(spark, folder).selectExpr(
        "id", "gender", "agegroup", "intent", "balance", "past",
        "IF(status != 'P', w0, NULL) AS income", "nullif(past, 'BUILDING') AS emp",
    )


@query("impute_value", f"WITH {RESP_SQL}, {_GAPS_SQL} SELECT id, coalesce(income, balance) AS income FROM gaps")
def fill_value(spark, folder):
    return _gaps(spark, folder).select("id", impute_value(F.col("income"), F.col("balance")).alias("income"))


@query(
    "impute_mean",
    f"""WITH {RESP_SQL}, {_GAPS_SQL}, m AS (SELECT gender, agegroup, avg(income) AS mean FROM gaps GROUP BY ALL)
SELECT id, round(coalesce(income, mean), 6) AS income_imp FROM gaps LEFT JOIN m USING (gender, agegroup)""",
)
def fill_mean(spark, folder):
    filled = impute_mean(_gaps(spark, folder), "income", ["gender", "agegroup"], "income_imp")
    return filled.select("id", F.round("income_imp", 6).alias("income_imp"))


@query(
    "impute_rule",
    f"""WITH {RESP_SQL}, {_GAPS_SQL}
SELECT id, CASE WHEN emp IS NULL AND balance < 1800 THEN 'not employed' ELSE emp END AS emp FROM gaps""",
)
def fill_rule(spark, folder):
    young = F.col("balance") < 1800
    return _gaps(spark, folder).select("id", impute_rule(F.col("emp"), young, "not employed").alias("emp"))


@query(
    "impute_hotdeck",
    f"""WITH {RESP_SQL}, {_GAPS_SQL}
SELECT id, last_value(income IGNORE NULLS) OVER (ORDER BY gender, agegroup, intent, id
         ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS income, income IS NULL AS income_i FROM gaps""",
)
def fill_hotdeck(spark, folder):
    """Donor is the last known value in sort order over the whole table."""
    gaps = _gaps(spark, folder).select("id", "gender", "agegroup", "intent", "income")
    return impute_hotdeck(gaps, "income", ["gender", "agegroup", "intent", "id"]).select("id", "income", "income_i")


_LINE_SQL = """v AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity AS x,
  CASE WHEN l_returnflag <> 'N' THEN l_extendedprice END AS y FROM lineitem),
fit AS (SELECT regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept, regr_r2(y, x) AS r2, regr_count(y, x) AS n,
  sqrt((regr_syy(y, x) - regr_slope(y, x) * regr_sxy(y, x)) / (regr_count(y, x) - 2)) AS sigma FROM v)"""


def _line_rows(spark, folder):
    return table(spark, folder, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber", "l_partkey", "l_quantity AS x",
        "IF(l_returnflag != 'N', l_extendedprice, NULL) AS y", "l_discount", "l_linestatus",
    )


@query(
    "ols_simple",
    f"""WITH {_LINE_SQL} SELECT round(slope, 5) AS slope, round(intercept, 4) AS intercept, round(r2, 9) AS r2,
round(sigma, 4) AS sigma, CAST(n AS BIGINT) AS n FROM fit""",
)
def ols_simple(spark, folder):
    return rounded(line_fit(_line_rows(spark, folder), "y", "x"), 4, "intercept", "sigma").withColumns(
        {"slope": F.round("slope", 5), "r2": F.round("r2", 9)}
    )


@query(
    "impute_regression",
    f"""WITH {_LINE_SQL} SELECT l_orderkey, l_linenumber, l_partkey, x, round(coalesce(y, intercept + slope * x), 3) AS y_imp
FROM v, fit""",
)
def fill_line(spark, folder):
    filled = impute_line(_line_rows(spark, folder), "y", "x", "y_imp")
    return filled.select("l_orderkey", "l_linenumber", "l_partkey", "x", F.round("y_imp", 3).alias("y_imp"))


@query(
    "ols_multiple",
    """WITH v AS (SELECT l_quantity AS a, l_discount AS b, l_extendedprice AS y FROM lineitem WHERE l_returnflag <> 'N'),
c AS (SELECT var_pop(a) AS aa, var_pop(b) AS bb, covar_pop(a, b) AS ab, covar_pop(a, y) AS ay, covar_pop(b, y) AS by_,
             avg(a) AS ma, avg(b) AS mb, avg(y) AS my FROM v),
s AS (SELECT (ay * bb - by_ * ab) / (aa * bb - ab * ab) AS sa, (by_ * aa - ay * ab) / (aa * bb - ab * ab) AS sb, ma, mb, my FROM c)
SELECT '(Intercept)' AS term, round(my - sa * ma - sb * mb, 2) AS estimate FROM s
UNION ALL SELECT 'x', round(sa, 3) FROM s UNION ALL SELECT 'l_discount', round(sb, 1) FROM s""",
)
def ols_multiple(spark, folder):
    """Two numeric predictors, listwise deletion; the coefficients come from the fitted model."""
    model = fit_linear(_line_rows(spark, folder), "y", ["x", "l_discount"]).stages[-1]
    a, b = model.coefficients
    rows = [("(Intercept)", round(model.intercept, 2)), ("x", round(float(a), 3)), ("l_discount", round(float(b), 1))]
    return spark.createDataFrame(rows, "term STRING, estimate DOUBLE")


# Normal equations of three predictors, solved by determinants.
_THREE_SQL = """v AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity AS x, l_discount AS b,
  CASE l_linestatus WHEN 'O' THEN 1.0 ELSE 0.0 END AS c, CASE WHEN l_returnflag <> 'N' THEN l_extendedprice END AS y FROM lineitem),
m AS (SELECT var_pop(x) AS xx, var_pop(b) AS bb, var_pop(c) AS cc, covar_pop(x, b) AS xb, covar_pop(x, c) AS xc,
  covar_pop(b, c) AS bc, covar_pop(x, y) AS xy, covar_pop(b, y) AS by_, covar_pop(c, y) AS cy,
  avg(x) AS mx, avg(b) AS mb, avg(c) AS mc, avg(y) AS my FROM v WHERE y IS NOT NULL),
d AS (SELECT *, xx * (bb * cc - bc * bc) - xb * (xb * cc - bc * xc) + xc * (xb * bc - bb * xc) AS det FROM m),
s AS (SELECT *, (xy * (bb * cc - bc * bc) - xb * (by_ * cc - bc * cy) + xc * (by_ * bc - bb * cy)) / det AS sx,
  (xx * (by_ * cc - bc * cy) - xy * (xb * cc - bc * xc) + xc * (xb * cy - by_ * xc)) / det AS sb,
  (xx * (bb * cy - by_ * bc) - xb * (xb * cy - by_ * xc) + xy * (xb * bc - bb * xc)) / det AS sc FROM d)"""


@query(
    "impute_regression_factors",
    f"""WITH {_THREE_SQL} SELECT l_orderkey, l_linenumber, l_partkey, v.x,
round(coalesce(y, my + sx * (v.x - mx) + sb * (b - mb) + sc * (c - mc)), 2) AS y_imp FROM v, s""",
)
def fill_regression(spark, folder):
    """Numeric and categorical predictors."""
    filled = impute_regression(_line_rows(spark, folder), "y", ["x", "l_discount"], ["l_linestatus"], "y_imp")
    return filled.select("l_orderkey", "l_linenumber", "l_partkey", "x", F.round("y_imp", 2).alias("y_imp"))
