"""Registered queries: regression on factors, as-of match, cell sums by waves, rows and lines by number, found levels, saved tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Window, functions as F
from pyspark.sql import types as T

from ..operators.asof import as_of
from ..operators.frames import drop_rows_by_index, rename_by_rules, rename_positions
from ..operators.impute import impute_regression, regression_summary
from ..operators.incremental import add_new_files, cells_so_far
from ..operators.sizing import attach, remember
from ..operators.strata import crosstab_found
from ..session import shared_folder
from ..sources import read_statistics, read_wave
from ..sources.colocated import join_co_located, save_co_located
from ..sources.stata import read_dta, save_dta
from .queries_weighting import rounded
from .registry import query
from .views import INTENT_LEVELS, PEOPLE_SQL, RESP_SQL, people, respondents, table

# One factor and one predictor that varies within it: everything comes from sums within the labels.
_FACTOR_SQL = """v AS (SELECT l_quantity AS x, l_extendedprice AS y, {factor} AS f FROM lineitem WHERE l_linenumber > 1),
g AS (SELECT f, count(*) AS n, avg(x) AS mx, avg(y) AS my, count(*) * var_pop(x) AS xx, count(*) * covar_pop(x, y) AS xy, count(*) * var_pop(y) AS yy FROM v GROUP BY f),
s AS (SELECT sum(xx) AS xx, sum(xy) / sum(xx) AS b, sum(yy) - sum(xy) * sum(xy) / sum(xx) AS rss, sum(n) AS n, count(*) AS k FROM g),
q AS (SELECT *, rss / (n - 1 - k) AS s2, (SELECT count(*) * var_pop(y) FROM v) AS total FROM s),
o AS (SELECT g.*, first_value(f) OVER w AS f1, first_value(n) OVER w AS n1, first_value(mx) OVER w AS mx1, first_value(my) OVER w AS my1 FROM g WINDOW w AS (ORDER BY f))"""


def _lines(spark, folder, factor: str):
    return table(spark, folder, "lineitem").where("l_linenumber > 1").selectExpr(
        "l_quantity AS x", "2 * l_quantity + 1 AS twice", "l_extendedprice AS y", f"{factor} AS f", "l_orderkey", "l_linenumber"
    )


@query(
    "ols_factors",
    f"""WITH {_FACTOR_SQL.format(factor="l_returnflag")},
t AS (
  SELECT '(intercept)' AS term, my - b * mx AS estimate, sqrt(s2 * (1.0 / o.n + mx * mx / q.xx)) AS std_error FROM o, q WHERE f = f1
  UNION ALL SELECT 'x', b, sqrt(s2 / xx) FROM q
  UNION ALL SELECT 'twice', NULL, NULL
  UNION ALL SELECT 'f' || f, my - my1 - b * (mx - mx1), sqrt(s2 * (1.0 / o.n + 1.0 / n1 + (mx - mx1) * (mx - mx1) / q.xx)) FROM o, q WHERE f <> f1)
SELECT term, round(estimate, 3) AS estimate, round(std_error, 4) AS std_error, round(1 - rss / total, 9) AS r2, round(sqrt(s2), 4) AS sigma, n::BIGINT AS n FROM t, q""",
)
def ols_factors(spark, folder):
    """A factor, a predictor, and another that depends on it, which has no estimate."""
    found = regression_summary(_lines(spark, folder, "l_returnflag"), "y", ["x", "twice"], ["f"])
    return rounded(rounded(rounded(found, 3, "estimate"), 4, "std_error", "sigma"), 9, "r2")


@query(
    "impute_regression_many_levels",
    f"""WITH {_FACTOR_SQL.format(factor="l_partkey").replace("WHERE l_linenumber > 1", "WHERE l_linenumber > 1 AND l_returnflag <> 'N'")}
SELECT l_orderkey, l_linenumber, round(CASE WHEN l_returnflag <> 'N' THEN l_extendedprice ELSE my + b * (l_quantity - mx) END, 2) AS y_imp
FROM lineitem LEFT JOIN g ON f = l_partkey, s WHERE l_linenumber > 1""",
)
def fill_by_part(spark, folder):
    """A label for every part, which takes the factor out of the equations; parts without a known price have no prediction."""
    lines = table(spark, folder, "lineitem").where("l_linenumber > 1").selectExpr(
        "l_orderkey", "l_linenumber", "l_quantity AS x", "l_partkey AS f", "IF(l_returnflag != 'N', l_extendedprice, NULL) AS y"
    )
    return impute_regression(lines, "y", ["x"], ["f"], "y_imp").select("l_orderkey", "l_linenumber", F.round("y_imp", 2).alias("y_imp"))


@query(
    "asof_timestamps",
    """WITH p AS (SELECT ts, max(value) AS high, min(value) AS low FROM events WHERE event_type = 'purchase' GROUP BY ts),
v AS (SELECT event_id, ts FROM events WHERE event_type = 'view'),
b AS (SELECT event_id, p.ts AS prev_ts, high AS prev_value FROM v ASOF LEFT JOIN p ON v.ts >= p.ts),
a AS (SELECT event_id, p.ts AS next_ts, low AS next_value FROM v ASOF LEFT JOIN p ON v.ts < p.ts)
SELECT v.event_id, strftime(prev_ts, '%Y-%m-%d %H:%M:%S.%f') AS prev_ts, prev_value, strftime(next_ts, '%Y-%m-%d %H:%M:%S.%f') AS next_ts, next_value
FROM v JOIN b USING (event_id) JOIN a USING (event_id)""",
)
def asof_timestamps(spark, folder):
    """For every view the purchase at or before it and the next one; all purchases are one series."""
    events = table(spark, folder, "events")
    purchases = events.where("event_type = 'purchase'").select("ts", "value")
    found = as_of(events.where("event_type = 'view'").select("event_id", "ts"), purchases, "ts", ["value"])
    shown = {c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS") for c in ("prev_ts", "next_ts")}
    return found.drop("ts").withColumns(shown)


@query(
    "asof_by_key",
    """WITH p AS (SELECT user_id, ts, max(value) AS high, min(value) AS low FROM events WHERE event_type IN ('purchase', 'signup') GROUP BY ALL),
v AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'error'),
b AS (SELECT event_id, high AS prev_value FROM v ASOF LEFT JOIN p ON v.user_id = p.user_id AND v.ts >= p.ts),
a AS (SELECT event_id, low AS next_value FROM v ASOF LEFT JOIN p ON v.user_id = p.user_id AND v.ts < p.ts)
SELECT event_id, prev_value, next_value FROM b JOIN a USING (event_id)""",
)
def asof_by_key(spark, folder):
    """The same within each user."""
    events = table(spark, folder, "events")
    known = events.where("event_type IN ('purchase', 'signup')").select("user_id", "ts", "value")
    found = as_of(events.where("event_type = 'error'").select("event_id", "user_id", "ts"), known, "ts", ["value"], ["user_id"])
    return found.select("event_id", "prev_value", "next_value")


@query(
    "strata_incremental",
    f"""WITH {PEOPLE_SQL} SELECT gender, past, count(*) AS n, round(sum(balance), 2) AS sum_balance FROM people GROUP BY ALL""",
)
def strata_incremental(spark, folder):
    """Two waves of people arrive as files; the second run reads the second one only."""
    path = f"{shared_folder(spark).rstrip('/')}/waves-{uuid.uuid4().hex}"
    remember(path)
    answers = people(spark, folder)
    for wave in (answers.where("person % 3 > 0"), answers.where("person % 3 = 0")):
        wave.write.mode("append").parquet(f"{path}/source")
        add_new_files(spark, f"{path}/source", answers.schema, f"{path}/state", ["gender", "past"], ["balance"])
    return rounded(cells_so_far(spark, f"{path}/state", ["gender", "past"]), 2, "sum_balance")


@query(
    "drop_rows_by_index",
    """SELECT o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS n FROM orders) WHERE n NOT IN (1, 3) AND n % 10 <> 0""",
)
def rows_by_index(spark, folder):
    """The cheapest order, the third cheapest and every tenth go."""
    orders = table(spark, folder, "orders").select("o_orderkey", "o_totalprice")
    indexes = spark.range(1, orders.count() + 1).where("id IN (1, 3) OR id % 10 = 0")
    return drop_rows_by_index(orders, ["o_totalprice", "o_orderkey"], indexes)


@query(
    "lines_by_number",
    """SELECT line, o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS line FROM orders) WHERE line >= 5""",
)
def lines_by_number(spark, folder):
    """Text files of the sorted orders, read back: line numbers within each file follow on from file to file."""
    path = f"{shared_folder(spark).rstrip('/')}/lines-{uuid.uuid4().hex}"
    remember(path)
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderstatus")
    orders.repartitionByRange(4, "o_orderkey").sortWithinPartitions("o_orderkey").write.option("sep", ";").csv(path)
    rows = read_statistics(spark, path, ["o_orderkey", "o_orderstatus"]).withColumn("o_orderkey", F.col("o_orderkey").cast("long"))
    files = rows.groupBy("file").agg(F.min("o_orderkey").alias("first"), (F.max("line") + 1).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("first").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row per file
    offsets = files.select("file", before.alias("before"))
    numbered = attach(rows, offsets, ["file"]).withColumn("line", F.col("line") + F.col("before"))
    return numbered.where("line >= 5").select("line", "o_orderkey", "o_orderstatus")


_LEVELS_SQL = ", ".join(f"count(*) FILTER (WHERE intent = '{level}') AS \"{level}\"" for level in INTENT_LEVELS)


@query("crosstab_found_levels", f"WITH {RESP_SQL} SELECT nation, {_LEVELS_SQL} FROM resp GROUP BY nation")
def crosstab_found_levels(spark, folder):
    """The columns are the levels that occur, zero cells included."""
    return crosstab_found(respondents(spark, folder), "nation", "intent").table


@query(
    "crosstab_many_levels",
    """SELECT o_orderstatus, dense_rank() OVER (ORDER BY o_custkey) AS ordinal, n FROM (SELECT o_orderstatus, o_custkey, count(*) AS n FROM orders GROUP BY ALL)""",
)
def crosstab_many_levels(spark, folder):
    """Every customer is a level, which is too many for columns: cells that occur, with the ordinal of their level."""
    return crosstab_found(table(spark, folder, "orders"), "o_orderstatus", "o_custkey", most=50).table


def _scratch(spark, kind: str) -> str:
    path = f"{shared_folder(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"
    remember(path)
    return path


@query("join_co_located", "SELECT o_orderkey, c_custkey, c_mktsegment, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey")
def joined_saved_tables(spark, folder):
    """Orders and customers saved in buckets of the customer, and joined where they lie."""
    run = uuid.uuid4().hex
    orders = table(spark, folder, "orders").selectExpr("o_custkey AS c_custkey", "o_orderkey", "o_totalprice")
    customers = table(spark, folder, "customer").select("c_custkey", "c_mktsegment")
    left, right = (save_co_located(df, f"{name}_{run}", ["c_custkey"], 8) for name, df in (("orders", orders), ("customers", customers)))
    return join_co_located(left, right)


@query(
    "src_dta_roundtrip",
    f"WITH {RESP_SQL} SELECT CAST(id AS DOUBLE) AS id, past, CASE WHEN wave = 1995 THEN NULL ELSE wave END AS wave, w0, CASE WHEN turnout = 1 THEN day END AS day FROM resp",
)
def src_dta_roundtrip(spark, folder):
    """Survey files with fixed-width records, written and read by byte ranges; one column is left unread."""
    path = _scratch(spark, "dta")
    answers = respondents(spark, folder).selectExpr(
        "id", "past", "intent", "IF(wave = 1995, NULL, wave) AS wave", "w0", "IF(turnout = 1, day, NULL) AS day"
    )
    save_dta(answers, path)
    return read_dta(spark, path, ["id", "past", "wave", "w0", "day"])


def _wave_file(spark, folder) -> str:
    path = _scratch(spark, "wave")
    people(spark, folder).selectExpr(
        "person AS id", "concat('Grüne, ', gender) AS label", "IF(past = 'BUILDING', 'NA', past) AS past", "IF(balance < 0, 'k.A.', CAST(balance AS STRING)) AS balance"
    ).write.option("header", True).csv(path)
    return path


def _wave_schema(balance: T.DataType) -> T.StructType:
    fields = {"id": T.LongType(), "label": T.StringType(), "past": T.StringType(), "balance": balance}
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


@query("src_wave_one_token", f"WITH {PEOPLE_SQL} SELECT person AS id, concat('Grüne, ', gender) AS label, nullif(past, 'BUILDING') AS past FROM people")
def src_wave_one_token(spark, folder):
    """A csv file with a header, UTF-8 texts with commas, and one mark for missing values."""
    return read_wave(spark, _wave_file(spark, folder), _wave_schema(T.StringType())).drop("balance")


@query(
    "src_wave_several_tokens",
    f"WITH {PEOPLE_SQL} SELECT person AS id, concat('Grüne, ', gender) AS label, nullif(past, 'BUILDING') AS past, CASE WHEN balance >= 0 THEN balance END AS balance FROM people",
)
def src_wave_several_tokens(spark, folder):
    return read_wave(spark, _wave_file(spark, folder), _wave_schema(T.DoubleType()), na=("NA", "k.A."))


@query("rename_rules", "SELECT c_custkey AS custkey, c_name AS name, c_nationkey AS nation, c_mktsegment AS segment FROM customer")
def renamed(spark, folder):
    """Every name through a chain of patterns, then one by its place."""
    customers = table(spark, folder, "customer").drop("c_acctbal").withColumnRenamed("c_name", "C_NAME")
    return rename_positions(rename_by_rules(customers, [("^[cC]_", ""), ("key$", "KEY"), ("^mkt", "")], lower=True), {2: "nation"})
