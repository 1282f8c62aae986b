"""Registered queries: columns, recodes, filters, joins, appends, sorts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import band, collapse_other, null_tokens, recode, recode_frame, survey_mode
from ..operators.frames import (
    add_row_number,
    category_rank,
    columns_first,
    columns_matching,
    complete_rows,
    first_row,
    label_blocks,
    relabel_by_position,
    rename_by_rules,
)
from ..operators.reshape import append_rows, append_rows_by_position
from ..operators.sizing import attach
from .registry import query
from .views import POLLS_SQL, RESP_SQL, people, polls, respondents, table


@query(
    "project_reorder",
    """SELECT p_size AS size, p_type AS kind, p_partkey AS p_partkey, p_name AS p_name, p_retailprice AS p_retailprice FROM part""",
)
def project_reorder(spark, folder):
    parts = table(spark, folder, "part").drop("p_brand").withColumnsRenamed({"p_size": "size", "p_type": "kind"})
    return columns_first(parts, "size", "kind")


@query(
    "select_by_pattern",
    "SELECT l_orderkey, l_linenumber, l_extendedprice AS extendedprice, l_tax AS tax, l_discount AS discount FROM lineitem",
)
def select_by_pattern(spark, folder):
    """Columns picked by a name pattern, then renamed by rules."""
    keys = ("l_orderkey", "l_linenumber")
    picked = columns_matching(table(spark, folder, "lineitem"), "price$|tax$|^l_disc", keys)
    return rename_by_rules(picked, [("^l_(?!orderkey|linenumber)", "")])


@query(
    "recode_case",
    f"""WITH {RESP_SQL}
SELECT id, CASE WHEN intent = '1-URGENT' THEN 'Higher education' WHEN intent IN ('2-HIGH', '3-MEDIUM') THEN 'Medium education'
       ELSE 'Lower education' END AS edu,
       CASE WHEN status = 'F' THEN 'online' WHEN status = 'O' THEN 'telefon' ELSE 'keineangabe' END AS typ FROM resp""",
)
def recode_case(spark, folder):
    level = F.substring("intent", 1, 1)
    edu = F.when(level == "1", "Higher education").when(level.isin("2", "3"), "Medium education")
    sample_text = F.concat(
        F.when(F.col("status") == "F", "O • ").when(F.col("status") == "O", "T • ").otherwise(""),
        F.col("w0").cast("long").cast("string"),
    )
    return respondents(spark, folder).select(
        "id", edu.otherwise("Lower education").alias("edu"), survey_mode(sample_text).alias("typ")
    )


@query(
    "recode_map",
    f"""WITH {RESP_SQL}
SELECT id, CASE past WHEN 'BUILDING' THEN 'Union' WHEN 'MACHINERY' THEN 'Linke' ELSE past END AS past,
       CASE gender WHEN 'Female' THEN 'f' WHEN 'Male' THEN 'm' END AS gender FROM resp""",
)
def recode_map(spark, folder):
    """One map over every text cell; unmapped values stay."""
    frame = respondents(spark, folder).select("id", "past", "gender")
    cells = {"BUILDING": "Union", "MACHINERY": "Linke", "Female": "f", "Male": "m"}
    return recode_frame(frame, cells)


@query(
    "recode_turnout",
    """SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'P' THEN '0' WHEN 'F' THEN '1' END AS turnout FROM orders""",
)
def recode_turnout(spark, folder):
    """A map whose unmapped values become NULL."""
    turnout = recode(F.col("o_orderstatus"), {"P": "0", "F": "1"}, keep_unmapped=False)
    return table(spark, folder, "orders").select(F.col("o_orderkey").alias("id"), turnout.alias("turnout"))


@query(
    "collapse_other",
    """SELECT c_custkey, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN c_mktsegment ELSE 'Other' END AS past FROM customer""",
)
def collapsed_other(spark, folder):
    kept = collapse_other(F.col("c_mktsegment"), ["BUILDING", "MACHINERY"])
    return table(spark, folder, "customer").select("c_custkey", kept.alias("past"))


@query(
    "recode_positional",
    """WITH lv AS (SELECT c_mktsegment, row_number() OVER (ORDER BY c_mktsegment) AS k
            FROM (SELECT DISTINCT c_mktsegment FROM customer))
SELECT c_custkey, c_mktsegment, CASE k WHEN 1 THEN 'AfD' WHEN 2 THEN 'Gruene' WHEN 3 THEN 'Union' WHEN 4 THEN 'Linke' WHEN 5 THEN 'FDP' END AS label
FROM customer JOIN lv USING (c_mktsegment)""",
)
def recode_positional(spark, folder):
    frame = table(spark, folder, "customer").select("c_custkey", "c_mktsegment")
    return relabel_by_position(frame, "c_mktsegment", ["AfD", "Gruene", "Union", "Linke", "FDP"], "label")


_RANKED = ("MACHINERY", "AUTOMOBILE", "HOUSEHOLD", "BUILDING")


@query(
    "order_by_category",
    f"""SELECT c_mktsegment AS past, CAST(CASE c_mktsegment {" ".join(f"WHEN '{x}' THEN {i}" for i, x in enumerate(_RANKED, 1))} END AS BIGINT) AS level,
       count(*) AS n FROM customer GROUP BY c_mktsegment""",
)
def order_by_category(spark, folder):
    """Sorted by the declared order of the categories, undeclared last."""
    counted = table(spark, folder, "customer").groupBy(F.col("c_mktsegment").alias("past")).agg(F.expr("count(*) AS n"))
    return counted.withColumn("level", category_rank(F.col("past"), _RANKED)).orderBy(F.col("level").asc_nulls_last())


@query(
    "row_id",
    f"""WITH {RESP_SQL}
SELECT id, row_number() OVER (ORDER BY balance, gender, intent, id) AS identifier FROM resp""",
)
def row_id(spark, folder):
    frame = respondents(spark, folder).select("id", "balance", "gender", "intent")
    return add_row_number(frame, ["balance", "gender", "intent", "id"]).select("id", "identifier")


@query(
    "block_label",
    """WITH r AS (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) - 1 AS k FROM part)
SELECT p_partkey, CASE (k // 8) % 3 WHEN 0 THEN 'Total' WHEN 1 THEN 'Male' ELSE 'Female' END AS gender FROM r""",
)
def block_label(spark, folder):
    """Every eight rows get the next label."""
    parts = table(spark, folder, "part").select("p_partkey")
    return label_blocks(parts, ["p_partkey"], ["Total", "Male", "Female"], 8, "gender")


@query(
    "bucketize",
    """SELECT p_partkey, CASE WHEN p_size < 25.5 THEN '18-25' WHEN p_size < 35.5 THEN '26-35' WHEN p_size < 45.5 THEN '36-45'
            WHEN p_size < 60.5 THEN '46-60' ELSE '60+' END AS agegroup,
       CASE WHEN p_size < 29.5 THEN '10.29' WHEN p_size < 49.5 THEN '30.49' ELSE '50p' END AS agegroup30 FROM part""",
)
def bucketize(spark, folder):
    size = F.col("p_size")
    return table(spark, folder, "part").select(
        "p_partkey",
        band(size, (25.5, 35.5, 45.5, 60.5), ("18-25", "26-35", "36-45", "46-60", "60+")).alias("agegroup"),
        band(size, (29.5, 49.5), ("10.29", "30.49", "50p")).alias("agegroup30"),
    )


@query(
    "filter_bool",
    f"""WITH {RESP_SQL}
SELECT id FROM resp WHERE nullif(past, 'BUILDING') <> 'MACHINERY' AND (gender = 'Male' OR NOT (turnout = 1)) AND status <> 'O'""",
)
def filter_bool(spark, folder):
    """Rows with an unknown predicate drop out."""
    known = F.nullif(F.col("past"), F.lit("BUILDING"))
    keep = (known != "MACHINERY") & ((F.col("gender") == "Male") | ~(F.col("turnout") == 1)) & (F.col("status") != "O")
    return respondents(spark, folder).filter(keep).select("id")


@query(
    "filter_null",
    f"""WITH {RESP_SQL}, g AS (SELECT id, nullif(past, 'BUILDING') AS past, nullif(intent, '5-LOW') AS intent FROM resp)
SELECT id, past, intent FROM g WHERE past IS NOT NULL AND intent IS NOT NULL""",
)
def filter_null(spark, folder):
    frame = respondents(spark, folder).selectExpr("id", "nullif(past, 'BUILDING') AS past", "nullif(intent, '5-LOW') AS intent")
    return complete_rows(frame, "past", "intent")


@query("filter_in", "SELECT event_id, event_type FROM events WHERE event_type IN ('click', 'view', 'signup')")
def filter_in(spark, folder):
    wanted = F.col("event_type").isin("click", "view", "signup")
    return table(spark, folder, "events").filter(wanted).select("event_id", "event_type")


@query(
    "filter_regex",
    """SELECT doc_id, lang, regexp_matches(text, '[0-9]{3}[-. ][0-9]{3,4}') AS has_number FROM documents
WHERE NOT regexp_matches(text, '^[A-Z][a-z]+ on ')""",
)
def filter_regex(spark, folder):
    number = F.col("text").rlike("[0-9]{3}[-. ][0-9]{3,4}")
    return (
        table(spark, folder, "documents")
        .filter(~F.col("text").rlike("^[A-Z][a-z]+ on "))
        .select("doc_id", "lang", number.alias("has_number"))
    )


@query(
    "filter_range",
    """SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders
WHERE o_orderdate > TIMESTAMP '1996-01-01' AND o_orderdate <= TIMESTAMP '2000-03-20' AND o_totalprice > 22000""",
)
def filter_range(spark, folder):
    """Ranges on time and number, pushed to the file scan."""
    orders = table(spark, folder, "orders").filter(
        "o_orderdate > TIMESTAMP_NTZ '1996-01-01' AND o_orderdate <= TIMESTAMP_NTZ '2000-03-20' AND o_totalprice > 22000"
    )
    return orders.selectExpr("o_orderkey", "CAST(o_orderdate AS DATE) AS day")


@query(
    "join_left_multi",
    f"""WITH {RESP_SQL}, s AS (SELECT gender, agegroup, past, round(avg(w0), 6) AS mean FROM resp WHERE status = 'F' GROUP BY ALL)
SELECT p.person, s.mean FROM people p LEFT JOIN s USING (gender, agegroup, past)""",
)
def join_left_multi(spark, folder):
    """Stratum table attached to rows on three keys."""
    keys = ["gender", "agegroup", "past"]
    finished = respondents(spark, folder).filter("status = 'F'").groupBy(*keys).agg(F.round(F.avg("w0"), 6).alias("mean"))
    return attach(people(spark, folder), finished, keys).select("person", "mean")


@query(
    "join_inner",
    """SELECT l_orderkey, l_linenumber, l_partkey, o_orderpriority FROM lineitem JOIN orders ON l_orderkey = o_orderkey
WHERE o_orderstatus <> 'P'""",
)
def join_inner(spark, folder):
    """Two large tables on one key; the join side is left to adaptive execution."""
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    orders = table(spark, folder, "orders").filter("o_orderstatus != 'P'").select("o_orderkey", "o_orderpriority")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).drop("o_orderkey")


_UNION = """SELECT c_custkey AS key, c_acctbal AS value FROM customer UNION ALL SELECT s_suppkey, s_acctbal FROM supplier"""


def _two_tables(spark, folder):
    suppliers = spark.read.schema("s_suppkey BIGINT, s_acctbal DOUBLE").parquet(f"{folder}/supplier.parquet")
    return (
        table(spark, folder, "customer").selectExpr("c_custkey AS key", "c_acctbal AS value"),
        suppliers.selectExpr("s_acctbal AS value", "s_suppkey AS key"),
    )


@query("union_by_name", _UNION)
def union_by_name(spark, folder):
    return append_rows(*_two_tables(spark, folder))


@query("union_by_position", _UNION)
def union_by_position(spark, folder):
    first, second = _two_tables(spark, folder)
    return append_rows_by_position(first, second.select("key", "value"))


@query(
    "union_fill",
    """SELECT c_custkey AS key, c_acctbal AS value FROM customer UNION ALL SELECT s_suppkey, NULL FROM supplier""",
)
def union_fill(spark, folder):
    first, second = _two_tables(spark, folder)
    return append_rows(first, second.drop("value"), fill_missing=True)


@query("distinct_rows", f"WITH {POLLS_SQL} SELECT DISTINCT institut, datum, partei FROM polls")
def distinct_rows(spark, folder):
    return polls(spark, folder).select("institut", "datum", "partei").distinct()


@query(
    "sort_multi",
    """WITH v AS (SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS income, o_orderpriority FROM orders)
SELECT row_number() OVER (ORDER BY o_orderpriority DESC, income ASC NULLS LAST, o_orderkey) AS position, o_orderkey, income, o_orderpriority FROM v""",
)
def sort_multi(spark, folder):
    """Ascending and descending keys, missing values last; the place in the order is a column, so that it is compared too."""
    orders = table(spark, folder, "orders").selectExpr(
        "o_orderkey",
        "IF(o_orderstatus != 'P', o_totalprice, NULL) AS income",
        "o_orderpriority",
        "-CAST(substr(o_orderpriority, 1, 1) AS INT) AS backwards",
    )
    numbered = add_row_number(orders, ["backwards", "income", "o_orderkey"], "position")
    return numbered.selectExpr("CAST(position AS BIGINT) AS position", "o_orderkey", "income", "o_orderpriority").orderBy("position")


@query(
    "top1_by",
    "SELECT event_id, event_type, value FROM events ORDER BY ts DESC, event_id LIMIT 1",
)
def top1_by(spark, folder):
    """The most recent row."""
    return first_row(table(spark, folder, "events"), F.col("ts").desc(), F.col("event_id")).select(
        "event_id", "event_type", "value"
    )


@query(
    "null_token",
    f"""WITH {RESP_SQL}
SELECT id, nullif(past, 'BUILDING') AS past, nullif(intent, '5-LOW') AS intent FROM resp""",
)
def null_token(spark, folder):
    """Marker texts become NULL in every text column."""
    marked = respondents(spark, folder).selectExpr(
        "id", "IF(past = 'BUILDING', '/', past) AS past", "IF(intent = '5-LOW', '', intent) AS intent"
    )
    return null_tokens(marked, ["/", ""])
