"""Registered queries: text, dates, pages, files."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import (
    day_gap,
    decimal_comma,
    extract,
    parse_day,
    replace_all,
    replace_first,
    split_label,
)
from ..operators.transition import ranking_columns
from ..session import shared_folder
from ..sources import link_rows, save_csv, save_table
from ..sources.grids import MOST_ROWS, grid_rows
from .registry import query
from .views import RESP_SQL, respondents, table


def _documents(spark, folder):
    return table(spark, folder, "documents").select("doc_id", "text")


@query(
    "str_replace_first",
    "SELECT doc_id, md5(regexp_replace(text, '[aeiou][a-z]+n', '#')) AS text_md5 FROM documents",
)
def str_replace_first(spark, folder):
    """Only the first match of the whole text; compared by checksum."""
    changed = replace_first(F.col("text"), "[aeiou][a-z]+n", "#")
    return _documents(spark, folder).select("doc_id", F.md5(changed).alias("text_md5"))


@query(
    "str_replace_all",
    "SELECT doc_id, md5(regexp_replace(text, ' %|≈|O • |T • |[?]|,', '', 'g')) AS text_md5 FROM documents",
)
def str_replace_all(spark, folder):
    changed = replace_all(F.col("text"), " %|≈|O • |T • |[?]|,", "")
    return _documents(spark, folder).select("doc_id", F.md5(changed).alias("text_md5"))


@query("str_case", "SELECT doc_id, md5(lower(text)) AS text_md5 FROM documents")
def str_case(spark, folder):
    return _documents(spark, folder).select("doc_id", F.md5(F.lower("text")).alias("text_md5"))


@query(
    "str_extract",
    "SELECT doc_id, nullif(regexp_extract(text, '[0-9]+[.,][0-9]+', 0), '') AS first_number FROM documents",
)
def str_extract(spark, folder):
    """First match, NULL when there is none."""
    return _documents(spark, folder).select("doc_id", extract(F.col("text"), "[0-9]+[.,][0-9]+").alias("first_number"))


@query(
    "split_label",
    f"WITH {RESP_SQL} SELECT id, gender, agegroup FROM resp",
)
def label_parts(spark, folder):
    """A combined label is cut into its two fields."""
    labelled = respondents(spark, folder).selectExpr("id", "concat(gender, '.', agegroup) AS label")
    gender, age = split_label(F.col("label"), "(Fem|M)ale")
    return labelled.select("id", gender.alias("gender"), age.alias("agegroup"))


@query(
    "split_rank",
    f"""WITH {RESP_SQL} SELECT id, past AS ranking1, intent AS ranking2,
CASE WHEN status <> 'P' THEN gender END AS ranking3, CAST(NULL AS VARCHAR) AS ranking4 FROM resp""",
)
def split_rank(spark, folder):
    """Places of a delimited ranking; NULL past its end."""
    ranked = respondents(spark, folder).selectExpr(
        "id", "concat_ws(' | ', past, intent, IF(status != 'P', gender, NULL)) AS ranking"
    )
    return ranking_columns(ranked, "ranking", 4).drop("ranking")


@query(
    "decimal_comma",
    """SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS price FROM orders""",
)
def decimal_commas(spark, folder):
    """Decimal commas to numbers; a mark that is no number becomes NULL."""
    text = "IF(o_orderstatus = 'P', '/', replace(CAST(o_totalprice AS STRING), '.', ',')) AS price"
    return table(spark, folder, "orders").selectExpr("o_orderkey", text).withColumn("price", decimal_comma(F.col("price")))


@query(
    "date_parse",
    """SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN CAST(o_orderdate AS DATE) END AS day FROM orders""",
)
def date_parse(spark, folder):
    text = "IF(o_orderstatus = 'P', 'Bundestagswahl', date_format(o_orderdate, 'dd.MM.yyyy')) AS day"
    return table(spark, folder, "orders").selectExpr("o_orderkey", text).withColumn("day", parse_day(F.col("day")))


@query(
    "date_parts",
    """SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS year, monthname(o_orderdate) AS month,
       CAST(datediff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS INTEGER) AS days,
       CAST(2017 - year(o_orderdate) AS INTEGER) AS age FROM orders""",
)
def date_parts(spark, folder):
    day = F.col("o_orderdate").cast("date")
    return table(spark, folder, "orders").select(
        "o_orderkey",
        F.year(day).alias("year"),
        F.date_format(day, "MMMM").alias("month"),
        day_gap(day, F.lit("1995-01-01").cast("date")).alias("days"),
        (2017 - F.year(day)).alias("age"),
    )


_LINK_SQL = r"""'<li><a href="([^"]*)">([^<]*)</a></li>'"""


@query(
    "html_rows_extract",
    f"""WITH r AS (SELECT page_id, unnest(range(len(regexp_extract_all(html, {_LINK_SQL})))) AS position,
  regexp_extract_all(html, {_LINK_SQL}, 1) AS targets, regexp_extract_all(html, {_LINK_SQL}, 2) AS labels FROM pages)
SELECT page_id, CAST(position AS INTEGER) AS position, targets[position + 1] AS target, labels[position + 1] AS label FROM r""",
)
def html_rows_extract(spark, folder):
    """List rows of every page with their position."""
    return link_rows(table(spark, folder, "pages"), "page_id")


@query(
    "html_grid_rows",
    """WITH l AS (SELECT l_orderkey // 64 AS page, l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) AS q, CAST(round(l_extendedprice * 100) AS BIGINT) AS p,
  CAST(round(l_discount * 100) AS BIGINT) AS d, l_returnflag = 'N' AS open FROM lineitem)
SELECT page, CAST(1 + row_number() OVER (PARTITION BY page ORDER BY l_orderkey, l_linenumber, q, p, d, open) AS INTEGER) AS row, CAST(l_orderkey AS VARCHAR) AS key,
  CAST(q AS VARCHAR) AS quantity, CASE WHEN open THEN '< ' || p ELSE CAST(p AS VARCHAR) END AS price,
  CASE WHEN open THEN '< ' || p ELSE CAST(d AS VARCHAR) END AS discount FROM l""",
)
def html_grid_rows(spark, folder):
    """Lines as web tables of 64 orders: the order's cell spans its lines, an open price spans two columns, a head of two rows, tables within cells."""
    lines = table(spark, folder, "lineitem").selectExpr(
        "l_orderkey DIV 64 AS page", "l_orderkey", "l_linenumber", "CAST(l_quantity AS BIGINT) AS q", "CAST(round(l_extendedprice * 100) AS BIGINT) AS p",
        "CAST(round(l_discount * 100) AS BIGINT) AS d", "l_returnflag = 'N' AS open",
    )
    order = ("l_linenumber", "q", "p", "d", "open")
    own = F.collect_list(F.struct(*order))
    # As in SQL, nulls come last.
    ranked = F.transform(own, lambda x: F.struct(*(one for c in order for one in (x[c].isNull().alias(f"no_{c}"), x[c].alias(c)))))
    rows = lines.groupBy("page", "l_orderkey").agg(F.array_sort(ranked).alias("own"))
    # A null is an empty cell; a cell that spans the most rows is followed by another one.
    body = f"""array_join(transform(own, (x, i) -> concat('<tr class="a>b">',
        IF(i % {MOST_ROWS} = 0, concat('<th rowspan=', least(size(own) - i, {MOST_ROWS}), '>', coalesce(string(l_orderkey), ''), '</th>'), ''),
        '<td>', coalesce(string(x.q), ''), '<table><tr><td>inner<td>', coalesce(string(x.d), ''), '</table>\n', IF(x.open, concat('<td colspan="2">', coalesce(concat('&lt; ', x.p), '')),
        concat('<td><b>', coalesce(string(x.p), ''), '</b></td> <TD>', coalesce(string(x.d), ''))))), '')"""
    head = "<!-- <table> --><p>Lines<table><thead><tr><th rowspan=2>Key<th rowspan='2'>Quantity<th colspan=2>Amounts<tr><th>Price</th><th>Discount<tbody>"
    pages = rows.groupBy("page").agg(F.array_sort(F.collect_list(F.struct("l_orderkey", F.expr(body).alias("part")))).alias("parts"))
    html = F.concat(F.lit(head), F.array_join("parts.part", ""), F.lit("</table><p>end"))
    read = grid_rows(pages.select("page", html.alias("html")), "page", ("Key", "Quantity", "Price", "Discount"))
    return read.select("page", "row", *(F.expr(f"nullif({c}, '')").alias(c) for c in ("key", "quantity", "price", "discount")))


def _scratch(spark, kind: str) -> str:
    """A new folder inside the shared one."""
    return f"{shared_folder(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


_ROUNDTRIP_SQL = f"WITH {RESP_SQL} SELECT id, gender, agegroup, past, intent, w0, wave, day FROM resp"


def _stored(spark, folder):
    return respondents(spark, folder).select("id", "gender", "agegroup", "past", "intent", "w0", "wave", "day")


@query("src_parquet_roundtrip", _ROUNDTRIP_SQL)
def src_parquet_roundtrip(spark, folder):
    """Stored by wave, so that a filter on the wave reads only its folder."""
    return save_table(_stored(spark, folder), _scratch(spark, "parquet"), ["wave"])


@query("src_csv_roundtrip", _ROUNDTRIP_SQL)
def src_csv_roundtrip(spark, folder):
    return save_csv(_stored(spark, folder), _scratch(spark, "csv"))
