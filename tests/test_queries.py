"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__
from __spark_entry__ import entry
from pollweave.plans import queries_analyses
from pollweave.plans.catalog import ORACLES, QUERIES
from pollweave.sources import table_rows
from tools.compare import compare, connect

FOLDER = "/root/testdata/sf0.001"
ROWS_ONLY: set[str] = set()


@pytest.fixture(scope="module")
def connection():
    return connect(FOLDER)


def test_flagship(spark):
    assert entry(spark).columns == ["intent", "n", "share"]


def test_every_query_has_sql():
    assert set(QUERIES) - set(ORACLES) == ROWS_ONLY
    assert set(ORACLES) <= set(QUERIES)


def test_entry_offers_them_all():
    assert QUERIES.keys() <= __spark_entry__.queries().keys()
    assert ORACLES.keys() <= __spark_entry__.oracle_sql().keys()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, connection, name):
    verdict = compare(name, QUERIES[name](spark, FOLDER), connection, ORACLES[name])
    assert verdict.startswith("ok"), verdict


def test_pages_of_one_large_source_are_bounded(spark, tmp_path, monkeypatch):
    parties = list(queries_analyses.PARTIES)
    connect(FOLDER).execute(
        f"""COPY (SELECT i AS event_id, TIMESTAMP '2024-03-05 12:00:00' AS ts, CASE WHEN i < 5000 THEN 1 ELSE i END AS user_id,
        list_extract({parties!r}, 1 + i % {len(parties)}) AS event_type, CAST(i % 97 AS DOUBLE) AS value, '' AS props FROM range(5020) r(i))
        TO '{tmp_path}/events.parquet' (FORMAT parquet)"""
    )
    seen = []
    monkeypatch.setattr(queries_analyses, "table_rows", lambda pages, *rest: seen.append(pages) or table_rows(pages, *rest))
    verdict = compare("poll_table_rows", QUERIES["poll_table_rows"](spark, str(tmp_path)), connect(str(tmp_path)), ORACLES["poll_table_rows"])
    assert verdict.startswith("ok 5020 rows"), verdict
    sizes = sorted(r.n for r in seen[0].selectExpr("regexp_count(html, '<tr ') AS n").collect())
    assert sum(sizes) == 5020 and sizes[:20] == [1] * 20 and len(sizes) == 30 and sizes[-1] < 2 * 500


def _html_grid_rows_of(spark, folder, lines):
    numbers = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in ("l_quantity", "l_extendedprice", "l_discount"))
    connect(FOLDER).execute(f"COPY (SELECT * REPLACE ({numbers}) FROM ({lines})) TO '{folder}/lineitem.parquet' (FORMAT parquet)")
    return compare("html_grid_rows", QUERIES["html_grid_rows"](spark, str(folder)), connect(str(folder)), ORACLES["html_grid_rows"])


def test_web_tables_hold_the_lines_of_every_number(spark, tmp_path):
    lines = "SELECT o AS l_orderkey, CAST(n AS INTEGER) AS l_linenumber, o + 2.0 AS l_quantity, n + 0.25 AS l_extendedprice, 0.05 AS l_discount, if(n % 2 = 0, 'N', 'R') AS l_returnflag"
    verdict = _html_grid_rows_of(spark, tmp_path, f"{lines} FROM range(100) a(o), range(1, 8) b(n) WHERE n <= 1 + o % 7")
    assert verdict == f"ok {sum(1 + o % 7 for o in range(100))} rows"


def test_web_tables_hold_lines_with_nulls_and_repeats(spark, tmp_path):
    """Every column null in some lines, alone and together, each line twice."""
    values = ("CAST(i // 32 AS BIGINT)", "CAST(i % 3 + 1 AS INTEGER)", "i % 5 + 1.0", "i % 11 + 0.5", "0.05", "if(i % 3 = 0, 'N', 'R')")
    names = ("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag")
    columns = ", ".join(f"if(i & {1 << k} > 0, NULL, {value}) AS {name}" for k, (value, name) in enumerate(zip(values, names, strict=True)))
    assert _html_grid_rows_of(spark, tmp_path, f"SELECT {columns} FROM range(4096) a(i), range(2)") == "ok 8192 rows"


def test_an_order_of_a_web_table_has_more_lines_than_a_cell_spans(spark, tmp_path):
    lines = "SELECT CAST(i // 70000 AS BIGINT) AS l_orderkey, CAST(i % 70000 AS INTEGER) AS l_linenumber, 3.0 AS l_quantity, 1.5 AS l_extendedprice, 0.05 AS l_discount, 'R' AS l_returnflag"
    assert _html_grid_rows_of(spark, tmp_path, f"{lines} FROM range(70010) a(i)") == "ok 70010 rows"
