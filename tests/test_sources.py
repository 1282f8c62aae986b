"""Readers, writers and page extraction on small files."""

import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from pollweave.functions import null_tokens
from pollweave.operators.frames import columns_first, label_blocks, rename_by_rules, rename_positions
from pollweave.plans.benchmark_plan import polls_from_pages
from pollweave.sources import PollColumns, clean_poll_rows, read_statistics, read_two_row_header, read_wave, save_csv, save_table, table_rows
from pollweave.sources.pages import BODY_CELL, HEAD_CELL


def write(tmp_path, name, text):
    file = tmp_path / name
    file.write_text(text, encoding="utf-8")
    return str(file)


def test_wave_with_one_and_several_na_tokens(spark, tmp_path):
    schema = StructType([StructField("uuid", StringType()), StructField("age", DoubleType()), StructField("vote", StringType())])
    path = write(tmp_path, "wave.csv", 'uuid,age,vote\na,34,"Grüne, die"\nb,NA,NA\nc,x,-\n')
    one = [tuple(r) for r in read_wave(spark, path, schema).collect()]
    assert one[0] == ("a", 34.0, "Grüne, die") and one[1] == ("b", None, None)
    several = [tuple(r) for r in read_wave(spark, path, schema, na=("NA", "-")).collect()]
    assert several == [("a", 34.0, "Grüne, die"), ("b", None, None), ("c", None, None)]


def test_statistics_table(spark, tmp_path):
    preamble = "".join(f"line {i}\n" for i in range(10))
    body = "CDU;24,5;1\n;;\nSPD;30,1;2\nx;/;3\n"
    path = write(tmp_path, "stat.csv", preamble + body)
    rows = read_statistics(spark, path, ["party", "a", "b"], 10, na=("/", ""), numeric=["a", "b"]).orderBy("line").collect()
    assert [(r.party, r.a, r.b) for r in rows] == [("CDU", 24.5, 1.0), (None, None, None), ("SPD", 30.1, 2.0), ("x", None, 3.0)]
    assert [r.line for r in rows] == [10, 11, 12, 13]


def test_rows_are_labelled_in_blocks(spark, tmp_path):
    path = write(tmp_path, "blocks.csv", "".join(f"p{i};{i},5\n" for i in range(24)))
    rows = read_statistics(spark, path, ["party", "v"], numeric=["v"])
    found = label_blocks(rows, ["line"], ["Total", "Male", "Female"], 8, "gender").orderBy("line").collect()
    assert [r.gender for r in found] == ["Total"] * 8 + ["Male"] * 8 + ["Female"] * 8


def test_two_row_header(spark, tmp_path):
    text = "title\nsource\nReligion;Männlich;;Weiblich;\n;Unter 10;10 - 19;Unter 10;10 - 19\nKirche;1,5;/;3;4\n"
    path = write(tmp_path, "census.csv", text)
    df = read_two_row_header(spark, path, 2, 3, 4)
    assert df.columns == ["file", "line", "Religion", "Männlich.Unter 10", "Männlich.10 - 19", "Weiblich.Unter 10", "Weiblich.10 - 19"]
    assert [tuple(r)[2:] for r in df.collect()] == [("Kirche", "1,5", None, "3", "4")]


def test_names(spark):
    df = spark.createDataFrame([(1, 2, 3)], ["[A1] Age", "x_Q2_gender", "Other"])
    renamed = rename_by_rules(df, [(r"\[.+\] (.+)", r"\1"), (r".+Q\d+_", "")], lower=True)
    assert renamed.columns == ["age", "gender", "other"]
    assert rename_positions(df, {1: "b"}).columns == ["[A1] Age", "b", "Other"]
    assert columns_first(renamed, "other").columns == ["other", "age", "gender"]


def test_round_trips(spark, tmp_path):
    schema = StructType([StructField("k", LongType()), StructField("t", StringType()), StructField("v", DoubleType()), StructField("w", StringType())])
    rows = [(1, 'a, "b"', 0.1, "x"), (2, None, None, "y"), (3, "Grüne", 1e-9, "x")]
    df = spark.createDataFrame(rows, schema)
    assert sorted(map(tuple, save_csv(df, str(tmp_path / "c")).collect())) == rows
    stored = save_table(df, str(tmp_path / "p"), ["w"])
    assert sorted(map(tuple, stored.select("k", "t", "v", "w").collect())) == rows
    assert (tmp_path / "p" / "w=x").is_dir()


PAGE = """<html><body><table><thead><tr><th></th><th>CDU/CSU</th><th>SPD</th><th>GRÜNE</th>{extra}</tr></thead>
<tbody>
<tr><td>24.05.2017</td><td>37,5 %</td><td>≈ 25 %</td><td><b>8</b>&nbsp;%</td>{a}</tr>
<tr><td>22.09.2013</td><td>41,5 %</td><td>25,7 %</td><td>8,4 %</td>{b}</tr>
<tr><td>17.05.2017</td><td>38 %</td><td>–</td><td>7 %</td>{c}</tr>
</tbody></table></body></html>"""


@pytest.fixture(scope="module")
def pages(spark):
    heads = "<th>Befragte</th><th>Zeitraum</th>"
    one = PAGE.format(extra=heads, a="<td>O • 2.004</td><td>18.05.–22.05.</td>", b="<td>Bundestagswahl</td><td></td>", c="<td>?</td><td>x</td>")
    # A spare cell stands before the last two columns and has no head.
    two = PAGE.format(extra=heads, a="<td></td><td>T • 1.500</td><td>a</td>", b="<td></td><td>Bundestagswahl</td><td></td>", c="<td></td><td>1.000</td><td>b</td>")
    return spark.createDataFrame([("insa", one), ("politbarometer", two)], "institut STRING, html STRING")


def test_table_rows(pages):
    rows = table_rows(pages, "institut", ["SPD", "FDP", "Befragte"], shifted={"politbarometer": ["Befragte"]}).orderBy("institut", "row").collect()
    assert [(r.institut, r.row, r.datum, r.spd, r.fdp, r.befragte) for r in rows] == [
        ("insa", 0, "24.05.2017", "≈ 25 %", None, "O • 2.004"),
        ("insa", 1, "22.09.2013", "25,7 %", None, "Bundestagswahl"),
        ("insa", 2, "17.05.2017", "–", None, "?"),
        ("politbarometer", 0, "24.05.2017", "≈ 25 %", None, "T • 1.500"),
        ("politbarometer", 1, "22.09.2013", "25,7 %", None, "Bundestagswahl"),
        ("politbarometer", 2, "17.05.2017", "–", None, "1.000"),
    ]


def test_heads_are_read_once_a_page(pages):
    """Not once for every row and use, which is quadratic in the rows of a page."""
    raw = table_rows(pages.select("institut", F.concat("html", "html").alias("html")), "institut", ["CDU/CSU", "SPD", "Befragte"])
    plan = clean_poll_rows(raw.withColumn("zeitraum", F.lit("x")), PollColumns(parties={"spd": "SPD"}))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(HEAD_CELL) == plan.count(BODY_CELL) == 1
    assert plan.index(BODY_CELL) < plan.index(HEAD_CELL)  # heads below the rows


def test_polls_from_pages(pages):
    rows = polls_from_pages(pages).collect()
    known = {(r.institut, r.datum, r.partei): (r.befragte, r.typ, r.anteil) for r in rows}
    day = dt.date(2017, 5, 24)
    assert known["insa", day, "CDU/CSU"] == (2004.0, "online", 0.375)
    assert known["insa", day, "SPD"] == (2004.0, "online", 0.25)
    assert known["insa", day, "Grüne"] == (2004.0, "online", 0.08)
    assert known["insa", day, "AfD"][2] is None
    assert known["politbarometer", day, "SPD"][:2] == (1500.0, "telefon")
    assert known["politbarometer", dt.date(2017, 5, 17), "CDU/CSU"] == (1000.0, "keineangabe", 0.38)
    assert {d for _, d, _ in known} == {day, dt.date(2017, 5, 17)}  # no election row, no row without a size
    assert ("insa", dt.date(2017, 5, 17), "SPD") not in known


def test_null_tokens_leave_numbers(spark):
    assert null_tokens(spark.createDataFrame([(1, "/")], "n INT, t STRING"), ["/"]).first() == (1, None)
