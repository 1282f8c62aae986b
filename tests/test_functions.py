"""Column functions."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from pollweave.functions import (
    band,
    collapse_other,
    decimal_comma,
    extract,
    half_width,
    mean_date,
    nth_choice,
    null_tokens,
    parse_day,
    range_label,
    recode,
    recode_frame,
    replace_first,
    round_to,
    split_label,
    sum_policy,
    survey_mode,
)


def values(spark, column, rows, schema="x STRING"):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


@pytest.mark.parametrize(
    "pattern, text",
    [
        ("CDU|CSU", "Union"),
        ("^male", "Male"),
        ("G.*?en", "Gruene"),
        (r"(46-60)|(60\+)", "45Plus"),
        (r"\s.+ter", "p"),
        ("o$", "1$x"),
    ],
)
def test_replace_first_is_like_sub(spark, pattern, text):
    rows = ["CDU CSU CDU", "male and male", "Die Grünen Grünen", "60+ 46-60", "80 und älter älter", "so so", "", "x\ny CSU"]
    found = values(spark, replace_first(F.col("x"), pattern, text), [(r,) for r in rows] + [(None,)])
    assert found == [re.sub(pattern, lambda m: text, r, count=1) for r in rows] + [None]


def test_extract_gives_null(spark):
    assert values(spark, extract(F.col("x"), "^.*male"), [("female.10",), ("x",), (None,)]) == ["female", None, None]


def test_split_label(spark):
    gender, age = split_label(F.col("x"), ".*male")
    rows = [("female.10.19",), ("male.80p",)]
    assert values(spark, F.struct(gender, age), rows) == [("female", "10.19"), ("male", "80p")]


def test_decimal_comma(spark):
    rows = [("37,5",), (" 4 ",), ("/",), ("",), (None,), ("1.5",)]
    assert values(spark, decimal_comma(F.col("x")), rows) == [37.5, 4.0, None, None, None, 1.5]


def test_nth_choice(spark):
    rows = [("A | B | C",)]
    assert [values(spark, nth_choice(F.col("x"), k), rows)[0] for k in (1, 3, 4)] == ["A", "C", None]


def test_band_edges(spark):
    labels = ("18-25", "26-35", "36-45", "46-60", "60+")
    found = values(spark, band(F.col("x"), (25.5, 35.5, 45.5, 60.5), labels), [(v,) for v in (-1.0, 25.0, 25.5, 60.0, 60.5, 99.0, None)], "x DOUBLE")
    assert found == ["18-25", "18-25", "26-35", "46-60", "60+", "60+", None]
    with pytest.raises(ValueError):
        band(F.col("x"), (1,), ("a",))


def test_recode(spark):
    rows = [("a",), ("b",), (None,)]
    assert values(spark, recode(F.col("x"), {"a": "1"}), rows) == ["1", "b", None]
    assert values(spark, recode(F.col("x"), {"a": "1"}, keep_unmapped=False), rows) == ["1", None, None]
    assert values(spark, collapse_other(F.col("x"), ["a"]), rows) == ["a", "Other", "Other"]


def test_whole_frames(spark):
    df = spark.createDataFrame([("/", 1, "a"), ("b", 2, ""), (None, 3, "c")], "x STRING, n INT, y STRING")
    assert [tuple(r) for r in null_tokens(df, ["/", ""]).collect()] == [(None, 1, "a"), ("b", 2, None), (None, 3, "c")]
    assert [tuple(r) for r in recode_frame(df, {"a": "A", "b": "B"}).collect()][:2] == [("/", 1, "A"), ("B", 2, "")]


def test_sum_policy(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("b", 2.0)], "k STRING, v DOUBLE")
    found = df.groupBy("k").agg(sum_policy(F.col("v")).alias("s"), sum_policy(F.col("v"), "propagate").alias("p"))
    assert {tuple(r) for r in found.collect()} == {("a", 1.0, None), ("b", 2.0, 2.0)}
    with pytest.raises(ValueError):
        sum_policy(F.col("v"), "other")


def test_dates(spark):
    assert values(spark, parse_day(F.col("x")), [("24.05.2017",), ("Bundestagswahl",), (None,)]) == [dt.date(2017, 5, 24), None, None]
    rows = [(dt.date(2017, 3, 18),), (dt.date(2017, 3, 22),)]
    assert values(spark, mean_date(F.col("x")), rows, "x DATE") == [dt.date(2017, 3, 20)]


def test_labels_and_errors(spark):
    df = spark.createDataFrame([(0.314, 0.352, 1000.0), (0.0, 0.5, 0.0)], "lo DOUBLE, hi DOUBLE, n DOUBLE")
    rows = df.select(range_label(F.col("lo"), F.col("hi")).alias("l"), half_width(F.col("lo"), F.col("n")).alias("w")).collect()
    assert rows[0].l == "31-35%"
    assert rows[0].w == pytest.approx(1.96 * (0.314 * 0.686 / 1000) ** 0.5)
    assert rows[1].w is None  # no respondents


def test_rounding_of_ties(spark):
    rows = [(0.5,), (1.5,), (2.5,)]
    assert values(spark, round_to(F.col("x"), 0), rows, "x DOUBLE") == [1.0, 2.0, 3.0]
    assert values(spark, round_to(F.col("x"), 0, "even"), rows, "x DOUBLE") == [0.0, 2.0, 2.0]


def test_survey_mode(spark):
    rows = [("O • 2.004",), ("T • 1.500",), ("1.000",)]
    assert values(spark, survey_mode(F.col("x")), rows) == ["online", "telefon", "keineangabe"]
