"""The chunked forms must equal the plain window, also for one hot series."""

import random

import pytest
from pyspark.sql import functions as F

from pollweave.operators.estimate import summary_statistics
from pollweave.operators.frames import add_row_number, label_blocks
from pollweave.operators.impute import impute_hotdeck
from pollweave.operators.ordered import carry_forward, in_order, number_rows, trailing
from pollweave.operators.polls import rolling_error, rolling_mean, with_errors


def series(spark, sizes, gaps=0.4):
    draw = random.Random(7)
    rows = []
    for key, size in sizes.items():
        for i in range(size):
            x = None if draw.random() < gaps else round(draw.random(), 3)
            rows.append((key, draw.randrange(40), i, x))
    draw.shuffle(rows)
    return spark.createDataFrame(rows, "k STRING, d INT, i INT, x DOUBLE").repartition(5)


def result(df):
    return sorted(df.select(sorted(df.columns)).collect(), key=str)


@pytest.mark.parametrize("rows_per_task", [3, 17, 100])
@pytest.mark.parametrize("lookback", [1, 9])
def test_trailing(spark, rows_per_task, lookback):
    df = series(spark, {"hot": 400, "b": 60, "c": 4, None: 30})
    columns = {
        "m": lambda w: F.round(F.avg("x").over(w), 9),
        "c": lambda w: F.count(F.lit(1)).over(w),
        "first": lambda w: F.first("i").over(w),
    }
    plain = in_order(df, ["k"], ["d", "i"])
    cut = in_order(df, ["k"], ["d", "i"], rows_per_task)
    assert cut.chunked and not plain.chunked
    assert result(trailing(plain, lookback, columns)) == result(trailing(cut, lookback, columns))


@pytest.mark.parametrize("keys", [[], ["k"]])
def test_number_rows(spark, keys):
    df = series(spark, {"hot": 300, "b": 50})
    cut = in_order(df, keys, ["d", "i", "k"], 20)
    assert cut.chunked
    assert result(number_rows(cut, "r")) == result(number_rows(in_order(df, keys, ["d", "i", "k"]), "r"))


@pytest.mark.parametrize("gaps", [0.4, 0.97])
def test_carry_forward(spark, gaps):
    df = series(spark, {"hot": 300, "b": 50}, gaps)
    cut = in_order(df, ["k"], ["d", "i"], 8)
    assert cut.chunked
    assert result(carry_forward(cut, "x", "y")) == result(carry_forward(in_order(df, ["k"], ["d", "i"]), "x", "y"))


def test_hotdeck_over_chunks(spark):
    df = series(spark, {"hot": 200, "b": 20})
    order = ["d", "k", "i"]
    assert result(impute_hotdeck(df, "x", order)) == result(impute_hotdeck(df, "x", order, rows_per_task=11))


def test_row_number_and_blocks(spark):
    df = spark.range(100).withColumnRenamed("id", "v")
    cut = add_row_number(df, ["v"], rows_per_task=7)
    assert [tuple(r) for r in cut.orderBy("v").collect()] == [(i, i + 1) for i in range(100)]
    blocks = label_blocks(df, ["v"], ["T", "M", "F"], 8, "g", rows_per_task=9).orderBy("v").collect()
    assert [r.g for r in blocks] == ["TMF"[(i // 8) % 3] for i in range(100)]


def test_quartiles_from_ranks(spark):
    df = series(spark, {"a": 301}, 0.2)
    whole, ranked = summary_statistics(df, "x").first(), summary_statistics(df, "x", rows_per_task=13).first()
    for name in whole.asDict():
        assert whole[name] == pytest.approx(ranked[name], abs=1e-12)


def test_rolling_poll_series_over_chunks(spark):
    draw = random.Random(3)
    rows = [
        ("hot" if i % 4 else "cold", f"2017-0{draw.randint(1, 9)}-11", float(draw.randint(900, 1100)), draw.random())
        for i in range(500)
    ]
    polls = spark.createDataFrame(rows, "partei STRING, datum STRING, befragte DOUBLE, anteil DOUBLE")
    polls = with_errors(polls.withColumn("datum", F.col("datum").cast("date")))
    for operator, value in ((rolling_mean, "rolling_average"), (rolling_error, "rolling_error")):
        a = operator(polls).withColumn(value, F.round(value, 9))
        b = operator(polls, rows_per_task=25).withColumn(value, F.round(value, 9))
        assert result(a) == result(b)


def test_short_series_has_no_average(spark):
    rows = [("p", i, 1000.0, 0.3) for i in range(9)]
    polls = spark.createDataFrame(rows, "partei STRING, datum INT, befragte DOUBLE, anteil DOUBLE")
    assert rolling_mean(polls).filter("rolling_average IS NOT NULL").count() == 0
