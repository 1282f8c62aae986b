"""Poll series against brute force on small fixtures."""

import datetime as dt
import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from pollweave.operators.polls import envelope, interpolate, latest_benchmark, latest_per_source, ranked_snapshot, with_errors

START = dt.date(2017, 1, 1)


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(11)
    found = []
    for _ in range(160):
        found.append(
            (
                f"i{draw.randint(1, 5)}",
                START + dt.timedelta(days=draw.randint(0, 30)),
                draw.choice(["A", "B"]),
                round(draw.uniform(0.05, 0.5), 3),
                float(draw.choice([0, 1000, 1500, 2004])) if draw.random() < 0.1 else 1250.0,
            )
        )
    return found + found[:20]  # copies


@pytest.fixture(scope="module")
def polls(spark, rows):
    return spark.createDataFrame(rows, "institut STRING, datum DATE, partei STRING, anteil DOUBLE, befragte DOUBLE")


def looking_back(rows, party, day):
    seen = [r for r in set(rows) if r[2] == party and r[1] <= day]
    newest = {}
    for r in seen:
        newest[r[0]] = max(newest.get(r[0], r[1]), r[1])
    return [r for r in seen if r[1] == newest[r[0]]]


@pytest.mark.parametrize("method", ["linear", "gauss"])
def test_latest_per_source(polls, rows, method):
    found = latest_per_source(polls, {"x": ("anteil", method)}).collect()
    assert len(found) == len({(r[2], r[1]) for r in rows})
    for row in found:
        latest = looking_back(rows, row.partei, row.datum)
        size = sum(r[4] for r in latest)
        if method == "linear":
            expected = sum(r[4] * r[3] for r in latest) / size if size else None
        else:
            expected = math.sqrt(sum((r[4] * r[3]) ** 2 for r in latest)) / size if size else None
        assert row.x == (None if expected is None else pytest.approx(expected, abs=1e-9))


def test_single_poll_keeps_its_share(spark):
    one = spark.createDataFrame([("i", START, "A", 0.31, 1000.0)], "institut STRING, datum DATE, partei STRING, anteil DOUBLE, befragte DOUBLE")
    row = latest_benchmark(one).first()
    delta = round(1.96 * math.sqrt(0.31 * 0.69 / 1000), 5)
    assert row.rolling_average == pytest.approx(0.31)
    assert row.ci_higher == pytest.approx(0.31 + delta) and row.ci_lower == pytest.approx(0.31 - delta)


def test_last_poll_counts_for_ever(spark):
    rows = [("a", START, "A", 0.2, 1000.0)] + [("b", START + dt.timedelta(days=d), "A", 0.4, 1000.0) for d in (1, 300)]
    polls = spark.createDataFrame(rows, "institut STRING, datum DATE, partei STRING, anteil DOUBLE, befragte DOUBLE")
    found = {r.datum: r.x for r in latest_per_source(polls, {"x": ("anteil", "linear")}).collect()}
    assert found[START + dt.timedelta(days=300)] == pytest.approx(0.3)


def by_series(rows):
    days = defaultdict(list)
    for institute, day, party, share, _ in rows:
        days[institute, party, day].append(share)
    grouped = defaultdict(dict)
    for (institute, party, day), shares in days.items():
        grouped[institute, party][day] = sum(shares) / len(shares)
    return grouped


def on_line(points, day):
    before = [d for d in points if d <= day]
    after = [d for d in points if d > day]
    if not before:
        return None
    a = max(before)
    if a == day:
        return points[a]
    if not after:
        return None
    b = min(after)
    return points[a] + (points[b] - points[a]) * (day - a).days / (b - a).days


def test_interpolation(polls, rows):
    series = by_series(rows)
    spine = {r[1] for r in rows}
    found = {(r.institut, r.partei, r.datum): r.anteil for r in interpolate(polls, "anteil").collect()}
    assert set(found) == {(i, p, d) for i, p in series for d in spine}
    for (institute, party, day), value in found.items():
        expected = on_line(series[institute, party], day)
        assert value == (None if expected is None else pytest.approx(expected, abs=1e-12))


def test_envelope_covers_every_poll_day(polls, rows):
    known = with_errors(polls.filter("befragte > 0"))
    found = envelope(known)
    assert found.count() == len({(p, d) for p in "AB" for d in {r[1] for r in rows if r[4] > 0}})
    days = known.groupBy("partei", "datum").agg(F.avg("ci_lower").alias("one"))
    assert found.join(days, ["partei", "datum"]).filter("ci_lower > one + 1e-9 OR ci_lower > ci_higher").count() == 0


def test_snapshot_is_ranked(polls):
    found = ranked_snapshot(latest_benchmark(polls.filter("befragte > 0"))).orderBy("y").collect()
    assert len({r.datum for r in found}) == 1
    assert [r.y for r in found] == list(range(1, len(found) + 1))
    assert [r.rolling_average for r in found] == sorted((r.rolling_average for r in found), reverse=True)
