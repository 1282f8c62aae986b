"""As-of match, cell sums by waves, lines and rows by number, levels found in the data."""

import random

import pytest
from pyspark.sql import functions as F

from pollweave.operators.asof import as_of
from pollweave.operators.frames import drop_rows_by_index
from pollweave.operators.incremental import add_new_files, cells_so_far
from pollweave.operators.strata import crosstab_found
from pollweave.sources import read_lines, read_statistics


@pytest.mark.parametrize("rows_per_task", [10_000, 40])
def test_as_of_against_brute_force(spark, rows_per_task):
    pick = random.Random(3)
    keys = ["hot"] * 8 + ["a", None]
    right = [(pick.choice(keys), pick.choice([None, *range(40)]), pick.choice([None, 1.0, 2.0, 3.0])) for _ in range(300)]
    left = [(n, pick.choice(keys + ["none"]), pick.choice([None, *range(-2, 45)]), "x") for n in range(200)]
    found = as_of(
        spark.createDataFrame(left, "id INT, k STRING, t INT, v STRING").repartition(4),
        spark.createDataFrame(right, "k STRING, at INT, v DOUBLE").repartition(4),
        "t", ["v"], ["k"], "at", rows_per_task,
    )
    assert found.columns == ["id", "k", "t", "v", "prev_t", "prev_v", "next_t", "next_v"]
    order = lambda r: (r[1], r[2] is not None, r[2] or 0)
    got = {r.id: tuple(r)[4:] for r in found.collect()}
    assert len(got) == len(left)
    for n, k, t, _ in left:
        own = sorted((r for r in right if r[0] == k and r[1] is not None), key=order)
        before = [r for r in own if t is not None and r[1] <= t]
        after = [r for r in own if t is not None and r[1] > t]
        want = (*(before[-1][1:] if before else (None, None)), *(after[0][1:] if after else (None, None)))
        assert got[n] == want, (n, k, t)


def test_as_of_forms_no_pairs(spark):
    events = spark.range(100).selectExpr("id % 3 AS k", "CAST(id AS TIMESTAMP) AS ts", "id * 1.0D AS v")
    plan = as_of(events.select("k", "ts"), events, "ts", ["v"], ["k"])._jdf.queryExecution().toString()
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") >= 1


def test_waves_are_counted_once(spark, tmp_path):
    source, state = str(tmp_path / "source"), str(tmp_path / "state")
    schema = "k STRING, y DOUBLE"
    waves = [[("a", 1.0), ("b", None), (None, 2.0)], [("a", 5.0)], [("c", 1.0), ("a", None)]]
    read = []
    for wave in waves:
        spark.createDataFrame(wave, schema).coalesce(1).write.mode("append").parquet(source)
        read.append(add_new_files(spark, source, schema, state, ["k"], ["y"]))
    read.append(add_new_files(spark, source, schema, state, ["k"], ["y"]))
    assert read == [3, 1, 2, 0]
    found = {r.k: (r.n, r.sum_y) for r in cells_so_far(spark, state, ["k"]).collect()}
    assert found == {"a": (3, 6.0), "b": (1, None), "c": (1, 1.0), None: (1, 2.0)}


def test_a_repeated_run_overwrites_its_cells(spark, tmp_path):
    """A run that stopped before its commit is done again: what it wrote does not count."""
    source, state = str(tmp_path / "source"), str(tmp_path / "state")
    rows = spark.createDataFrame([("a",), ("a",)], "k STRING").coalesce(1)
    rows.write.parquet(source)

    def stops(batch):
        batch.groupBy("k").agg(F.count("*").alias("n")).write.parquet(f"{state}/cells/batch=0")
        raise RuntimeError("stopped")

    with pytest.raises(Exception, match="stopped"):
        add_new_files(spark, source, "k STRING", state, ["k"], prepare=stops)
    assert cells_so_far(spark, state, ["k"]).first().n == 2
    assert add_new_files(spark, source, "k STRING", state, ["k"]) == 2
    assert cells_so_far(spark, state, ["k"]).first().n == 2


@pytest.fixture
def small_splits(spark):
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    spark.conf.set(name, "2000")
    yield
    spark.conf.set(name, before)


def test_line_numbers_over_many_splits(spark, tmp_path, small_splits):
    texts = {"a.txt": "".join(f"{k};{'x' * (k % 90)}\n" if k % 11 else "\r\n" for k in range(1500)), "b.txt": "one\r\ntwo\n\nfour", "c.txt": ""}
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 10
    found = sorted((r.file.rsplit("/", 1)[1], r.line, r.text) for r in read_lines(spark, str(tmp_path)).collect())
    want = sorted((name, n, line.removesuffix("\r")) for name, text in texts.items() for n, line in enumerate(text.split("\n")) if line.removesuffix("\r"))
    assert found == want
    table = read_statistics(spark, str(tmp_path / "a.txt"), ["k", "x"], skip=700)
    assert table.agg(F.min("line"), F.count("*")).first()[:] == (700, sum(k % 11 > 0 for k in range(700, 1500)))


def test_rows_by_index(spark):
    rows = spark.range(100).selectExpr("100 - id AS v", "id").repartition(7)
    for size in (10, 1000):
        found = {r.v for r in drop_rows_by_index(rows, ["v"], [1, 2, 50, 1000], size).collect()}
        assert found == set(range(1, 101)) - {1, 2, 50}
    wanted = spark.createDataFrame([(3,), (3,), (None,)], "n INT")
    assert drop_rows_by_index(rows, ["v"], wanted).count() == 99


def test_levels_are_found(spark):
    rows = [("r1", "b", 2.0), ("r1", "a", 1.0), ("r2", "b", None), (None, "c", 4.0), ("r3", None, 5.0)]
    df = spark.createDataFrame(rows, "r STRING, c STRING, w DOUBLE")
    found = crosstab_found(df, "r", "c")
    assert found.wide and found.table.columns == ["r", "a", "b"]
    assert {tuple(r) for r in found.table.collect()} == {("r1", 1, 1), ("r2", 0, 1)}
    kept = crosstab_found(df, "r", "c", weight="w", keep_null=True)
    assert {tuple(r) for r in kept.table.collect()} == {("r1", 1.0, 2.0, 0.0), ("r2", 0.0, 0.0, 0.0), (None, 0.0, 0.0, 4.0)}
    long = crosstab_found(df, "r", "c", most=1)
    assert not long.wide and {tuple(r) for r in long.table.collect()} == {("r1", 1, 1), ("r1", 2, 1), ("r2", 2, 1)}
    assert [tuple(r) for r in long.dictionary.orderBy("ordinal").collect()] == [("a", 1, 1), ("b", 2, 2)]
    none = crosstab_found(df.where("false"), "r", "c")
    assert none.wide and none.table.columns == ["r"] and none.table.count() == 0
