"""Fixed-width record files and tables saved in buckets."""

import datetime as dt
import struct

import pytest
from pyspark.sql import functions as F

from pollweave.sources.colocated import join_co_located, save_co_located
from pollweave.sources.stata import HEAD, read_dta, save_dta


def big_endian_file(rows):
    """Columns id (int), sex (byte with labels), income (float), born (days), town (str5)."""
    cells = lambda texts, width: b"".join(t.encode("latin-1").ljust(width, b"\0") for t in texts)
    head = struct.pack(">" + HEAD, 114, 1, 1, 0, 5, len(rows), b"", b"") + bytes([252, 251, 254, 253, 5])
    head += cells(["id", "sex", "income", "born", "town"], 33) + bytes(12) + cells(["%8.0g", "%8.0g", "%9.0g", "%td", "%5s"], 49)
    head += cells(["", "sexes", "", "", ""], 33) + bytes(5 * 81) + struct.pack(">BI3s", 1, 3, b"abc") + bytes(5)
    body = b"".join(struct.pack(">hbfi5s", *row) for row in rows)
    texts = b"male\0female\0"
    table = struct.pack(">II2i2i", 2, len(texts), 0, 5, 1, 2) + texts
    return head + body + struct.pack(">I33s3x", len(table), b"sexes") + table


@pytest.mark.parametrize("split_bytes", [40, 10**6])
def test_records_with_labels_and_missing_values(spark, tmp_path, split_bytes):
    rows = [(k, 1 + k % 2, k / 2, k * 100, f"t{k}".encode()) for k in range(97)]
    rows += [(32741, 101, 2.0**127, 2147483621, b""), (5, 7, -1.5, -3653, "Köl".encode("latin-1"))]
    path = tmp_path / "survey.dta"
    path.write_bytes(big_endian_file(rows))
    df = read_dta(spark, str(path), split_bytes=split_bytes)
    assert df.dtypes == [("id", "int"), ("sex", "string"), ("income", "double"), ("born", "date"), ("town", "string")]
    assert df.rdd.getNumPartitions() == (1 if split_bytes > 1000 else 50)
    day = lambda n: dt.date(1960, 1, 1) + dt.timedelta(n)
    want = [(k, ["male", "female"][k % 2], k / 2, day(k * 100), f"t{k}") for k in range(97)]
    want += [(None, None, None, None, ""), (5, "7", -1.5, day(-3653), "Köl")]
    assert sorted(map(tuple, df.collect()), key=repr) == sorted(want, key=repr)
    one = read_dta(spark, str(path), ["town", "sex"], split_bytes=split_bytes)
    assert one.columns == ["town", "sex"] and one.where("sex = 'male'").count() == 49


def test_written_files_are_read_back(spark, tmp_path):
    schema = "a INT, b LONG, c DOUBLE, d STRING, e DATE, f BOOLEAN"
    rows = [(k, k * 10**10, k / 3, f"é{k}", dt.date(1950 + k % 90, 1, 2), None) for k in range(500)] + [(None, None, None, None, None, True)]
    df = spark.createDataFrame(rows, schema).repartition(3).withColumn("f", F.col("f").cast("int"))
    folder = str(tmp_path / "out")
    assert save_dta(df, folder) == 501
    found = read_dta(spark, folder, split_bytes=1000)
    want = [(a, None if b is None else float(b), c, d or "", e, None if f is None else 1) for a, b, c, d, e, f in rows]
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(want, key=repr)


def test_a_cut_file_raises(spark, tmp_path):
    path = tmp_path / "cut.dta"
    path.write_bytes(big_endian_file([(1, 1, 1.0, 1, b"a")] * 50)[:-400])
    with pytest.raises(Exception, match="ends within its records|unpack"):
        read_dta(spark, str(path)).collect()
    (tmp_path / "no.dta").write_bytes(b"PK")
    with pytest.raises(Exception, match="114 or 115"):
        read_dta(spark, str(tmp_path / "no.dta"))


@pytest.fixture
def no_broadcast(spark):
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    yield
    spark.conf.set(name, before)


def test_saved_tables_join_without_an_exchange(spark, tmp_path, no_broadcast):
    left = spark.range(1000).selectExpr("id % 200 AS k", "id AS v")
    right = spark.range(150).selectExpr("id AS k", "id * 2 AS w")
    try:
        one, two = save_co_located(left, "co_left", ["k"], 4), save_co_located(right, "co_right", ["k"], 4)
        joined = join_co_located(one, two, "left")
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "SortMergeJoin" in plan
        assert joined.count() == 1000 and joined.where("w IS NULL").count() == 250
        assert join_co_located(one, two).count() == 750
        with pytest.raises(ValueError):
            join_co_located(one, save_co_located(right, "co_other", ["k"], 2))
    finally:
        for name in ("co_left", "co_right", "co_other"):
            spark.sql(f"DROP TABLE IF EXISTS {name}")


def test_hot_keys_are_kept_apart(spark, no_broadcast):
    left = spark.range(900).selectExpr("IF(id % 3 = 0, 7, id % 50) AS k", "id AS v").union(spark.range(5).selectExpr("CAST(NULL AS LONG)", "id"))
    right = spark.range(60).selectExpr("id AS k", "id * 2 AS w")
    try:
        one, two = save_co_located(left, "hot_left", ["k"], 4, rows_per_key=100), save_co_located(right, "hot_right", ["k"], 4)
        assert [r.k for r in one.hot_keys.collect()] == [7] and one.hot_rows.count() == left.where("k = 7").count() and one.rows.where("k = 7").count() == 0
        for how in ("inner", "left"):
            want = left.join(right, ["k"], how)
            found = join_co_located(one, two, how)
            assert found.exceptAll(want).count() == 0 and found.count() == want.count()
    finally:
        for name in ("hot_left", "hot_right"):
            spark.sql(f"DROP TABLE IF EXISTS {name}")
