"""Size checks and the shared folder."""

from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from pollweave.operators.sizing import attach, chunks_for, drop_stored, group_sizes, settle_counted, store
from pollweave.session import shared_folder

from .test_plans import plan_of


@pytest.fixture(scope="module")
def rows(spark):
    # One key holds most rows, one is NULL, one is not in the lookup.
    keys = F.expr("CASE WHEN id % 10 < 7 THEN 'hot' WHEN id % 10 = 7 THEN NULL WHEN id % 10 = 8 THEN 'b' ELSE 'none' END")
    return spark.range(1000).withColumn("k", keys)


@pytest.fixture(scope="module")
def lookup(spark):
    return spark.createDataFrame([("hot", 1), ("b", 2), (None, 3)], "k STRING, v INT")


@pytest.mark.parametrize("null_safe, nulls_found", [(False, 0), (True, 100)])
def test_lookup_beyond_the_bound_joins_the_same(spark, rows, lookup, null_safe, nulls_found):
    small = attach(rows, lookup, ["k"], null_safe=null_safe)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        large = attach(rows, lookup, ["k"], max_rows=2, null_safe=null_safe)
        assert "BroadcastHashJoin" in plan_of(small) and "BroadcastHashJoin" not in plan_of(large)
        collected = [{(r.id, r.k, r.v) for r in df.collect()} for df in (small, large)]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert collected[0] == collected[1] and len(collected[0]) == 1000
    assert sum(1 for _, k, v in collected[0] if k is None and v is not None) == nulls_found


def test_counts(rows, lookup):
    assert group_sizes(rows, ["k"]) == (1000, 700) and group_sizes(rows, []) == (1000, 1000)
    assert group_sizes(rows.limit(0), ["k"]) == (0, 0)
    kept, n = settle_counted(lookup)
    assert n == 3 == kept.count()
    assert chunks_for(10, 1000) == 1 and chunks_for(1_000_000, 1000) == 4000 and chunks_for(10**12, 1000) == 4 * 10**9


def test_a_cluster_needs_a_shared_folder():
    unset = SimpleNamespace(
        sparkContext=SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077"),
        conf=SimpleNamespace(get=lambda key, default=None: default),
    )
    with pytest.raises(RuntimeError):
        shared_folder(unset)


def test_a_configured_folder_is_used():
    chosen = []
    session = SimpleNamespace(
        sparkContext=SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077", setCheckpointDir=chosen.append),
        conf=SimpleNamespace(get=lambda key, default=None: "hdfs:///shared"),
    )
    assert shared_folder(session) == "hdfs:///shared" and chosen == ["hdfs:///shared"]


def test_stored_results_can_be_dropped(spark, tmp_path):
    kept = store(spark.range(5))
    path = kept.inputFiles()[0]
    assert kept.count() == 5 and drop_stored(spark) >= 1 and drop_stored(spark) == 0
    with pytest.raises(Exception, match="(?i)exist|found"):
        spark.read.parquet(path).count()
