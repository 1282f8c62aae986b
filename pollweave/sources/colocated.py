"""Saved tables that are joined on their key again and again."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..operators.sizing import ROWS_PER_TASK, join_null_safe, settle, store


@dataclass(frozen=True)
class CoLocated:
    """A table saved in buckets of its keys, and apart from it the rows of keys with too many rows for one bucket.

    ``hot_keys`` lists these keys; it is as long as the rows of a table divided by the rows of a task.
    """

    rows: DataFrame
    hot_rows: DataFrame
    hot_keys: DataFrame
    keys: tuple[str, ...]
    buckets: int


def save_co_located(df: DataFrame, name: str, keys: Sequence[str], buckets: int, rows_per_key: int = ROWS_PER_TASK) -> CoLocated:
    """Save ``df`` as table ``name`` of the catalog, in ``buckets`` buckets of ``keys``, each sorted by them.

    Tables with equal keys and numbers of buckets are joined without moving a row. Rows of a key with more than ``rows_per_key`` rows are
    stored apart and spread evenly, because a bucket is read by one task.
    """
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > rows_per_key).select(*keys)
    hot_keys = settle(counts)
    if hot_keys.isEmpty():
        hot_rows, rows = df.limit(0), df
    else:
        # Very few keys: each has more rows than a task should hold.
        marked = join_null_safe(df, F.broadcast(hot_keys.withColumn("_hot", F.lit(True))), keys)
        hot_rows, rows = store(marked.filter("_hot").drop("_hot")), marked.filter("_hot IS NULL").drop("_hot")
    rows.repartition(buckets, *keys).write.mode("overwrite").bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(name)
    return CoLocated(df.sparkSession.table(name), hot_rows, hot_keys, tuple(keys), buckets)


def join_co_located(left: CoLocated, right: CoLocated, how: str = "inner") -> DataFrame:
    """Join two saved tables on their common keys (``inner`` or ``left``); NULL keys do not match.

    The buckets meet without an exchange. Keys that are hot on either side are joined apart, by a shuffle join whose large
    partitions adaptive execution splits.
    """
    if left.keys != right.keys or left.buckets != right.buckets:
        raise ValueError("the tables are saved by different keys or numbers of buckets")
    if how not in ("inner", "left"):
        raise ValueError("how is inner or left")
    keys = list(left.keys)
    if left.hot_keys.isEmpty() and right.hot_keys.isEmpty():
        return left.rows.join(right.rows, keys, how)
    hot = settle(left.hot_keys.union(right.hot_keys).distinct())

    def parts(table: CoLocated) -> tuple[DataFrame, DataFrame]:
        cold = join_null_safe(table.rows, F.broadcast(hot.withColumn("_hot", F.lit(True))), keys)
        return cold.filter("_hot IS NULL").drop("_hot"), cold.filter("_hot").drop("_hot").unionByName(table.hot_rows)

    (cold_left, hot_left), (cold_right, hot_right) = parts(left), parts(right)
    return cold_left.join(cold_right, keys, how).unionByName(hot_left.join(hot_right, keys, how))
