"""Cell sums that grow with each wave instead of being counted anew."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType


def add_new_files(
    spark: SparkSession,
    source: str,
    schema: StructType | str,
    path: str,
    keys: Sequence[str],
    measures: Sequence[str] = (),
    prepare: Callable[[DataFrame], DataFrame] | None = None,
) -> int:
    """Count the rows of the Parquet files in ``source`` that were not counted before, and return how many rows they held.

    Every run adds one table of cells (keys, n, sum of each measure) under ``path``; the measures' sums skip NULL. Which files were
    counted is kept in the stream's checkpoint under ``path``, so a run reads new files only. A run that is cut short is
    repeated on the same files and overwrites its own table, so no row counts twice. ``prepare`` turns the stored rows into
    rows with the keys and measures.
    """

    def add(rows: DataFrame, batch: int) -> None:
        rows = rows if prepare is None else prepare(rows)
        sums = [F.sum(m).cast("double").alias(f"sum_{m}") for m in measures]
        rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *sums).write.mode("overwrite").parquet(f"{path}/cells/batch={batch}")

    stream = spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(add)
    run = stream.option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    run.awaitTermination()
    return sum(progress["numInputRows"] for progress in run.recentProgress)


def cells_so_far(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """The cells of all runs merged: (keys, n, sum of each measure)."""
    stored = spark.read.parquet(f"{path}/cells")
    sums = [c for c in stored.columns if c not in (*keys, "batch")]
    return stored.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums])
