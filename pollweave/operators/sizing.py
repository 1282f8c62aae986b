"""Size checks: what may be broadcast, and what one task may hold."""

from __future__ import annotations

import math
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import shared_folder

# A lookup above this many rows, or bytes of its rows written out as text, is joined by shuffle instead of broadcast.
BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 64_000_000
# A window group above this many rows is cut into ordered chunks.
ROWS_PER_TASK = 2_000_000
# Up to this many margin cells are fitted in one task; more are fitted by grouping and joining.
CELLS_PER_TASK = 100_000


def settle(df: DataFrame) -> DataFrame:
    """Compute ``df`` once and keep it in the shared checkpoint folder.

    The result survives lost executors, is never computed a second time by its
    readers, and has a short lineage.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def store(df: DataFrame) -> DataFrame:
    """Write a large intermediate result once as Parquet into the shared folder.

    Like ``settle``, for results as large as the data: the files are compressed
    and later readers scan only the columns they need.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/stored-{uuid.uuid4().hex}"
    remember(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_STORED: list[str] = []


def remember(path: str) -> None:
    """Note a written intermediate result, for ``drop_stored``."""
    _STORED.append(path)


def drop_stored(spark: SparkSession) -> int:
    """Delete the intermediate results that this process wrote; to be called when the final results are written."""
    n = len(_STORED)
    while _STORED:
        path = spark._jvm.org.apache.hadoop.fs.Path(_STORED.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return n


def settle_counted(df: DataFrame) -> tuple[DataFrame, int]:
    """``settle`` and the number of stored rows."""
    kept = settle(df)
    return kept, kept.count()


def attach(
    df: DataFrame,
    lookup: DataFrame,
    on: Sequence[str],
    how: str = "left",
    max_rows: int = BROADCAST_ROWS,
    null_safe: bool = False,
) -> DataFrame:
    """Join a (usually small) lookup to a large frame.

    The lookup is computed once and measured. Within ``max_rows`` and ``BROADCAST_BYTES`` it is broadcast
    and the large side does not move; beyond that the join is an ordinary
    shuffle join, whose skewed partitions adaptive execution splits.
    """
    lookup = settle(lookup)
    if broadcastable(lookup, max_rows):
        lookup = F.broadcast(lookup)
    return join_null_safe(df, lookup, on, how) if null_safe else df.join(lookup, list(on), how)


def broadcastable(stored: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether a stored frame is small enough, by rows and by bytes."""
    rows, size = stored.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(F.to_json(F.struct("*")))), F.lit(0))).first()
    return rows <= max_rows and size <= max_bytes


def group_sizes(df: DataFrame, keys: Sequence[str]) -> tuple[int, int]:
    """Row count of the frame and of its largest group (one pass, combined before the shuffle)."""
    if not keys:
        total = df.count()
        return total, total
    row = df.groupBy(*keys).count().agg(F.sum("count"), F.max("count")).first()
    return row[0] or 0, row[1] or 0


def chunks_for(total: int, rows_per_task: int) -> int:
    """Chunks of a quarter of what a task may hold, so that a long series is spread widely."""
    return max(1, math.ceil(4 * total / rows_per_task))


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join on key columns where NULL matches NULL; the keys of ``left`` are kept."""
    renamed = {key: f"_right_{key}" for key in keys}
    condition = F.lit(True)
    for key, other in renamed.items():
        condition = condition & F.col(key).eqNullSafe(F.col(other))
    return left.join(right.withColumnsRenamed(renamed), condition, how).drop(*renamed.values())
