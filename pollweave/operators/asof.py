"""As-of match: the latest observation at or before a row, and the first one after it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from .ordered import carry_both, in_order
from .sizing import ROWS_PER_TASK


def as_of(
    left: DataFrame,
    right: DataFrame,
    at: str,
    values: Sequence[str],
    keys: Sequence[str] = (),
    right_at: str | None = None,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Add ``prev_<at>``, ``prev_<value>``, ``next_<at>`` and ``next_<value>`` to every row of ``left``.

    ``at`` is of any type that can be sorted, the same on both sides. The previous observation is the latest of ``right`` at or before
    the row, the next one is the first after it, each within the row's ``keys``, where NULL matches NULL. Of several
    observations at one time the order of their ``values`` decides, NULL first. An observation without a time
    is passed over; a row without one finds nothing. Both sides are put on top of each other and sorted once, and the last
    known observation is carried along; no pairs are formed, and a long series is cut into chunks.
    """
    right_at = right_at or at
    seen = F.struct(F.col(right_at).alias("at"), *[F.col(v).alias(f"v{n}") for n, v in enumerate(values)])
    # At one time the observations come first, so a row finds them behind it.
    observed = right.filter(F.col(right_at).isNotNull()).select(*keys, F.col(right_at).alias("_at"), F.lit(0).alias("_side"), seen.alias("_seen"))
    rows = left.select(*keys, F.col(at).alias("_at"), F.lit(1).alias("_side"), F.struct("*").alias("_row"))
    stacked = observed.unionByName(rows, allowMissingColumns=True)
    carried = carry_both(in_order(stacked, keys, ("_at", "_side", "_seen"), rows_per_task), "_seen", "_prev", "_next").filter("_side = 1")
    timed = F.col("_at").isNotNull()
    found = []
    for name, side in (("prev", "_prev"), ("next", "_next")):
        held = F.when(timed, F.col(side))
        found += [held["at"].alias(f"{name}_{at}"), *[held[f"v{n}"].alias(f"{name}_{v}") for n, v in enumerate(values)]]
    return carried.select("_row.*", *found)
