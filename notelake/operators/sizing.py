"""Row-count checks that decide between a broadcast and a shuffled join."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_BROADCAST_ROWS = 200_000


def row_bound(df: DataFrame, limit: int = MAX_BROADCAST_ROWS) -> int | None:
    """Number of rows when it is at most ``limit``, else None. Reads at most limit + 1 rows."""
    seen = df.limit(limit + 1).count()
    return seen if seen <= limit else None


def broadcast_if_small(df: DataFrame, limit: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint for a side counted to be small; otherwise the join stays open
    to the optimiser (shuffled, with adaptive skew handling)."""
    return df if row_bound(df, limit) is None else F.broadcast(df)


def pin_if_small(df: DataFrame, limit: int = MAX_BROADCAST_ROWS) -> tuple[DataFrame, pa.Table | None]:
    """Evaluate a query-sized table once.

    Returns a local DataFrame and its rows when there are at most ``limit`` of
    them, else the table as it was and None.
    """
    rows = df.limit(limit + 1).toArrow()
    if rows.num_rows > limit:
        return df, None
    return df.sparkSession.createDataFrame(rows, df.schema), rows
