"""Broadcasts behind a check of size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows up to which a side table is sent to all tasks.
MOST = 50_000


def checked(side: DataFrame, most: int = MOST) -> DataFrame:
    """The side marked for broadcast if it has at most `most` rows; else left to the planner."""
    return F.broadcast(side) if side.limit(most + 1).count() <= most else side
