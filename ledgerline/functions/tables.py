"""Sides of joins whose size is looked at before they are sent to every task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a table that is sent to every task, at most.
SMALL_ROWS = 50_000


def small(table: DataFrame, most: int = SMALL_ROWS) -> DataFrame:
    """A parameter table with the hint to broadcast it, if it has at most `most` rows; a larger one as it is, to be shuffled."""
    return F.broadcast(table) if table.limit(most + 1).count() <= most else table
