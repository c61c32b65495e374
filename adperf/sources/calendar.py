"""Calendar spine derived from a table's own date range."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def calendar_spine(df: DataFrame, day: str = "event_date") -> DataFrame:
    """Every date between the first and the last one in ``df``."""
    return df.agg(F.min(day).alias("first_day"), F.max(day).alias("last_day")).select(
        F.explode(F.sequence("first_day", "last_day")).alias(day)
    )
