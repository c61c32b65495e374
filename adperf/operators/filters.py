"""Optional report filters."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def filtered_slice(
    df: DataFrame,
    date_from: date | None = None,
    date_to: date | None = None,
    channels: list[str] | None = None,
    devices: list[str] | None = None,
    countries: list[str] | None = None,
) -> DataFrame:
    """Keep the rows that meet every filter given; both date ends are inclusive."""
    if date_from is not None:
        df = df.where(F.col("event_date") >= F.lit(date_from))
    if date_to is not None:
        df = df.where(F.col("event_date") <= F.lit(date_to))
    for column, wanted in (("channel", channels), ("device", devices), ("country", countries)):
        if wanted is not None:
            df = df.where(F.col(column).isin(list(wanted)))
    return df
