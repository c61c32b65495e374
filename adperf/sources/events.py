"""Adapter: a click-stream ``events`` table as an ad-impression fact."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import dow_sun0
from ..operators.bands import band_label, broadcast_band_join
from ..schemas import RAW_CAMPAIGNS
from .tables import literal_rows

# Where the drift begins and which campaigns it hits.
DRIFT_START = date(2024, 1, 21)
DRIFT_CAMPAIGNS = ["CMP-004", "CMP-006", "CMP-007", "CMP-008"]

# The click loss that the named queries put into the given events, to have a drift to find.
CLICK_LOSS = (DRIFT_START, DRIFT_CAMPAIGNS)
# Label of what an event without the needed fields would have been looked up by.
UNKNOWN = "Unknown"

# The campaign of each slot (slot, campaign, channel, objective).
CAMPAIGNS = [
    (0, "CMP-001", "Search", "conversion"),
    (1, "CMP-002", "Search", "conversion"),
    (2, "CMP-003", "Search", "conversion"),
    (3, "CMP-004", "Social", "awareness"),
    (4, "CMP-005", "Social", "retargeting"),
    (5, "CMP-006", "Social", "awareness"),
    (6, "CMP-007", "Display", "awareness"),
    (7, "CMP-008", "Display", "awareness"),
    (8, "CMP-009", "Email", "conversion"),
    (9, "CMP-010", "Email", "retargeting"),
    (10, "CMP-011", "Affiliate", "conversion"),
    (11, "CMP-012", "Affiliate", "conversion"),
]

# Integer bands [low, high).
DEVICE_BANDS = [("Desktop", 0, 42), ("Mobile", 42, 90), ("Tablet", 90, 100)]
COUNTRY_BANDS = [
    ("US", 0, 32), ("CA", 32, 42), ("GB", 42, 58), ("DE", 58, 72), ("FR", 72, 86), ("AU", 86, 100),
]
VISITOR_BANDS = [("returning", 0, 9), ("new", 9, 20)]


def campaign_slots(spark: SparkSession) -> DataFrame:
    """The twelve literal campaigns; their number is fixed by this file, so they can be broadcast."""
    return literal_rows(spark, CAMPAIGNS, "slot int, campaign_id string, channel string, objective string")


def _point(x: Column) -> Column:
    """An integer to look a band up by; -1 lies in no band.

    Being never NULL, it spares the scan a NULL filter that would parse the JSON a second time.
    """
    return F.coalesce(x, F.lit(-1))


def _json_k() -> Column:
    """Field k of the JSON text. The plain form is read without the JSON parser, which takes most of the scan's time."""
    plain = F.regexp_extract("props", r'^\{"k": ?([0-9]{1,9})\}$', 1).try_cast("int")
    return F.coalesce(plain, F.get_json_object("props", "$.k").try_cast("int"))


def keyed_events(
    spark: SparkSession, sf_dir: str, date_from: date | None = None, date_to: date | None = None
) -> DataFrame:
    """Events with the integers that the bands and the campaign slot are looked up by.

    Dates, both inclusive, become filters on the stored timestamp, which the scan can skip files by.
    """
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    if date_from is not None:
        events = events.where(F.col("ts") >= F.lit(date_from).cast("timestamp_ntz"))
    if date_to is not None:
        events = events.where(F.col("ts") < F.lit(date_to + timedelta(days=1)).cast("timestamp_ntz"))
    return (
        events.withColumn("k", _json_k())
        .select(
            "event_id", "ts", "event_type", "value",
            F.to_date("ts").alias("event_date"),
            _point(F.col("k") % 12).alias("slot"),
            _point(F.col("event_id") * 37 % 100).alias("device_point"),
            _point((F.col("user_id") * 53 + F.col("k")) % 100).alias("country_point"),
            _point(F.col("user_id") % 20).alias("visitor_point"),
        )
    )


BANDS = [
    ("device", DEVICE_BANDS, "device_point"),
    ("country", COUNTRY_BANDS, "country_point"),
    ("visitor_type", VISITOR_BANDS, "visitor_point"),
]


def join_visitor_bands(events: DataFrame) -> DataFrame:
    """Device, country and visitor type by three range joins against literal band tables; no event is lost."""
    for name, rows, point in BANDS:
        table = literal_rows(events.sparkSession, rows, f"{name} string, low int, high int")
        events = broadcast_band_join(events, table, point, how="left")
        events = events.withColumn(name, F.coalesce(name, F.lit(UNKNOWN)))
    return events


def label_visitor_bands(events: DataFrame) -> DataFrame:
    """The same three columns without a join, the bands being literals."""
    return events.withColumns({
        name: F.coalesce(band_label(F.col(point), rows), F.lit(UNKNOWN)) for name, rows, point in BANDS
    })


def impressions(
    spark: SparkSession,
    sf_dir: str,
    date_from: date | None = None,
    date_to: date | None = None,
    click_loss: tuple[date, list[str]] | None = None,
) -> DataFrame:
    """One row per event, in the raw impression schema; what cannot be looked up is "Unknown".

    ``click_loss`` (a first day and campaigns) leaves a fifth of these campaigns'
    clicks from that day on, so that a fixture has a drift.
    """
    events = label_visitor_bands(keyed_events(spark, sf_dir, date_from, date_to)).join(
        F.broadcast(campaign_slots(spark)), "slot", "left"
    )
    events = events.withColumns(
        {name: F.coalesce(name, F.lit(UNKNOWN)) for name in ("campaign_id", "channel", "objective")}
    ).withColumn("campaign_name", F.concat_ws(" ", "channel", "campaign_id"))
    clicked = F.col("event_type").isin("click", "purchase")
    if click_loss is not None:
        first_day, campaigns = click_loss
        clicked &= ~(
            F.col("campaign_id").isin(campaigns)
            & (F.col("event_date") >= F.lit(first_day))
            & (F.col("event_id") % 5 != 0)
        )
    converted = clicked & (F.col("event_type") == "purchase")
    return events.select(
        F.format_string("IMP-%09d", "event_id").alias("impression_id"),
        F.col("ts").alias("event_ts"),
        "event_date", "campaign_id", "channel", "campaign_name",
        "device", "country", "visitor_type", "objective",
        F.hour("ts").alias("hour_of_day"),
        dow_sun0("event_date").alias("day_of_week"),
        clicked.cast("int").alias("clicked"),
        converted.cast("int").alias("converted"),
        F.round(F.col("value") * 0.01, 5).alias("cost_usd"),
        F.when(converted, F.round("value", 2)).otherwise(F.lit(0.0)).alias("conversion_value_usd"),
    )


def campaigns(impressions: DataFrame) -> DataFrame:
    """One row per campaign: the average cost of an impression as its bid, its first day as the launch."""
    seen = impressions.groupBy("campaign_id", "campaign_name", "channel", "objective").agg(
        F.avg("cost_usd").alias("base_bid_usd"), F.min("event_date").cast("string").alias("launch_date")
    )
    return seen.to(T.StructType.fromDDL(RAW_CAMPAIGNS))
