"""Adapter: order lines as an impression fact, for heavier rollups.

The buyers are joined to the orders first, so the fact meets two tables
instead of four and is shuffled twice at most. No side is hinted: Spark
broadcasts one only below its size limit and otherwise shuffles both on the
key, where adaptive execution splits a hot key.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import dow_sun0

# Where the drift begins and which brands it hits.
DRIFT_START = date(2001, 1, 1)
DRIFT_BRANDS = ["Brand#11", "Brand#22", "Brand#33"]


def impressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order line, in the raw impression schema."""

    def table(name: str) -> DataFrame:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")

    buyers = table("customer").join(
        table("nation"), F.col("c_nationkey") == F.col("n_nationkey"), "inner"
    ).select("c_custkey", "c_mktsegment", "n_regionkey")
    orders = table("orders").join(buyers, F.col("o_custkey") == F.col("c_custkey"), "inner").select(
        "o_orderkey", "o_orderpriority", "c_mktsegment", "n_regionkey"
    )
    parts = table("part").select("p_partkey", "p_brand")
    lines = (
        table("lineitem")
        .join(parts, F.col("l_partkey") == F.col("p_partkey"), "inner")
        .join(orders, F.col("l_orderkey") == F.col("o_orderkey"), "inner")
    )
    clicked = F.col("l_quantity") % 3 == 0
    converted = clicked & (F.col("l_quantity") % 2 == 0)
    day = F.to_date("l_shipdate")
    return lines.select(
        F.format_string("LINE-%d-%d", "l_orderkey", "l_linenumber").alias("impression_id"),
        F.col("l_shipdate").alias("event_ts"),
        day.alias("event_date"),
        F.col("p_brand").alias("campaign_id"),
        F.col("c_mktsegment").alias("channel"),
        F.concat_ws(" ", F.lit("Campaign"), "p_brand").alias("campaign_name"),
        F.col("l_returnflag").alias("device"),
        F.col("n_regionkey").cast("string").alias("country"),
        F.col("l_linestatus").alias("visitor_type"),
        F.col("o_orderpriority").alias("objective"),
        F.hour("l_shipdate").alias("hour_of_day"),
        dow_sun0(day).alias("day_of_week"),
        clicked.cast("int").alias("clicked"),
        converted.cast("int").alias("converted"),
        F.round(F.col("l_extendedprice") * 0.001, 5).alias("cost_usd"),
        F.when(converted, F.round("l_extendedprice", 2)).otherwise(F.lit(0.0)).alias("conversion_value_usd"),
    )
