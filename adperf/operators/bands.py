"""Range lookups: half-open bands low <= x < high, and bands built from weights."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import first_match
from ..session import materialize
from .lookups import SMALL_TABLE_ROWS, is_small

# Up to this many bands a fact row is compared with every band.
NESTED_LOOP_BANDS = 48
# Most bins of bands that do not overlap, so that the bins of one band fit a row.
MOST_BINS = 1 << 20

# Ratio between the bin widths of neighbouring levels.
LEVEL_BASE = 8.0
# Level of a band without a finite length.
OPEN_LEVEL = 1_000


def _in_band(x: str):
    return (F.col(x) >= F.col("__low")) & (F.col(x) < F.col("__high"))


def _renamed(bands: DataFrame, low: str, high: str) -> DataFrame:
    return bands.withColumnsRenamed({low: "__low", high: "__high"})


def band_label(x: Column, bands: list[tuple]) -> Column:
    """Label of the literal band [low, high) that ``x`` lies in, as an expression without a join."""
    return first_match([((x >= low) & (x < high), F.lit(name)) for name, low, high in bands], None)


def broadcast_band_join(
    df: DataFrame, bands: DataFrame, x: str, low: str = "low", high: str = "high", on: list[str] = (),
    how: str = "inner",
) -> DataFrame:
    """Range join, inner or left, against bands whose number the caller knows to be small (literal tables)."""
    table = F.broadcast(_renamed(bands, low, high))
    condition = _in_band(x)
    for name in on:
        table = table.withColumnRenamed(name, f"__{name}")
        condition = (F.col(name) == F.col(f"__{name}")) & condition
    return df.join(table, condition, how).drop("__low", "__high", *[f"__{name}" for name in on])


def binned_band_join(
    df: DataFrame, bands: DataFrame, x: str, low: str = "low", high: str = "high", on: list[str] = ()
) -> DataFrame:
    """Inner range join as an equi-join on (level, bin), for band tables of any size.

    A band belongs to the level whose bins are at least as wide as the band, so
    it touches at most a few bins however long it is. A fact row looks into one
    bin per level that occurs; the number of levels is bounded by the exponent
    range of a double. A hot bin is one more hot join key, which adaptive
    execution splits.
    """
    length = F.try_subtract("__high", "__low").cast("double")
    finite = length < F.lit(float("inf"))
    level = F.when(finite, F.ceil(F.log(LEVEL_BASE, length)).cast("int")).otherwise(F.lit(OPEN_LEVEL))
    table = (
        _renamed(bands, low, high)
        .where(F.col("__low") < F.col("__high"))
        .withColumn("__level", level)
    )

    def bin_of(value, at_level):
        width = F.pow(F.lit(LEVEL_BASE), at_level.cast("double"))
        return F.when(at_level == OPEN_LEVEL, F.lit(0).cast("bigint")).otherwise(
            F.floor(value.cast("double") / width).cast("bigint")
        )

    table = table.withColumn(
        "__bin",
        F.explode(
            F.sequence(bin_of(F.col("__low"), F.col("__level")), bin_of(F.col("__high"), F.col("__level")))
        ),
    )
    levels = sorted(row[0] for row in table.select("__level").distinct().collect())
    facts = df.withColumn("__fact_level", F.explode(F.array(*[F.lit(v) for v in levels]).cast("array<int>")))
    facts = facts.withColumn("__fact_bin", bin_of(F.col(x), F.col("__fact_level")))
    condition = (
        (F.col("__fact_level") == F.col("__level")) & (F.col("__fact_bin") == F.col("__bin")) & _in_band(x)
    )
    for name in on:
        table = table.withColumnRenamed(name, f"__{name}")
        condition = condition & (F.col(name) == F.col(f"__{name}"))
    helpers = ["__low", "__high", "__level", "__bin", "__fact_level", "__fact_bin"]
    return facts.join(table, condition, "inner").drop(*helpers, *[f"__{name}" for name in on])


def disjoint_band_join(
    df: DataFrame, bands: DataFrame, x: str, low: str = "low", high: str = "high"
) -> DataFrame:
    """Inner range join against finite bands that do not overlap, such as those from weights.

    All bins have one width, the bands' span by their number, so the bands touch
    no more bins than there are bands and bins together, and a fact row looks
    into one bin. The bands are stored first, as their span is needed.
    """
    table = materialize(_renamed(bands, low, high).where(F.col("__low") < F.col("__high")))
    n, first, last = table.agg(
        F.count(F.lit(1)), F.min("__low").cast("double"), F.max("__high").cast("double")
    ).first()
    first, width = (first, (last - first) / min(n, MOST_BINS)) if n else (0.0, 1.0)
    if not (math.isfinite(first) and math.isfinite(width)):
        raise ValueError("bands without an end need binned_band_join")

    def bin_of(value: Column) -> Column:
        return F.floor((value.cast("double") - F.lit(first)) / F.lit(width)).cast("bigint")

    table = table.withColumn("__bin", F.explode(F.sequence(bin_of(F.col("__low")), bin_of(F.col("__high")))))
    facts = df.withColumn("__fact_bin", bin_of(F.col(x)))
    return facts.join(table, (F.col("__fact_bin") == F.col("__bin")) & _in_band(x), "inner").drop(
        "__low", "__high", "__bin", "__fact_bin"
    )


def band_join(
    df: DataFrame,
    bands: DataFrame,
    x: str,
    low: str = "low",
    high: str = "high",
    on: list[str] = (),
    small_rows: int = NESTED_LOOP_BANDS,
) -> DataFrame:
    """Inner range join: compared one by one when the counted bands are a few dozen, binned equi-join otherwise.

    ``on`` adds equality columns, for instance the regime a band set is valid in.
    """
    join = broadcast_band_join if is_small(bands, small_rows) else binned_band_join
    return join(df, bands, x, low, high, on)


def cumulative_bands(
    weights: DataFrame, key: str, weight: str, by: list[str] = (), small_rows: int = SMALL_TABLE_ROWS
) -> DataFrame:
    """Turn weights into bands [low, high) that cover [0, 1), in key order, per ``by`` group.

    ``weights`` holds one row per (by, key). Few rows are summed up in one
    window; many are range-partitioned and stored once, and each partition is
    then shifted by the total of the partitions before it.
    """
    weights = materialize(weights.select(*by, key, weight))
    if weights.count() <= small_rows:
        whole = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))
        running = whole.orderBy(key).rowsBetween(Window.unboundedPreceding, 0)
        summed = weights.select(
            *by, key,
            F.sum(weight).over(running).alias("__upto"),
            F.sum(weight).over(whole).alias("__total"),
            F.lead(F.lit(1)).over(whole.orderBy(key)).isNull().alias("__last"),
        ).withColumn("__from", F.lag("__upto").over(whole.orderBy(key)))
    else:
        summed = _partitioned_running_sum(weights, key, weight, list(by))
    # A band begins with the very number that the one before it ends with.
    return summed.select(
        *by, key,
        F.coalesce(F.col("__from") / F.col("__total"), F.lit(0.0)).alias("low"),
        F.when(F.col("__last"), F.lit(1.0)).otherwise(F.col("__upto") / F.col("__total")).alias("high"),
    )


def _partitioned_running_sum(weights: DataFrame, key: str, weight: str, by: list[str]) -> DataFrame:
    stored = materialize(
        weights.repartitionByRange(*by, key).withColumn("__part", F.spark_partition_id())
    )
    # One row per (group, partition): as many as there are groups plus partitions.
    parts = stored.groupBy(*by, "__part").agg(F.sum(weight).alias("__part_total"))
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))
    offsets = parts.select(
        *by, "__part",
        (
            F.sum("__part_total").over(group.orderBy("__part").rowsBetween(Window.unboundedPreceding, 0))
            - F.col("__part_total")
        ).alias("__before"),
        F.sum("__part_total").over(group).alias("__total"),
    )
    within = Window.partitionBy(*by, "__part").orderBy(key)
    summed = materialize(
        stored.withColumn("__inner", F.sum(weight).over(within.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("__end", F.lead(F.lit(1)).over(within).isNull())
        .join(offsets, [*by, "__part"], "inner")
        .select(*by, key, "__part", "__end", (F.col("__before") + F.col("__inner")).alias("__upto"), "__total")
    )
    ends = summed.where("__end").select(*by, "__part", "__upto")
    handed = ends.select(
        *by, "__part",
        F.lag("__upto").over(group.orderBy("__part")).alias("__handed"),
        F.lead(F.lit(1)).over(group.orderBy("__part")).isNull().alias("__final"),
    )
    return summed.join(handed, [*by, "__part"], "inner").select(
        *by, key, "__upto", "__total",
        F.coalesce(F.lag("__upto").over(within), "__handed").alias("__from"),
        (F.col("__final") & F.col("__end")).alias("__last"),
    )
