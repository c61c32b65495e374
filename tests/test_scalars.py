from __future__ import annotations

from datetime import date

import pytest
from pyspark.sql import functions as F

from adperf.functions import scalars
from adperf.functions.weighted import improvement_pct, weighted_mae, weighted_r2, weighted_rmse


def values(spark, column, rows, ddl):
    return [row[0] for row in spark.createDataFrame(rows, ddl).select(column).collect()]


def test_clamp_keeps_null_and_nan(spark):
    got = values(spark, scalars.clamp("x", 0.0, 0.15), [(-1.0,), (0.1,), (9.0,), (None,), (float("nan"),)], "x double")
    assert got[:4] == [0.0, 0.1, 0.15, None]
    assert got[4] != got[4]


def test_ratio_and_change_guard_their_denominators(spark):
    rows = [(1, 2), (1, 0), (None, 2)]
    assert values(spark, scalars.ratio("a", "b"), rows, "a int, b int") == [0.5, None, None]
    change = scalars.relative_change_pct("v", "b")
    assert values(spark, change, [(1.5, 1.0), (1.5, 0.0), (1.5, None)], "v double, b double") == [50.0, None, None]


def test_weeks_and_weekdays(spark):
    sunday, monday = date(2024, 1, 7), date(2024, 1, 8)
    rows = [(sunday,), (monday,)]
    assert values(spark, scalars.week_start("d"), rows, "d date") == [date(2024, 1, 1), monday]
    assert values(spark, scalars.dow_sun0("d"), rows, "d date") == [0, 1]
    assert values(spark, scalars.dow_mon0("d"), rows, "d date") == [6, 0]


def test_week_does_not_depend_on_the_session_time_zone(spark):
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        assert values(spark, scalars.week_start("d"), [(date(2024, 3, 10),)], "d date") == [date(2024, 3, 4)]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_case_lookup_and_first_match(spark):
    got = values(spark, scalars.case_lookup("k", {"a": 1.0, "b": 2.0}, 0.5), [("a",), ("b",), ("z",), (None,)], "k string")
    assert got == [1.0, 2.0, 0.5, 0.5]
    first = scalars.first_match([(F.col("x") > 1, F.lit("big")), (F.col("x") > 0, F.lit("small"))], "none")
    assert values(spark, first, [(5,), (1,), (-1,)], "x int") == ["big", "small", "none"]


def test_weighted_metrics(spark):
    rows = [(0.1, 0.2, 10), (0.3, 0.1, 30), (0.5, None, 1000)]
    df = spark.createDataFrame(rows, "y double, p double, w int")
    args = ("y", "p", "w")
    row = df.agg(
        weighted_rmse(*args).alias("rmse"), weighted_mae(*args).alias("mae"), weighted_r2(*args).alias("r2"),
        weighted_rmse(*args, F.lit(False)).alias("none"),
    ).first()
    mean = (0.1 * 10 + 0.3 * 30) / 40
    sse = 10 * 0.01 + 30 * 0.04
    sst = 10 * (0.1 - mean) ** 2 + 30 * (0.3 - mean) ** 2
    assert row["rmse"] == pytest.approx((sse / 40) ** 0.5)
    assert row["mae"] == pytest.approx((10 * 0.1 + 30 * 0.2) / 40)
    assert row["r2"] == pytest.approx(1 - sse / sst)
    assert row["none"] is None


def test_improvement_pct(spark):
    assert values(spark, improvement_pct(F.col("a"), F.col("b")), [(0.2, 0.164)], "a double, b double") == [18.0]
