"""Monitoring metrics: properties and edge cases."""

from __future__ import annotations

from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from adperf.operators.slices import drift_status, rolling_sums, slice_baseline, slice_daily
from adperf.plans import monitoring
from adperf.plans.monitoring import COLUMNS, MonitorConfig, monitoring_metrics
from adperf.sources import day_tables

PREDICTIONS = (
    "event_date date, channel string, device string, impressions bigint, actual_ctr double, "
    "predicted_ctr_champion double, is_drift_window boolean, model_version_champion string"
)
CONFIG = MonitorConfig(windows_days=[1, 7, 28], dimensions=["channel", "device"])
DAY = date(2024, 1, 1)


@pytest.fixture(scope="module")
def predictions(spark):
    rows = []
    for day in [0, 1, 2, 5, 9, 20, 21, 40]:
        for i, channel in enumerate(["Search", "Social", None]):
            for j, device in enumerate(["Mobile", "Desktop"]):
                n = 10 + day + i * 3 + j
                actual = 0.1 + 0.01 * i
                rows.append((DAY + timedelta(days=day), channel, device, n, actual, actual + 0.001 * (day + j), day >= 20, "1"))
    return spark.createDataFrame(rows, PREDICTIONS)


@pytest.fixture(scope="module")
def metrics(predictions):
    return monitoring_metrics(predictions, CONFIG).cache()


def test_columns(metrics):
    assert metrics.columns == COLUMNS


def test_every_dimension_adds_up_to_overall(predictions):
    daily = slice_daily(predictions, CONFIG.dimensions)
    totals = daily.groupBy("metric_date", "dimension_name").agg(
        F.sum("impressions").alias("n"), F.sum("sum_squared_error").alias("e"), F.sum("observation_count").alias("c")
    ).collect()
    by_day = {}
    for row in totals:
        by_day.setdefault(row["metric_date"], []).append((row["n"], round(row["e"], 9), row["c"]))
    assert all(len(set(values)) == 1 and len(values) == 3 for values in by_day.values())


def test_missing_dimension_value_is_unknown(metrics):
    values = {row[0] for row in metrics.where("dimension_name = 'channel'").select("dimension_value").distinct().collect()}
    assert values == {"Search", "Social", "Unknown"}


def brute_rolling(rows, day, days):
    used = [r for r in rows if 0 <= (day - r["event_date"]).days < days]
    weight = sum(r["impressions"] for r in used)
    error = sum(r["impressions"] * (r["predicted_ctr_champion"] - r["actual_ctr"]) ** 2 for r in used)
    return weight, len(used), (error / weight) ** 0.5


@pytest.mark.parametrize("days", [1, 7, 28])
def test_rolling_windows_respect_missing_days(predictions, metrics, days):
    rows = predictions.collect()
    overall = metrics.where(f"dimension_name = 'overall' and window_days = {days}").collect()
    assert len(overall) == 8
    for row in overall:
        weight, count, rmse = brute_rolling(rows, row["metric_date"], days)
        assert (row["impressions"], row["observation_count"]) == (weight, count)
        assert row["weighted_rmse"] == pytest.approx(rmse)


def test_baseline_is_pre_drift(predictions, metrics):
    rows = [r for r in predictions.collect() if not r["is_drift_window"]]
    weight = sum(r["impressions"] for r in rows)
    error = sum(r["impressions"] * (r["predicted_ctr_champion"] - r["actual_ctr"]) ** 2 for r in rows)
    seen = {row[0] for row in metrics.where("dimension_name = 'overall'").select("baseline_rmse").distinct().collect()}
    assert list(seen) == pytest.approx([(error / weight) ** 0.5])


def test_rolling_is_the_same_across_a_clock_change(spark, predictions):
    """Seven days are seven days, also where a local day has 25 hours."""
    days = [(date(2024, 10, 30) + timedelta(days=i), "Search", "Mobile", 10, 0.1, 0.1, False, "1") for i in range(14)]
    df = spark.createDataFrame(days, PREDICTIONS)
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        rows = monitoring_metrics(df, CONFIG).where("dimension_name = 'overall' and window_days = 7").collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert sorted(row["observation_count"] for row in rows)[-8:] == [7] * 8


def test_unknown_baseline_is_healthy(spark):
    exact = [
        (DAY, "Search", "Mobile", 10, 0.1, 0.1, False, "1"),
        (DAY + timedelta(1), "Search", "Mobile", 10, 0.1, 0.9, True, "1"),
    ]
    new = [(DAY, "Search", "Mobile", 10, 0.1, 0.9, True, "2")]
    df = spark.createDataFrame(exact + new, PREDICTIONS)
    for row in monitoring_metrics(df, CONFIG).collect():
        assert row["rmse_change_pct"] is None
        assert row["drift_status"] == "healthy"
    baselines = slice_baseline(slice_daily(df, [])).collect()
    assert [(row["model_version"], row["baseline_rmse"]) for row in baselines] == [("1", 0.0)]


def test_no_impressions_gives_null_rates(spark):
    df = spark.createDataFrame([(DAY, "Search", "Mobile", 0, 0.1, 0.1, False, "1")], PREDICTIONS)
    row = monitoring_metrics(df, MonitorConfig([7], [])).first()
    assert row["weighted_rmse"] is None and row["actual_ctr"] is None


def test_status_limits(spark):
    df = spark.createDataFrame([(9.99,), (10.0,), (19.99,), (20.0,), (None,)], "x double")
    got = [row[0] for row in df.select(drift_status(F.col("x"), 10.0, 20.0)).collect()]
    assert got == ["healthy", "warning", "warning", "critical", "healthy"]


def test_one_scan_two_shuffles_one_sort(predictions):
    plan = monitoring_metrics(predictions, CONFIG)._jdf.queryExecution().executedPlan().toString()
    initial = plan.split("== Initial Plan ==")[-1]
    assert initial.count("Exchange hashpartitioning") == 2
    assert initial.count("Window [") == 1
    assert initial.count("Sort [") == 1


def test_rolling_keeps_one_row_per_day_and_window(predictions):
    daily = slice_daily(predictions, ["channel"])
    assert rolling_sums(daily, [1, 7]).count() == 2 * daily.count()


def test_stored_windows_equal_the_full_computation_after_late_days(spark, predictions):
    """Days in any order, one corrected, one taken away; only windows within reach are rewritten."""
    root = f"{spark.sparkContext.getCheckpointDir()}/windows-test"
    days = sorted(r[0] for r in predictions.select("event_date").distinct().collect())
    late, last = days[2], days[-1]

    def rows(df):
        digits = [F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]
        return sorted(str(tuple(r)) for r in df.select(*digits).drop("computed_at").collect())

    def expect(df):
        assert rows(monitoring.stored_metrics(spark, root, CONFIG)) == rows(monitoring_metrics(df, CONFIG))

    first = [d for d in days if d not in (late, last)]
    assert monitoring.refresh_windows(spark, predictions, root, first, CONFIG) == first
    expect(predictions.where(F.col("event_date").isin(first)))
    before = day_tables.manifest(spark, f"{root}/{monitoring.ROLLED}")["days"]
    assert monitoring.refresh_windows(spark, predictions, root, [last], CONFIG) == [last]
    ends = monitoring.refresh_windows(spark, predictions, root, [late], CONFIG)
    assert ends == [d for d in days if late <= d < late + timedelta(28)]
    after = day_tables.manifest(spark, f"{root}/{monitoring.ROLLED}")["days"]
    assert all(after[d] == before[d] for d in before if date.fromisoformat(d) < late)
    expect(predictions)
    corrected = predictions.withColumn(
        "impressions", F.when(F.col("event_date") == days[0], 3 * F.col("impressions")).otherwise(F.col("impressions"))
    )
    monitoring.refresh_windows(spark, corrected, root, [days[0]], CONFIG)
    expect(corrected)
    gone = corrected.where(F.col("event_date") != days[4])
    monitoring.refresh_windows(spark, gone, root, [days[4]], CONFIG)
    expect(gone)
