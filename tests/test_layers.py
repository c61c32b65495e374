"""Rollups, filters, questions and checks on small hand-made tables."""

from __future__ import annotations

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from adperf.operators import filters, layers
from adperf.plans import predictions, quality, questions
from adperf.plans.monitoring import MonitorConfig
from adperf.schemas import RAW_IMPRESSIONS
from adperf.sources import events

START = date(2024, 1, 8)


def impression(n, day, campaign, clicked, converted=0, channel="Social", device="Mobile", country="US", cost=1.0):
    return (
        f"IMP-{n}", datetime(2024, 1, day, 12), date(2024, 1, day), campaign, channel, f"{campaign} name", device,
        country, "new", "awareness", 12, 1, clicked, converted, cost, 50.0 * converted,
    )


@pytest.fixture(scope="module")
def silver(spark):
    rows = [impression(i, 1, "C1", int(i < 4), int(i < 1)) for i in range(8)]
    rows += [impression(i, 9, "C1", int(i < 1)) for i in range(8)]
    rows += [impression(i, 9, "C2", int(i < 4), channel="Search") for i in range(4)]
    raw = spark.createDataFrame(rows, RAW_IMPRESSIONS)
    return layers.silver_impressions(raw, START, ["C1"])


@pytest.fixture(scope="module")
def predicted(silver):
    return predictions.group_mean_predictions(layers.segment_ctr_daily(silver), 1.0)


def test_silver_flags_include_the_first_day(spark):
    raw = spark.createDataFrame([impression(1, 7, "C1", 0), impression(2, 8, "C2", 0)], RAW_IMPRESSIONS)
    rows = layers.silver_impressions(raw, START, ["C1"]).orderBy("impression_id").collect()
    assert [(r["is_drift_window"], r["is_drift_segment"]) for r in rows] == [(False, True), (True, False)]
    assert rows[0]["event_week"] == date(2024, 1, 1)


def test_rollups(silver):
    rows = {(r["event_date"].day, r["campaign_id"]): r for r in layers.segment_ctr_daily(silver).collect()}
    first = rows[1, "C1"]
    assert (first["impressions"], first["clicks"], first["conversions"]) == (8, 4, 1)
    assert (first["actual_ctr"], first["actual_cvr"], first["spend_usd"]) == (0.5, 0.25, 8.0)
    assert rows[9, "C2"]["actual_cvr"] == 0.0


def test_no_clicks_gives_null_cvr(spark):
    raw = spark.createDataFrame([impression(1, 1, "C1", 0)], RAW_IMPRESSIONS)
    row = layers.segment_ctr_daily(layers.silver_impressions(raw, START, [])).first()
    assert row["actual_ctr"] == 0.0 and row["actual_cvr"] is None


def test_campaign_rollup_is_the_same_from_either_input(silver):
    direct = layers.campaign_daily(silver)
    derived = layers.campaign_daily_from_segments(layers.segment_ctr_daily(silver))
    assert direct.columns == derived.columns
    assert sorted(map(tuple, direct.collect())) == sorted(map(tuple, derived.collect()))


def test_group_means_and_waste(predicted, silver):
    rows = {(r["event_date"].day, r["campaign_id"]): r for r in predicted.collect()}
    assert rows[9, "C1"]["predicted_ctr_stale"] == 0.5
    assert rows[9, "C1"]["predicted_ctr_champion"] == 0.125
    assert rows[9, "C1"]["ctr_gap_stale"] == 0.375
    # A campaign without pre-drift rows has no stale prediction and no baseline.
    assert rows[9, "C2"]["predicted_ctr_stale"] is None
    means = predictions.campaign_means(layers.segment_ctr_daily(silver))
    assert questions.wasted_spend_total(predicted, means).first()[0] == 6.0
    assert [tuple(r) for r in questions.wasted_spend_by_channel(predicted, means).collect()] == [("Social", 6.0)]


def test_zero_baseline_wastes_nothing(spark):
    rows = [impression(1, 1, "C1", 0), impression(2, 9, "C1", 1)]
    silver = layers.silver_impressions(spark.createDataFrame(rows, RAW_IMPRESSIONS), START, ["C1"])
    segments = layers.segment_ctr_daily(silver)
    means = predictions.campaign_means(segments)
    predicted = predictions.group_mean_predictions(segments, 1.0, means=means)
    assert questions.wasted_spend_total(predicted, means).first()[0] == 0.0


def test_prior_champion_becomes_stale(predicted):
    scored = predicted.withColumn("predicted_ctr_champion", F.lit(0.3))
    prior = predicted.where("campaign_id = 'C1'")
    rows = predictions.prior_as_stale(scored, prior).collect()
    assert len(rows) == 3
    got = {(r["event_date"].day, r["campaign_id"]): r["predicted_ctr_stale"] for r in rows}
    assert got == {(1, "C1"): 0.5, (9, "C1"): 0.125, (9, "C2"): None}


def test_filters_combine(silver):
    segments = layers.segment_ctr_daily(silver)
    assert filters.filtered_slice(segments).count() == 3
    assert filters.filtered_slice(segments, date(2024, 1, 9), date(2024, 1, 9)).count() == 2
    assert filters.filtered_slice(segments, channels=["Search"], devices=["Mobile"], countries=["US"]).count() == 1
    assert filters.filtered_slice(segments, channels=[]).count() == 0


def test_segment_count_counts_null_parts(spark):
    rows = [("a", None), ("a", None), ("a", "x")]
    df = spark.createDataFrame(rows, "channel string, device string").withColumns(
        {name: F.lit("z") for name in ("country", "visitor_type", "campaign_id")}
    )
    assert questions.segment_count(df).first()[0] == 2


def checks(df):
    return {r["check"]: (r["observed"], r["passed"]) for r in df.collect()}


def test_row_checks_see_violations(spark):
    rows = [impression(1, 1, "C1", 0, 1), impression(2, 1, None, 1, 1), impression(3, 1, "C1", 1, 0)]
    silver = layers.silver_impressions(spark.createDataFrame(rows, RAW_IMPRESSIONS), START, [])
    got = checks(quality.row_checks(silver, ["campaign_id", "device"], 5, 9))
    assert got == {
        "converted_implies_clicked": (1.0, False),
        "row_count": (3.0, False),
        "no_null_campaign_id": (1.0, False),
        "no_null_device": (0.0, True),
    }


def test_rate_days_and_values(spark, silver):
    segments = layers.segment_ctr_daily(silver)
    assert checks(quality.rate_checks(segments, 0.15)) == {"actual_ctr_in_range": (2.0, False)}
    missing = [r["event_date"].day for r in quality.days_present(segments).where("not present").collect()]
    assert sorted(missing) == [2, 3, 4, 5, 6, 7, 8]
    found = {r["country"]: r["passed"] for r in quality.values_present(silver, "country", ["US", "AU"]).collect()}
    assert found == {"US": True, "AU": False}


def test_a_campaign_with_two_channels_fails(spark):
    rows = [impression(1, 1, "C1", 0), impression(2, 1, "C1", 0, channel="Email"), impression(3, 1, "C2", 0)]
    df = spark.createDataFrame(rows, RAW_IMPRESSIONS)
    got = {r["campaign_id"]: r["passed"] for r in quality.campaigns_with_many_channels(df).collect()}
    assert got == {"C1": False, "C2": True}


def test_metric_coverage_sees_what_is_missing(spark):
    df = spark.createDataFrame([("overall", 1), ("channel", 7)], "dimension_name string, window_days int")
    config = MonitorConfig(windows_days=[1, 7], dimensions=["channel"])
    got = {(r["dimension_name"], r["window_days"]): r["passed"] for r in quality.metric_coverage(df, config).collect()}
    assert got == {("overall", 1): True, ("overall", 7): False, ("channel", 1): False, ("channel", 7): True}


def test_gap_and_mix_checks(silver, predicted):
    got = checks(quality.gap_checks(predicted, 0.01))
    assert got == {"stale_gap_positive": (0.375, True), "champion_gap_small": (0.0, True)}
    campaigns = layers.campaign_daily(silver)
    got = checks(quality.mix_shift(campaigns, ["Search"]))
    assert got["mix_share_before"] == (0.0, True)
    assert got["mix_share_after"] == (pytest.approx(1 / 3), True)


def test_events_without_fields_are_kept_as_unknown(spark, tmp_path):
    day = datetime(2024, 1, 22, 5)
    rows = [
        (1, day, 7, "click", '{"k": 3}', 1.0), (2, day, None, "click", '{"k": 3}', 1.0),
        (3, day, 7, "view", "{}", 1.0), (4, day, 7, "view", None, 1.0), (5, day, 7, "click", '{"k": "x"}', 1.0),
    ]
    schema = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, props string, value double"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/events.parquet")
    kept = {r["impression_id"][-1]: r for r in events.impressions(spark, str(tmp_path)).collect()}
    assert len(kept) == 5
    assert kept["1"]["campaign_id"] == "CMP-004" and kept["1"]["clicked"] == 1
    assert (kept["2"]["campaign_id"], kept["2"]["country"], kept["2"]["visitor_type"]) == ("CMP-004", "Unknown", "Unknown")
    assert all(kept[i]["campaign_id"] == kept[i]["channel"] == kept[i]["country"] == "Unknown" for i in "345")
    names = ["device", "country", "visitor_type"]
    looked_up = events.join_visitor_bands(events.keyed_events(spark, str(tmp_path))).collect()
    assert {str(r["event_id"]): [r[n] for n in names] for r in looked_up} == {i: [r[n] for n in names] for i, r in kept.items()}
    lossy = events.impressions(spark, str(tmp_path), click_loss=events.CLICK_LOSS)
    assert lossy.agg({"clicked": "sum"}).first()[0] == 1
