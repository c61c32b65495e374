"""Decision tables: the retrain policy and the promotion gate."""

from __future__ import annotations

from datetime import date, datetime, timedelta, timezone

import pytest

from adperf.operators import decisions as d

NOW = datetime(2026, 9, 8, tzinfo=timezone.utc)
POLICY = d.RetrainPolicy()
METRICS = (
    "metric_date date, window_days int, dimension_name string, dimension_value string, model_version string, "
    "weighted_rmse double, baseline_rmse double, rmse_change_pct double, impressions bigint, drift_status string"
)


def metrics(spark, rows, value="All", window_days=7):
    """Newest first: (status, impressions)."""
    return spark.createDataFrame(
        [
            (date(2026, 9, 8) - timedelta(days=age), window_days, "overall", value, "2", 0.012, 0.008, 50.0, seen, status)
            for age, (status, seen) in enumerate(rows)
        ],
        METRICS,
    )


def log(spark, moment, should_retrain=True):
    return spark.createDataFrame(
        [("overall", "All", should_retrain, moment)],
        "dimension_name string, dimension_value string, should_retrain boolean, evaluated_at timestamp",
    )


CRITICAL = ("critical", 100_000)
CASES = [
    ([CRITICAL, CRITICAL], None, d.RETRAIN),
    ([CRITICAL], None, d.TOO_LITTLE_HISTORY),
    ([("critical", 10_000), CRITICAL], None, d.TOO_FEW_IMPRESSIONS),
    ([CRITICAL, CRITICAL], NOW - timedelta(days=2), d.COOLING_DOWN),
    ([CRITICAL, ("warning", 100_000)], None, d.NOT_PERSISTENT),
    # At the limits.
    ([CRITICAL, CRITICAL], NOW - timedelta(days=7), d.RETRAIN),
    ([CRITICAL, CRITICAL], NOW - timedelta(days=7) + timedelta(seconds=1), d.COOLING_DOWN),
    ([("critical", 50_000), CRITICAL], None, d.RETRAIN),
    ([("critical", 49_999), CRITICAL], None, d.TOO_FEW_IMPRESSIONS),
    # Only the newest rows count, and the order of the tests is fixed.
    ([CRITICAL, CRITICAL, ("healthy", 1)], None, d.RETRAIN),
    ([("healthy", 1), CRITICAL], NOW, d.TOO_FEW_IMPRESSIONS),
    ([("critical", 100_000), (None, 100_000)], None, d.NOT_PERSISTENT),
]


@pytest.mark.parametrize("rows, last, reason", CASES)
def test_retrain_policy(spark, rows, last, reason):
    past = None if last is None else log(spark, last)
    (row,) = d.retrain_decisions(metrics(spark, rows), POLICY, NOW, past).collect()
    assert row["reason"] == reason
    assert row["should_retrain"] == (reason == d.RETRAIN)
    assert row["metric_date"] == "2026-09-08"
    assert row["impressions"] == rows[0][1]
    assert (row["weighted_rmse"], row["baseline_rmse"], row["rmse_change_pct"]) == (0.012, 0.008, 50.0)


def test_a_refused_evaluation_starts_no_cooldown(spark):
    past = log(spark, NOW - timedelta(days=1), should_retrain=False)
    (row,) = d.retrain_decisions(metrics(spark, [CRITICAL, CRITICAL]), POLICY, NOW, past).collect()
    assert row["reason"] == d.RETRAIN


def test_naive_times_are_utc(spark):
    (row,) = d.retrain_decisions(metrics(spark, [CRITICAL, CRITICAL]), POLICY, NOW.replace(tzinfo=None)).collect()
    (aware,) = d.retrain_decisions(metrics(spark, [CRITICAL, CRITICAL]), POLICY, NOW).collect()
    assert row["evaluated_at"] == aware["evaluated_at"]


def test_a_slice_without_metrics_still_gets_a_decision(spark):
    empty = metrics(spark, [CRITICAL], window_days=28)
    (row,) = d.retrain_decisions(empty, POLICY, NOW, slices=d.overall_slice(spark)).collect()
    assert (row["reason"], row["metric_date"], row["impressions"]) == (d.TOO_LITTLE_HISTORY, None, 0)


def test_slices_are_decided_apart(spark):
    both = metrics(spark, [CRITICAL, CRITICAL]).unionByName(metrics(spark, [CRITICAL], value="Other"))
    got = {row["dimension_value"]: row["reason"] for row in d.retrain_decisions(both, POLICY, NOW).collect()}
    assert got == {"All": d.RETRAIN, "Other": d.TOO_LITTLE_HISTORY}


GATE = [
    (0.01, None, 5.0, True, "No incumbent"),
    (0.009, 0.01, 10.0, True, "met threshold 0.00900"),
    (0.0095, 0.01, 10.0, False, "exceeded"),
    (0.01, 0.01, 0.0, True, "met"),
    (None, 0.01, 0.0, False, "exceeded"),
]


@pytest.mark.parametrize("candidate, incumbent, pct, promoted, text", GATE)
def test_promotion_gate(spark, candidate, incumbent, pct, promoted, text):
    df = spark.createDataFrame([(candidate, incumbent)], "candidate_rmse double, incumbent_rmse double")
    row = d.promotion_gate(df, pct).first()
    assert row["promoted"] is promoted
    assert text in row["reason"]
