"""Data-quality checks. Each reads its table once and reports what it saw."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import ratio
from ..operators.layers import SEGMENT_KEYS
from ..operators.slices import OVERALL
from ..sources.calendar import calendar_spine
from ..sources.tables import literal_rows
from .monitoring import MonitorConfig
from .questions import SHIFTED_CHANNELS, wasted_spend_rows


def report(df: DataFrame, checks: list[tuple[str, Column, Column]], keys: list[str] = ()) -> DataFrame:
    """One row (check, observed, passed) per check, from columns of ``df``."""
    rows = F.array(
        *[
            F.struct(
                F.lit(name).alias("check"),
                observed.cast("double").alias("observed"),
                F.coalesce(passed, F.lit(False)).alias("passed"),
            )
            for name, observed, passed in checks
        ]
    )
    return df.select(*keys, F.inline(rows))


def _violations(condition: Column) -> Column:
    """How many rows meet the condition; 0 over no rows."""
    return F.count_if(condition)


def _row_counts(keys: list[str]) -> dict[str, Column]:
    """The row count and the rows that break each rule, as aggregates by name."""
    return {
        "rows": F.count(F.lit(1)),
        "unclicked_conversions": _violations((F.col("converted") == 1) & (F.col("clicked") != 1)),
        **{f"null_{key}": _violations(F.col(key).isNull()) for key in keys},
    }


def _row_rules(keys: list[str], min_rows: int, max_rows: int) -> list[tuple[str, Column, Column]]:
    rows, unclicked = F.col("rows"), F.col("unclicked_conversions")
    return [
        ("converted_implies_clicked", unclicked, unclicked == 0),
        ("row_count", rows, rows.between(min_rows, max_rows)),
        *[(f"no_null_{key}", F.col(f"null_{key}"), F.col(f"null_{key}") == 0) for key in keys],
    ]


def _outside(rate: Column, max_ctr: float) -> Column:
    return _violations(~rate.between(0.0, max_ctr)).alias("outside")


def row_checks(
    silver: DataFrame, keys: list[str], min_rows: int, max_rows: int
) -> DataFrame:
    """Conversions have clicks, keys are not NULL, the row count is near its target."""
    counted = silver.agg(*[count.alias(name) for name, count in _row_counts(keys).items()])
    return report(counted, _row_rules(keys, min_rows, max_rows))


def rate_checks(segments: DataFrame, max_ctr: float) -> DataFrame:
    """Click rates lie within [0, max_ctr]."""
    outside = segments.agg(_outside(F.col("actual_ctr"), max_ctr))
    return report(outside, [("actual_ctr_in_range", F.col("outside"), F.col("outside") == 0)])


def fact_checks(
    silver: DataFrame, keys: list[str], min_rows: int, max_rows: int, max_ctr: float
) -> DataFrame:
    """The row and the rate checks in one scan: counted within each segment-day, then summed up."""
    counts = _row_counts(keys)
    segments = silver.groupBy(*SEGMENT_KEYS).agg(
        F.sum("clicked").alias("clicks"), *[count.alias(name) for name, count in counts.items()]
    )
    total = segments.agg(
        *[F.coalesce(F.sum(name), F.lit(0)).alias(name) for name in counts],
        _outside(ratio("clicks", "rows"), max_ctr),
    )
    rules = _row_rules(keys, min_rows, max_rows)
    return report(total, [*rules, ("actual_ctr_in_range", F.col("outside"), F.col("outside") == 0)])


def drift_weekly(segments: DataFrame) -> DataFrame:
    """Weekly click rate of the cohort, of the rest, and blended."""
    member = F.col("is_drift_segment")

    def ctr(where: Column) -> Column:
        clicks, impressions = (F.sum(F.when(where, F.col(name))) for name in ("clicks", "impressions"))
        return ratio(clicks, impressions)

    return (
        segments.groupBy("event_week")
        .agg(
            ctr(member).alias("cohort_ctr"),
            ctr(~member).alias("other_ctr"),
            ratio(F.sum("clicks"), F.sum("impressions")).alias("blended_ctr"),
        )
        .orderBy("event_week")
    )


def mix_shift(campaigns: DataFrame, channels: list[str] = SHIFTED_CHANNELS) -> DataFrame:
    """The channels' share of impressions before and inside the drift window; passes if it rose."""
    after, member = F.col("is_drift_window"), F.col("channel").isin(channels)

    def share(where: Column) -> Column:
        inside = F.sum(F.when(where, F.when(member, F.col("impressions")).otherwise(F.lit(0))))
        return ratio(inside, F.sum(F.when(where, F.col("impressions"))))

    shares = campaigns.agg(share(~after).alias("before"), share(after).alias("after"))
    return report(
        shares,
        [
            ("mix_share_before", F.col("before"), F.col("before").isNotNull()),
            ("mix_share_after", F.col("after"), F.col("after") > F.col("before")),
        ],
    )


def waste_in_band(predictions: DataFrame, means: DataFrame, low: float, high: float) -> DataFrame:
    """Total wasted spend lies inside the accepted band."""
    total = wasted_spend_rows(predictions, means).agg(F.sum("wasted_spend_usd").alias("total"))
    return report(total, [("wasted_spend_in_band", F.col("total"), F.col("total").between(low, high))])


def segment_count_check(counted: DataFrame, low: int, high: int) -> DataFrame:
    """The number of distinct segments lies in a range."""
    n = F.col("segments")
    return report(counted, [("segment_count", n, n.between(low, high))])


def days_present(segments: DataFrame, first: date | None = None, last: date | None = None) -> DataFrame:
    """Impressions of every calendar day from ``first`` to ``last``, 0 where a day is missing.

    Without these, the days between the table's own first and last one, where a missing end is not seen.
    """
    daily = segments.groupBy("event_date").agg(F.sum("impressions").alias("seen"))
    if first is None or last is None:
        days = calendar_spine(segments)
    else:
        ends = literal_rows(segments.sparkSession, [(first,), (last,)], "event_date date")
        days = calendar_spine(ends)
    return days.join(daily, "event_date", "left").select(
        "event_date",
        F.coalesce("seen", F.lit(0).cast("bigint")).alias("impressions"),
        F.col("seen").isNotNull().alias("present"),
    )


def campaigns_with_many_channels(impressions: DataFrame) -> DataFrame:
    """Campaigns and whether they keep to one channel.

    The pairs are made distinct first, by hash and before the shuffle, so the
    text minimum, which needs sorted input, runs over a few rows per campaign.
    """
    one = F.min("channel") == F.max("channel")
    return impressions.select("campaign_id", "channel").distinct().groupBy("campaign_id").agg(
        F.min("channel").alias("first_channel"),
        F.coalesce(one, F.lit(False)).alias("passed"),
    )


def values_present(df: DataFrame, column: str, expected: list[str]) -> DataFrame:
    """For every expected value: how many rows carry it, and whether any does."""
    wanted = literal_rows(df.sparkSession, [(value,) for value in expected], f"{column} string")
    seen = df.groupBy(column).agg(F.count(F.lit(1)).alias("seen"))
    return wanted.join(seen, column, "left").select(
        column,
        F.coalesce("seen", F.lit(0).cast("bigint")).alias("rows"),
        F.col("seen").isNotNull().alias("passed"),
    )


def gap_checks(predictions: DataFrame, champion_tolerance: float) -> DataFrame:
    """On the drifted cohort the stale model over-predicts and the champion does not."""
    member = F.col("is_drift_segment") & F.col("is_drift_window")
    weight = F.sum(F.when(member, F.col("impressions")))
    stale, champion = (
        ratio(F.sum(F.when(member, F.col(f"ctr_gap_{model}") * F.col("impressions"))), weight)
        for model in ("stale", "champion")
    )
    gaps = predictions.agg(stale.alias("stale"), champion.alias("champion"))
    return report(
        gaps,
        [
            ("stale_gap_positive", F.col("stale"), F.col("stale") > 0),
            ("champion_gap_small", F.col("champion"), F.abs("champion") <= champion_tolerance),
        ],
    )


def metric_coverage(metrics: DataFrame, config: MonitorConfig = MonitorConfig()) -> DataFrame:
    """Every configured dimension has metrics for every window length."""
    wanted = [
        (name, days) for name in [OVERALL[0], *config.dimensions] for days in config.windows_days
    ]
    expected = literal_rows(metrics.sparkSession, wanted, "dimension_name string, window_days int")
    seen = metrics.groupBy("dimension_name", "window_days").agg(F.count(F.lit(1)).alias("seen"))
    return expected.join(seen, ["dimension_name", "window_days"], "left").select(
        "dimension_name", "window_days",
        F.coalesce("seen", F.lit(0).cast("bigint")).alias("rows"),
        F.col("seen").isNotNull().alias("passed"),
    )


def versions_check(versions: DataFrame, current_alias: DataFrame, alias: str = "champion") -> DataFrame:
    """At least two versions of each model exist and the alias points to the newest one."""
    newest = versions.groupBy("model_name").agg(
        F.count(F.lit(1)).alias("versions"), F.max("version").alias("newest")
    )
    named = current_alias.where(F.col("alias") == alias).select("model_name", F.col("version").alias("aliased"))
    return report(
        newest.join(named, "model_name", "left"),
        [
            ("at_least_two_versions", F.col("versions"), F.col("versions") >= 2),
            ("alias_on_newest_version", F.col("aliased"), F.col("aliased") == F.col("newest")),
        ],
    )


def trial_count_check(runs: DataFrame, feature_sets: int, trials: int) -> DataFrame:
    """The run log holds at least one candidate per feature set and trial."""
    counted = runs.agg(
        F.count_if(F.col("tags")["model_generation"].endswith("candidate")).alias("candidates")
    )
    n = F.col("candidates")
    return report(counted, [("candidate_runs", n, n >= feature_sets * trials)])


def decisions_recorded_check(log: DataFrame, evaluations: int) -> DataFrame:
    """Every evaluation left a row with a reason."""
    with_reason = log.agg(F.count_if(F.length("reason") > 0).alias("with_reason"))
    n = F.col("with_reason")
    return report(with_reason, [("decisions_recorded", n, n >= evaluations)])
