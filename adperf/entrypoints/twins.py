"""SQL twins of the named queries, over the same tables.

Each twin is written for itself from the column rules; it shares no expression
with the DataFrame code. All of them run over whole tables.
"""

from __future__ import annotations

IMPRESSIONS = """
dim(slot, campaign_id, channel, objective) AS (VALUES
  (0, 'CMP-001', 'Search', 'conversion'), (1, 'CMP-002', 'Search', 'conversion'),
  (2, 'CMP-003', 'Search', 'conversion'), (3, 'CMP-004', 'Social', 'awareness'),
  (4, 'CMP-005', 'Social', 'retargeting'), (5, 'CMP-006', 'Social', 'awareness'),
  (6, 'CMP-007', 'Display', 'awareness'), (7, 'CMP-008', 'Display', 'awareness'),
  (8, 'CMP-009', 'Email', 'conversion'), (9, 'CMP-010', 'Email', 'retargeting'),
  (10, 'CMP-011', 'Affiliate', 'conversion'), (11, 'CMP-012', 'Affiliate', 'conversion')),
ev AS (SELECT *, TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events),
placed AS (
  SELECT ev.event_id, ev.ts, ev.event_type, ev.value, coalesce(dim.campaign_id, 'Unknown') AS campaign_id,
    coalesce(dim.channel, 'Unknown') AS channel, coalesce(dim.objective, 'Unknown') AS objective,
    CASE WHEN event_id * 37 % 100 < 42 THEN 'Desktop' WHEN event_id * 37 % 100 < 90 THEN 'Mobile'
         ELSE 'Tablet' END AS device,
    CASE WHEN user_id IS NULL OR k IS NULL THEN 'Unknown'
         WHEN (user_id * 53 + k) % 100 < 32 THEN 'US' WHEN (user_id * 53 + k) % 100 < 42 THEN 'CA'
         WHEN (user_id * 53 + k) % 100 < 58 THEN 'GB' WHEN (user_id * 53 + k) % 100 < 72 THEN 'DE'
         WHEN (user_id * 53 + k) % 100 < 86 THEN 'FR' ELSE 'AU' END AS country,
    CASE WHEN user_id IS NULL THEN 'Unknown' WHEN user_id % 20 < 9 THEN 'returning' ELSE 'new' END AS visitor_type,
    event_type IN ('click', 'purchase')
      AND NOT (coalesce(dim.campaign_id, '') IN ('CMP-004', 'CMP-006', 'CMP-007', 'CMP-008')
               AND ts >= TIMESTAMP '2024-01-21' AND event_id % 5 <> 0) AS hit
  FROM ev LEFT JOIN dim ON ev.k % 12 = dim.slot),
imp AS (
  SELECT printf('IMP-%09d', event_id) AS impression_id, ts AS event_ts, CAST(ts AS DATE) AS event_date,
    campaign_id, channel, channel || ' ' || campaign_id AS campaign_name, device, country, visitor_type, objective,
    CAST(hour(ts) AS INTEGER) AS hour_of_day, CAST(dayofweek(ts) AS INTEGER) AS day_of_week,
    CAST(hit AS INTEGER) AS clicked,
    CAST(hit AND event_type = 'purchase' AS INTEGER) AS converted,
    round(value * 0.01, 5) AS cost_usd,
    CASE WHEN hit AND event_type = 'purchase' THEN round(value, 2) ELSE 0.0 END AS conversion_value_usd
  FROM placed)"""

SILVER = IMPRESSIONS + """,
silver AS (
  SELECT *, CAST(date_trunc('week', event_date) AS DATE) AS event_week, conversion_value_usd AS revenue_usd,
    event_date >= DATE '2024-01-21' AS is_drift_window,
    campaign_id IN ('CMP-004', 'CMP-006', 'CMP-007', 'CMP-008') AS is_drift_segment
  FROM imp)"""

MEASURES = """
    CAST(count(*) AS BIGINT) AS impressions, CAST(sum(clicked) AS BIGINT) AS clicks,
    CAST(sum(converted) AS BIGINT) AS conversions,
    sum(clicked) / count(*) AS {rate},{cvr}
    sum(cost_usd) AS spend_usd, sum(conversion_value_usd) AS conversion_value_usd,
    bool_or(is_drift_window) AS is_drift_window, bool_or(is_drift_segment) AS is_drift_segment"""

SEGMENT_COLUMNS = "event_date, event_week, channel, campaign_id, campaign_name, device, country, visitor_type, objective"
CAMPAIGN_COLUMNS = "event_date, event_week, channel, campaign_id, campaign_name, objective"
CVR = " sum(converted) / nullif(sum(clicked), 0) AS actual_cvr,"

SEGMENTS_OF = """seg AS (SELECT {keys}, {measures} FROM {source} GROUP BY {keys})"""
SEGMENTS = SILVER + ",\n" + SEGMENTS_OF.format(
    keys=SEGMENT_COLUMNS, measures=MEASURES.format(rate="actual_ctr", cvr=CVR), source="silver"
)
CAMPAIGNS = SILVER + f""",
camp AS (SELECT {CAMPAIGN_COLUMNS}, {MEASURES.format(rate="blended_ctr", cvr="")}
  FROM silver GROUP BY {CAMPAIGN_COLUMNS})"""
BOTH = SEGMENTS + CAMPAIGNS[len(SILVER):]

MEANS = """,
base AS (
  SELECT campaign_id, sum(clicks) / sum(impressions) AS baseline_ctr
  FROM seg WHERE NOT is_drift_window GROUP BY campaign_id),
regime AS (
  SELECT campaign_id, is_drift_window, sum(clicks) / sum(impressions) AS regime_ctr
  FROM seg GROUP BY campaign_id, is_drift_window)"""
PREDICTED = """,
pred AS (
  SELECT event_date, channel, device, country, visitor_type, campaign_id, campaign_name, objective,
    impressions, spend_usd, actual_ctr, baseline_ctr AS predicted_ctr_stale,
    regime_ctr AS predicted_ctr_champion, baseline_ctr - actual_ctr AS ctr_gap_stale,
    regime_ctr - actual_ctr AS ctr_gap_champion, is_drift_window, is_drift_segment,
    '2' AS model_version_champion
  FROM seg LEFT JOIN base USING (campaign_id) JOIN regime USING (campaign_id, is_drift_window))"""
PREDICTIONS = SEGMENTS + MEANS + PREDICTED
ALL = BOTH + MEANS + PREDICTED

WASTE = """,
waste AS (
  SELECT p.*, spend_usd * greatest(0, 1 - actual_ctr / nullif(baseline_ctr, 0)) AS wasted
  FROM pred p JOIN base USING (campaign_id) WHERE is_drift_window AND is_drift_segment)"""

DIMENSIONS = ["channel", "device", "country", "visitor_type", "campaign_name", "objective"]
SLICES = [("'overall'", "'All'")] + [(f"'{d}'", f"coalesce({d}, 'Unknown')") for d in DIMENSIONS]


def _monitor(predicted: str, version: str) -> str:
    """CTEs daily, bline and metrics for a prediction column."""
    parts = "\n  UNION ALL\n  ".join(
        f"SELECT event_date AS metric_date, {name} AS dimension_name, {value} AS dimension_value, "
        f"'{version}' AS model_version, impressions AS w, actual_ctr AS y, {predicted} AS p, is_drift_window FROM pred"
        for name, value in SLICES
    )
    sums = [
        "sum_squared_error", "sum_absolute_error", "sum_signed_error",
        "sum_actual", "sum_predicted", "impressions", "observation_count",
    ]
    keys = "dimension_name, dimension_value, model_version"
    rolled = "\n  UNION ALL\n  ".join(
        f"SELECT metric_date, {days} AS window_days, {keys}, "
        + ", ".join(f"sum({s}) OVER win AS {s}" for s in sums)
        + f" FROM daily WINDOW win AS (PARTITION BY {keys} ORDER BY metric_date"
        f" RANGE BETWEEN INTERVAL {days - 1} DAY PRECEDING AND CURRENT ROW)"
        for days in (1, 7, 28)
    )
    return f""",
parts AS (
  {parts}),
daily AS (
  SELECT metric_date, {keys},
    sum(pow(p - y, 2) * w) AS sum_squared_error, sum(abs(p - y) * w) AS sum_absolute_error,
    sum((p - y) * w) AS sum_signed_error, sum(y * w) AS sum_actual, sum(p * w) AS sum_predicted,
    sum(w) AS impressions, count(*) AS observation_count,
    sum(pow(p - y, 2) * w) FILTER (WHERE NOT is_drift_window) AS baseline_squared_error,
    sum(w) FILTER (WHERE NOT is_drift_window) AS baseline_impressions
  FROM parts GROUP BY metric_date, {keys}),
bline AS (
  SELECT {keys}, sqrt(sum(pow(p - y, 2) * w) / sum(w)) AS baseline_rmse
  FROM parts WHERE NOT is_drift_window GROUP BY {keys}),
rolled AS (
  {rolled}),
rates AS (
  SELECT metric_date, CAST(window_days AS INTEGER) AS window_days, dimension_name, dimension_value, model_version,
    sum_actual / impressions AS actual_ctr, sum_predicted / impressions AS predicted_ctr,
    sqrt(sum_squared_error / impressions) AS weighted_rmse, sum_absolute_error / impressions AS weighted_mae,
    sum_signed_error / impressions AS signed_bias,
    abs(sum_predicted / impressions - sum_actual / impressions) AS absolute_ctr_gap,
    baseline_rmse,
    CASE WHEN baseline_rmse > 0
      THEN 100.0 * (sqrt(sum_squared_error / impressions) - baseline_rmse) / baseline_rmse END AS rmse_change_pct,
    CAST(observation_count AS BIGINT) AS observation_count, CAST(impressions AS BIGINT) AS impressions
  FROM rolled LEFT JOIN bline USING ({keys})),
metrics AS (
  SELECT *, CASE WHEN rmse_change_pct >= 20 THEN 'critical' WHEN rmse_change_pct >= 10 THEN 'warning'
    ELSE 'healthy' END AS drift_status FROM rates)"""


METRICS = PREDICTIONS + _monitor("predicted_ctr_champion", "2")
INCUMBENT = PREDICTIONS + _monitor("predicted_ctr_stale", "1")

METRIC_DOUBLES = [
    "actual_ctr", "predicted_ctr", "weighted_rmse", "weighted_mae", "signed_bias", "absolute_ctr_gap",
    "baseline_rmse", "rmse_change_pct",
]
METRIC_KEYS = "metric_date, window_days, dimension_name, dimension_value, model_version, drift_status"
VOLUME = "observation_count, impressions"


def _r(columns: list[str], digits: int = 6) -> str:
    return ", ".join(f"round({c}, {digits}) + 0.0 AS {c}" for c in columns)


METRIC_SELECT = f"{METRIC_KEYS}, {_r(METRIC_DOUBLES)}, {VOLUME}"


def _evaluation(number: int, day: str, earlier: list[int]) -> str:
    """CTE log<number>: one evaluation at 07:00 of ``day``, seeing earlier days and earlier log rows."""
    log = " UNION ALL ".join(f"SELECT * FROM log{i}" for i in earlier)
    triggers = (
        f"SELECT dimension_name, dimension_value, max(evaluated_at) AS last_trigger FROM ({log}) "
        "WHERE should_retrain GROUP BY ALL"
        if earlier
        else "SELECT '' AS dimension_name, '' AS dimension_value, TIMESTAMP '1970-01-01' AS last_trigger WHERE false"
    )
    keys = "dimension_name, dimension_value, model_version"
    return f""",
log{number} AS (
  SELECT *, reason = 'persistent critical drift exceeded the retraining threshold' AS should_retrain FROM (
    SELECT CAST(n.metric_date AS VARCHAR) AS metric_date, n.weighted_rmse, n.baseline_rmse, n.rmse_change_pct,
      n.impressions, n.dimension_name, n.dimension_value, n.model_version,
      TIMESTAMP '{day} 07:00:00' AS evaluated_at,
      CASE WHEN s.periods < 2 THEN 'insufficient metric history'
           WHEN n.impressions < 500 THEN 'minimum impression volume not met'
           WHEN t.last_trigger + INTERVAL 7 DAY > TIMESTAMP '{day} 07:00:00' THEN 'retraining cooldown is active'
           WHEN s.critical < 2 THEN 'critical threshold has not persisted'
           ELSE 'persistent critical drift exceeded the retraining threshold' END AS reason
    FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY metric_date DESC) AS age
          FROM metrics WHERE window_days = 7 AND metric_date < DATE '{day}') n
    JOIN (SELECT {keys}, count(*) AS periods, count(*) FILTER (WHERE drift_status = 'critical') AS critical
          FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY metric_date DESC) AS age
                FROM metrics WHERE window_days = 7 AND metric_date < DATE '{day}') WHERE age <= 2
          GROUP BY {keys}) s USING ({keys})
    LEFT JOIN ({triggers}) t USING (dimension_name, dimension_value)
    WHERE n.age = 1))"""


DAYS = ["2024-01-22", "2024-01-25", "2024-01-29", "2024-02-01"]
LOGS = "".join(_evaluation(i, day, list(range(i))) for i, day in enumerate(DAYS))
LOG_SELECT = (
    "metric_date, " + _r(["weighted_rmse", "baseline_rmse", "rmse_change_pct"])
    + ", impressions, should_retrain, reason, evaluated_at, dimension_name, dimension_value, model_version"
)

ORDER_LINES = f"""
lines AS (
  SELECT CAST(l_shipdate AS DATE) AS event_date, CAST(date_trunc('week', CAST(l_shipdate AS DATE)) AS DATE) AS event_week,
    c_mktsegment AS channel, p_brand AS campaign_id, 'Campaign ' || p_brand AS campaign_name,
    l_returnflag AS device, CAST(n_regionkey AS VARCHAR) AS country, l_linestatus AS visitor_type,
    o_orderpriority AS objective,
    CAST(l_quantity % 3 = 0 AS INTEGER) AS clicked,
    CAST(l_quantity % 3 = 0 AND l_quantity % 2 = 0 AS INTEGER) AS converted,
    round(l_extendedprice * 0.001, 5) AS cost_usd,
    CASE WHEN l_quantity % 3 = 0 AND l_quantity % 2 = 0 THEN round(l_extendedprice, 2) ELSE 0.0 END
      AS conversion_value_usd,
    l_shipdate >= TIMESTAMP '2001-01-01' AS is_drift_window,
    p_brand IN ('Brand#11', 'Brand#22', 'Brand#33') AS is_drift_segment
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
    JOIN nation ON c_nationkey = n_nationkey JOIN part ON l_partkey = p_partkey),
""" + SEGMENTS_OF.format(
    keys=SEGMENT_COLUMNS, measures=MEASURES.format(rate="actual_ctr", cvr=CVR), source="lines"
)

SEGMENT_SELECT = (
    f"{SEGMENT_COLUMNS}, impressions, clicks, conversions, is_drift_window, is_drift_segment, "
    + _r(["actual_ctr", "actual_cvr", "spend_usd", "conversion_value_usd"])
)
CAMPAIGN_SELECT = (
    f"{CAMPAIGN_COLUMNS}, impressions, clicks, conversions, is_drift_window, is_drift_segment, "
    + _r(["blended_ctr", "spend_usd", "conversion_value_usd"])
)
PREDICTION_SELECT = (
    "event_date, channel, device, country, visitor_type, campaign_id, campaign_name, objective, impressions, "
    "is_drift_window, is_drift_segment, model_version_champion, "
    + _r(["spend_usd", "actual_ctr", "predicted_ctr_stale", "predicted_ctr_champion", "ctr_gap_stale", "ctr_gap_champion"])
)
IMPRESSION_SELECT = (
    "impression_id, event_ts, event_date, campaign_id, channel, campaign_name, device, country, visitor_type, "
    "objective, hour_of_day, day_of_week, clicked, converted, "
    + _r(["cost_usd", "conversion_value_usd"])
)

WEIGHTS = """
w AS (
  SELECT * FROM (SELECT o_custkey, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cents
    FROM orders GROUP BY o_custkey) WHERE cents > 0),
bands AS (
  SELECT o_custkey,
    CAST(sum(cents) OVER (ORDER BY o_custkey) - cents AS DOUBLE) / CAST(sum(cents) OVER () AS DOUBLE) AS low,
    CAST(sum(cents) OVER (ORDER BY o_custkey) AS DOUBLE) / CAST(sum(cents) OVER () AS DOUBLE) AS high
  FROM w)"""
POINT = "(event_id * 7919 % 1000003) / 1000003.0"


def _check_rows(rows: list[tuple[str, str, str]], source: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{name}' AS \"check\", round(CAST({observed} AS DOUBLE), 6) + 0.0 AS observed, "
        f"coalesce({passed}, false) AS passed FROM {source}"
        for name, observed, passed in rows
    )


def _with(ctes: str, select: str) -> str:
    return f"WITH {ctes}\n{select}"


KEYS = ["impression_id", "event_date", "channel", "device", "country", "visitor_type", "campaign_id"]
COHORT = "is_drift_segment AND is_drift_window"


def _model(model: str, where: str = "true") -> dict[str, str]:
    p = f"predicted_ctr_{model}"
    f = f"FILTER (WHERE {where})"
    w, we2 = f"sum(impressions) {f}", f"sum(impressions * pow({p} - actual_ctr, 2)) {f}"
    mean = f"(sum(impressions * actual_ctr) {f} / {w})"
    return {
        "rmse": f"sqrt({we2} / {w})",
        "mae": f"sum(impressions * abs({p} - actual_ctr)) {f} / {w}",
        "r2": f"1 - {we2} / (sum(impressions * actual_ctr * actual_ctr) {f} - {w} * {mean} * {mean})",
    }


def oracle_sql() -> dict[str, str]:
    """Query name -> SQL."""
    stale, champion = _model("stale"), _model("champion")
    stale_cohort, champion_cohort = _model("stale", COHORT)["rmse"], _model("champion", COHORT)["rmse"]
    hot = [
        ("channel", ["Affiliate", "Display", "Email", "Search", "Social"]),
        ("device", ["Desktop", "Mobile", "Tablet"]),
        ("country", ["AU", "CA", "DE", "FR", "GB", "US"]),
        ("visitor_type", ["new", "returning"]),
    ]
    hot_columns = ", ".join(
        f"CASE WHEN {c} = '{v}' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS \"{c}_{v}\"" for c, vs in hot for v in vs
    )
    grain = "event_date, channel, device, country, visitor_type, campaign_id"
    digest = (
        "md5(concat_ws('|', CAST(event_date AS VARCHAR), channel, device, country, visitor_type, campaign_id))"
    )
    bucket = f"CAST(CAST(concat('0x', substr({digest}, 1, 8)) AS BIGINT) % 5 AS INTEGER)"
    weighted = {
        c: f"sum({c} * impressions) / sum(impressions)"
        for c in ("actual_ctr", "predicted_ctr_stale", "predicted_ctr_champion", "ctr_gap_stale")
    }
    expected = ", ".join(f"('{c}')" for c in ("US", "CA", "GB", "DE", "FR", "AU"))
    pairs = ", ".join(f"('{d}', {n})" for d in ["overall", *DIMENSIONS] for n in (1, 7, 28))
    return {
        "impressions": _with(IMPRESSIONS, f"SELECT {IMPRESSION_SELECT} FROM imp"),
        "raw_campaigns": _with(
            IMPRESSIONS,
            "SELECT campaign_id, campaign_name, channel, objective, round(avg(cost_usd), 6) + 0.0 AS base_bid_usd, "
            "CAST(min(event_date) AS VARCHAR) AS launch_date FROM imp "
            "GROUP BY campaign_id, campaign_name, channel, objective",
        ),
        "silver_impressions": _with(
            SILVER,
            f"SELECT {IMPRESSION_SELECT}, event_week, round(revenue_usd, 6) + 0.0 AS revenue_usd, "
            "is_drift_window, is_drift_segment FROM silver",
        ),
        "segment_ctr_daily": _with(SEGMENTS, f"SELECT {SEGMENT_SELECT} FROM seg"),
        "refresh_by_day": _with(
            SILVER + ",\n" + SEGMENTS_OF.format(
                keys=SEGMENT_COLUMNS, measures=MEASURES.format(rate="actual_ctr", cvr=CVR),
                source="silver WHERE NOT (event_date = DATE '2024-01-15' AND device = 'Tablet')",
            ),
            f"SELECT {SEGMENT_SELECT} FROM seg",
        ),
        "refresh_by_day_campaigns": _with(
            CAMPAIGNS.replace("FROM silver GROUP", "FROM silver WHERE event_date <> DATE '2024-01-15' GROUP"),
            f"SELECT {CAMPAIGN_SELECT} FROM camp",
        ),
        "written_tables": _with(
            CAMPAIGNS + """,
channels AS (SELECT channel, CAST(sum(impressions) AS BIGINT) AS impressions FROM camp GROUP BY channel),
both_parts AS (
  SELECT channel, impressions, CAST(NULL AS VARCHAR) AS origin FROM channels
  UNION ALL SELECT lower(channel), NULL, 'copy' FROM channels)""",
            "SELECT *, CAST(2 * (SELECT count(*) FROM channels) AS INTEGER) AS rows_written, "
            "2 * impressions AS doubled FROM both_parts",
        ),
        "decision_log": (
            "SELECT evaluated_at, 1::BIGINT AS decisions, 1::BIGINT AS with_reason FROM (VALUES "
            "(TIMESTAMP '2024-01-22 07:00:00'), (TIMESTAMP '2024-01-25 07:00:00'), "
            "(TIMESTAMP '2024-01-29 07:00:00'), (TIMESTAMP '2024-02-01 07:00:00')) evaluations(evaluated_at)"
        ),
        "hot_key_join": _with(
            IMPRESSIONS + """,
named AS (SELECT campaign_id, max(campaign_name) AS name, count(*) AS total FROM imp GROUP BY campaign_id)""",
            "SELECT imp.event_date, imp.campaign_id, count(*) AS impressions, CAST(sum(total) AS BIGINT) AS totals, "
            "max(name) AS name FROM imp JOIN named USING (campaign_id) GROUP BY imp.event_date, imp.campaign_id",
        ),
        "campaign_daily": _with(CAMPAIGNS, f"SELECT {CAMPAIGN_SELECT} FROM camp"),
        "campaign_daily_from_segments": _with(CAMPAIGNS, f"SELECT {CAMPAIGN_SELECT} FROM camp"),
        "order_line_segment_daily": _with(
            ORDER_LINES,
            f"SELECT {SEGMENT_COLUMNS}, impressions, clicks, conversions, is_drift_window, is_drift_segment, "
            + _r(["actual_ctr", "actual_cvr", "spend_usd", "conversion_value_usd"]) + " FROM seg",
        ),
        "band_lookup": _with(IMPRESSIONS, "SELECT event_id, device, country, visitor_type FROM placed"),
        "cumulative_bands": _with(
            WEIGHTS, "SELECT o_custkey, round(low, 9) + 0.0 AS low, round(high, 9) + 0.0 AS high FROM bands"
        ),
        "weighted_pick": _with(
            WEIGHTS,
            f"SELECT event_id, o_custkey FROM events JOIN bands ON {POINT} >= low AND {POINT} < high",
        ),
        "regime_lookup": _with(
            CAMPAIGNS + """,
w AS (SELECT is_drift_window, channel, sum(impressions) AS n FROM camp GROUP BY ALL),
bands AS (
  SELECT is_drift_window, channel,
    CAST(sum(n) OVER running - n AS DOUBLE) / CAST(sum(n) OVER whole AS DOUBLE) AS low,
    CAST(sum(n) OVER running AS DOUBLE) / CAST(sum(n) OVER whole AS DOUBLE) AS high
  FROM w WINDOW running AS (PARTITION BY is_drift_window ORDER BY channel),
    whole AS (PARTITION BY is_drift_window)),
points AS (SELECT event_id, ts >= TIMESTAMP '2024-01-21' AS is_drift_window, """ + POINT + """ AS point FROM events)""",
            "SELECT event_id, is_drift_window, channel AS picked_channel FROM points JOIN bands "
            "USING (is_drift_window) WHERE point >= low AND point < high",
        ),
        "filtered_slice": _with(
            SEGMENTS,
            "SELECT channel, country, CAST(sum(impressions) AS BIGINT) AS impressions, "
            "round(sum(spend_usd), 6) AS spend_usd FROM seg WHERE event_date BETWEEN DATE '2024-01-10' AND "
            "DATE '2024-01-25' AND channel IN ('Search', 'Social') AND country IN ('US', 'GB', 'DE') "
            "GROUP BY channel, country",
        ),
        "biggest_gap_by_channel": _with(
            PREDICTIONS,
            "SELECT channel, round(avg(ctr_gap_stale), 4) + 0.0 AS avg_stale_gap, "
            "round(avg(actual_ctr), 4) AS avg_actual_ctr FROM pred WHERE is_drift_window GROUP BY channel "
            "ORDER BY avg_stale_gap DESC",
        ),
        "impression_mix_weekly": _with(
            CAMPAIGNS,
            "SELECT event_week, channel, CAST(sum(impressions) AS BIGINT) AS impressions FROM camp "
            "GROUP BY event_week, channel ORDER BY event_week, channel",
        ),
        "impression_share_weekly": _with(
            CAMPAIGNS,
            "SELECT event_week, channel, CAST(sum(impressions) AS BIGINT) AS impressions, "
            "round(sum(impressions) / sum(sum(impressions)) OVER (PARTITION BY event_week), 6) AS impression_share, "
            "round(sum(clicks) / sum(impressions), 6) AS ctr FROM camp GROUP BY event_week, channel",
        ),
        "social_display_weekly_ctr": _with(
            SEGMENTS,
            "SELECT event_week, channel, CAST(sum(impressions) AS BIGINT) AS impressions, "
            "round(sum(clicks) / sum(impressions), 6) AS actual_ctr FROM seg "
            "WHERE channel IN ('Social', 'Display') GROUP BY event_week, channel",
        ),
        "wasted_spend_total": _with(
            PREDICTIONS + WASTE, "SELECT round(sum(wasted), 0) AS wasted_spend_usd FROM waste"
        ),
        "wasted_spend_by_channel": _with(
            PREDICTIONS + WASTE,
            "SELECT channel, round(sum(wasted), 6) AS wasted_spend_usd FROM waste GROUP BY channel",
        ),
        "champion_vs_stale_gap": _with(
            PREDICTIONS,
            "SELECT channel, round(avg(abs(ctr_gap_stale)), 4) AS avg_abs_stale_gap, "
            "round(avg(abs(ctr_gap_champion)), 4) AS avg_abs_champion_gap FROM pred WHERE is_drift_window "
            "GROUP BY channel ORDER BY avg_abs_stale_gap DESC",
        ),
        "champion_tracking": _with(
            PREDICTIONS,
            f"SELECT {COHORT} AS in_cohort, round(avg(ctr_gap_stale), 6) + 0.0 AS avg_stale_gap, "
            "round(avg(ctr_gap_champion), 6) + 0.0 AS avg_champion_gap, count(*) AS segment_days "
            "FROM pred GROUP BY 1",
        ),
        "accuracy_lift_by_channel": _with(
            PREDICTIONS,
            "SELECT channel, round(avg(abs(ctr_gap_stale)) - avg(abs(ctr_gap_champion)), 6) + 0.0 AS accuracy_lift "
            "FROM pred WHERE is_drift_window GROUP BY channel",
        ),
        "kpi_row": _with(
            ALL + WASTE,
            "SELECT CAST(sum(impressions) AS BIGINT) AS impressions, "
            "round(sum(clicks) / sum(impressions), 6) AS blended_ctr, "
            "round(sum(conversions) / sum(clicks), 6) AS blended_cvr, "
            "round((SELECT sum(wasted) FROM waste), 6) AS wasted_spend_usd FROM camp",
        ),
        "predicted_vs_actual_weekly": _with(
            PREDICTIONS,
            "SELECT CAST(date_trunc('week', event_date) AS DATE) AS event_week, "
            + ", ".join(f"round(avg({c}), 6) AS avg_{c}" for c in (
                "actual_ctr", "predicted_ctr_stale", "predicted_ctr_champion"))
            + " FROM pred GROUP BY 1",
        ),
        "ctr_by_channel_before_after": _with(
            CAMPAIGNS,
            "SELECT channel, "
            "round(sum(clicks) FILTER (WHERE NOT is_drift_window) / sum(impressions) FILTER (WHERE NOT is_drift_window), 6)"
            " AS ctr_before, "
            "round(sum(clicks) FILTER (WHERE is_drift_window) / sum(impressions) FILTER (WHERE is_drift_window), 6)"
            " AS ctr_after FROM camp GROUP BY channel",
        ),
        "worst_segments": _with(
            PREDICTIONS,
            "SELECT channel, campaign_id, campaign_name, device, country, "
            + ", ".join(f"round({e}, 6) + 0.0 AS {c}" for c, e in weighted.items())
            + ", round(sum(CASE WHEN is_drift_segment THEN spend_usd * "
            "greatest(0, 1 - actual_ctr / nullif(baseline_ctr, 0)) ELSE 0 END), 6) + 0.0 AS wasted_spend_usd "
            "FROM pred JOIN base USING (campaign_id) WHERE is_drift_window "
            "GROUP BY channel, campaign_id, campaign_name, device, country "
            f"ORDER BY round({weighted['ctr_gap_stale']}, 6) DESC, channel, campaign_id, campaign_name, device, country "
            "",
        ),
        "segment_gaps": _with(
            PREDICTIONS,
            "SELECT channel, device, country, visitor_type, campaign_id, is_drift_segment, "
            "CAST(sum(impressions) AS BIGINT) AS impressions, round(sum(spend_usd), 6) AS spend_usd, "
            + ", ".join(
                f"round(sum({c} * impressions) / sum(impressions), 6) + 0.0 AS {c}"
                for c in ("actual_ctr", "predicted_ctr_stale", "predicted_ctr_champion", "ctr_gap_stale", "ctr_gap_champion")
            )
            + ", round(sum(CASE WHEN is_drift_segment THEN spend_usd * "
            "greatest(0, 1 - actual_ctr / nullif(baseline_ctr, 0)) ELSE 0 END), 6) + 0.0 AS wasted_spend_usd "
            "FROM pred JOIN base USING (campaign_id) WHERE is_drift_window GROUP BY ALL",
        ),
        "cohort_ctr": _with(
            SEGMENTS,
            "SELECT round(sum(clicks) FILTER (WHERE NOT is_drift_window) / "
            "sum(impressions) FILTER (WHERE NOT is_drift_window), 6) AS predrift_ctr, "
            "round(sum(clicks) FILTER (WHERE is_drift_window) / sum(impressions) FILTER (WHERE is_drift_window), 6) "
            "AS drift_ctr FROM seg WHERE is_drift_segment",
        ),
        "mix_share_by_regime": _with(
            CAMPAIGNS,
            "SELECT is_drift_window, round(sum(CASE WHEN channel IN ('Social', 'Display') THEN impressions ELSE 0 END) "
            "/ sum(impressions), 6) AS shifted_channel_share FROM camp GROUP BY is_drift_window",
        ),
        "segment_count": _with(
            SEGMENTS,
            "SELECT count(*) AS segments FROM "
            "(SELECT DISTINCT channel, device, country, visitor_type, campaign_id FROM seg)",
        ),
        "group_mean_predictions": _with(PREDICTIONS, f"SELECT {PREDICTION_SELECT} FROM pred"),
        "prior_as_stale": _with(
            PREDICTIONS + f""",
overall AS (SELECT campaign_id, sum(clicks) / sum(impressions) AS ctr FROM seg GROUP BY campaign_id),
joined AS (
  SELECT seg.*, overall.ctr AS predicted_ctr_champion, prior.predicted_ctr_champion AS predicted_ctr_stale,
    overall.ctr - seg.actual_ctr AS ctr_gap_champion,
    prior.predicted_ctr_champion - seg.actual_ctr AS ctr_gap_stale, '3' AS model_version_champion
  FROM seg JOIN overall USING (campaign_id)
    LEFT JOIN (SELECT * FROM pred WHERE event_date < DATE '2024-01-28') prior USING ({grain}))""",
            f"SELECT {PREDICTION_SELECT} FROM joined",
        ),
        "model_metrics": _with(
            PREDICTIONS,
            "SELECT "
            + ", ".join(
                f"round({e}, 6) + 0.0 AS {name}_{model}"
                for model, metrics in (("stale", stale), ("champion", champion))
                for name, e in metrics.items()
            )
            + f", round({stale_cohort}, 6) AS rmse_misbid_cohort_stale"
            f", round({champion_cohort}, 6) AS rmse_misbid_cohort_champion"
            f", round(100.0 * ({stale_cohort} - {champion_cohort}) / {stale_cohort}, 1) + 0.0 AS rmse_improvement_pct"
            " FROM pred",
        ),
        "feature_frame": _with(
            SEGMENTS,
            f"SELECT {grain}, campaign_name, objective, impressions, "
            + _r(["spend_usd", "actual_ctr"])
            + ", CAST(isodow(event_date) - 1 AS INTEGER) AS day_of_week, "
            "CAST(is_drift_window AS INTEGER) AS is_drift_window, is_drift_segment FROM seg",
        ),
        "one_hot_wide": _with(SEGMENTS, f"SELECT {grain}, {hot_columns} FROM seg"),
        "training_weights": _with(
            SEGMENTS,
            f"SELECT {grain}, impressions, CAST(impressions * CASE WHEN is_drift_window THEN 4 ELSE 1 END AS DOUBLE) "
            "AS train_weight FROM seg",
        ),
        "hash_split": _with(
            SEGMENTS, f"SELECT {grain}, {bucket} AS bucket, {bucket} = 0 AS is_validation FROM seg"
        ),
        "model_facts": _with(
            SEGMENTS,
            f"SELECT 'rows_training' AS fact, count(*) FILTER ({bucket} <> 0) AS value FROM seg "
            f"UNION ALL SELECT 'rows_validation', count(*) FILTER ({bucket} = 0) FROM seg "
            "UNION ALL SELECT 'rows_scored', count(*) FROM seg "
            "UNION ALL VALUES ('predictions_outside_bounds', 0), ('gaps_that_differ', 0), ('trials', 12), "
            "('trials_fs_a_core', 4), ('trials_fs_b_campaign', 4), ('trials_fs_c_full', 4), "
            "('parameters_outside_space', 0), ('winner_is_not_the_minimum', 0), ('importances_below_zero', 0), "
            "('importances_do_not_add_up', 0)",
        ),
        "slice_daily": _with(
            METRICS,
            "SELECT metric_date, dimension_name, dimension_value, model_version, "
            + _r(["sum_squared_error", "sum_absolute_error", "sum_signed_error", "sum_actual", "sum_predicted",
                  "baseline_squared_error"], 8)
            + ", CAST(impressions AS BIGINT) AS impressions, observation_count, "
            "CAST(baseline_impressions AS BIGINT) AS baseline_impressions FROM daily",
        ),
        "slice_baseline": _with(
            METRICS,
            "SELECT dimension_name, dimension_value, model_version, round(baseline_rmse, 6) AS baseline_rmse FROM bline",
        ),
        "monitoring_incremental": _with(METRICS, f"SELECT {METRIC_SELECT} FROM metrics"),
        "level_ids": _with(
            SEGMENTS + """,
levels AS (
  SELECT unnest(['channel', 'device', 'country', 'visitor_type', 'campaign_id', 'objective']) AS name,
    unnest([channel, device, country, visitor_type, campaign_id, objective]) AS level FROM seg)""",
            "SELECT name, level, row_number() OVER (PARTITION BY name ORDER BY level) - 1 AS index, count(*) AS rows "
            "FROM levels WHERE level IS NOT NULL GROUP BY name, level",
        ),
        "monitoring_metrics": _with(METRICS, f"SELECT {METRIC_SELECT} FROM metrics"),
        "health_latest_overall": _with(
            METRICS,
            f"SELECT {METRIC_SELECT} FROM metrics WHERE dimension_name = 'overall' AND window_days = 7 "
            "ORDER BY metric_date DESC LIMIT 1",
        ),
        "health_trend": _with(
            METRICS, f"SELECT {METRIC_SELECT} FROM metrics WHERE dimension_name = 'overall' AND window_days = 7"
        ),
        "health_slices_latest": _with(
            METRICS,
            f"SELECT {METRIC_SELECT} FROM metrics WHERE dimension_name <> 'overall' AND window_days = 7 "
            "QUALIFY row_number() OVER (PARTITION BY dimension_name, dimension_value, model_version "
            "ORDER BY metric_date DESC) = 1",
        ),
        "retrain_decision": _with(INCUMBENT + LOGS, f"SELECT {LOG_SELECT} FROM log2"),
        "decision_history": _with(
            INCUMBENT + LOGS,
            " UNION ALL ".join(f"SELECT {LOG_SELECT} FROM log{i}" for i in range(len(DAYS))),
        ),
        "promotion_gate": _with(
            PREDICTIONS + """,
c AS (
  SELECT campaign_id,
    sqrt(sum(impressions * pow(predicted_ctr_champion - actual_ctr, 2)) / sum(impressions)) AS candidate_rmse,
    sqrt(sum(impressions * pow(predicted_ctr_stale - actual_ctr, 2)) FILTER (WHERE is_drift_segment)
      / sum(impressions) FILTER (WHERE is_drift_segment)) AS incumbent_rmse
  FROM pred WHERE is_drift_window GROUP BY campaign_id),
g AS (SELECT *, incumbent_rmse * (1 - 5.0 / 100) AS bound FROM c)""",
            "SELECT campaign_id, round(candidate_rmse, 6) AS candidate_rmse, round(incumbent_rmse, 6) AS incumbent_rmse, "
            "coalesce(candidate_rmse <= bound, true) AS promoted, "
            "CASE WHEN bound IS NULL THEN 'No incumbent prediction metric exists' "
            "WHEN candidate_rmse <= bound THEN printf('Candidate RMSE %.5f met threshold %.5f', candidate_rmse, bound) "
            "ELSE printf('Candidate RMSE %.5f exceeded threshold %.5f', candidate_rmse, bound) END AS reason FROM g",
        ),
        "dq_rows": _with(
            SEGMENTS + ",\nc AS (SELECT count(*) AS n, count(*) FILTER (WHERE converted = 1 AND clicked <> 1) AS bad, "
            + ", ".join(f"count(*) FILTER (WHERE {k} IS NULL) AS null_{k}" for k in KEYS)
            + " FROM silver), o AS (SELECT count(*) FILTER (WHERE actual_ctr NOT BETWEEN 0 AND 0.15) AS bad FROM seg)",
            _check_rows(
                [("converted_implies_clicked", "bad", "bad = 0"),
                 ("row_count", "n", "n BETWEEN 9000 AND 11000"),
                 *[(f"no_null_{k}", f"null_{k}", f"null_{k} = 0") for k in KEYS]],
                "c",
            ) + " UNION ALL " + _check_rows([("actual_ctr_in_range", "bad", "bad = 0")], "o"),
        ),
        "dq_drift_weekly": _with(
            SEGMENTS,
            "SELECT event_week, "
            "round(sum(clicks) FILTER (WHERE is_drift_segment) / sum(impressions) FILTER (WHERE is_drift_segment), 6)"
            " AS cohort_ctr, round(sum(clicks) FILTER (WHERE NOT is_drift_segment) / "
            "sum(impressions) FILTER (WHERE NOT is_drift_segment), 6) AS other_ctr, "
            "round(sum(clicks) / sum(impressions), 6) AS blended_ctr FROM seg GROUP BY event_week",
        ),
        "dq_mix_and_waste": _with(
            ALL + WASTE + """,
m AS (
  SELECT sum(impressions) FILTER (WHERE channel IN ('Social', 'Display') AND NOT is_drift_window)
      / sum(impressions) FILTER (WHERE NOT is_drift_window) AS before,
    sum(impressions) FILTER (WHERE channel IN ('Social', 'Display') AND is_drift_window)
      / sum(impressions) FILTER (WHERE is_drift_window) AS after
  FROM camp),
t AS (SELECT sum(wasted) AS total FROM waste)""",
            _check_rows(
                [("mix_share_before", "before", "before IS NOT NULL"), ("mix_share_after", "after", "after > before")],
                "m",
            ) + " UNION ALL " + _check_rows([("wasted_spend_in_band", "total", "total BETWEEN 1000 AND 5000")], "t"),
        ),
        "dq_segments": _with(
            SEGMENTS + ", n AS (SELECT count(*) AS n FROM "
            "(SELECT DISTINCT channel, device, country, visitor_type, campaign_id FROM seg))",
            _check_rows([("segment_count", "n", "n BETWEEN 1 AND 432")], "n"),
        ),
        "dq_days_present": _with(
            SEGMENTS,
            "SELECT CAST(d.day AS DATE) AS event_date, CAST(coalesce(s.n, 0) AS BIGINT) AS impressions, "
            "s.n IS NOT NULL AS present FROM (SELECT unnest(generate_series(DATE '2024-01-01', "
            "DATE '2024-01-31', INTERVAL 1 DAY)) AS day) d "
            "LEFT JOIN (SELECT event_date, sum(impressions) AS n FROM seg GROUP BY event_date) s "
            "ON CAST(d.day AS DATE) = s.event_date",
        ),
        "dq_campaign_channel": _with(
            SILVER,
            "SELECT campaign_id, min(channel) AS first_channel, count(DISTINCT channel) = 1 AS passed "
            "FROM silver GROUP BY campaign_id",
        ),
        "dq_countries": _with(
            SILVER,
            "SELECT v.country, count(s.country) AS rows, count(s.country) > 0 AS passed "
            f"FROM (VALUES {expected}) v(country) LEFT JOIN silver s ON s.country = v.country GROUP BY v.country",
        ),
        "dq_gap": _with(
            PREDICTIONS + """,
g AS (
  SELECT sum(ctr_gap_stale * impressions) / sum(impressions) AS stale,
    sum(ctr_gap_champion * impressions) / sum(impressions) AS champion
  FROM pred WHERE is_drift_segment AND is_drift_window)""",
            _check_rows(
                [("stale_gap_positive", "stale", "stale > 0"), ("champion_gap_small", "champion", "abs(champion) <= 0.01")],
                "g",
            ),
        ),
        "dq_metric_coverage": _with(
            METRICS,
            "SELECT v.dimension_name, v.window_days, count(m.metric_date) AS rows, count(m.metric_date) > 0 AS passed "
            f"FROM (VALUES {pairs}) v(dimension_name, window_days) LEFT JOIN metrics m "
            "ON m.dimension_name = v.dimension_name AND m.window_days = v.window_days GROUP BY ALL",
        ),
    }
