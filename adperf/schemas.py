"""Column lists of the tables the library reads and writes, as DDL."""

# Table schemas.
RAW_CAMPAIGNS = (
    "campaign_id string, campaign_name string, channel string, objective string, "
    "base_bid_usd double, launch_date string"
)
RAW_IMPRESSIONS = (
    "impression_id string, event_ts timestamp, event_date date, campaign_id string, channel string, "
    "campaign_name string, device string, country string, visitor_type string, objective string, "
    "hour_of_day int, day_of_week int, clicked int, converted int, cost_usd double, "
    "conversion_value_usd double"
)

# The grain of a segment-day row.
GRAIN = ["event_date", "channel", "device", "country", "visitor_type", "campaign_id"]
SEGMENT = ["channel", "device", "country", "visitor_type", "campaign_id"]
DIMENSIONS = ["channel", "device", "country", "visitor_type", "campaign_name", "objective"]
