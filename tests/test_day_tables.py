"""Refresh by day: one day changed, failed writes, writers at a time, and equality with a full rebuild."""

from __future__ import annotations

import uuid
from datetime import date

import pytest
from pyspark.sql import functions as F

from adperf.operators.layers import campaign_daily, segment_ctr_daily, silver_impressions
from adperf.plans import lifecycle
from adperf.sources import day_tables, events

DAYS = [date(2024, 1, d) for d in (1, 2, 3)]
SCHEMA = "event_date date, x long"


@pytest.fixture
def root(spark):
    return f"{spark.sparkContext.getCheckpointDir()}/day-table-{uuid.uuid4().hex}"


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def table(spark, *values):
    return spark.createDataFrame(list(values), SCHEMA)


def test_changing_one_day_leaves_the_files_of_the_others(spark, root):
    assert day_tables.replace_days(table(spark, *[(d, k) for k, d in enumerate(DAYS)]), root) == 1
    first = day_tables.manifest(spark, root)
    assert day_tables.replace_days(table(spark, (DAYS[1], 7), (DAYS[1], 8)), root) == 2
    second = day_tables.manifest(spark, root)
    changed = {d for d in second["days"] if second["days"][d] != first["days"][d]}
    assert changed == {"2024-01-02"}
    assert rows(day_tables.read_days(spark, root)) == sorted([(DAYS[0], 0), (DAYS[1], 7), (DAYS[1], 8), (DAYS[2], 2)], key=repr)
    assert rows(day_tables.read_days(spark, root, version=1)) == sorted([(d, k) for k, d in enumerate(DAYS)], key=repr)


def test_only_wanted_days_are_read(spark, root):
    day_tables.replace_days(table(spark, *[(d, k) for k, d in enumerate(DAYS)]), root)
    some = day_tables.read_days(spark, root, [DAYS[2], date(2030, 1, 1)])
    assert rows(some) == [(DAYS[2], 2)]
    assert all("2024-01-03" in name for name in some.inputFiles()) and some.inputFiles()
    assert day_tables.read_days(spark, root, []).collect() == []


def test_a_day_can_lose_all_rows_and_strange_rows_are_refused(spark, root):
    day_tables.replace_days(table(spark, *[(d, k) for k, d in enumerate(DAYS)]), root)
    day_tables.replace_days(table(spark), root, [DAYS[0]])
    assert rows(day_tables.read_days(spark, root)) == sorted([(DAYS[1], 1), (DAYS[2], 2)], key=repr)
    with pytest.raises(ValueError, match="other days"):
        day_tables.replace_days(table(spark, (DAYS[1], 1)), root, [DAYS[2]])
    with pytest.raises(ValueError, match="other days"):
        day_tables.replace_days(table(spark, (None, 1)), root)
    assert day_tables.manifest(spark, root)["version"] == 2


def test_a_failed_write_leaves_the_old_version(spark, root, monkeypatch):
    day_tables.replace_days(table(spark, (DAYS[0], 1)), root)
    monkeypatch.setattr(day_tables, "create_once", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError, match="lost"):
        day_tables.replace_days(table(spark, (DAYS[0], 2)), root)
    monkeypatch.undo()
    broken = table(spark, (DAYS[0], 3)).withColumn("x", F.raise_error(F.lit("boom")).cast("long"))
    with pytest.raises(Exception, match="boom"):
        day_tables.replace_days(broken, root)
    assert rows(day_tables.read_days(spark, root)) == [(DAYS[0], 1)]


def test_writers_at_a_time(spark, root, monkeypatch):
    """Another writer commits between the write and the manifest: other days are kept, the same day is refused."""
    day_tables.replace_days(table(spark, *[(d, 0) for d in DAYS]), root)
    real = day_tables._written_days

    def meanwhile(day):
        def other(spark, path):
            monkeypatch.setattr(day_tables, "_written_days", real)
            day_tables.replace_days(table(spark, (day, 5)), root)
            return real(spark, path)

        monkeypatch.setattr(day_tables, "_written_days", other)

    meanwhile(DAYS[2])
    day_tables.replace_days(table(spark, (DAYS[0], 9)), root)
    assert rows(day_tables.read_days(spark, root)) == sorted([(DAYS[0], 9), (DAYS[1], 0), (DAYS[2], 5)], key=repr)
    meanwhile(DAYS[1])
    with pytest.raises(day_tables.ConcurrentRefresh, match="2024-01-02"):
        day_tables.replace_days(table(spark, (DAYS[1], 9)), root)
    assert (DAYS[1], 5) in rows(day_tables.read_days(spark, root))


def test_no_version_yet(spark, root):
    assert day_tables.manifest(spark, root)["version"] == 0
    with pytest.raises(ValueError, match="no version"):
        day_tables.read_days(spark, root)


def test_refresh_of_one_day_equals_a_full_rebuild(spark, sf_dir, root):
    raw = events.impressions(spark, sf_dir).cache()
    drift = (events.DRIFT_START, events.DRIFT_CAMPAIGNS)
    days = [r[0] for r in raw.select("event_date").distinct().collect()]
    lifecycle.refresh_days(spark, raw, root, days, *drift)
    before = day_tables.manifest(spark, f"{root}/{lifecycle.SEGMENTS}")["days"]
    late = raw.where((F.col("event_date") != days[0]) | (F.col("device") == "Mobile"))
    versions = lifecycle.refresh_days(spark, late, root, [days[0]], *drift)
    assert set(versions.values()) == {2}
    after = day_tables.manifest(spark, f"{root}/{lifecycle.SEGMENTS}")["days"]
    assert [d for d in after if after[d] != before[d]] == [days[0].isoformat()]
    silver = silver_impressions(late, *drift)
    for name, full in ((lifecycle.SILVER, silver), (lifecycle.SEGMENTS, segment_ctr_daily(silver)), (lifecycle.CAMPAIGNS, campaign_daily(silver))):
        stored = day_tables.read_days(spark, f"{root}/{name}")
        def digits(df):
            kept = [F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]
            return rows(df.select(*kept))
        assert digits(stored) == digits(full), name
