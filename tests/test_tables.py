"""Sources and sinks over catalog tables."""

from __future__ import annotations

from datetime import date

import pytest
from pyspark.sql import functions as F

from adperf.session import materialize
from adperf.sources import tables
from adperf.sources.calendar import calendar_spine


@pytest.fixture(scope="module")
def db(spark):
    tables.create_database(spark, "sinks")
    tables.create_database(spark, "sinks")
    return "sinks"


def test_literal_rows_have_the_declared_schema(spark):
    df = tables.literal_rows(spark, [("a", 1, None, True), ("b", 2, 0.5, False)], "s string, i int, x double, b boolean")
    assert [f.dataType.simpleString() for f in df.schema.fields] == ["string", "int", "double", "boolean"]
    assert sorted(tuple(r) for r in df.collect()) == [("a", 1, None, True), ("b", 2, 0.5, False)]
    assert "LocalRelation" in df._jdf.queryExecution().optimizedPlan().toString()


def test_overwrite_replaces_rows_and_schema_and_counts(spark, db):
    name = f"{db}.plain"
    assert tables.overwrite_table(spark.range(10), name, "it's a comment") == 10
    assert tables.overwrite_table(spark.range(3).withColumn("x", F.lit("y")), name, "second") == 3
    assert tables.read_table(spark, name).columns == ["id", "x"]
    described = {r["col_name"]: r["data_type"] for r in spark.sql(f"DESCRIBE TABLE EXTENDED {name}").collect()}
    assert described["Comment"] == "second"


def test_comments(spark, db):
    name = f"{db}.commented"
    tables.overwrite_table(spark.range(1), name, "it's \\ quoted")
    tables.comment_columns(spark, name, {"id": "the 'key'"})
    rows = spark.sql(f"DESCRIBE TABLE EXTENDED {name}").collect()
    assert any(r["col_name"] == "id" and r["comment"] == "the 'key'" for r in rows)
    assert any(r["data_type"] == "it's \\ quoted" for r in rows)


def test_partitioned_table_is_pruned(spark, db):
    name = f"{db}.by_day"
    df = spark.range(6).withColumn("day", F.date_add(F.lit(date(2024, 1, 1)), (F.col("id") % 3).cast("int")))
    tables.overwrite_table(df, name, partition_by=["day"])
    kept = spark.table(name).where(F.col("day") == F.lit(date(2024, 1, 2)))
    assert kept.count() == 2
    assert "PartitionFilters: [isnotnull(day" in kept._jdf.queryExecution().executedPlan().toString()


def test_append_adds_columns_and_fills_missing_ones(spark, db):
    name = f"{db}.log"
    assert tables.append_table(spark.sql("SELECT 1 AS a, 'x' AS b"), name) == 1
    assert tables.append_table(spark.sql("SELECT 2 AS a, CAST(1.5 AS DOUBLE) AS c"), name) == 1
    assert tables.append_table(spark.sql("SELECT 'y' AS b, 3 AS a"), name) == 1
    got = sorted(tuple(r) for r in spark.table(name).select("a", "b", "c").collect())
    assert got == [(1, "x", None), (2, None, 1.5), (3, "y", None)]


def test_replace_may_read_what_it_replaces(spark, db):
    name = f"{db}.state"
    assert tables.replace_table(spark.range(3), name, "numbers") == 3
    for expected in (6, 12, 24):
        assert tables.replace_table(spark.table(name).union(spark.table(name)), name) == expected
        assert spark.table(name).count() == expected
    kept = spark.sql(f"SHOW TABLES IN {db} LIKE 'state__v*'").collect()
    assert sorted(r["tableName"] for r in kept) == ["state__v3", "state__v4"]


def test_failed_replace_leaves_the_old_version(spark, db):
    name = f"{db}.guarded"
    tables.replace_table(spark.range(3), name)
    bad = spark.range(3).select(F.raise_error(F.lit("no")).cast("bigint").alias("id"))
    with pytest.raises(Exception):
        tables.replace_table(bad, name)
    assert spark.table(name).count() == 3


def test_optional_table(spark, db):
    assert tables.optional_table(spark, f"{db}.nothing_here") is None
    tables.overwrite_table(spark.range(2), f"{db}.something")
    assert tables.optional_table(spark, f"{db}.something").count() == 2


def test_calendar_spine(spark):
    df = spark.createDataFrame([(date(2024, 2, 27),), (date(2024, 3, 2),)], "event_date date")
    assert [r[0].day for r in calendar_spine(df).orderBy("event_date").collect()] == [27, 28, 29, 1, 2]


def test_materialize_keeps_schema_and_rows(spark):
    df = spark.range(5).withColumn("x", F.lit(None).cast("double"))
    stored = materialize(df)
    assert stored.schema.simpleString() == df.schema.simpleString()
    assert stored.count() == 5
    folder = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    assert all(folder in path for path in stored.inputFiles())
