"""Reading and writing catalog tables with plain Spark."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_table(spark: SparkSession, name: str) -> DataFrame:
    """A table or view of the catalog."""
    return spark.table(name)


def literal_rows(spark: SparkSession, rows: list[tuple], ddl: str) -> DataFrame:
    """A small table written down in code, with a declared schema of plain columns.

    It goes in by Arrow, so the optimizer sees a local relation of known size.
    """
    schema = StructType.fromDDL(ddl)
    columns = {name: pa.array([row[i] for row in rows]) for i, name in enumerate(schema.names)}
    return spark.createDataFrame(pa.table(columns), schema)


def optional_table(spark: SparkSession, name: str) -> DataFrame | None:
    """The table, or None if there is none. Any other error is raised."""
    return spark.table(name) if spark.catalog.tableExists(name) else None


def create_database(spark: SparkSession, database: str, location: str | None = None) -> None:
    """Create the database unless it exists."""
    where = f" LOCATION '{location}'" if location else ""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}{where}")


def comment_table(spark: SparkSession, name: str, comment: str) -> None:
    """Set the comment of a table."""
    spark.sql(f"COMMENT ON TABLE {name} IS {_text(comment)}")


def comment_columns(spark: SparkSession, name: str, comments: dict[str, str]) -> None:
    """Set the comments of columns."""
    for column, comment in comments.items():
        spark.sql(f"ALTER TABLE {name} ALTER COLUMN {column} COMMENT {_text(comment)}")


def _text(value: str) -> str:
    escaped = value.replace("\\", "\\\\").replace("'", "\\'")
    return f"'{escaped}'"


def _counted(df: DataFrame) -> tuple[DataFrame, Observation]:
    seen = Observation()
    return df.observe(seen, F.count(F.lit(1)).alias("rows")), seen


def _write(df: DataFrame, name: str, mode: str, partition_by: list[str]) -> int:
    counted, seen = _counted(df)
    writer = counted.write.mode(mode).format("parquet")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.saveAsTable(name)
    return seen.get["rows"]


def overwrite_table(df: DataFrame, name: str, comment: str | None = None, partition_by: list[str] = ()) -> int:
    """Replace a table and its schema; returns the rows written, counted while writing.

    The table must not be an input of ``df``; use ``replace_table`` for that.
    """
    rows = _write(df, name, "overwrite", list(partition_by))
    if comment:
        comment_table(df.sparkSession, name, comment)
    return rows


def append_table(df: DataFrame, name: str) -> int:
    """Append rows by column name. New columns are added to the table, missing ones become NULL."""
    spark = df.sparkSession
    if not spark.catalog.tableExists(name):
        return _write(df, name, "append", [])
    existing = spark.table(name).schema
    known = set(existing.names)
    added = [field for field in df.schema.fields if field.name not in known]
    if added:
        columns = ", ".join(f"`{field.name}` {field.dataType.simpleString()}" for field in added)
        spark.sql(f"ALTER TABLE {name} ADD COLUMNS ({columns})")
    target = spark.table(name).schema
    offered = set(df.columns)
    aligned = df.select(
        *[
            (F.col(f"`{f.name}`") if f.name in offered else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in target.fields
        ]
    )
    return _write(aligned, name, "append", [])


def _versions(spark: SparkSession, name: str) -> list[int]:
    *database, table = name.split(".")
    scope = f" IN {'.'.join(database)}" if database else ""
    listed = spark.sql(f"SHOW TABLES{scope} LIKE '{table}__v*'").collect()
    matches = (re.fullmatch(rf"{re.escape(table.lower())}__v(\d+)", row["tableName"].lower()) for row in listed)
    return sorted(int(match.group(1)) for match in matches if match)


def current_version(spark: SparkSession, name: str) -> str | None:
    """Name of the table behind a view that ``replace_table`` keeps; None without one."""
    versions = _versions(spark, name)
    return f"{name}__v{versions[-1]}" if versions and spark.catalog.tableExists(name) else None


def replace_table(
    df: DataFrame, name: str, comment: str = "", partition_by: list[str] = (), keep: int = 2
) -> int:
    """Write a new version beside the old one, then switch the view ``name`` to it.

    ``df`` may read the current version. A failed write leaves readers on the
    old version; the newest ``keep`` versions stay for readers under way.
    Returns the rows written.
    """
    spark = df.sparkSession
    versions = _versions(spark, name)
    fresh = f"{name}__v{(versions[-1] if versions else 0) + 1}"
    rows = _write(df, fresh, "errorifexists", list(partition_by))
    spark.sql(f"CREATE OR REPLACE VIEW {name} COMMENT {_text(comment)} AS SELECT * FROM {fresh}")
    for old in versions[: max(len(versions) - keep + 1, 0)]:
        spark.sql(f"DROP TABLE IF EXISTS {name}__v{old}")
    return rows
