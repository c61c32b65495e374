"""Model versions, tags and aliases as logs that several jobs may write at a time."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.decisions import as_utc
from ..sources.commits import log_row

VERSION_SCHEMA = "model_name string, version int, run_id string, artifact string, created_at timestamp"
TAG_SCHEMA = "model_name string, version int, tag string, value string, set_at timestamp"
ALIAS_SCHEMA = "model_name string, alias string, version int, set_at timestamp"


def register_version(
    spark: SparkSession, database: str, model_name: str, run_id: str, artifact: str, now: datetime
) -> int:
    """Add the next version of a model and return its number; no two callers get the same one."""
    return log_row(
        spark, database, "model_versions", VERSION_SCHEMA, model_name,
        lambda version: {
            "model_name": model_name, "version": version, "run_id": run_id, "artifact": artifact,
            "created_at": as_utc(now).isoformat(),
        },
    )


def tag_version(
    spark: SparkSession, database: str, model_name: str, version: int, tags: dict[str, str], now: datetime
) -> None:
    """Add tags of a version."""
    for tag, value in tags.items():
        row = {"model_name": model_name, "version": version, "tag": tag, "value": value, "set_at": as_utc(now).isoformat()}
        log_row(spark, database, "model_version_tags", TAG_SCHEMA, model_name, lambda _, row=row: row)


def set_alias(
    spark: SparkSession, database: str, model_name: str, alias: str, version: int, now: datetime
) -> None:
    """Point an alias to a version."""
    row = {"model_name": model_name, "alias": alias, "version": version, "set_at": as_utc(now).isoformat()}
    log_row(spark, database, "model_aliases", ALIAS_SCHEMA, model_name, lambda _: row)


def current_aliases(aliases: DataFrame) -> DataFrame:
    """The version each alias points to now."""
    return aliases.groupBy("model_name", "alias").agg(
        F.max_by("version", F.struct("set_at", "version")).alias("version")
    )
