"""Tables that are refreshed day by day, behind a manifest.

A manifest is a numbered file that lists one folder for each day. A refresh writes
the changed days to folders of their own and then creates the next manifest; until
that moment, and if it never comes, readers see the version before. Nothing that a
manifest names is ever overwritten. Two refreshes at a time both succeed if they
change different days; the later one of the same day is refused.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .commits import ATTEMPTS, create_once, numbers, read_json

#: Name of the folder level that parts the days; the day itself stays a column of the files.
PART = "__day"


class ConcurrentRefresh(RuntimeError):
    """Another writer replaced one of the same days in the meantime."""


def manifest(spark: SparkSession, root: str, version: int | None = None) -> dict:
    """Version, schema and folder by day of the newest (or the given) version; version 0 has no days."""
    taken = numbers(spark, f"{root}/manifests")
    if version is None:
        version = taken[-1] if taken else 0
    if version == 0:
        return {"version": 0, "schema": None, "days": {}}
    found = read_json(spark, f"{root}/manifests/{version:010d}.json")
    if found is None:
        raise ValueError(f"{root} has no version {version}")
    return found


def _written_days(spark: SparkSession, path: str) -> set[str]:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    names = [status.getPath().getName() for status in hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(hadoop)]
    return {name.removeprefix(f"{PART}=") for name in names if name.startswith(f"{PART}=")}


def replace_days(df: DataFrame, root: str, days: Iterable[date] | None = None, day: str = "event_date") -> int:
    """Put the rows of ``df`` in place of their days and return the new version.

    ``days`` are the days that are replaced, also those that have no rows any more;
    without them, the days that ``df`` has. Rows without a day are refused.
    """
    spark = df.sparkSession
    before = manifest(spark, root)
    folder = f"{root}/data/{uuid.uuid4().hex}"
    df.withColumn(PART, F.coalesce(F.col(day).cast("date").cast("string"), F.lit("none"))).write.partitionBy(PART).parquet(folder)
    written = _written_days(spark, folder)
    changed = written if days is None else {d.isoformat() for d in days}
    if not written <= changed or "none" in written:
        raise ValueError(f"rows of other days: {sorted(written - changed | written & {'none'})}")
    for _ in range(ATTEMPTS):
        base = manifest(spark, root)
        clash = [d for d in changed if base["days"].get(d) != before["days"].get(d)]
        if clash:
            raise ConcurrentRefresh(f"{root}: {', '.join(sorted(clash))}")
        kept = {d: path for d, path in base["days"].items() if d not in changed}
        fresh = {
            "version": base["version"] + 1,
            "schema": df.schema.jsonValue(),
            "days": kept | {d: f"{folder}/{PART}={d}" for d in written},
        }
        if create_once(spark, f"{root}/manifests/{fresh['version']:010d}.json", fresh):
            return fresh["version"]
    raise ConcurrentRefresh(root)


def read_days(spark: SparkSession, root: str, days: Iterable[date] | None = None, version: int | None = None) -> DataFrame:
    """The table, or only some of its days; files of other days are not even listed."""
    found = manifest(spark, root, version)
    if found["schema"] is None:
        raise ValueError(f"{root} has no version yet")
    schema = StructType.fromJson(found["schema"])
    wanted = found["days"] if days is None else {d.isoformat() for d in days} & set(found["days"])
    paths = [found["days"][d] for d in sorted(wanted)]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)
