"""Join of a fact to a keyed table, by the keyed table's counted size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize

# Up to this many rows, and bytes as JSON text, a keyed table counts as small.
SMALL_TABLE_ROWS = 100_000
SMALL_TABLE_BYTES = 16 << 20


def is_small(df: DataFrame, rows: int, most_bytes: int = SMALL_TABLE_BYTES) -> bool:
    """Whether ``df`` is within both bounds; one aggregate, of which each partition hands on one row."""
    width = F.octet_length(F.to_json(F.struct("*")))
    n, size = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(width), F.lit(0))).first()
    return n <= rows and size <= most_bytes


#: Keys that the sketch of the fact keeps count of, and hot keys that are split at most.
TRACKED_KEYS, HOT_KEYS = 10_000, 1_000
#: Tasks of the average size that a split of a hot key fills.
SPLIT_SIZE = 0.5


def hot_keys(fact: DataFrame, key: str, parts: int, split_size: float = SPLIT_SIZE) -> DataFrame:
    """``key`` and ``splits``: over how many tasks each key is spread that holds more than a task's share of the fact.

    Counts come from Spark's mergeable sketch of frequent items: each partition hands
    on one sketch of bounded size, so this is one small aggregate, whatever the number
    of keys. A key with the share s of all rows gets s x parts / split_size splits.
    """
    counted = fact.where(F.col(key).isNotNull()).agg(
        F.expr(f"approx_top_k(`{key}`, {HOT_KEYS}, {TRACKED_KEYS})").alias("top"), F.count(F.lit(1)).alias("rows")
    )
    item = counted.select(F.explode("top").alias("top"), "rows").select(F.col("top.item").alias(key), "top.count", "rows")
    splits = F.ceil(F.col("count") * parts / (F.col("rows") * split_size)).cast("int")
    return item.select(key, splits.alias("splits")).where(F.col("splits") > 1)


def salt(spread: list[str], salts: Column | int) -> Column:
    """A number below ``salts`` from the row's own columns, so a task that runs again gives the same one."""
    return F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int")


def lookup_join(
    fact: DataFrame,
    lookup: DataFrame,
    key: str,
    spread: list[str],
    small_rows: int | None = None,
    parts: int | None = None,
) -> DataFrame:
    """Inner join with a table that has one row per key, best a stored one as it is measured first.

    A small table is broadcast and the fact stays where it is. Otherwise both sides
    are shuffled on (key, salt). Keys that hold more of the fact than a task should are
    spread by their measured share: their rows get one of so many salts, and their row
    of the table is repeated as often. All other keys have one salt, and nothing of
    theirs is repeated. ``spread`` names fact columns that differ between the rows of
    a key; ``parts`` is the number of tasks, as the session has it by default.
    """
    spark = fact.sparkSession
    if is_small(lookup, SMALL_TABLE_ROWS if small_rows is None else small_rows):
        return fact.join(F.broadcast(lookup), key, "inner")
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # A table of at most HOT_KEYS rows that is written once, as both sides have to see the same numbers.
    hot = F.broadcast(materialize(hot_keys(fact, key, parts)))
    splits = F.coalesce("splits", F.lit(1))
    salted = fact.join(hot, key, "left").withColumn("__salt", salt(spread, splits)).drop("splits")
    repeated = (
        lookup.join(hot, key, "left")
        .withColumn("__salt", F.explode(F.sequence(F.lit(0), splits - 1)))
        .drop("splits")
    )
    return salted.join(repeated, [key, "__salt"], "inner").drop("__salt")
