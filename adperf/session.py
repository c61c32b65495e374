"""Session defaults and the one place that decides where checkpoints live."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Splits a hot key of a sort-merge join over several tasks, even where
    # that costs one more shuffle above the join.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}

# Partition sizes for a cluster: start wide, and let adaptive execution merge
# small partitions up to the advisory size instead of keeping every core busy.
CLUSTER = {
    "spark.sql.files.maxPartitionBytes": "256m",
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "8000",
    "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
}


def build_session(app: str = "adperf", master: str | None = None, conf: dict | None = None) -> SparkSession:
    """Session with the library's defaults, and cluster sizes unless local; ``conf`` wins over both."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    sizes = {} if (master or "").startswith("local") else CLUSTER
    for key, value in {**DEFAULTS, **sizes, **(conf or {})}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def split_hot_keys(spark: SparkSession) -> None:
    """Let joins split a hot key in a session that somebody else made, too."""
    for key in ("spark.sql.adaptive.skewJoin.enabled", "spark.sql.adaptive.forceOptimizeSkewedJoin"):
        spark.conf.set(key, DEFAULTS[key])


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder: what the session names, else a scratch folder in local mode."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
        configured = tempfile.mkdtemp(prefix="adperf-checkpoint-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


#: While a table is stored, its shuffle files are deleted as soon as it is there.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and read it from there afterwards.

    Files keep columns apart and carry their size, so later reads prune columns
    and the planner knows whether the table can be broadcast. ``discard`` deletes
    the table when nothing reads it any more.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)
    stored = spark.read.schema(df.schema).parquet(path)
    stored.stored_at = path
    return stored


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``materialize`` stored; no result that is still to be computed may need them."""
    for table in tables:
        spark = table.sparkSession
        folder = spark._jvm.org.apache.hadoop.fs.Path(table.stored_at)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
