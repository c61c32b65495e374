"""Feature frame, one-hot encoding and splits for the click-rate model."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, StringIndexer, StringIndexerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import dow_mon0
from ..operators.lookups import SMALL_TABLE_ROWS, is_small
from ..schemas import GRAIN
from ..session import materialize

# The columns that are one-hot encoded, and the named feature sets.
CATEGORICALS = ["channel", "device", "country", "visitor_type", "campaign_id", "objective"]
FEATURE_SETS = {
    "fs_a_core": ["channel", "device", "country", "visitor_type"],
    "fs_b_campaign": ["channel", "device", "country", "visitor_type", "campaign_id", "objective"],
    "fs_c_full": [
        "channel", "device", "country", "visitor_type", "campaign_id", "objective",
        "day_of_week", "impressions", "is_drift_window",
    ],
}

# Fixed value: how much more a row inside the drift window counts in training.
DRIFT_UPWEIGHT = 4.0


def feature_frame(segments: DataFrame) -> DataFrame:
    """Segment-days with the weekday (Monday = 0) and the drift flag as numbers."""
    return segments.select(
        *[F.to_date("event_date").alias(name) if name == "event_date" else F.col(name) for name in GRAIN],
        "campaign_name", "objective", "impressions", "spend_usd", "actual_ctr",
        dow_mon0("event_date").alias("day_of_week"),
        F.col("is_drift_window").cast("int").alias("is_drift_window"),
        "is_drift_segment",
    )


def training_weight() -> Column:
    """Impressions, counted several times inside the drift window."""
    factor = F.when(F.col("is_drift_window").cast("int") == 1, F.lit(DRIFT_UPWEIGHT)).otherwise(F.lit(1.0))
    return F.col("impressions") * factor


def split_bucket(folds: int = 5, keys: list[str] = GRAIN) -> Column:
    """Bucket 0..folds-1 from a digest of the key: the same on every run, partitioning and engine."""
    text = F.concat_ws("|", *[F.coalesce(F.col(key).cast("string"), F.lit("")) for key in keys])
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint"), F.lit(folds)).cast("int")


def with_split(frame: DataFrame, folds: int = 5) -> DataFrame:
    """Mark one bucket of ``folds`` as validation rows."""
    return frame.withColumn("is_validation", split_bucket(folds) == 0)


def fit_encoder(frame: DataFrame, feature_names: list[str]) -> PipelineModel:
    """Learn the category levels of a feature set; no level is dropped.

    A level that was not seen, or NULL, becomes all zeros: the encoder drops
    only the slot that the indexer keeps for unknown values.
    """
    categorical = [name for name in feature_names if name in CATEGORICALS]
    numeric = [name for name in feature_names if name not in CATEGORICALS]
    indexed = [f"{name}__index" for name in categorical]
    encoded = [f"{name}__hot" for name in categorical]
    stages = [
        StringIndexer(
            inputCols=categorical, outputCols=indexed, handleInvalid="keep", stringOrderType="alphabetAsc"
        ),
        OneHotEncoder(inputCols=indexed, outputCols=encoded, dropLast=True),
        VectorAssembler(inputCols=encoded + numeric, outputCol="features"),
    ]
    return Pipeline(stages=stages).fit(frame)


def slot_names(encoder: PipelineModel) -> list[str]:
    """Name of every slot of the feature vector: column_level, or the numeric column."""
    indexer = next(stage for stage in encoder.stages if isinstance(stage, StringIndexerModel))
    assembler = next(stage for stage in encoder.stages if isinstance(stage, VectorAssembler))
    categorical = indexer.getInputCols()
    hot = [f"{name}_{level}" for name, levels in zip(categorical, indexer.labelsArray) for level in levels]
    return hot + assembler.getInputCols()[len(categorical):]


def encode(frame: DataFrame, encoder: PipelineModel) -> DataFrame:
    """Add the feature vector and drop the encoder's intermediate columns."""
    encoded = encoder.transform(frame)
    return encoded.drop(*[name for name in encoded.columns if name.endswith(("__index", "__hot"))])


def one_hot_wide(frame: DataFrame, encoder: PipelineModel, keep: list[str] = GRAIN) -> DataFrame:
    """The encoded features as one double column per slot."""
    slots = vector_to_array("features")
    return encode(frame, encoder).select(
        *keep, *[slots[i].alias(name) for i, name in enumerate(slot_names(encoder))]
    )


def level_dictionary(frame: DataFrame, columns: list[str]) -> DataFrame:
    """``name``, ``level`` and ``index``: the levels of each column numbered from 0 in order, without the driver.

    The distinct levels are sorted by range over all tasks. The number of a level is its
    place in its task plus the number of levels of that column in the tasks before, of
    which there is one count for each task and column.
    """
    pair = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("level")) for c in columns]))
    levels = frame.select(pair.alias("pair")).select("pair.*").where(F.col("level").isNotNull()).distinct()
    parts = int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # The number of a row of a sorted task: the task in the upper bits, the row in the lower ones.
    numbered = materialize(
        levels.repartitionByRange(parts, "name", "level").sortWithinPartitions("name", "level")
        .withColumn("place", F.monotonically_increasing_id())
        .withColumn("task", F.shiftright("place", 33))
    )
    earlier = Window.partitionBy("name").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    starts = numbered.groupBy("name", "task").agg(F.count(F.lit(1)).alias("levels"), F.min("place").alias("first"))
    starts = starts.select("name", "task", "first", F.coalesce(F.sum("levels").over(earlier), F.lit(0)).alias("past"))
    return numbered.join(starts, ["name", "task"]).select(
        "name", "level", (F.col("past") + F.col("place") - F.col("first")).alias("index")
    )


def encode_by_dictionary(frame: DataFrame, dictionary: DataFrame, feature_names: list[str]) -> DataFrame:
    """Add the feature vector of ``encode``, sparse, from a (stored) dictionary of any number of levels.

    Only the number of levels of each column is known to the driver. A level that the
    dictionary lacks, or NULL, becomes all zeros.
    """
    categorical = [name for name in feature_names if name in CATEGORICALS]
    numeric = [name for name in feature_names if name not in CATEGORICALS]
    sizes = {row["name"]: row["count"] for row in dictionary.groupBy("name").count().collect()}
    small = is_small(dictionary, SMALL_TABLE_ROWS)
    for name in categorical:
        own = dictionary.where(F.col("name") == name).select(F.col("level").alias(f"{name}__level"), F.col("index").alias(f"{name}__id"))
        frame = frame.join(F.broadcast(own) if small else own, F.col(name).cast("string") == F.col(f"{name}__level"), "left")
        unknown = sizes.get(name, 0)
        index = F.coalesce(F.col(f"{name}__id"), F.lit(unknown)).cast("double")
        # The slot after the last level is for unknown ones; the encoder drops it.
        about = {"ml_attr": {"type": "nominal", "num_vals": unknown + 1}}
        frame = frame.withColumn(f"{name}__index", index.alias(f"{name}__index", metadata=about))
        frame = frame.withMetadata(f"{name}__index", about).drop(f"{name}__level", f"{name}__id")
    hot = OneHotEncoder(
        inputCols=[f"{c}__index" for c in categorical], outputCols=[f"{c}__hot" for c in categorical], dropLast=True
    )
    assembler = VectorAssembler(inputCols=[f"{c}__hot" for c in categorical] + numeric, outputCol="features")
    encoded = Pipeline(stages=[hot, assembler]).fit(frame).transform(frame)
    return encoded.drop(*[name for name in encoded.columns if name.endswith(("__index", "__hot"))])
