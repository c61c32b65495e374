"""Boosted trees from collapsed rows.

Rows with the same feature vector get the same prediction in every round, so a
squared-error fit needs only their summed weight and weighted target. Spark reduces
the fact to one row for each distinct vector (numbers in up to ``BINS`` quantile
bins) and sampling bucket; what is left grows with the levels of the features, not
with the impressions. Each model is then grown in a task of its own from these
cells, many models side by side. Tables of more than ``MOST_CELLS`` cells are not
held in a task: those are fitted by the trees of Spark ML over the collapsed rows.

The result is a model of Spark ML in either case, so scoring, storing and
importances are the library's own. Leaves are shrunk by ``LAMBDA``, children have a
weight of ``LEAST_WEIGHT`` or more. Rows are sampled by ``BUCKETS`` buckets of a
digest of their key, for each tree anew; columns are sampled for each tree.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Iterable
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.ml.feature import StringIndexerModel, VectorAssembler
from pyspark.ml.regression import GBTRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir, discard, materialize
from .features import slot_names, split_bucket

BINS, BUCKETS = 32, 20
MOST_CELLS = 500_000
LAMBDA, LEAST_WEIGHT = 1.0, 1.0
#: A split has to lower the squared error by this share of all of it.
LEAST_GAIN = 1e-12

NODES = (
    "job string, tree int, id int, value double, weight double, total double, squares double, impurity double, gain double, "
    "left int, right int, feature int, threshold double"
)


@dataclass(frozen=True)
class Job:
    """One model to fit: rows that are encoded by ``encoder``, the weight column, the parameters."""

    name: str
    encoder: PipelineModel
    params: dict
    weight: str
    seed: int


def _columns(encoder: PipelineModel) -> tuple[StringIndexerModel, list[str]]:
    indexer = next(stage for stage in encoder.stages if isinstance(stage, StringIndexerModel))
    assembler = next(stage for stage in encoder.stages if isinstance(stage, VectorAssembler))
    return indexer, assembler.getInputCols()[len(indexer.getInputCols()):]


def thresholds(frame: DataFrame, numeric: list[str]) -> dict[str, list[float]]:
    """Upper bounds of the bins of each numeric feature: halfway between neighbours among its approximate quantiles."""
    if not numeric:
        return {}
    marks = frame.select(*[F.col(c).cast("double").alias(c) for c in numeric]).approxQuantile(
        numeric, [k / BINS for k in range(BINS + 1)], 1 / (20 * BINS)
    )
    found = {}
    for name, values in zip(numeric, marks):
        distinct = sorted(set(values))
        found[name] = [(a + b) / 2 for a, b in zip(distinct, distinct[1:])]
    return found


def _below(name: str):
    return lambda bound: F.col(name) > bound


def cells(frame: DataFrame, encoder: PipelineModel, weight: str, bounds: dict[str, list[float]]) -> DataFrame:
    """``code`` (level or bin of each feature), ``bucket``, and the sums of weight, weight x target, weight x target squared."""
    indexer, numeric = _columns(encoder)
    levels = [F.col(c).cast("int") for c in indexer.getOutputCols()]
    bins = [
        F.size(F.filter(F.array(*[F.lit(b) for b in bounds[name]]), _below(name))) if bounds[name] else F.lit(0)
        for name in numeric
    ]
    w, y = F.col(weight).cast("double"), F.col("actual_ctr").cast("double")
    return (
        indexer.transform(frame)
        .where(w > 0)
        .groupBy(F.array(*levels, *bins).alias("code"), F.floor(split_bucket(5 * BUCKETS) / 5).cast("int").alias("bucket"))
        .agg(F.sum(w).alias("w"), F.sum(w * y).alias("wy"), F.sum(w * y * y).alias("wyy"))
    )


class _Features:
    """The candidate splits: a level against the rest, or a number up to a threshold."""

    def __init__(self, sizes: list[int], bounds: list[list[float]]):
        self.sizes, self.bounds = sizes, bounds
        self.slot = np.concatenate([
            np.arange(sum(sizes)), *[np.full(len(b), sum(sizes) + k) for k, b in enumerate(bounds)]
        ]).astype(int)
        self.threshold = np.concatenate([np.full(sum(sizes), 0.5), *bounds])
        self.slots = sum(sizes) + len(bounds)
        spans = [*sizes, *[len(b) for b in bounds]]
        self.feature = np.repeat(np.arange(len(spans)), spans)
        self.place = np.concatenate([np.arange(span) for span in spans]).astype(int)

    def columns(self, codes: np.ndarray) -> list[np.ndarray]:
        """The codes feature by feature, each in one piece of memory; unknown levels share the place after the last."""
        spans = [*self.sizes, *[len(b) for b in self.bounds]]
        return [np.minimum(codes[:, k], size) for k, size in enumerate(spans)]

    def right_sums(self, columns: list[np.ndarray], node: np.ndarray, nodes: int, *values: np.ndarray) -> list[np.ndarray]:
        """Sums of each of ``values`` that would go right, for every node and candidate."""
        out = [[] for _ in values]
        for k, size in enumerate([*self.sizes, *[len(b) for b in self.bounds]]):
            place = node * (size + 1) + columns[k]
            for found, value in zip(out, values):
                table = np.bincount(place, value, nodes * (size + 1)).reshape(nodes, size + 1)
                if k < len(self.sizes):
                    found.append(table[:, :size])
                else:  # beyond the threshold: all later bins
                    found.append(np.cumsum(table[:, ::-1], axis=1)[:, ::-1][:, 1:])
        return [np.concatenate(found, axis=1) for found in out]

    def goes_right(self, codes: np.ndarray, rows: np.ndarray, candidate: np.ndarray) -> np.ndarray:
        """Whether each of ``rows`` goes right at its own candidate."""
        feature, at = self.feature[candidate], self.place[candidate]
        code = codes[rows, feature]
        return np.where(feature < len(self.sizes), code == at, code > at)


def grow(codes: np.ndarray, w: np.ndarray, wy: np.ndarray, wyy: np.ndarray, features: _Features, params: dict, seed: int):
    """The nodes of all trees; ``w`` and the others by cell and bucket. Tree 0 is the mean, later ones fit what is left."""
    rng = np.random.default_rng(seed)
    rate, depth = float(params["learning_rate"]), int(params["max_depth"])
    take = max(1, round(float(params.get("subsample", 1.0)) * BUCKETS))
    keep = max(1, math.ceil(float(params.get("colsample_bytree", 1.0)) * features.slots))
    mean = wy.sum() / w.sum()
    guess = np.full(len(codes), mean)
    least = LEAST_GAIN * max(wyy.sum() - mean * wy.sum(), 0.0)
    trees = [[(0, 0, mean, w.sum(), wy.sum(), wyy.sum(), 0.0, -1.0, -1, -1, -1, 0.0)]]
    all_w, all_wy, all_wyy = w.sum(1), wy.sum(1), wyy.sum(1)
    columns = features.columns(codes)
    for tree in range(1, int(params["n_estimators"]) + 1):
        if take < BUCKETS:
            chosen = rng.permutation(BUCKETS)[:take]
            tw, ty, tyy = w[:, chosen].sum(1), wy[:, chosen].sum(1), wyy[:, chosen].sum(1)
        else:
            tw, ty, tyy = all_w, all_wy, all_wyy
        allowed = np.ones(features.slots, bool)
        if keep < features.slots:
            allowed[rng.permutation(features.slots)[keep:]] = False
        open_candidates = allowed[features.slot]
        g = ty - tw * guess
        squares = tyy - 2 * guess * ty + guess * guess * tw
        node = np.zeros(len(codes), np.int64)  # id of each cell's node
        records: dict[int, list] = {}
        first, count = 0, 1
        for level in range(depth + 1):
            local = node - first
            live = local >= 0
            at = local[live]
            sums = [np.bincount(at, x[live], count) for x in (tw, g, squares)]
            weight, total, square = sums
            safe = np.maximum(weight, 1e-300)
            impurity = np.maximum(square / safe - (total / safe) ** 2, 0.0)
            value = total / (weight + LAMBDA)
            best = np.full(count, -1)
            gain = np.full(count, -1.0)
            if level < depth and open_candidates.any():
                own = columns if live.all() else [column[live] for column in columns]
                right_w, right_g = features.right_sums(own, at, count, tw[live], g[live])
                left_w, left_g = weight[:, None] - right_w, total[:, None] - right_g
                score = left_g**2 / (left_w + LAMBDA) + right_g**2 / (right_w + LAMBDA) - (total**2 / (weight + LAMBDA))[:, None]
                score[(np.minimum(left_w, right_w) < LEAST_WEIGHT) | ~open_candidates[None, :]] = -np.inf
                top = score.max(1)
                # of splits that are as good but for rounding (a level and its complement), the first
                slack = 1e-9 * np.abs(top) + 1e-12 * square
                best = (score >= (top - slack)[:, None]).argmax(1)
                best[~(top > least)] = -1
                gain = np.where(best >= 0, top / safe, -1.0)
            split = best >= 0
            children = first + count + 2 * (np.cumsum(split) - 1)
            for k in range(count):
                j = best[k]
                records[first + k] = [
                    tree, first + k, value[k], weight[k], total[k], square[k], impurity[k], gain[k],
                    int(children[k]) if j >= 0 else -1, int(children[k]) + 1 if j >= 0 else -1,
                    int(features.slot[j]) if j >= 0 else -1, float(features.threshold[j]) if j >= 0 else 0.0,
                ]
            if not split.any():
                break
            moving = np.flatnonzero(live)[split[at]]
            here = node[moving] - first
            node[moving] = children[here] + features.goes_right(codes, moving, best[here])
            first, count = first + count, 2 * int(split.sum())
        values = np.array([records[k][2] for k in range(len(records))])
        guess = guess + rate * values[node]
        trees.append([tuple(records[k]) for k in range(len(records))])
    return [node for tree in trees for node in tree]


def _fit(job: str, table: pd.DataFrame, features: _Features, params: dict, seed: int) -> pd.DataFrame:
    codes = np.stack(table["code"].to_numpy()).astype(np.int64)
    distinct, cell = np.unique(codes, axis=0, return_inverse=True)
    sums = []
    for name in ("w", "wy", "wyy"):
        by_bucket = np.zeros((len(distinct), BUCKETS))
        np.add.at(by_bucket, (cell.ravel(), table["bucket"].to_numpy()), table[name].to_numpy())
        sums.append(by_bucket)
    names = [field.split()[0] for field in NODES.split(", ")]
    nodes = pd.DataFrame(grow(distinct, *sums, features, params, seed), columns=names[1:])
    nodes.insert(0, "job", job)
    return nodes


def fit_models(frame: DataFrame, jobs: Iterable[Job]) -> dict[str, GBTRegressionModel | None]:
    """Fit all jobs on ``frame`` side by side, a Spark job each; None for those whose cells are too many for a task.

    In one Spark job the few small groups would be merged into one task and grown one after another.
    """
    jobs, parts, shapes, numeric_bounds = list(jobs), [], {}, {}
    for job in jobs:
        indexer, numeric = _columns(job.encoder)
        missing = tuple(c for c in numeric if c not in numeric_bounds)
        numeric_bounds |= thresholds(frame, list(missing))
        bounds = {c: numeric_bounds[c] for c in numeric}
        shapes[job.name] = ([len(labels) for labels in indexer.labelsArray], [bounds[c] for c in numeric], job.params, job.seed)
        parts.append(cells(frame, job.encoder, job.weight, bounds).withColumn("job", F.lit(job.name)))
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    stored = materialize(every)
    counts = {row["job"]: row["count"] for row in stored.groupBy("job").count().collect()}
    spark = frame.sparkSession

    def model(job: Job) -> GBTRegressionModel | None:
        if not 0 < counts.get(job.name, 0) <= MOST_CELLS:
            return None
        sizes, bounds, params, seed = shapes[job.name]

        def fit(key, table: pd.DataFrame) -> pd.DataFrame:
            return _fit(key[0], table, _Features(sizes, bounds), params, seed)

        nodes = stored.where(F.col("job") == job.name).groupBy("job").applyInPandas(fit, NODES)
        return as_model(spark, nodes, job, len(slot_names(job.encoder)))

    with ThreadPool(max(1, len(jobs))) as pool:
        models = pool.map(inheritable_thread_target(spark)(model), jobs, chunksize=1)
    discard(stored)
    return {job.name: found for job, found in zip(jobs, models)}


def collapsed(frame: DataFrame, encoded_weight: str) -> DataFrame:
    """Encoded rows with one row for each distinct feature vector: summed weight, weighted mean of the target."""
    w = F.col(encoded_weight).cast("double")
    return frame.where(w > 0).groupBy("features").agg(
        F.sum(w).alias(encoded_weight), (F.sum(w * F.col("actual_ctr")) / F.sum(w)).alias("actual_ctr")
    )


def as_model(spark: SparkSession, nodes: DataFrame, job: Job, slots: int) -> GBTRegressionModel:
    """The nodes as a model of Spark ML, by way of its file format."""
    path = f"{checkpoint_dir(spark)}/model-{uuid.uuid4().hex}"
    rounds = int(job.params["n_estimators"])
    shared = {"labelCol": "actual_ctr", "predictionCol": "prediction", "featuresCol": "features"}
    about = {
        "class": "org.apache.spark.ml.regression.GBTRegressionModel", "timestamp": 0, "sparkVersion": spark.version,
        "uid": f"GBTRegressor_{uuid.uuid4().hex[:12]}",
        "paramMap": shared | {"maxIter": rounds, "maxDepth": int(job.params["max_depth"]), "stepSize": float(job.params["learning_rate"])},
        "defaultParamMap": {"leafCol": "", "impurity": "variance"}, "numFeatures": slots, "numTrees": rounds + 1,
    }
    tree = about | {"class": "org.apache.spark.ml.regression.DecisionTreeRegressionModel", "paramMap": shared}
    one = lambda values, schema: spark.createDataFrame(values, schema).coalesce(1)
    one([(json.dumps(about),)], "value string").write.text(f"{path}/metadata")
    trees = spark.range(0, rounds + 1, 1, 1).select(
        F.col("id").cast("int").alias("_1"),
        F.concat(F.lit(json.dumps({k: v for k, v in tree.items() if k != "uid"})[:-1] + ', "uid": "dtr_'), F.col("id").cast("string"), F.lit('"}')).alias("_2"),
        F.when(F.col("id") == 0, F.lit(1.0)).otherwise(F.lit(float(job.params["learning_rate"]))).alias("_3"),
    )
    trees.write.parquet(f"{path}/treesMetadata")
    none = F.lit(-1)
    leaf = F.col("left") < 0
    split = F.struct(
        F.col("feature").alias("featureIndex"),
        F.when(leaf, F.array().cast("array<double>")).otherwise(F.array("threshold")).alias("leftCategoriesOrThreshold"),
        none.alias("numCategories"),
    )
    data = nodes.select(
        F.col("tree").alias("treeID"),
        F.struct(
            "id", F.col("value").alias("prediction"), "impurity",
            F.array("weight", "total", "squares").alias("impurityStats"),
            F.greatest(F.col("weight").cast("long"), F.lit(1)).alias("rawCount"), "gain",
            F.col("left").alias("leftChild"), F.col("right").alias("rightChild"), split.alias("split"),
        ).alias("nodeData"),
    )
    data.write.parquet(f"{path}/data")
    return GBTRegressionModel.load(path)


def predicted(nodes: pd.DataFrame, vectors: np.ndarray, rate: float) -> np.ndarray:
    """Predictions from the nodes themselves, tree by tree; for small tables and tests."""
    out = np.zeros(len(vectors))
    for tree, part in nodes.groupby("tree"):
        part = part.sort_values("id").reset_index(drop=True)
        at = np.zeros(len(vectors), int)
        while True:
            feature = part["feature"].to_numpy()[at]
            inner = feature >= 0
            if not inner.any():
                break
            left = vectors[np.arange(len(vectors)), np.maximum(feature, 0)] <= part["threshold"].to_numpy()[at]
            at = np.where(inner, np.where(left, part["left"].to_numpy()[at], part["right"].to_numpy()[at]), at)
        out += (1.0 if tree == 0 else rate) * part["value"].to_numpy()[at]
    return out


