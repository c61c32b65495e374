"""Range lookups against brute force, on both paths."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from adperf.operators import bands


def brute(points, table):
    return sorted((p, name) for p in points for name, low, high in table if low <= p < high)


def joined(df):
    return sorted((row["x"], row["name"]) for row in df.collect())


@pytest.fixture(scope="module")
def case():
    rng = random.Random(5)
    points = [rng.uniform(-50, 50) for _ in range(400)] + [0.0, 1.0, -8.0, 8.0, 64.0]
    table = [("all", float("-inf"), float("inf")), ("half", 0.0, float("inf")), ("empty", 3.0, 3.0)]
    table += [(f"unit{i}", float(i), float(i + 1)) for i in range(-10, 10)]
    for i in range(60):
        low = rng.uniform(-60, 60)
        table.append((f"r{i}", low, low + 10 ** rng.uniform(-6, 2)))
    return points, table


@pytest.mark.parametrize("join", [bands.broadcast_band_join, bands.binned_band_join])
def test_band_join_matches_brute_force(spark, case, join):
    points, table = case
    facts = spark.createDataFrame([(p,) for p in points], "x double")
    lookup = spark.createDataFrame(table, "name string, low double, high double")
    assert joined(join(facts, lookup, "x")) == brute(points, table)


def test_band_join_goes_by_the_counted_size(spark, case):
    points, table = case
    facts = spark.createDataFrame([(p,) for p in points], "x double")
    lookup = spark.createDataFrame(table, "name string, low double, high double")
    small = bands.band_join(facts, lookup, "x", small_rows=1_000)
    large = bands.band_join(facts, lookup, "x", small_rows=10)
    plan = large._jdf.queryExecution().optimizedPlan().toString()
    assert "__fact_bin" in plan
    assert "__fact_bin" not in small._jdf.queryExecution().optimizedPlan().toString()
    assert joined(small) == joined(large) == brute(points, table)


@pytest.mark.parametrize("n", [0, 1, 700])
def test_disjoint_bands_match_brute_force(spark, n):
    rng = random.Random(n)
    edges = sorted({rng.gauss(0, 1) ** 5 for _ in range(n + 1)})
    table = [(f"b{i}", a, b) for i, (a, b) in enumerate(zip(edges, edges[1:])) if i % 5 != 4]
    points = [rng.gauss(0, 2) for _ in range(500)] + edges + [float("nan"), float("inf"), float("-inf"), 1e300]
    facts = spark.createDataFrame([(p,) for p in points], "x double")
    lookup = spark.createDataFrame(table, "name string, low double, high double")
    assert joined(bands.disjoint_band_join(facts, lookup, "x")) == brute(points, table)


def test_disjoint_join_refuses_open_bands(spark):
    lookup = spark.createDataFrame([("a", 0.0, float("inf"))], "name string, low double, high double")
    with pytest.raises(ValueError, match="binned_band_join"):
        bands.disjoint_band_join(spark.range(3).withColumnRenamed("id", "x"), lookup, "x")


def test_binned_join_of_large_integers(spark):
    base = 2**60
    table = [("a", base, base + 1), ("b", base + 1, base + 3), ("c", base - 5, base + 500)]
    points = [base - 1, base, base + 1, base + 2, base + 3]
    facts = spark.createDataFrame([(p,) for p in points], "x bigint")
    lookup = spark.createDataFrame(table, "name string, low bigint, high bigint")
    assert joined(bands.binned_band_join(facts, lookup, "x")) == brute(points, table)


def test_regimes_keep_their_own_bands(spark):
    lookup = spark.createDataFrame(
        [("before", "a", 0.0, 1.0), ("after", "b", 0.0, 0.5), ("after", "c", 0.5, 1.0)],
        "regime string, name string, low double, high double",
    )
    facts = spark.createDataFrame([("before", 0.7), ("after", 0.7), ("after", 0.2)], "regime string, x double")
    for join in (bands.broadcast_band_join, bands.binned_band_join):
        got = sorted(tuple(row) for row in join(facts, lookup, "x", on=["regime"]).select("regime", "x", "name").collect())
        assert got == [("after", 0.2, "b"), ("after", 0.7, "c"), ("before", 0.7, "a")]


def test_band_label_is_the_join_without_a_join(spark):
    table = [("a", 0, 3), ("b", 3, 5)]
    facts = spark.range(-1, 6).withColumnRenamed("id", "x")
    labels = {row["x"]: row["name"] for row in facts.select("x", bands.band_label(F.col("x"), table).alias("name")).collect()}
    assert labels == {-1: None, 0: "a", 1: "a", 2: "a", 3: "b", 4: "b", 5: None}


def test_cumulative_bands_cover_the_unit_interval(spark):
    weights = spark.createDataFrame([("x", 1.0), ("y", 3.0), ("z", 4.0)], "k string, w double")
    rows = {row["k"]: (row["low"], row["high"]) for row in bands.cumulative_bands(weights, "k", "w").collect()}
    assert rows == {"x": (0.0, 0.125), "y": (0.125, 0.5), "z": (0.5, 1.0)}


@pytest.mark.parametrize("by", [[], ["g"]])
def test_cumulative_bands_by_partitions_equal_one_window(spark, by):
    rows = [("hot" if i % 3 else f"g{i % 7}", i, (i * 37) % 11 + 1) for i in range(500)]
    weights = spark.createDataFrame(rows, "g string, k int, w int")
    one = bands.cumulative_bands(weights, "k", "w", by)
    many = bands.cumulative_bands(weights, "k", "w", by, small_rows=10)
    order = [*by, "k"]
    assert one.orderBy(*order).collect() == many.orderBy(*order).collect()


@pytest.mark.parametrize("small_rows", [10**6, 0])
def test_bands_of_fractions_touch(spark, small_rows):
    rows = [(g, k, (k * 7919 % 997 + 1) / 10.0) for g in ("a", "b") for k in range(1500)]
    weights = spark.createDataFrame(rows, "g string, k int, w double")
    found = bands.cumulative_bands(weights, "k", "w", by=["g"], small_rows=small_rows).orderBy("g", "k").collect()
    for g in ("a", "b"):
        own = [r for r in found if r.g == g]
        assert own[0].low == 0.0 and own[-1].high == 1.0 and len(own) == 1500
        assert all(a.high == b.low for a, b in zip(own, own[1:]))
