"""Features, search and the three jobs, on a small rollup."""

from __future__ import annotations

import math
import random
import re
from datetime import date, datetime, timezone
from fractions import Fraction
from multiprocessing.pool import ThreadPool
from threading import Barrier

import pytest
from pyspark.ml.functions import vector_to_array

from adperf.entrypoints.queries import UPPER
from adperf.operators.decisions import RetrainPolicy
from adperf.operators.layers import segment_ctr_daily, silver_impressions
from adperf.plans import boosting, features, lifecycle, quality, registry, training
from adperf.plans.predictions import COLUMNS
from adperf.session import materialize
from adperf.sources import commits, events
from adperf.sources.tables import create_database, overwrite_table

TINY = {
    "n_estimators": {"type": "int", "low": 2, "high": 3},
    "max_depth": {"type": "int", "low": 2, "high": 3},
    "learning_rate": {"type": "float", "low": 0.1, "high": 0.4, "log": True},
}
TINY_STALE = {"n_estimators": 2, "max_depth": 3, "learning_rate": 0.3}


@pytest.fixture(scope="module")
def frame(spark, sf_dir):
    silver = silver_impressions(events.impressions(spark, sf_dir), events.DRIFT_START, events.DRIFT_CAMPAIGNS)
    return features.feature_frame(segment_ctr_daily(silver)).cache()


def test_unseen_and_null_levels_are_all_zeros(spark):
    seen = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "channel string, impressions double")
    encoder = features.fit_encoder(seen, ["channel", "impressions"])
    assert features.slot_names(encoder) == ["channel_a", "channel_b", "impressions"]
    other = spark.createDataFrame([("b", 3.0), ("new", 4.0), (None, 5.0)], "channel string, impressions double")
    rows = features.encode(other, encoder).select(vector_to_array("features")).collect()
    assert sorted(row[0] for row in rows) == [[0.0, 0.0, 4.0], [0.0, 0.0, 5.0], [0.0, 1.0, 3.0]]


def test_split_is_stable_and_about_a_fifth(frame):
    split = features.with_split(frame).select("event_date", *features.GRAIN[1:], "is_validation")
    again = features.with_split(frame.repartition(7)).select("event_date", *features.GRAIN[1:], "is_validation")
    assert split.exceptAll(again).count() == 0
    share = split.where("is_validation").count() / split.count()
    assert 0.12 < share < 0.28


def test_draws_stay_inside_the_space():
    rng = random.Random(1)
    for _ in range(200):
        drawn = training.draw_params(training.SEARCH_SPACE, rng)
        for name, bounds in training.SEARCH_SPACE.items():
            assert bounds["low"] <= drawn[name] <= bounds["high"]
    again = [training.draw_params(training.SEARCH_SPACE, random.Random(42)) for _ in range(2)]
    assert again[0] == again[1]


def test_unknown_parameter_type_is_refused():
    with pytest.raises(ValueError, match="unknown type"):
        training.draw_params({"x": {"type": "choice", "low": 0, "high": 1}}, random.Random(1))


def test_winner_ignores_trials_without_cohort_rows():
    runs = [{"metrics": {"rmse_misbid_cohort": value}} for value in (None, 0.2, 0.1)]
    assert training.winner(runs) is runs[2]


def test_jobs_end_to_end(spark, sf_dir):
    database, artifacts = "jobs", f"{spark.sparkContext.getCheckpointDir()}/jobs_models"
    raw = events.impressions(spark, sf_dir)
    written = lifecycle.refresh_tables(spark, raw, database, events.DRIFT_START, events.DRIFT_CAMPAIGNS)
    assert written[lifecycle.SILVER] == raw.count()
    segments = written[lifecycle.SEGMENTS]

    times = [datetime(2024, 1, day, 7, tzinfo=timezone.utc) for day in (22, 25, 26, 31)]
    config = training.TrainingConfig(
        n_trials=1, space=TINY, parallel_trials=3, generation="champion_candidate"
    )
    first = lifecycle.train_initial(
        spark, database, "ctr", artifacts, times[0], config, TINY_STALE, UPPER
    ).first()
    assert (first["stale_version"], first["champion_version"], first["segments_scored"]) == (1, 2, segments)
    scored = spark.table(f"{database}.{lifecycle.PREDICTIONS}")
    assert scored.columns == [*COLUMNS, "predicted_at"]
    assert scored.where("predicted_ctr_champion NOT BETWEEN 0 AND 1 OR predicted_ctr_stale IS NULL").count() == 0

    policy = RetrainPolicy(minimum_impressions=1)
    for now in (times[1], times[2], times[2]):
        decision = lifecycle.run_monitor(spark, database, now, policy=policy).collect()
        assert len(decision) == 1 and decision[0]["reason"]
    log = spark.table(f"{database}.{lifecycle.DECISIONS}")
    assert log.count() == 2

    again = training.TrainingConfig(n_trials=1, space=TINY, parallel_trials=3)
    prior = {tuple(r)[:-1]: r[-1] for r in scored.select(*features.GRAIN, "predicted_ctr_champion").collect()}
    refused = lifecycle.retrain(spark, database, "ctr", artifacts, times[2], again, 99.9, UPPER).first()
    assert not refused["promoted"] and refused["rows_scored"] == 0
    accepted = lifecycle.retrain(spark, database, "ctr", artifacts, times[3], again, -1000.0, UPPER).first()
    assert accepted["promoted"] and accepted["rows_scored"] == segments
    now_scored = spark.table(f"{database}.{lifecycle.PREDICTIONS}")
    assert {tuple(r)[:-1]: r[-1] for r in now_scored.select(*features.GRAIN, "predicted_ctr_stale").collect()} == prior

    aliases = registry.current_aliases(spark.table(f"{database}.model_aliases"))
    assert {(r["alias"], r["version"]) for r in aliases.collect()} == {("stale", 1), ("champion", 4)}
    tags = {(r["version"], r["tag"]): r["value"] for r in spark.table(f"{database}.model_version_tags").collect()}
    assert tags[3, "promotion_gate"] == "failed" and tags[4, "promotion_gate"] == "passed"

    runs = spark.table(f"{database}.{lifecycle.RUNS}")
    assert quality.trial_count_check(runs, 3, 3).first()["passed"]
    assert training.leaderboard(runs).count() == 9
    again_summary = lifecycle.retrain(spark, database, "ctr", artifacts, times[3], again, -1000.0, UPPER).first()
    assert again_summary == accepted  # the same run: nothing is trained or registered again
    importances = spark.table(f"{database}.{lifecycle.IMPORTANCES}")
    assert importances.where(training.F.col("run_id") == accepted["run_id"]).count() > 0
    assert accepted["top_features"]
    versions = spark.table(f"{database}.model_versions")
    assert versions.count() == 4
    assert all(r["passed"] for r in quality.versions_check(versions, aliases).collect())
    assert quality.decisions_recorded_check(log, 2).first()["passed"]


def test_importance_names_every_slot(spark, frame):
    ready = training.prepared(frame)
    trained = training.refit(ready, {"feature_set": "fs_c_full", "params": TINY_STALE}, training.TrainingConfig())
    importance = training.feature_importance(spark, trained)
    assert importance.count() == len(features.slot_names(trained.encoder))
    assert sum(r["importance"] for r in importance.collect()) == pytest.approx(1.0)
    top = training.top_features(importance).collect()
    assert len(top) == importance.count() and len(training.top_features(importance, 10).collect()) == 10
    assert [r["importance"] for r in top] == sorted((r["importance"] for r in top), reverse=True)


@pytest.mark.parametrize("broken", ["register_version", "score_against_prior"])
def test_a_stopped_retrain_goes_on_after_its_last_step(spark, frame, monkeypatch, broken):
    """Stopped right after the effect of a step, before it is noted: one version, one set of runs, the right prior."""
    database = f"stopped_{broken}"
    artifacts = f"{spark.sparkContext.getCheckpointDir()}/{database}_models"
    create_database(spark, database)
    overwrite_table(frame.withColumn("event_date", training.F.col("event_date")), f"{database}.{lifecycle.SEGMENTS}")
    config = training.TrainingConfig(n_trials=1, space=TINY, parallel_trials=3)
    times = [datetime(2024, 1, day, tzinfo=timezone.utc) for day in (1, 2)]
    lifecycle.retrain(spark, database, "ctr", artifacts, times[0], config, upper=UPPER).collect()
    before = spark.table(f"{database}.{lifecycle.PREDICTIONS}").select(*features.GRAIN, "predicted_ctr_champion").collect()
    real = getattr(lifecycle, broken)

    def stopping(*args, **kwargs):
        real(*args, **kwargs)
        raise RuntimeError("lost")

    monkeypatch.setattr(lifecycle, broken, stopping)
    with pytest.raises(RuntimeError, match="lost"):
        lifecycle.retrain(spark, database, "ctr", artifacts, times[1], config, -1000.0, UPPER)
    monkeypatch.setattr(lifecycle, broken, real)
    summary = lifecycle.retrain(spark, database, "ctr", artifacts, times[1], config, -1000.0, UPPER).collect()
    assert len(summary) == 1 and summary[0]["candidate_version"] == 2
    assert spark.table(f"{database}.model_versions").count() == 2
    runs = spark.table(f"{database}.{lifecycle.RUNS}")
    assert runs.count() == runs.select("run_id").distinct().count() == 8
    stale = spark.table(f"{database}.{lifecycle.PREDICTIONS}").select(*features.GRAIN, "predicted_ctr_stale").collect()
    assert sorted(map(tuple, stale), key=repr) == sorted(map(tuple, before), key=repr)


def test_many_writers_get_numbers_of_their_own(spark):
    create_database(spark, "writers")
    now = datetime(2024, 1, 1)
    registry.register_version(spark, "writers", "other model/x", "run", "path", now)
    with ThreadPool(8) as pool:
        found = pool.map(lambda k: registry.register_version(spark, "writers", "ctr", f"run{k}", "path", now), range(24))
    assert sorted(found) == list(range(1, 25))
    rows = spark.table("writers.model_versions").where("model_name = 'ctr'").collect()
    assert sorted(r["version"] for r in rows) == list(range(1, 25)) and len({r["run_id"] for r in rows}) == 24


def test_files_that_exist_once(spark):
    folder = f"{spark.sparkContext.getCheckpointDir()}/numbers"
    assert commits.take_number(spark, folder, lambda n: {"n": n}) == 1
    commits.write_json(spark, f"{folder}/_draft-of-a-writer-that-died", {})
    assert commits.take_number(spark, folder, lambda n: {"n": n}) == 2
    assert not commits.create_once(spark, f"{folder}/0000000001.json", {})
    assert commits.read_json(spark, f"{folder}/0000000002.json") == {"n": 2}
    assert commits.read_json(spark, f"{folder}/none.json") is None


def test_same_trees_from_collapsed_and_plain_rows(spark):
    """Whole numbers as weights and targets: the sums are exact, so the trees are the same ones."""
    rng = random.Random(5)
    rows = [
        (date(2024, 1, 1 + k % 28), *[rng.choice(levels) for levels in (["a", "b", "c"], ["x", "y"], ["m", "n", "o"], ["u", "v"], ["k1", "k2"], ["f", "g"])],
         float(rng.randint(0, 8)), rng.randint(1, 9))
        for k in range(900)
    ]
    names = ["event_date", *features.FEATURE_SETS["fs_b_campaign"], "actual_ctr", "train_weight"]
    plain = spark.createDataFrame(rows, names)
    params = {"n_estimators": 12, "max_depth": 4, "learning_rate": 0.5}
    for name in ("fs_a_core", "fs_b_campaign"):
        encoder = features.fit_encoder(plain, features.FEATURE_SETS[name])
        job = boosting.Job(name, encoder, params, "train_weight", 3)
        w = training.F.col("train_weight")
        keys = features.FEATURE_SETS[name]
        summed = plain.groupBy(*keys).agg(
            training.F.min("event_date").alias("event_date"),
            (training.F.sum(w * training.F.col("actual_ctr")) / training.F.sum(w)).alias("actual_ctr"),
            training.F.sum(w).alias("train_weight"),
            *[training.F.min(c).alias(c) for c in features.GRAIN[1:] if c not in keys],
        )
        whole = boosting.fit_models(plain, [job])[name]
        folded = boosting.fit_models(summed, [job])[name]
        assert len(whole.trees) == 13 and whole.treeWeights[:2] == [1.0, 0.5]
        splits = re.compile(r"feature (\d+) (?:<=|>) ([\d.]+)")
        assert splits.findall(whole.toDebugString) == splits.findall(folded.toDebugString)
        encoded = features.encode(plain, encoder)
        for a, b in zip(whole.transform(encoded).select("prediction").collect(), folded.transform(encoded).select("prediction").collect()):
            assert a[0] == pytest.approx(b[0], abs=1e-9)


def test_boosting_finds_the_rule_and_equals_plain_boosting(spark):
    """A step in a number and a level: found by few trees; predictions equal those of the nodes, tree by tree."""
    rng = random.Random(8)
    rows = [(date(2024, 1, 1 + k % 28), rng.choice("abc"), "d", "c", "v", f"k{k % 3}", "o", k % 7, float(rng.randint(1, 100)), 0, rng.randint(1, 5)) for k in range(700)]
    names = ["event_date", *features.FEATURE_SETS["fs_c_full"], "train_weight"]
    F = training.F
    table = spark.createDataFrame(rows, names).withColumn("actual_ctr", F.when((F.col("channel") == "a") & (F.col("impressions") > 50), 1.0).otherwise(0.0))
    encoder = features.fit_encoder(table, features.FEATURE_SETS["fs_c_full"])
    job = boosting.Job("c", encoder, {"n_estimators": 30, "max_depth": 3, "learning_rate": 0.5, "subsample": 0.8, "colsample_bytree": 0.9}, "train_weight", 3)
    model = training.fit_all(table, [job])["c"]
    off = model.transform(features.encode(table, encoder)).select(F.abs(F.col("prediction") - F.col("actual_ctr")))
    assert off.agg(F.avg(off.columns[0])).first()[0] < 0.06  # bins are wider than single impressions
    assert model.numFeatures == len(features.slot_names(encoder))
    one = boosting.Job("one", encoder, {"n_estimators": 1, "max_depth": 2, "learning_rate": 0.5}, "train_weight", 3)
    named = dict(zip(features.slot_names(encoder), training.fit_all(table, [one])["one"].featureImportances.toArray()))
    assert named["channel_a"] + named["impressions"] == pytest.approx(1.0)


def test_models_of_a_round_are_fitted_side_by_side(spark, frame, monkeypatch):
    """Each model waits for the others; grown one after another they would never meet."""
    together, plain = Barrier(3, timeout=60), boosting.as_model

    def meeting(*args):
        together.wait()
        return plain(*args)

    ready = training.prepared(frame)
    jobs = [
        boosting.Job(name, features.fit_encoder(ready, names), TINY_STALE, "train_weight", 3)
        for name, names in features.FEATURE_SETS.items()
    ]
    alone = {job.name: boosting.fit_models(ready, [job])[job.name].toDebugString for job in jobs}
    monkeypatch.setattr(boosting, "as_model", meeting)
    trees = lambda text: text.split("\n", 1)[1]  # noqa: E731  without the uid
    found = boosting.fit_models(ready, jobs)
    assert {name: trees(model.toDebugString) for name, model in found.items()} == {k: trees(v) for k, v in alone.items()}


def test_cells_beyond_the_bound_are_fitted_by_spark_ml(spark, frame, monkeypatch):
    monkeypatch.setattr(boosting, "MOST_CELLS", 5)
    ready = training.prepared(frame)
    trained = training.refit(ready, {"feature_set": "fs_a_core", "params": TINY_STALE}, training.TrainingConfig())
    assert trained.model.getNumTrees == 2 and trained.metrics["rmse"] > 0


def test_suggestions_are_seeded_inside_the_space_and_better_than_random():
    space = training.SEARCH_SPACE

    def loss(p):
        return (math.log(p["learning_rate"] / 0.05)) ** 2 + ((p["max_depth"] - 6) / 3) ** 2 + ((p["n_estimators"] - 400) / 200) ** 2

    def best(adaptive, seed, trials=30):
        rng, seen = random.Random(seed), []
        for _ in range(trials):
            p = training.suggest(space, seen, rng) if adaptive else training.draw_params(space, rng)
            for name, bounds in space.items():
                assert bounds["low"] <= p[name] <= bounds["high"]
            seen.append((p, loss(p)))
        return [x for _, x in seen]

    assert best(True, 1) == best(True, 1)
    adaptive, plain = (sum(min(best(how, seed)) for seed in range(20)) / 20 for how in (True, False))
    assert adaptive < 0.6 * plain
    # trials without a loss are no example to follow
    assert training.suggest(space, [(training.draw_params(space, random.Random(1)), None)] * 3, random.Random(2))


def test_dictionary_encoding_equals_the_encoder(spark, frame):
    names = features.FEATURE_SETS["fs_c_full"]
    encoder = features.fit_encoder(frame, names)
    odd = frame.limit(1).withColumns({"channel": training.F.lit("never seen"), "device": training.F.lit(None).cast("string")})
    rows = frame.unionByName(odd)
    dictionary = materialize(features.level_dictionary(frame, features.CATEGORICALS))
    by_join = features.encode_by_dictionary(rows, dictionary, names)
    assert by_join.columns == [*rows.columns, "features"]
    keys = [*features.GRAIN, "features"]
    text = lambda df: sorted(str(tuple(r)) for r in df.select(*keys).withColumn("features", vector_to_array("features")).collect())
    assert text(by_join) == text(features.encode(rows, encoder))


def test_many_levels_are_numbered_in_order_over_all_tasks(spark):
    n = 300_000
    frame = spark.range(0, n, 1, 8).select(
        training.F.format_string("c%07d", training.F.col("id") * 7 % n).alias("campaign_id"),
        training.F.when(training.F.col("id") % 3 == 0, "hot").otherwise(training.F.concat(training.F.lit("d"), training.F.col("id") % 5)).alias("device"),
    )
    found = materialize(features.level_dictionary(frame, ["campaign_id", "device"]))
    campaigns = found.where("name = 'campaign_id'")
    assert campaigns.count() == campaigns.select("index").distinct().count() == n
    assert campaigns.where(training.F.col("level") != training.F.format_string("c%07d", training.F.col("index"))).count() == 0
    assert [r["level"] for r in found.where("name = 'device'").orderBy("index").collect()] == ["d0", "d1", "d2", "d3", "d4", "hot"]


@pytest.mark.parametrize("partitions", [1, 7])
def test_r2_around_the_mean_is_exact_at_low_rates_and_large_weights(spark, partitions):
    rng = random.Random(2)
    rows = [(1e-6 + rng.uniform(-1e-11, 1e-11), 1e-6 + rng.uniform(-1e-11, 1e-11), rng.randint(1, 10**12)) for _ in range(400)]
    exact = [(Fraction(y), Fraction(p), w) for y, p, w in rows]
    mean = sum(y * w for y, _, w in exact) / sum(w for *_, w in exact)
    wanted = 1 - sum(w * (p - y) ** 2 for y, p, w in exact) / sum(w * (y - mean) ** 2 for y, _, w in exact)
    df = spark.createDataFrame(rows, "actual_ctr double, prediction double, impressions long").repartition(partitions)
    df = df.withColumns({"is_drift_segment": training.F.lit(False), "is_drift_window": training.F.lit(False)})
    assert training.evaluate(df)["r2"] == pytest.approx(float(wanted), rel=1e-9)
    plain = df.agg(training.weighted_r2("actual_ctr", "prediction", "impressions").alias("r2")).first()["r2"]
    assert plain != pytest.approx(float(wanted), rel=1e-9)  # what the center is for
