from __future__ import annotations

from types import SimpleNamespace

import pytest

from adperf import session


def fake(master, configured=None, current=None):
    state = {"dir": current}
    context = SimpleNamespace(
        master=master,
        getCheckpointDir=lambda: state["dir"],
        setCheckpointDir=lambda path: state.update(dir=path),
    )
    return SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda key, default: configured or default))


def test_the_folder_in_use_wins():
    assert session.checkpoint_dir(fake("yarn", "hdfs:///b", current="hdfs:///a")) == "hdfs:///a"


def test_the_configured_folder_is_used():
    assert session.checkpoint_dir(fake("yarn", "hdfs:///b")) == "hdfs:///b"


def test_a_cluster_needs_a_shared_folder():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.checkpoint_dir(fake("yarn"))


def test_local_mode_gets_a_scratch_folder():
    assert "adperf-checkpoint-" in session.checkpoint_dir(fake("local[2]"))


def test_stored_tables_can_be_discarded_and_leave_the_settings_alone(spark):
    before = spark.conf.get(session.CLEANUP)
    table = session.materialize(spark.range(10).repartition(3).groupBy("id").count())
    assert table.count() == 10
    assert spark.conf.get(session.CLEANUP) == before
    path = spark._jvm.org.apache.hadoop.fs.Path(table.stored_at)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    assert files.exists(path)
    session.discard(table)
    assert not files.exists(path)
