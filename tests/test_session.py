"""Where lineage is cut: in the folder the session names."""

from __future__ import annotations

from types import SimpleNamespace

import pytest

from stationdays import session


def fake(master: str, **conf):
    settings = {k.replace("_", "."): v for k, v in conf.items()}
    return SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: settings.get(k, d)),
                           sparkContext=SimpleNamespace(master=master))


def test_the_named_folder_is_used():
    assert session.scratch_root(fake("yarn", spark_checkpoint_dir="hdfs://h/c/")) == "hdfs://h/c"
    folder = session.scratch_folder(fake("yarn", spark_checkpoint_dir="hdfs://h/c"), "x")
    assert folder.startswith("hdfs://h/c/x-")


def test_a_cluster_must_name_one():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.scratch_root(fake("yarn"))


def test_one_machine_may_do_without():
    assert session.scratch_root(fake("local[2]")) == session.scratch_root(fake("local[*]"))


def test_cut_lineage_is_a_reliable_checkpoint(spark):
    frame = spark.range(10).selectExpr("id % 3 AS k").groupBy("k").count()
    kept = session.cut_lineage(frame)
    assert sorted(kept.collect()) == sorted(frame.collect())
    assert spark.sparkContext.getCheckpointDir()
