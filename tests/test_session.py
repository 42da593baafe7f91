"""The shared folder comes from the session's own setting."""

import os
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from creditloom import session
from creditloom.operators import sampling


def with_setting(spark, folder):
    """The session as a cluster with that setting would show it: it is fixed at start."""
    conf = SimpleNamespace(get=lambda name, default: {"spark.checkpoint.dir": folder}.get(name, default))
    return SimpleNamespace(conf=conf, sparkContext=spark.sparkContext, read=spark.read)


def test_shared_folder(spark, tmp_path):
    fallback = session.shared_dir(spark)
    assert session.shared_dir(spark) == fallback
    cluster = with_setting(spark, str(tmp_path / "shared"))
    assert session.shared_dir(cluster) == str(tmp_path / "shared")
    assert session.scratch_path(cluster, "x").startswith(str(tmp_path / "shared") + "/x-")
    remote = SimpleNamespace(
        conf=SimpleNamespace(get=lambda name, default: default),
        sparkContext=SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None),
    )
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_dir(remote)


def test_materialised_frame_has_no_lineage(spark):
    stored = session.materialise(spark.range(10).withColumn("x", F.col("id") * 2), "numbers")
    assert stored.agg(F.sum("x")).first()[0] == 90
    assert "Range" not in stored._jdf.queryExecution().executedPlan().toString()


def test_discarded_tables_are_gone(spark, tmp_path):
    stored = session.materialise(spark.range(10), "numbers")
    folder = stored.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file://").removeprefix("file:")
    assert os.path.isdir(folder)
    session.discard(stored)
    assert not os.path.exists(folder)
    spark.range(3).write.parquet(str(tmp_path / "mine"))
    session.discard(spark.read.parquet(str(tmp_path / "mine")))
    assert os.path.isdir(tmp_path / "mine")  # not written by materialise


def test_children_join_without_a_switch(spark):
    """No hint: adaptive execution decides by the real size."""
    child = spark.range(1000).select((F.col("id") % 50).alias("SK_ID_CURR"))
    kept = sampling.subset_children(child, spark.range(10).withColumnRenamed("id", "SK_ID_CURR"))
    assert "hint" not in kept._jdf.queryExecution().analyzed().toString().lower()
    assert kept.count() == 200


def test_only_local_mode_falls_back(spark):
    cluster = SimpleNamespace(
        conf=SimpleNamespace(get=lambda name, default: default),
        sparkContext=SimpleNamespace(master="local-cluster[3,2,1024]", getCheckpointDir=lambda: None),
    )
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_dir(cluster)
