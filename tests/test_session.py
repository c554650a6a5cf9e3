import os
from types import SimpleNamespace

import pytest

from cellsift.session import clear_stages, scratch, shared_dir, spread, written


def fake(named=None, checkpoint=None, master="local[2]"):
    """A session without settings of its own: what the cluster names decides."""
    state = {"dir": checkpoint}
    context = SimpleNamespace(
        master=master, getCheckpointDir=lambda: state["dir"], setCheckpointDir=lambda d: state.update(dir=f"{d}/x")
    )
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: named), sparkContext=context)


def test_the_named_folder_comes_first(spark):
    assert shared_dir(fake("s3a://shared/ckpt/", "/other")) == "s3a://shared/ckpt"
    assert shared_dir(fake(None, "/other")) == "/other"
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    local = fake()
    assert shared_dir(local) == shared_dir(local) and os.path.isdir(os.path.dirname(shared_dir(local)))
    with pytest.raises(RuntimeError):
        shared_dir(fake(master="spark://host"))


def test_scratch_names_are_new(spark):
    assert scratch(spark, "a") != scratch(spark, "a")


def test_written_keeps_rows_and_schema(spark):
    df = spark.range(100, numPartitions=100).selectExpr("id", "cast(id as string) AS `odd name`", "array(id) AS a")
    back = written(df)
    assert back.schema.simpleString() == df.schema.simpleString()
    assert sorted(r["id"] for r in back.collect()) == list(range(100))
    assert len(back.inputFiles()) <= 16


def test_work_before_a_stage_keeps_its_splits(spark):
    df = spark.range(200, numPartitions=200).where("id % 50 = 0")
    tracker, group = spark.sparkContext.statusTracker(), "splits"
    spark.sparkContext.setJobGroup(group, group)
    written(df)
    stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds]
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert max(s.numTasks for s in stages if s is not None) == 200


def test_stages_can_be_cleared(spark):
    written(spark.range(3))
    path = scratch(spark, "gone")
    spark.range(3).write.parquet(path)
    assert os.path.isdir(path) and clear_stages(spark) >= 2 and not os.path.exists(path)
    assert clear_stages(spark) == 0


def test_spread_leaves_wide_scans_alone(spark, tmp_path):
    narrow, wide = str(tmp_path / "narrow"), str(tmp_path / "wide")
    spark.range(10, numPartitions=1).write.parquet(narrow)
    spark.range(1000, numPartitions=8).write.option("parquet.block.size", 1024).parquet(wide)
    assert spread(spark.read.parquet(narrow), "id").rdd.getNumPartitions() == 4
    few = spark.read.parquet(narrow)
    assert spread(few, "id", enough=1) is few
