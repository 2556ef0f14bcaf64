"""Masks of lost frames: what the plans move, and odd rows."""

import re

import pytest
from pyspark.sql import functions as F

from voxlake.model import CHANNELS
from voxlake.operators import motion as M, quality
from voxlake.plans import queries as Q, tables

from .oracle import DATA


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """lineitem with nulls in the channels and voxels, rows that come twice and a run of one frame."""
    if not DATA.exists():
        pytest.skip("the driver's tables aren't here")
    folder = tmp_path_factory.mktemp("odd")
    rows = spark.read.parquet(f"{DATA}/lineitem.parquet").limit(2000).withColumn("n", F.monotonically_increasing_id())
    columns = [F.when(F.col("n") % 23 != k, F.col(c)).alias(c) if c in ("l_tax", "l_quantity", "l_partkey", "l_extendedprice") else F.col(c) for k, c in enumerate(rows.columns) if c != "n"]
    rows = rows.select(*columns)
    single = rows.limit(1).withColumn("l_suppkey", F.lit(-1).cast("long"))
    rows.union(rows.limit(500)).union(single).write.parquet(f"{folder}/lineitem.parquet")
    return str(folder)


def executed(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def rows_of(df) -> list[tuple]:
    return sorted(map(tuple, df.collect()), key=repr)


def test_motion_comes_with_its_mask_out_of_one_join(spark, odd):
    plan = executed(Q.motion_with_mask(spark, odd))
    assert len(re.findall(r"SortMergeJoin|HashJoin", plan)) == 1
    assert len(re.findall("FileScan", plan)) == 2  # of motion and of the signal


def test_motion_with_mask_on_odd_rows_is_motion_joined_with_the_mask(spark, odd):
    lost = quality.choose_mask("or", M.lost_mask("fd", Q.FD_THRESHOLD), M.lost_mask("global_change", Q.CHANGE_THRESHOLD))
    masks = Q._both(spark, odd).select("run", "t", lost.cast("int").alias("mask"))
    joined = tables.motion(spark, odd).join(masks, ["run", "t"])
    want = rows_of(joined.select("run", "t", M.motion_lines(joined).alias("line")))
    assert rows_of(Q.motion_with_mask(spark, odd)) == want
    assert len(want) == 2501 and any(line.count("\t") < 6 for _, _, line in want)


@pytest.mark.parametrize("name", ["masks_chosen", "motion_with_mask"])
def test_frames_are_judged_before_they_are_joined(spark, odd, name, monkeypatch):
    given, join = [], quality.join_frames
    monkeypatch.setattr(quality, "join_frames", lambda fd, change, *how: given.extend((fd, change)) or join(fd, change, *how))
    assert Q.QUERIES[name](spark, odd).columns
    measures = [[c for c, kind in df.dtypes if kind == "double" and c not in CHANNELS] for df in given]
    assert measures == [[], []]


def test_masks_on_odd_rows_are_those_of_the_joined_measures(spark, odd):
    both = Q._both(spark, odd)
    fd, change = F.col("fd") > Q.FD_THRESHOLD, F.col("global_change") > Q.CHANGE_THRESHOLD
    want = rows_of(both.select("run", "t", fd, change, fd | change, fd & change))
    assert rows_of(Q.masks_chosen(spark, odd).select("run", "t", "fwd", "dvars", "either", "both")) == want
    assert any(row[2] is None for row in want) and any(row[2] for row in want)


def test_the_join_of_frames_moves_only_what_it_is_given(spark):
    fd = spark.createDataFrame([(1, 0, 0.5)], "run int, t long, fd double")
    change = spark.createDataFrame([(1, 0, 2.5)], "run int, t long, global_change double")
    plan = executed(quality.join_frames(fd, change, ["run"]))
    below_join = plan[plan.index("Join") :]
    assert "1 AS" not in below_join


@pytest.mark.parametrize("a, b", [([(1, 0)], [(1, 0), (1, 1)]), ([(1, 0), (1, 1)], [(1, 0)]), ([(None, 0)], [(None, 0)]), ([(1, None)], [(1, None)]), ([(1, 0)], [])])
def test_frames_without_their_like_are_refused(spark, a, b):
    fd, change = (spark.createDataFrame([(*row, 0.1) for row in rows], f"run int, t long, {name} double") for rows, name in ((a, "fd"), (b, "global_change")))
    with pytest.raises(Exception, match="differ in length"):
        quality.join_frames(fd, change, ["run"]).collect()


def test_joined_frames_keep_null_values_and_repeated_frames(spark):
    fd = spark.createDataFrame([(1, 0, None), (1, 0, 0.5), (1, 1, 0.7)], "run int, t long, fd double")
    change = spark.createDataFrame([(1, 0, None), (1, 1, 2.0), (1, 1, 3.0)], "run int, t long, global_change double")
    joined = quality.join_frames(fd, change, ["run"])
    assert joined.columns == ["run", "t", "fd", "global_change"]
    assert rows_of(joined) == sorted([(1, 0, None, None), (1, 0, 0.5, None), (1, 1, 0.7, 2.0), (1, 1, 0.7, 3.0)], key=repr)
    assert quality.join_frames(fd.limit(0), change.limit(0), ["run"]).collect() == []
