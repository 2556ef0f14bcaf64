"""Runs are dealt so that a task's rows don't grow with the table."""

import pytest
from pyspark.sql import functions as F

from voxlake import session
from voxlake.plans import tables
from voxlake.plans.queries import QUERIES, SQL

from .oracle import DATA, assert_same


@pytest.mark.parametrize("stand_in", [tables.motion, tables.signal])
def test_a_task_gets_a_bounded_number_of_frames(spark, stand_in, monkeypatch):
    if not DATA.exists():
        pytest.skip("the driver's tables aren't here")
    monkeypatch.setattr(session, "TASK_ROWS", 100, raising=False)
    frames = stand_in(spark, str(DATA)).select("run", "t", F.spark_partition_id().alias("task")).distinct()
    run = frames.groupBy("run").count().agg(F.max("count")).first()[0]
    assert frames.groupBy("task").count().agg(F.max("count")).first()[0] <= 3 * max(run, 100)
    assert frames.groupBy("run").agg(F.countDistinct("task").alias("n")).where("n > 1").count() == 0


@pytest.mark.parametrize("name", ["masks_chosen", "motion_with_mask", "quality_table"])
def test_results_do_not_depend_on_the_dealing(spark, name, monkeypatch):
    monkeypatch.setattr(session, "TASK_ROWS", 100, raising=False)
    assert_same(spark, QUERIES[name], SQL[name])
