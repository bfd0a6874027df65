"""Intermediate tables are removed, and spreading looks at sources only."""

import os

from pyspark.sql import functions as F

from lexmill.session import discard, release, scan_tasks, spread, stored


def test_tables_are_dropped(spark):
    one, two = stored(spark.range(5), "one"), stored(spark.range(7), "two")
    discard(one, one, spark.range(1))
    assert not os.path.exists(one.stored_at.removeprefix("file://")) and two.count() == 7
    release(spark)
    assert not os.path.exists(two.stored_at.removeprefix("file://"))


def test_spreading_runs_no_job(spark):
    table = stored(spark.range(1000, numPartitions=2), "few")
    counted = table.groupBy("id").agg(F.count("*").alias("n"))
    tracker = spark.sparkContext.statusTracker()
    before = len(tracker.getJobIdsForGroup(None))
    wide = spread(counted, "id")
    assert len(tracker.getJobIdsForGroup(None)) == before and scan_tasks(counted) == 2
    assert wide.rdd.getNumPartitions() > 2 and spread(stored(spark.range(100, numPartitions=8), "many")).rdd.getNumPartitions() >= 4
