from collections import Counter

import pytest
from pyspark.sql import functions as F

from lexmill.operators import skew
from tests.conftest import rows


@pytest.fixture(scope="module")
def skewed(spark):
    data = [("hot", i, i % 3) for i in range(2000)] + [("warm", i, 0) for i in range(600)] + [(f"k{i % 300}", i, 1) for i in range(1500)] + [(None, 1, 1)] * 3
    return spark.createDataFrame(data, "k string, id bigint, extra int")


def test_layout_splits_large_keys_and_balances(spark, skewed):
    layout = skew.plan_layout(skewed.filter("k is not null"), "k", 8)
    assert layout.heavy["hot"][1] >= 4 and max(layout.loads) < 1.6 * sum(layout.loads) / 8
    placed = skew.fragmented(skewed.filter("k is not null"), "k", layout, ["id"]).groupBy(F.spark_partition_id()).count()
    assert max(r["count"] for r in placed.collect()) < 1.8 * 4100 / 8


def test_aggregate_equals_plain(skewed):
    got = skew.balanced_aggregate(skewed, "k", {"n": F.count("*"), "s": F.sum("id")}, {"n": F.sum("n"), "s": F.sum("s")}, ["id"])
    assert rows(got) == rows(skewed.filter("k is not null").groupBy("k").agg(F.count("*"), F.sum("id")))


@pytest.mark.parametrize("how", ["inner", "left"])
def test_join_equals_plain(spark, skewed, how):
    right = spark.createDataFrame([("hot", 1, "a"), ("hot", 2, "b"), ("k1", 3, "c"), ("other", 4, "d"), (None, 5, "e")], "k string, id bigint, v string")
    got = skew.balanced_join(skewed, right, "k", ["id"], how)
    assert got.columns == ["k", "id", "extra", "id_right", "v"]
    plain = skewed.join(right.withColumnRenamed("id", "id_right"), "k", how).select(*got.columns)
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, plain.collect()))


def test_empty_and_repeated_rows(spark, skewed):
    empty = skewed.limit(0)
    assert skew.balanced_aggregate(empty, "k", {"n": F.count("*")}, {"n": F.sum("n")}, ["id"]).count() == 0
    same = spark.createDataFrame([("a", 1)] * 50, "k string, id bigint")
    assert rows(skew.balanced_aggregate(same, "k", {"n": F.count("*")}, {"n": F.sum("n")}, ["id"])) == [("a", 50)]


def test_layout_for_ten_thousand_tasks(spark):
    """The sketch grows with the tasks, so that keys just above the limit are found among many more keys."""
    from lexmill.operators.skew import tracked_for

    n_tasks = 10_000
    # 4,000 keys of 300 rows, above the limit of 75 rows that 10,000 tasks leave, and 300,000 keys of one row
    rows = spark.range(1_500_000).select(F.when(F.col("id") < 1_200_000, F.concat(F.lit("h"), F.col("id") % 4000)).otherwise(F.concat(F.lit("l"), F.col("id"))).alias("k"))
    layout = skew.plan_layout(rows, "k", n_tasks)
    assert tracked_for(n_tasks) == 1 << 16 and len([k for k in layout.heavy if k.startswith("h")]) == 4000
    assert not [k for k in layout.heavy if k.startswith("l")] and max(layout.loads) <= 4 * sum(layout.loads) / n_tasks
    assert len(layout.bins) == n_tasks * skew.BINS and tracked_for(8) == skew.LEAST_TRACKED
