import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexmill.functions.codecs import CODECS


def coded(spark, values, codec, tf=False):
    df = spark.createDataFrame([(values,)], "v array<bigint>")
    c = CODECS[codec]
    encode = c.encode_tf if tf else c.encode
    return df.select(F.hex(encode(F.col("v")))).first()[0]


@pytest.mark.parametrize(
    ("values", "codec", "tf", "want"),
    [
        ([34, 67, 89, 454], "vbe", False, "A2A19602ED"),
        ([34, 67, 89, 454], "elias", False, "000000040460882E016E"),
        ([1, 2, 3], "elias", True, "000000034C80"),
        ([1, 2, 3], "vbe", True, "818283"),
        ([0], "vbe", False, "80"),
        ([0], "elias", False, "0000000180"),
        ([127, 128, 16383, 16384], "vbe", True, "FF01807FFF010080"),
        ([1, 2], "standard", False, "01000000000000000200000000000000"),
        ([], "vbe", False, ""),
        ([], "elias", False, ""),
        ([], "standard", False, ""),
    ],
)
def test_golden_bytes(spark, values, codec, tf, want):
    assert coded(spark, values, codec, tf) == want


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.integers(0, 2**40), max_size=12, unique=True), min_size=8, max_size=8))
def test_round_trips(spark, lists):
    lists = [sorted(x) for x in lists] + [[]]
    df = spark.createDataFrame([(x,) for x in lists], "v array<bigint>").coalesce(1)
    for c in CODECS.values():
        got = df.select("v", c.decode(c.encode(F.col("v"))).alias("a"), c.decode_tf(c.encode_tf(F.col("v"))).alias("b")).collect()
        assert all(list(r.v) == list(r.a) == list(r.b) for r in got)


def test_long_lists_take_time_in_proportion(spark):
    """A chunk of 4,096 postings took a tenth of a second and more, and four times that at twice its length."""
    import time

    lists = [[i * 37 + (i * i) % 31 for i in range(n)] for n in (4096, 100_000, 1, 0)]
    df = spark.createDataFrame([(x,) for x in lists], "v array<bigint>").coalesce(1)
    for c in CODECS.values():
        began = time.perf_counter()
        got = df.select("v", c.decode(c.encode(F.col("v"))).alias("a"), c.decode_tf(c.encode_tf(F.col("v"))).alias("b")).collect()
        assert all(list(r.v) == list(r.a) == list(r.b) for r in got)
        assert time.perf_counter() - began < 30
