from conftest import rows

import pytest
from pyspark.sql import functions as F

from keyferry import scratch


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_equals_broadcast_join(spark, how):
    big = spark.range(900).select(
        F.col("id").alias("seq"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).alias("k")
    )
    small = scratch.settle(spark.range(0, 40).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v")))
    one = scratch.lookup_join(big, small, ["k"], F.col("seq"), how)
    other = scratch.lookup_join(big, small, ["k"], F.col("seq"), how, max_rows=5, salts=4)
    assert rows(one) == rows(other)


def test_tables_are_settled_in_the_sessions_shared_folder(spark):
    shared = spark.conf.get("spark.checkpoint.dir")
    assert scratch.scratch_root(spark) == shared
    three = scratch.settle(spark.range(3), "three")
    assert all(shared in f for f in three.inputFiles()) and three.count() == 3


@pytest.mark.parametrize("max_rows", [100, 1])
def test_null_keys_meet_if_asked(spark, max_rows):
    big = spark.createDataFrame([(1, "a"), (2, None), (3, None), (4, "z")], "seq long, key string")
    small = scratch.settle(spark.createDataFrame([("a", 10), (None, 20)], "key string, v long"))
    join = lambda **kw: rows(scratch.lookup_join(big, small, ["key"], F.col("seq"), "left", max_rows, **kw))
    assert join(nulls_match=True) == sorted([(1, "a", 10), (2, None, 20), (3, None, 20), (4, "z", None)], key=repr)
    assert rows(scratch.lookup_join(big, small, ["key"], F.col("seq"), "left", max_rows).where("v is not null"), "v") == [(10,)]
