from conftest import rows, stream

from pyspark.sql import functions as F

from keyferry.operators import placement
from keyferry.sources.tables import with_groups


def test_owners_hold_contiguous_ranges(spark):
    ranges = placement.owner_ranges(spark)
    assert rows(ranges) == [(0, 0, 31), (1, 32, 63), (2, 64, 95), (3, 96, 127)]
    uneven = placement.owner_ranges(spark, num_groups=10, num_owners=3)
    assert rows(uneven) == [(0, 0, 3), (1, 4, 6), (2, 7, 9)]


def test_every_key_has_one_group_inside_its_owners_range(spark):
    keys = stream(spark, [f"key-{i}" for i in range(500)])
    out = placement.key_group_assign(keys)
    assert out.count() == 500
    assert out.where("key_group not between 0 and 127 or owner <> key_group div 32").count() == 0


def test_singletons_and_sizes_agree(spark):
    keys = stream(spark, [f"key-{i}" for i in range(60) for _ in range(3)])
    sizes = placement.partition_size(keys)
    single = placement.singleton_groups(keys)
    assert single.count() == sizes.where("entries = 1").count()
    assert sizes.agg(F.sum("entries")).first()[0] == 60


def test_plans_take_each_owners_busiest_group(spark):
    keys = stream(spark, [f"key-{i}" for i in range(200)] + ["key-7"] * 50)
    plans = placement.make_plans(keys)
    moved = with_groups(spark.createDataFrame([("key-7",)], "key string")).first()
    assert moved["key_group"] in [r["key_group"] for r in plans.collect()]
    assert plans.where("target <> (source + 1) % 4").count() == 0
    assert plans.count() == 4


def test_equal_plans_differ_only_in_size_and_id(spark):
    plans = spark.createDataFrame(
        [(1, 7, 0, 1, 10), (2, 7, 0, 1, 20), (3, 7, 0, 2, 10)],
        "plan_id long, key_group int, source int, target int, est_bytes long",
    )
    assert rows(placement.distinct_plans(plans)) == [(1, 7, 0, 1, 20), (3, 7, 0, 2, 10)]


def test_two_sources_share_a_third_party(spark):
    plans = spark.createDataFrame(
        [(1, 7, 0, 1), (2, 70, 2, 3)], "plan_id long, key_group int, source int, target int"
    )
    assert rows(placement.shared_target(plans), "key_group", "target") == [(7, 1), (70, 1)]
