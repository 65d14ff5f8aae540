import random

from conftest import rows, stream

from pyspark.sql import functions as F

from keyferry import schemas
from keyferry.operators import counts, routing
from keyferry.plans import inputs
from keyferry.sources.tables import records, with_groups

LOG = "key_group int, at_seq long, pos int, target int"


def current(spark, log):
    out = routing.route_current(spark.createDataFrame(log, LOG))
    return {r["key_group"]: r["owner"] for r in out.collect()}


def test_default_override_and_clear(spark):
    owner = current(spark, [(42, 5, 0, 3)])
    assert owner[42] == 3 and owner[99] == 3 and owner[0] == 0
    assert current(spark, [(42, 5, 0, 3), (42, 9, 0, None)])[42] == 1


def barrier(migration_id, final, at, *plans):
    return (migration_id, final, at, [dict(zip(("key_group", "source", "target"), p)) for p in plans])


def test_barriers_install_plans_and_final_ones_do_not(spark):
    import datetime as dt

    t = dt.datetime(2024, 1, 1)
    rows_ = [
        barrier(1, False, t, (42, 0, 2), (7, 0, 1), (42, 0, 3)),
        barrier(2, False, t + dt.timedelta(1), (7, 1, 2)),
        barrier(3, True, t + dt.timedelta(2)),
        barrier(4, True, t + dt.timedelta(3), (9, 0, 1)),
    ]
    made = spark.createDataFrame(rows_, schemas.BARRIER)
    assert rows(routing.overrides_from_barriers(made)) == [(42, 3, 1), (7, 2, 2)]


def test_flip_is_in_band(spark):
    """Six records before the flip stay at the source, the next six go to the target."""
    moved = stream(spark, ["k"] * 12).withColumn("key_group", F.lit(5)).withColumn("owner", F.lit(0))
    log = spark.createDataFrame([(5, 5, 0, 2)], LOG)
    out = routing.route_effective(moved, log)
    assert rows(out.where("owner = 0"), "seq") == [(i,) for i in range(6)]
    assert out.where("owner = 2").agg(F.min("seq"), F.max("seq")).first() == (6, 11)


def random_log(groups, last_seq, n, seed=7):
    r = random.Random(seed)
    out = set()
    while len(out) < n:
        out.add((r.choice(groups), r.randrange(-1, last_seq), r.randrange(3)))
    return [(g, s, p, r.choice([None, 0, 1, 2, 3])) for g, s, p in sorted(out)]


def brute(records_, log):
    out = []
    for seq, group, owner in records_:
        known = [(s, p, t) for g, s, p, t in log if g == group and s < seq]
        since, _, target = max(known, key=lambda x: x[:2]) if known else (-1, 0, None)
        out.append((seq, owner if target is None else target, since))
    return sorted(out)


def test_both_ways_to_route_agree_with_brute_force(spark, data):
    ev = with_groups(records(spark, data).select("seq", "key")).where("seq < 400")
    plain = [tuple(r) for r in ev.select("seq", "key_group", "owner").collect()]
    log = random_log(sorted({g for _, g, _ in plain}), 400, 150)
    table = spark.createDataFrame(log, LOG)
    want = brute(plain, log)
    small = routing.route_effective(ev, table)
    large = routing.route_effective(ev, table, max_rows=10, block=64)
    assert sorted(tuple(r) for r in small.select("seq", "owner", "since_seq").collect()) == want
    assert sorted(tuple(r) for r in large.select("seq", "owner", "since_seq").collect()) == want


def test_a_long_log_is_routed_right_and_without_a_shuffle(spark, data):
    """Two years of daily overrides of one group, cut in few or many pieces."""
    ev = with_groups(records(spark, data).select("seq", "key")).where("seq < 800")
    plain = [tuple(r) for r in ev.select("seq", "key_group", "owner").collect()]
    group = plain[0][1]
    log = random_log([group], 800, 730, seed=3) + random_log([g for _, g, _ in plain[:3]], 800, 20)
    table = spark.createDataFrame(sorted(set(log), key=repr), LOG).dropDuplicates(["key_group", "at_seq", "pos"])
    want = brute(plain, [tuple(r) for r in table.collect()])
    for pieces in (1, 7, 1024):
        out = routing.route_effective(ev, table, pieces=pieces)
        assert "Exchange hashpartitioning" not in out._jdf.queryExecution().toString()
        assert sorted(tuple(r) for r in out.select("seq", "owner", "since_seq").collect()) == want


def test_each_owner_has_its_own_partitions(spark, data):
    ev = with_groups(records(spark, data).select("seq", "key"))
    one = routing.physical_route(ev)
    assert one.where(F.spark_partition_id() != F.col("owner")).count() == 0
    four = routing.physical_route(ev, lanes=4, spread=F.col("seq"))
    assert four.where(F.floor(F.spark_partition_id() / 4) != F.col("owner")).count() == 0
    assert rows(routing.routed_partitions(four), "owner", "partitions") == [(i, 4) for i in range(4)]


def test_serving_needs_range_or_hosting(spark):
    routed = spark.createDataFrame(
        [(0, 5), (1, 5), (1, 6), (1, 40)], "owner int, key_group int"
    )
    hosted = spark.createDataFrame([(1, 5)], "owner int, key_group int")
    assert rows(routing.serve_check(routed, hosted)) == [(0, 1, 0, 0), (1, 1, 1, 1)]


def test_last_counts_follow_the_owner(spark):
    routed = spark.createDataFrame(
        [("k", 0, 0, -1), ("k", 1, 1, 0), ("k", 2, 0, 1), ("k", 3, 0, 1)],
        "key string, seq long, owner int, since_seq long",
    )
    assert rows(counts.last_count_by_owner(routed)) == [(0, "k", 4, 3), (1, "k", 2, 1)]


def test_clearing_all_gives_a_row_per_group(spark, data):
    log = inputs.override_log(inputs.barriers(spark, data))
    groups = log.select("key_group").distinct().count()
    clears = log.where("pos = -1").groupBy("at_seq").count()
    assert [r["count"] for r in clears.collect()] == [groups] * clears.count()
    assert rows(routing.clear_overrides(log, 9).groupBy("at_seq").count()) == [(9, groups)]
