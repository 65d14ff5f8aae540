import datetime as dt

from conftest import rows

from keyferry import schemas
from keyferry.operators import barriers as bar
from keyferry.scratch import settle

T = dt.datetime(2024, 1, 1)


def plan(group, source, target):
    return {"key_group": group, "source": source, "target": target}


def test_barriers_survive_write_and_read_in_order(spark):
    made = spark.createDataFrame(
        [(42, False, T, [plan(7, 0, 1), plan(9, 2, 3)]), (5, True, T, [])], schemas.BARRIER
    )
    back = settle(made)
    assert back.schema == made.schema
    plans = {r["migration_id"]: [p["key_group"] for p in r["plans"]] for r in back.collect()}
    assert plans == {42: [7, 9], 5: []}


def test_event_rows_survive_write_and_read(spark):
    made = spark.createDataFrame(
        [(1, 0, T, "PreCopyRoundComplete", 5, 10, 100, False, None, None)], schemas.EVENT
    )
    assert rows(settle(made)) == rows(made)


def arrivals(spark, *seen):
    return spark.createDataFrame(
        [(1, t, c, T + dt.timedelta(seconds=s)) for t, c, s in seen], schemas.ARRIVAL
    )


def expected(spark):
    return spark.createDataFrame(
        [(1, t, 2) for t in range(4)], "migration_id long, task int, expected long"
    )


def test_one_of_two_channels_is_not_aligned(spark):
    seen = arrivals(spark, *[(t, "left", t) for t in range(4)])
    out = bar.barrier_alignment(expected(spark), seen)
    assert rows(out, "received", "aligned", "aligned_at") == [(1, False, None)] * 4
    assert rows(bar.migration_ready(out, 4)) == [(1, 0, False)]


def test_both_channels_align_at_the_later_one(spark):
    seen = arrivals(
        spark, *[(t, c, 10 * t + i) for t in range(4) for i, c in enumerate(["left", "right"])],
        (0, "left", 99),
    )
    out = bar.barrier_alignment(expected(spark), seen)
    times = [T + dt.timedelta(seconds=10 * t + 1) for t in range(4)]
    assert sorted(r["aligned_at"] for r in out.collect()) == times
    assert rows(bar.barrier_arrivals(seen), "channels_seen") == [(2,)] * 4
    assert rows(bar.migration_ready(out, 4)) == [(1, 4, True)]


def test_a_missing_task_keeps_the_migration_waiting(spark):
    seen = arrivals(spark, *[(t, c, 0) for t in range(3) for c in ("left", "right")])
    three = expected(spark).where("task < 3")
    assert rows(bar.migration_ready(bar.barrier_alignment(three, seen), 4)) == [(1, 3, False)]


def test_fan_out_by_part_of_the_name(spark):
    tasks = spark.createDataFrame(
        [("Source: orders-source (1/1)#0",), ("count (1/2)#0",), ("count (2/2)#0",)], "task string"
    )
    parts = spark.createDataFrame(
        [(99, "orders-source"), (100, "count"), (101, "sink")], "migration_id long, name_part string"
    )
    assert rows(bar.barrier_fanout(parts, tasks)) == [(100, 2), (101, 0), (99, 1)]


def test_first_plan_listed_counts(spark):
    made = spark.createDataFrame(
        [(1, False, T, [plan(7, 0, 1), plan(7, 0, 2), plan(9, 2, 3)])], schemas.BARRIER
    )
    assert rows(bar.plan_for_partition(made)) == [(1, 7, 0, 1), (1, 9, 2, 3)]


def test_touched_and_untouched_records_split_the_stream(spark):
    made = spark.createDataFrame([(1, False, T, [plan(7, 0, 1)])], schemas.BARRIER)
    ev = spark.createDataFrame([(i, i % 10) for i in range(100)], "seq long, key_group int")
    assert bar.affected_records(ev, made).count() == 10
    assert bar.unaffected_records(ev, made).count() == 90
