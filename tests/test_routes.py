"""Overrides that travel with the records of a stream."""

import random

import pytest
from conftest import rows
from pyspark.errors import StreamingQueryException
from test_routing import brute, random_log

from keyferry.plans import catalogue
from keyferry.scratch import fresh_path
from keyferry.sources import streams
from keyferry.streaming import jobs, routes

RECORDS = "seq long, key_group int, owner int"
SCHEMA = f"{RECORDS}, at_seq long, pos int, target int"


def start(spark, inbox, **kw):
    job = jobs.Job(
        lambda s: streams.file_stream(s, inbox, SCHEMA, max_bytes=1), streams.stream_session(spark), name="routed"
    )
    return job, routes.RoutedStream(job.output, f"{job.root}/routes", **kw)


def land(spark, inbox, records, log):
    made = routes.in_band(spark.createDataFrame(records, RECORDS), spark.createDataFrame(log, routes.OVERRIDES))
    streams.land(made.coalesce(1), inbox)


def some(seed, n, groups=(0, 5, 9)):
    rng = random.Random(seed)
    return [(i, rng.choice(groups), rng.randrange(4)) for i in range(n)], random_log(groups, n, n // 4, seed)


def land_in_parts(spark, inbox, records, log, size):
    for at in range(0, len(records), size):
        mine = [x for x in log if at - 1 <= x[1] < at + size - 1]
        land(spark, inbox, records[at : at + size], mine)


@pytest.mark.parametrize("max_rows", [10_000, 3])
def test_stream_equals_brute_force(spark, max_rows):
    records, log = some(1, 120)
    inbox = fresh_path(spark, "inbox")
    job, sink = start(spark, inbox, max_rows=max_rows)
    land_in_parts(spark, inbox, records, log, 24)
    job.run(sink)
    out = job.result(spark)
    assert out.select("batch_id").distinct().count() == 5
    assert sorted(rows(out, "seq", "owner", "since_seq")) == brute(records, log)
    assert out.where("late").count() == 0 and sink.late_overrides(spark).count() == 0


def test_records_out_of_order_within_the_delay(spark):
    records, log = some(2, 80)
    inbox = fresh_path(spark, "inbox")
    job, sink = start(spark, inbox, delay=40)
    for at in (0, 40):
        land(spark, inbox, records[at + 20 : at + 40], [x for x in log if at - 1 <= x[1] < at + 39])
        land(spark, inbox, records[at : at + 20], [])
    job.run(sink)
    assert sorted(rows(job.result(spark), "seq", "owner", "since_seq")) == brute(records, log)
    assert job.result(spark).where("late").count() == 0


def test_kept_overrides_do_not_grow(spark):
    """Only what can still be asked for is kept: the last override of a group before the watermark."""
    inbox = fresh_path(spark, "inbox")
    job, sink = start(spark, inbox)
    for at in range(0, 40, 10):
        land(spark, inbox, [(i, 5, 0) for i in range(at, at + 10)], [(5, i, 0, i % 4) for i in range(at - 1, at + 9)])
    job.run(sink)
    assert rows(sink.overrides(job.session, 4)) == [(5, 38, 0, 2)]


def test_late_overrides_and_records(spark):
    inbox = fresh_path(spark, "inbox")
    job, sink = start(spark, inbox)
    land(spark, inbox, [(0, 5, 0), (1, 5, 0)], [])
    land(spark, inbox, [(2, 5, 0)], [])
    # Comes after records 1 and 2, which keep their owner; holds from record 3 on.
    land(spark, inbox, [(3, 5, 0), (1, 9, 2)], [(5, 0, 0, 3)])
    land(spark, inbox, [(4, 5, 0)], [(5, 2, 0, 1), (5, 2, 0, 1)])
    job.run(sink)
    got = rows(job.result(spark), "seq", "key_group", "owner", "since_seq", "late")
    assert got == [
        (0, 5, 0, -1, False), (1, 5, 0, -1, False), (1, 9, 2, -1, True),
        (2, 5, 0, -1, False), (3, 5, 3, 0, False), (4, 5, 1, 2, False),
    ]
    assert rows(sink.late_overrides(spark), "key_group", "at_seq", "target", "v") == [
        (5, 0, 3, 2), (5, 2, 1, 3), (5, 2, 1, 3),
    ]


@pytest.mark.parametrize("after_state", [False, True])
def test_repeated_batch_finds_the_overrides_it_began_with(spark, after_state):
    records, log = some(3, 60)
    inbox = fresh_path(spark, "inbox")
    job, sink = start(spark, inbox)
    land_in_parts(spark, inbox, records, log, 20)
    whole = sink.write

    def lost(batch, batch_id):
        whole(batch, batch_id)
        if batch_id == 1 and not after_state:
            raise RuntimeError("the sink is lost")

    def failing(batch, batch_id):
        sink.write = lost
        sink(batch, batch_id)
        if batch_id == 1:
            raise RuntimeError("the sink is lost")

    with pytest.raises(StreamingQueryException, match="the sink is lost"):
        job.run(failing)
    sink.write = whole
    job.run(sink)
    assert sorted(rows(job.result(spark), "seq", "owner", "since_seq")) == brute(records, log)


def test_empty_batches(spark):
    inbox = fresh_path(spark, "inbox")
    job, sink = start(spark, inbox)
    land(spark, inbox, [], [(5, -1, 0, 2)])
    land(spark, inbox, [(0, 5, 0)], [])
    job.run(sink)
    assert rows(job.result(spark), "seq", "owner", "since_seq") == [(0, 2, -1)]


@pytest.mark.parametrize("max_bytes", [1, 1 << 30])
def test_query_equals_the_batch_for_any_bound(spark, data, max_bytes):
    want = rows(catalogue.route_effective(spark, data).select("key_group", "owner", "records", "min_seq", "max_seq"))
    got = catalogue.stream_route_effective(spark, data, max_bytes=max_bytes)
    assert rows(got.select("key_group", "owner", "records", "min_seq", "max_seq")) == want
