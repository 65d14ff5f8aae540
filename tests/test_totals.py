"""Running counts of a stream from totals in tables."""

import random

import pytest
from conftest import rows
from pyspark.errors import StreamingQueryException

from keyferry.operators import counts
from keyferry.scratch import fresh_path
from keyferry.sources import streams
from keyferry.streaming import jobs
from keyferry.streaming.totals import RunningTotals

SCHEMA = "seq long, key string"


def some_records(rng, n):
    return [(i, rng.choice(["hot", "hot", None, None, "a", "b", "c"])) for i in range(n)]


def want(records):
    seen, out = {}, []
    for seq, key in records:
        seen[key] = seen.get(key, 0) + 1
        out.append((seq, key, seen[key]))
    return sorted(out, key=repr)


def start(spark, inbox, **kw):
    job = jobs.Job(
        lambda s: streams.file_stream(s, inbox, SCHEMA, max_bytes=1), streams.stream_session(spark), name="totals"
    )
    return job, RunningTotals(job.output, f"{job.root}/totals", **kw)


def land(spark, inbox, records):
    streams.land(spark.createDataFrame(records, SCHEMA).coalesce(1), inbox)


@pytest.mark.parametrize("kw", [{}, {"hot_rows": 3, "block": 4, "compact": 2}])
def test_counts_go_on_over_batches(spark, kw):
    records, inbox = some_records(random.Random(3), 140), fresh_path(spark, "inbox")
    job, sink = start(spark, inbox, **kw)
    for at in range(0, 140, 20):
        land(spark, inbox, records[at : at + 20])
    job.run(sink)
    assert job.result(spark).select("batch_id").distinct().count() == 7
    assert rows(job.result(spark), "seq", "key", "n") == want(records)


@pytest.mark.parametrize("compact", [1, 2, 16])
@pytest.mark.parametrize("after_totals", [False, True])
def test_repeated_batch_finds_its_own_base(spark, compact, after_totals):
    """The sink fails after its output, or after its totals are written; the batch is repeated."""
    records, inbox = some_records(random.Random(4), 90), fresh_path(spark, "inbox")
    job, sink = start(spark, inbox, compact=compact)
    for at in range(0, 60, 20):
        land(spark, inbox, records[at : at + 20])
    whole_write = sink.write

    def lost(batch, batch_id):
        whole_write(batch, batch_id)
        if batch_id == 2 and not after_totals:
            raise RuntimeError("the sink is lost")

    def failing(batch, batch_id):
        sink.write = lost
        sink(batch, batch_id)
        if batch_id == 2:
            raise RuntimeError("the sink is lost")

    with pytest.raises(StreamingQueryException, match="the sink is lost"):
        job.run(failing)
    sink.write = whole_write
    land(spark, inbox, records[60:])
    job.run(sink)
    assert rows(job.result(spark), "seq", "key", "n") == want(records)


def test_record_out_of_order_fails(spark):
    inbox = fresh_path(spark, "inbox")
    job, sink = start(spark, inbox)
    land(spark, inbox, [(5, "a")])
    land(spark, inbox, [(4, "a")])
    with pytest.raises(StreamingQueryException, match="record 4 of key a came after record 5"):
        job.run(sink)


def test_no_python_in_the_plan(spark):
    inbox = fresh_path(spark, "inbox")
    job, sink = start(spark, inbox)
    land(spark, inbox, some_records(random.Random(5), 40))
    plans, write = [], sink.write

    def noting(batch, batch_id):
        plans.append(batch._jdf.queryExecution().toString())
        write(batch, batch_id)

    sink.write = noting
    job.run(sink)
    assert plans and not any("Python" in p or "Arrow" in p for p in plans)


def test_hot_null_key_is_split(spark):
    records = [(i, None if i % 2 else f"k{i % 5}") for i in range(400)]
    df = spark.createDataFrame(records, SCHEMA)
    counted = counts.running_count(df, hot_rows=50, block=40)
    assert rows(counted, "seq", "key", "n") == want(records)
