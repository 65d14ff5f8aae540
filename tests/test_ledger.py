"""States and changes as of a record, for any bound of a micro-batch; hand-off of any state."""

import duckdb
import pytest
from conftest import DATA, rows, stream
from pyspark.sql import functions as F

from keyferry.operators import rounds
from keyferry.plans import catalogue
from keyferry.plans.oracles import ORACLES
from keyferry.scratch import fresh_path, settle
from keyferry.sources import statestore, streams
from keyferry.streaming import jobs


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{DATA}/events.parquet'")
    return con


def equals_sql(duck, name, out):
    columns = sorted(out.columns)
    got = sorted((tuple(r) for r in out.select(*columns).collect()), key=repr)
    result = duck.execute(ORACLES[name])
    names = [c[0] for c in result.description]
    return got == sorted((tuple(r[names.index(c)] for c in columns) for r in result.fetchall()), key=repr)


@pytest.mark.parametrize(
    "name", ["phase_stream", "state_from_checkpoint", "state_change_feed", "precopy_from_changes"]
)
def test_any_number_of_micro_batches(spark, data, duck, name):
    out = getattr(catalogue, name)(spark, data, max_bytes=1, files=3)
    assert equals_sql(duck, name, out)


@pytest.mark.parametrize("name", ["state_handoff_fold", "state_all_variables"])
def test_held_state_over_micro_batches(spark, data, duck, name):
    out = getattr(catalogue, name)(spark, data, max_bytes=1, parts=2)
    assert equals_sql(duck, name, out)


def test_rounds_of_the_feed_are_those_of_the_scan(spark, data):
    """The same rounds by a scan: both use one schedule of five daily rounds for all groups."""
    from keyferry.plans.inputs import bounds
    from keyferry.sources.tables import records, with_groups

    b = bounds(spark, data)
    daily = rounds.round_schedule(spark, b.midpoint, catalogue.FEED_ROUNDS).where("schedule = 1").drop("schedule")
    both = daily.withColumn("schedule", F.explode(F.array(F.lit(0), F.lit(1))))
    ev = with_groups(records(spark, data).select("seq", "ts", "key"))
    want = rounds.precopy_rounds(ev, both)
    got = catalogue.precopy_from_changes(spark, data)
    assert rows(got, *sorted(got.columns)) == rows(want, *sorted(got.columns))


def test_ledger_knows_only_marked_records(spark):
    ev, inbox = stream(spark, ["a", "b", None] * 4), fresh_path(spark, "inbox")
    job = jobs.Job(
        lambda s: jobs.key_counts(streams.file_stream(s, inbox, ev.schema, 1)),
        streams.stream_session(spark), "update", "marked",
    )
    assert job.mark(-1) == -1
    phases = [(3, ev.where("seq <= 3")), (5, ev.where("seq > 3 and seq <= 5")), (9, ev.where("seq > 5 and seq <= 9"))]
    jobs.run_phases(job, phases, inbox, files=2)
    assert job.batch_at(3) < job.batch_at(5) < job.batch_at(9)
    state = statestore.read_state(job.session, job.checkpoint, job.batch_at(5))
    assert rows(state, "key.key", "value.count") == [("a", 2), ("b", 2), (None, 2)]
    with pytest.raises(ValueError, match="record 4"):
        job.batch_at(4)


def test_latest_change_wins_and_deletions_stay(spark):
    feed = spark.createDataFrame(
        [(0, "update", "a", 1), (1, "update", "a", 2), (1, "update", "b", 5), (2, "delete", "b", 5),
         (2, "update", None, 7), (0, "delete", "c", 1), (3, "update", "c", 9)],
        "batch_id long, change_type string, key string, n long",
    )
    got = rounds.latest_changes(feed, ["key"], ["n"])
    assert rows(got) == [("a", False, 2), ("b", True, None), ("c", False, 9), (None, False, 7)]
    changes = feed.withColumn("round", F.when(F.col("batch_id") < 2, 1).otherwise(2))
    sizes = rounds.rounds_from_changes(changes, 2, num_groups=1).sort("round").collect()
    assert [(r["round"], r["delta_size"]) for r in sizes] == [(1, 3), (2, 3)]


def test_fold_starts_from_a_moved_state(spark):
    ev, inbox = stream(spark, ["a", "b"] * 4), fresh_path(spark, "inbox")
    initial = settle(spark.createDataFrame([("a", 100, 50), ("z", 1, 1)], "key string, total long, most long"))
    job = jobs.Job(
        lambda s: jobs.running_fold(
            streams.file_stream(s, inbox, ev.schema), lambda v, r: (v[0] + r.seq, max(v[1], r.seq)),
            "total long, most long", (0, -1), initial,
        ),
        streams.stream_session(spark), name="seeded",
    )
    streams.land(ev, inbox)
    job.run()
    last = {r["key"]: (r["total"], r["most"]) for r in job.result(spark).sort("seq").collect()}
    assert last == {"a": (112, 50), "b": (16, 7)}


def test_variables_come_from_the_checkpoint(spark):
    ev, inbox = stream(spark, ["a", "b"]), fresh_path(spark, "inbox")
    session = streams.stream_session(spark)
    counted = jobs.Job(
        lambda s: jobs.key_counts(streams.file_stream(s, inbox, ev.schema)), session, "update", "plain"
    )
    streams.land(ev, inbox)
    counted.run()
    assert statestore.variables(session, counted.checkpoint) == [(0, None)]
    every = statestore.read_variables(session, counted.checkpoint)
    assert rows(every, "key", "value") == [('{"key":"a"}', '{"count":1}'), ('{"key":"b"}', '{"count":1}')]


def test_losses_and_repeats_over_micro_batches(spark, data, duck):
    out = catalogue.stream_handoff_integrity(spark, data, max_bytes=1, parts=3)
    assert equals_sql(duck, "stream_handoff_integrity", out)


def test_a_loss_is_reported_once_and_a_stray_is_told(spark):
    at = lambda s: f"timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, {s})"
    sent = spark.range(10).selectExpr("id as seq", "'k' as key", f"{at('cast(id as int)')} as ts")
    done = sent.select("seq", "ts").where("seq <> 4")
    stray = spark.range(1).selectExpr("99L as seq", f"{at('3')} as ts")
    end = spark.range(1).selectExpr("-1L as seq", "cast(null as string) as key", f"{at('90000')} as ts")
    left, right = fresh_path(spark, "left"), fresh_path(spark, "right")
    job = jobs.Job(
        lambda s: jobs.reconcile(
            streams.file_stream(s, left, sent.schema), streams.file_stream(s, right, done.schema)
        ),
        streams.stream_session(spark), name="loss",
    )
    streams.land(sent, left)
    streams.land(done.unionByName(stray), right)
    job.run()
    assert rows(job.result(spark), "seq", "status") == sorted([(i, "done") for i in range(10) if i != 4], key=repr)
    for _ in range(2):
        streams.land(end, left)
        streams.land(end.select("seq", "ts"), right)
        job.run()
    late = job.result(spark).where("status <> 'done' and seq >= 0")
    assert rows(late, "seq", "status") == [(4, "lost"), (99, "stray")]
