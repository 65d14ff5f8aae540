from conftest import rows, stream

import pytest
from pyspark.sql import functions as F

from keyferry.operators import counts, cutover
from keyferry.operators.integrity import handoff_integrity
from keyferry.scratch import fresh_path, settle
from keyferry.sinks.tables import batch_writer
from keyferry.sources import statestore, streams
from keyferry.sources.tables import records, with_groups
from keyferry.streaming import jobs


def parts(df, *edges):
    bounds = [-1, *edges, 10**12]
    return [df.where((F.col("seq") > a) & (F.col("seq") <= b)) for a, b in zip(bounds, bounds[1:])]


@pytest.fixture(scope="module")
def ev(spark, data):
    return settle(records(spark, data).select("seq", "key"))


def test_running_count_over_batches_and_a_failure(spark, ev):
    """The sink fails in the second batch after writing; the restarted query repeats that batch."""
    inbox = fresh_path(spark, "inbox")
    job = jobs.Job(
        lambda s: jobs.running_counts(streams.file_stream(s, inbox, ev.schema)),
        streams.stream_session(spark), name="running",
    )
    first, second, third = parts(ev, 299, 700)
    streams.land(first, inbox)
    job.run()
    streams.land(second, inbox)
    write = batch_writer(job.output)

    def failing(batch, batch_id):
        write(batch.limit(7), batch_id)
        raise RuntimeError("sink lost")

    with pytest.raises(Exception, match="sink lost"):
        job.run(failing)
    job.run()
    streams.land(third, inbox)
    job.run()
    got = job.result(spark)
    assert got.select("batch_id").distinct().count() == 3
    assert rows(got, "seq", "key", "n") == rows(counts.running_count(ev), "seq", "key", "n")


def move(spark, key, flip, release):
    group = with_groups(spark.createDataFrame([(key,)], "key string"))
    return settle(group.select(
        "key_group", F.col("owner").alias("source"),
        ((F.col("owner") + 1) % 4).cast("int").alias("target"),
        F.lit(flip).cast("long").alias("flip_seq"), F.lit(release).cast("long").alias("release_seq"),
    ))


def run_hold(spark, ev, control, edges, lanes, known=None, last=False, max_bytes=1, update=None):
    """Land the records in four parts and the news of the move, all before the query starts; a bounded
    query takes a file per micro-batch. With ``last``, the news come after the records are processed."""
    data, marks = fresh_path(spark, "data"), fresh_path(spark, "control")
    job = jobs.Job(
        lambda s: jobs.hold_replay(
            with_groups(streams.file_stream(s, data, ev.schema, max_bytes)),
            streams.file_stream(s, marks, control.schema), lanes, known, update,
        ),
        streams.stream_session(spark), name="hold",
    )
    streams.land(control.limit(0) if last else control, marks)
    for part in parts(ev, *edges):
        streams.land(part.coalesce(1), data)
    job.run()
    if last:
        streams.land(control, marks)
        job.run()
    return job


COLUMNS = ["seq", "key", "key_group", "phase", "owner", "effective_seq", "n"]


@pytest.mark.parametrize("news", ["first", "known", "known and last"])
@pytest.mark.parametrize("max_bytes", [1, 10**9])
def test_phases_follow_seq_however_records_come(spark, ev, news, max_bytes):
    cut = move(spark, "7", 400, 700)
    job = run_hold(
        spark, ev, jobs.control_records(cut, 3), [250, 500, 750], 3,
        None if news == "first" else cut, news == "known and last", max_bytes,
    )
    got = job.result(spark)
    if max_bytes == 1:
        assert got.select("batch_id").distinct().count() >= 4
    want = cutover.hold_replay(with_groups(counts.running_count(ev)), cut)
    assert want.where("phase = 'held'").count() > 0
    assert rows(got, *COLUMNS) == rows(want, *COLUMNS)
    check = handoff_integrity(with_groups(ev), got, cut)
    assert check.where("lost > 0 or duplicated > 0 or not cut_clean").count() == 0


def test_records_wait_for_a_release_that_is_not_known(spark):
    """Held in the state over several micro-batches; the release, when it comes, sorts them by seq."""
    ev = stream(spark, ["key-7", "key-8"] * 20)
    open_, released = move(spark, "key-7", 9, None), move(spark, "key-7", 9, 25)
    data, marks = fresh_path(spark, "data"), fresh_path(spark, "control")
    control = jobs.control_records(open_, 1)
    job = jobs.Job(
        lambda s: jobs.hold_replay(
            with_groups(streams.file_stream(s, data, ev.schema, 1)),
            streams.file_stream(s, marks, control.schema), 1,
        ),
        streams.stream_session(spark), name="hold",
    )
    streams.land(control, marks)
    for part in parts(ev, 7, 20, 30):
        streams.land(part.coalesce(1), data)
    job.run()
    assert rows(job.result(spark).where("key = 'key-7'"), "seq") == [(i,) for i in range(0, 10, 2)]
    held = statestore.read_state(job.session, job.checkpoint, variable="held")
    assert held.count() == 15
    streams.land(jobs.control_records(released, 1), marks)
    job.run()
    want = cutover.hold_replay(with_groups(counts.running_count(ev)), released)
    assert rows(job.result(spark), *COLUMNS) == rows(want, *COLUMNS)


@pytest.mark.parametrize("flip, release, cancel", [(9, None, 25), (9, 30, 25), (9, 20, 25), (29, None, 15)])
def test_cancel_gives_the_batch_answer(spark, flip, release, cancel):
    """Nothing of an abandoned move remains; one released before is not abandoned any more."""
    ev = stream(spark, ["key-7", "key-8"] * 20)
    cut = move(spark, "key-7", flip, release).withColumn("cancel_seq", F.lit(cancel).cast("long"))
    out = run_hold(spark, ev, jobs.control_records(cut, 2), [10, 20, 30], 2).result(spark)
    want = cutover.hold_replay(with_groups(counts.running_count(ev)), cut)
    assert rows(out, *COLUMNS) == rows(want, *COLUMNS)
    if release is None or release > cancel:
        source = cut.first()["source"]
        assert out.where("key = 'key-7'").where(F.col("owner") != source).count() == 0


def test_hold_takes_the_users_function(spark):
    ev = stream(spark, ["key-7", "key-8"] * 10).withColumn("value", F.col("seq") * 1.0)
    cut = move(spark, "key-7", 5, 11)
    job = run_hold(
        spark, ev, jobs.control_records(cut, 1), [4, 8, 12], 1, update=lambda n, r: n + int(r.value)
    )
    sums = {r["seq"]: r["n"] for r in job.result(spark).where("key = 'key-7'").collect()}
    assert sums == {s: sum(range(0, s + 1, 2)) for s in range(0, 20, 2)}


def test_users_fold_over_batches(spark, ev):
    inbox = fresh_path(spark, "inbox")
    job = jobs.Job(
        lambda s: jobs.running_fold(
            streams.file_stream(s, inbox, ev.schema, 1),
            lambda state, r: (state[0] + r.seq, max(state[1], r.seq)), "total long, most long", (0, -1),
        ),
        streams.stream_session(spark), name="fold",
    )
    for part in parts(ev, 200, 600):
        streams.land(part.coalesce(1), inbox)
    job.run()
    assert job.result(spark).select("batch_id").distinct().count() == 3
    want = ev.selectExpr(
        "seq", "key", "sum(seq) over (partition by key order by seq) as total", "seq as most"
    )
    assert rows(job.result(spark), "seq", "key", "total", "most") == rows(want)


def test_a_record_out_of_order_fails(spark):
    ev = stream(spark, ["a", "b"] * 5)
    inbox = fresh_path(spark, "inbox")
    job = jobs.Job(
        lambda s: jobs.running_counts(streams.file_stream(s, inbox, ev.schema)),
        streams.stream_session(spark), name="late",
    )
    streams.land(ev.where("seq > 3"), inbox)
    job.run()
    streams.land(ev.where("seq <= 3"), inbox)
    with pytest.raises(Exception, match="came after record"):
        job.run()


def test_partitions_are_those_of_the_checkpoint(spark, ev):
    inbox = fresh_path(spark, "inbox")
    job = jobs.Job(
        lambda s: jobs.running_counts(streams.file_stream(s, inbox, ev.schema)),
        streams.stream_session(spark), name="kept",
    )
    first, second = parts(ev, 500)
    streams.land(first, inbox)
    job.run()
    kept = job.session.conf.get("spark.sql.shuffle.partitions")
    job.session = streams.stream_session(spark)
    job.session.conf.set("spark.sql.shuffle.partitions", str(int(kept) - 1))
    streams.land(second, inbox)
    job.run()
    assert job.session.conf.get("spark.sql.shuffle.partitions") == kept
    assert rows(job.result(spark), "seq", "key", "n") == rows(counts.running_count(ev), "seq", "key", "n")


def test_demo_words_are_a_stream(spark):
    words = streams.word_rate_stream(streams.stream_session(spark), ["red", "green", "blue"])
    assert words.isStreaming and words.columns == ["timestamp", "w"]


def test_an_owner_drops_what_it_has_in_flight(spark):
    """News to a query that already holds records; a move released before, and other owners' ones, go on."""
    ev = stream(spark, [f"key-{i}" for i in range(12)] * 8)
    grouped = with_groups(ev).select("key_group", "owner").distinct().collect()
    moves = [(r["key_group"], r["owner"], (r["owner"] + 1) % 4, 20, 30 if i % 3 == 0 else None) for i, r in enumerate(grouped)]
    cut = settle(spark.createDataFrame(moves, "key_group int, source int, target int, flip_seq long, release_seq long"))
    dropped = settle(cutover.drop_owner(cut, 1, 50))
    named = {r["key_group"]: r["cancel_seq"] for r in dropped.collect()}
    assert {named[m[0]] for m in moves if 1 in m[1:3]} == {50} and {named[m[0]] for m in moves if 1 not in m[1:3]} == {None}
    assert cutover.drop_owner(dropped, 1, 70).where("cancel_seq > 50").count() == 0
    job = run_hold(spark, ev, jobs.control_records(dropped, 2), [20, 40, 60], 2, cut, last=True)
    want = cutover.hold_replay(with_groups(counts.running_count(ev)), dropped)
    assert rows(job.result(spark), "seq", "n") == rows(want.where("n is not null"), "seq", "n")
