import datetime as dt
import random

from conftest import rows

import pytest

from keyferry import schemas
from keyferry.functions import states as S
from keyferry.operators import lifecycle as life
from keyferry.scratch import fresh_path
from keyferry.sources import streams
from keyferry.streaming import jobs

T = dt.datetime(2024, 1, 1)


def log(spark, *migrations):
    """Each migration is ``(id, [(second, kind, {fields}), ...])``."""
    out = []
    for m, steps in migrations:
        for pos, (second, kind, fields) in enumerate(steps):
            f = {"delta_size": None, "bytes": None, "converged": None, "ok": None, "reason": None}
            f.update(fields)
            out.append((
                m, pos, T + dt.timedelta(seconds=second), kind, 5, f["delta_size"], f["bytes"],
                f["converged"], f["ok"], f["reason"],
            ))
    return spark.createDataFrame(out, schemas.EVENT)


PREPARED = [(0, S.PREPARE_SOURCE, {"ok": True}), (1, S.PREPARE_TARGET, {"ok": True}),
            (2, S.START_PRE_COPY, {})]


def round_(second, size, converged, bytes_=None):
    return (second, S.ROUND_COMPLETE,
            {"delta_size": size, "bytes": size if bytes_ is None else bytes_, "converged": converged})


ALIGNED = (20, S.BARRIER_ALIGNED, {})
DONE = (21, S.FINAL_DELTA_COMPLETE, {"ok": True, "delta_size": 256})
FULL = [*PREPARED, round_(5, 10_000_000, False), round_(6, 1000, True), ALIGNED, DONE]


def state(spark, steps, **kw):
    return rows(life.lifecycle(log(spark, (1, steps)), **kw), "state", "reason")[0]


@pytest.fixture(scope="module")
def many(spark):
    """Fixtures by migration, in one log that ends late enough for every timeout."""
    cases = {
        1: FULL,
        2: [*PREPARED, *[round_(5 + i, 5_000_000, False) for i in range(4)]],
        3: [*PREPARED, round_(5, 0, True, 1024), ALIGNED, DONE],
        4: [*PREPARED, round_(5, 0, True), ALIGNED, (21, S.FINAL_DELTA_COMPLETE, {"ok": False})],
        5: [(0, S.START_PRE_COPY, {}), *FULL],
        6: [(0, S.PREPARE_SOURCE, {"ok": True}), (1, S.PREPARE_TARGET, {"ok": False})],
        7: [(0, S.PREPARE_SOURCE, {"ok": True}), (45, S.PREPARE_TARGET, {"ok": True})],
        8: [*PREPARED, round_(5, 10, False), (6, S.ABORT, {"reason": "requested"}), ALIGNED],
        9: [*PREPARED, (4, S.BARRIER_ALIGNED, {}), round_(5, 0, True), ALIGNED, DONE],
        10: [*PREPARED, round_(5, 0, True), (80, S.BARRIER_ALIGNED, {}), (81, S.ABORT, {})],
        11: [(0, S.ABORT, {}), (1, S.BARRIER_ALIGNED, {}), round_(2, 0, True)],
        12: [*PREPARED, *[round_(5 + i, 100 - i, False) for i in range(12)]],
        13: [*PREPARED, round_(5, 9, False), round_(310, 0, True)],
        14: [*FULL[:-1], (95, S.FINAL_DELTA_COMPLETE, {"ok": True, "delta_size": 1})],
        15: [*[round_(0, 7, False)] * 3, *PREPARED, *[round_(5 + i, 50 - i, False) for i in range(9)]],
        16: [*[(0, S.PREPARE_SOURCE, {"ok": True})], *[round_(1, 7, False)] * 4,
             (2, S.PREPARE_TARGET, {"ok": True}), *[round_(5 + i, 50 - i, False) for i in range(9)]],
        17: [*FULL, (30, S.ABORT, {"reason": "too late"}), round_(31, 5, False)],
        18: [(399, S.PREPARE_SOURCE, {"ok": True}), (400, S.PREPARE_TARGET, {"ok": True})],
    }
    return log(spark, *cases.items())


WANT = {
    1: ("COMMITTED", None),
    2: ("ABORTED", "divergence"),
    3: ("COMMITTED", None),
    4: ("ABORTED", "final delta failed"),
    5: ("COMMITTED", None),
    6: ("ABORTED", "prepare failed"),
    7: ("ABORTED", "timeout INIT"),
    8: ("ABORTED", "requested"),
    9: ("COMMITTED", None),
    10: ("ABORTED", "timeout AWAIT_BARRIER"),
    12: ("ABORTED", "maximum rounds"),
    13: ("ABORTED", "timeout PRE_COPY"),
    14: ("ABORTED", "timeout FINALIZING"),
    15: ("ABORTED", "timeout PRE_COPY"),
    16: ("ABORTED", "maximum rounds"),
    17: ("COMMITTED", None),
    18: ("PRE_COPY", None),
}


@pytest.fixture(scope="module")
def walked(many):
    return life.lifecycle(many)


def test_every_fixture_ends_where_it_should(walked):
    got = {r["migration_id"]: (r["state"], r["reason"]) for r in walked.collect()}
    assert got == WANT


def test_many_migrations_take_the_shuffled_way(many, walked):
    assert rows(life.lifecycle(many, max_rows=3)) == rows(walked)


def test_big_round_alone_stays_in_pre_copy(spark):
    assert state(spark, FULL[:4]) == ("PRE_COPY", None)
    assert state(spark, FULL[:5]) == ("AWAIT_BARRIER", None)
    assert state(spark, FULL[:6]) == ("FINALIZING", None)


def test_own_limits(spark):
    strict = {"AWAIT_BARRIER": 5}
    assert state(spark, FULL, timeouts=strict) == ("ABORTED", "timeout AWAIT_BARRIER")


def test_timeouts_say_how_late(walked):
    got = {r["migration_id"]: (r["state"], r["overdue_s"]) for r in life.timeouts(walked).collect()}
    assert got[7] == ("INIT", 15) and got[10] == ("AWAIT_BARRIER", 15)
    assert got[13] == ("PRE_COPY", 9) and got[14] == ("FINALIZING", 15)


def test_metrics(many, walked):
    got = {r["migration_id"]: r for r in life.migration_metrics(many, walked).collect()}
    one, three, eight = got[1], got[3], got[8]
    assert (one["rounds"], one["bytes"], one["last_delta"]) == (2, 10_001_256, 1000)
    assert (one["duration_s"], one["barrier_injected"], one["final_delta_sent"]) == (21, True, True)
    assert (three["rounds"], three["bytes"], three["last_delta"]) == (1, 1280, 0)
    assert (eight["rounds"], eight["barrier_injected"], eight["final_delta_sent"]) == (1, False, False)
    assert got[17]["rounds"] == 2 and got[16]["rounds"] == 10
    assert got[18]["duration_s"] == 1


def test_illegal_requests_are_reported(many, walked):
    got = {tuple(r)[:3] for r in life.invalid_transitions(many, walked).collect()}
    assert (5, "IDLE", "PRE_COPY") in got
    assert (9, "PRE_COPY", "FINALIZING") in got
    assert (8, "ABORTED", "FINALIZING") in got
    assert (17, "COMMITTED", "ABORTED") in got
    assert not any(m == 1 for m, _, _ in got)


def test_transition_table_and_predicates(spark):
    legal = [("IDLE", "INIT"), ("INIT", "PRE_COPY"), ("PRE_COPY", "AWAIT_BARRIER"),
             ("AWAIT_BARRIER", "FINALIZING"), ("FINALIZING", "COMMITTED"), ("INIT", "ABORTED"),
             ("PRE_COPY", "ABORTED"), ("AWAIT_BARRIER", "ABORTED"), ("FINALIZING", "ABORTED")]
    every = [(a, b) for a in S.STATES for b in S.STATES]
    from pyspark.sql import functions as F

    table = spark.createDataFrame(every, "a string, b string")
    allowed = table.where(S.is_legal_move(F.col("a"), F.col("b")))
    assert rows(allowed) == sorted(legal)
    flags = {r[0]: tuple(r)[1:] for r in S.state_table(spark).collect()}
    assert flags["IDLE"] == (False, False, False)
    assert flags["PRE_COPY"] == flags["AWAIT_BARRIER"] == (False, True, True)
    assert flags["INIT"] == flags["FINALIZING"] == (False, True, False)
    assert flags["COMMITTED"] == flags["ABORTED"] == (True, False, False)


def test_active_counts(walked):
    got = {r["state"]: r["migrations"] for r in life.active_migrations(walked).collect()}
    assert got["PRE_COPY"] == 1 and got["IDLE"] == 0
    assert sum(got.values()) == len(WANT)


def test_admission_refuses_second_and_running_plans(spark):
    requests = spark.createDataFrame(
        [(0, 5), (1, 5), (2, 7), (3, 9), (4, 7)], "pos long, key_group int"
    )
    active = spark.createDataFrame([(9,)], "key_group int")
    assert rows(life.admit_plans(requests, active)) == [
        (0, 5, True, 1), (1, 5, False, None), (2, 7, True, 2), (3, 9, False, None),
        (4, 7, False, None),
    ]


def streamed(spark, table, batches):
    """Final states by the stateful processor, the log arriving in parts by time."""
    inbox = fresh_path(spark, "events")
    job = jobs.Job(
        lambda s: jobs.lifecycles(streams.file_stream(s, inbox, schemas.EVENT)),
        streams.stream_session(spark), name="lifecycle",
    )
    edges = [-1, *batches, 10_000]
    for low, high in zip(edges, edges[1:]):
        part = table.where(
            (table.at_ts > T + dt.timedelta(seconds=low))
            & (table.at_ts <= T + dt.timedelta(seconds=high))
        )
        streams.land(part, inbox)
        job.run()
    last = {}
    for r in sorted(job.result(job.session).collect(), key=lambda r: r["step"]):
        last[r["migration_id"]] = (r["state"], r["reason"])
    return last


@pytest.mark.parametrize("batches", [[], [3, 40]])
def test_stream_agrees_with_batch(spark, many, batches):
    assert streamed(spark, many, batches) == WANT


def test_random_logs_agree_between_stream_and_batch(spark):
    r = random.Random(11)
    kinds = [S.PREPARE_SOURCE, S.PREPARE_TARGET, S.START_PRE_COPY, S.ROUND_COMPLETE,
             S.ROUND_COMPLETE, S.ROUND_COMPLETE, S.BARRIER_ALIGNED, S.FINAL_DELTA_COMPLETE]
    cases = []
    for m in range(150):
        at, steps = 0, list(PREPARED) if r.random() < 0.7 else []
        at = 3 if steps else 0
        for _ in range(r.randrange(3, 22)):
            at += r.choice([1, 2, 5, 25, 70])
            kind = S.ABORT if r.random() < 0.03 else r.choice(kinds)
            fields = {}
            if kind == S.ROUND_COMPLETE:
                fields = {"delta_size": r.randrange(6), "bytes": 1, "converged": r.random() < 0.2}
            elif kind in (S.PREPARE_SOURCE, S.PREPARE_TARGET, S.FINAL_DELTA_COMPLETE):
                fields = {"ok": r.random() < 0.85}
            steps.append((at, kind, fields))
        cases.append((m, steps))
    table = log(spark, *cases)
    batch = {x["migration_id"]: (x["state"], x["reason"]) for x in life.lifecycle(table).collect()}
    assert streamed(spark, table, []) == batch
    assert len(set(batch.values())) >= 6


def greedy(requests):
    """Admit in order what its group is free for; number the admitted by position."""
    free, admitted = {}, set()
    for pos, group, at, until in sorted((r for r in requests if r[2] is not None), key=lambda r: (r[2], r[0])):
        if group not in free or (free[group] is not None and at >= free[group]):
            admitted.add(pos)
            free[group] = None if until is None else max(at, until)
    number = {pos: i for i, pos in enumerate(sorted(admitted), 1)}
    return sorted([(pos, g, pos in admitted, number.get(pos)) for pos, g, _, _ in requests], key=repr)


def asked(spark, requests):
    at = lambda s: None if s is None else T + dt.timedelta(seconds=s)
    return spark.createDataFrame(
        [(pos, g, at(a), at(z)) for pos, g, a, z in requests],
        "pos long, key_group int, at_ts timestamp_ntz, until_ts timestamp_ntz",
    )


@pytest.mark.parametrize("ranges", [1, 5, 256])
def test_admission_over_time_is_greedy(spark, ranges):
    """Ties, ends at a request's time, ends before their begin, moves without end, requests without time."""
    rng = random.Random(ranges)
    requests = []
    for pos in rng.sample(range(1_000), 300):
        at = None if rng.random() < 0.02 else rng.randint(0, 120)
        until = None if rng.random() < 0.01 else (at or 0) + rng.choice([-3, 0, 0, 1, 2, 5, 30])
        requests.append((pos, rng.choice([1, 1, 1, 2, None, None, rng.randint(3, 40)]), at, until))
    got = life.admit_over_time(asked(spark, requests), ranges)
    assert rows(got) == greedy(requests)
    assert sum(r[2] for r in greedy(requests)) > 60


def test_a_long_chain_of_admissions(spark):
    requests = [(i, 7, i, i + 2) for i in range(500)]
    got = life.admit_over_time(asked(spark, requests), 8)
    assert rows(got.where("admitted"), "pos") == sorted([(i,) for i in range(0, 500, 2)], key=repr)


def test_no_requests(spark):
    assert life.admit_over_time(asked(spark, [])).count() == 0
