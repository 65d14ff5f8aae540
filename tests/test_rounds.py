from conftest import rows

from keyferry.operators import rounds
from keyferry.sources.tables import with_groups

SCHEMA = "migration_id long, round int, delta_size long, bytes long, converged boolean"


def table(spark, *deltas):
    return spark.createDataFrame(
        [(1, i + 2, d, d, d < 5000) for i, d in enumerate(deltas)], SCHEMA
    )


def outcome(spark, *deltas, upto=None):
    return rows(rounds.precopy_outcome(table(spark, *deltas[:upto])), "outcome", "round")[0]


def test_big_round_stays_small_one_converges(spark):
    assert outcome(spark, 10_000_000, 1000, upto=1) == ("PRE_COPY", 2)
    assert outcome(spark, 10_000_000, 1000) == ("AWAIT_BARRIER", 3)


def test_diverges_at_the_fourth_equal_round_not_the_third(spark):
    assert outcome(spark, *[5_000_000] * 4, upto=3) == ("PRE_COPY", 4)
    assert outcome(spark, *[5_000_000] * 4) == ("DIVERGED", 5)


def test_a_decrease_resets_the_streak(spark):
    assert outcome(spark, 9000, 9000, 8000, 8000, 8000) == ("PRE_COPY", 6)
    assert outcome(spark, 9000, 9000, 8000, 8000, 8000, 8000) == ("DIVERGED", 7)


def test_falling_rounds_stop_at_the_bound(spark):
    assert outcome(spark, *range(20_000, 8_000, -1000)) == ("MAX_ROUNDS", 11)


def test_first_decision_wins(spark):
    assert outcome(spark, 10_000, 10, 10_000, 10_000, 10_000, 10_000) == ("AWAIT_BARRIER", 3)


def test_rounds_copy_all_keys_then_changed_ones(spark):
    import datetime as dt

    day = dt.datetime(2024, 1, 10)
    at = [
        (1, "a", day - dt.timedelta(days=3), 2), (2, "b", day - dt.timedelta(days=2), 2),
        (3, "a", day + dt.timedelta(hours=1), 2), (4, "a", day + dt.timedelta(hours=2), 2),
        (5, "a", day + dt.timedelta(hours=30), 2), (6, "c", day + dt.timedelta(hours=47), 2),
    ]
    ev = spark.createDataFrame(at, "seq long, key string, ts timestamp_ntz, key_group int")
    start = "2024-01-10 00:00:00"
    got = rounds.precopy_rounds(ev, rounds.round_schedule(spark, start, 5))
    # Even groups halve: a day, 12 h, 6 h, 3 h; hour 47 is past the last interval.
    assert rows(got, "round", "delta_size", "bytes", "converged") == [
        (1, 2, 18, False), (2, 1, 9, False), (3, 1, 9, False), (4, 0, 0, True), (5, 0, 0, True)
    ]


def test_as_many_rounds_as_the_schedule_has(spark):
    start = "2024-01-05 00:00:00"
    ev = with_groups(spark.sql(f"select timestamp_ntz'{start}' as ts, 'a' as key"))
    got = rounds.precopy_rounds(ev, rounds.round_schedule(spark, start, 15))
    assert rows(got, "round") == [(i,) for i in sorted(range(1, 16), key=lambda i: repr((i,)))]
