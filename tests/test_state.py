import os

import pytest
from conftest import rows

from keyferry.operators import state as st
from keyferry.scratch import fresh_path, settle
from keyferry.sinks import tables as sinks

SCHEMA = "state_name string, key_group int, key string, n long"
ON = st.ENTRY


def table(spark, *entries):
    return spark.createDataFrame([("count", g, k, n) for g, k, n in entries], SCHEMA)


def groups(spark, *numbers):
    return spark.createDataFrame([(g,) for g in numbers], "key_group int")


def three_groups(spark):
    return table(spark, *[(g, f"key-{g}-{i}", g * 100 + i) for g in (3, 7, 9) for i in range(5)])


def test_move_one_group_only(spark):
    source, own = three_groups(spark), table(spark, (2, "target-own", 1))
    moved = st.extract_groups(source, groups(spark, 7)).select(*ON, "n")
    after = st.ingest(own, moved)
    assert after.count() == 6
    assert rows(after.select("key_group").distinct()) == [(2,), (7,)]
    assert rows(st.isolation_check(own, after, groups(spark, 7))) == [(1, 0, 5, 0)]
    assert rows(st.compare(source, three_groups(spark), [*ON, "n"])) == [(15, 15, 0, 0)]


def test_move_through_a_file_and_skip_empty_groups(spark):
    path, target = fresh_path(spark, "export"), fresh_path(spark, "target")
    exported = sinks.write_state(st.extract_groups(three_groups(spark), groups(spark, 7, 8)), path)
    assert exported.count() == 5
    assert [f for f in os.listdir(path) if f.startswith("key_group")] == ["key_group=7"]
    own = sinks.write_state(table(spark, (2, "target-own", 1), (7, "stale", 5)), target)
    sinks.overwrite_groups(exported, target)
    again = sinks.read_state(spark, target, own)
    assert rows(again.groupBy("key_group").count()) == [(2, 1), (7, 5)]


def test_empty_group_exports_nothing(spark):
    assert st.extract_groups(three_groups(spark), groups(spark, 55)).count() == 0


def test_delta_puts_changes_and_deletes_then_is_empty(spark):
    source = table(spark, (7, "a", 1), (7, "b", 2), (7, "c", 3))
    target = table(spark, (7, "b", 0), (7, "c", 3), (7, "z", 9))
    delta = st.state_delta(source, target)
    assert rows(delta, "key", "change") == [
        ("a", "put_new"), ("b", "put_changed"), ("z", "delete")
    ]
    applied = st.apply_delta(target, delta)
    assert st.state_delta(source, applied).count() == 0
    assert rows(st.compare(source, applied, [*ON, "n"])) == [(3, 3, 0, 0)]


def test_delta_keeps_states_of_the_same_key_apart(spark):
    source = spark.createDataFrame([("count", 7, "a", 1), ("recent", 7, "a", 5)], SCHEMA)
    target = spark.createDataFrame([("count", 7, "a", 1), ("recent", 7, "a", 4)], SCHEMA)
    assert rows(st.state_delta(source, target), "state_name", "change") == [
        ("recent", "put_changed")
    ]


def test_replace_is_repeatable_and_deletes_leftovers(spark):
    target = table(spark, (2, "own", 1), (7, "stale", 5))
    moved = table(spark, (7, "a", 1))
    once = st.replace_groups(target, moved, groups(spark, 7))
    twice = st.replace_groups(once, moved, groups(spark, 7))
    want = [("count", 2, "own", 1), ("count", 7, "a", 1)]
    assert rows(once, *ON, "n") == rows(twice, *ON, "n") == want


def test_deletion_counts(spark):
    owned = st.own_state(three_groups(spark))
    assert rows(st.deletion_counts(owned, groups(spark, 7)), "deleted", "remaining") == [(5, 10)]


def test_compare_counts_repeated_rows(spark):
    left = table(spark, (1, "a", 1), (1, "a", 1), (1, "b", 1))
    right = table(spark, (1, "a", 1), (1, "c", 1))
    assert rows(st.compare(left, right, [*ON, "n"])) == [(3, 2, 2, 1)]


def test_lookup_finds_only_the_wanted_keys(spark, data):
    from keyferry.operators.counts import key_counts
    from keyferry.scratch import settle
    from keyferry.sources.tables import records

    state = st.state_snapshot(records(spark, data), 10**9)
    wanted = settle(spark.createDataFrame([("7",), ("nobody",)], "key string"))
    want = key_counts(records(spark, data)).where("key = '7'")
    assert rows(st.state_lookup(state, wanted), "key", "n") == rows(want)


def test_a_null_key_is_a_key(spark):
    source = table(spark, (0, None, 4), (7, "a", 1))
    older = table(spark, (0, None, 3), (7, "a", 1))
    assert st.state_delta(source, source).count() == 0
    assert rows(st.state_delta(source, older), "key", "change", "old_n", "new_n") == [
        (None, "put_changed", 3, 4)
    ]
    for again in (
        st.apply_delta(source, st.state_delta(source, source)),
        st.apply_delta(older, st.state_delta(source, older)),
        st.ingest(source, source),
        st.ingest(older, source),
    ):
        assert rows(again, *ON, "n") == rows(source, *ON, "n")
    assert rows(st.isolation_check(source, source, groups(spark, 7))) == [(2, 0, 0, 0)]
    gone = st.state_delta(table(spark), source)
    assert rows(st.apply_delta(source, gone), "key") == []


def test_lookup_of_a_null_key(spark):
    from keyferry.scratch import settle

    state = table(spark, (0, None, 4), (0, "x", 5))
    wanted = settle(spark.createDataFrame([(None,)], "key string"))
    assert rows(st.state_lookup(state, wanted), "n") == [(4,)]


def test_states_of_several_values(spark):
    schema = "state_name string, key_group int, key string, total double, most long"
    new = spark.createDataFrame([("s", 1, "a", 2.5, None), ("s", 1, "b", 1.0, 3)], schema)
    old = spark.createDataFrame([("s", 1, "a", 2.5, 9), ("s", 1, "c", 1.0, 3)], schema)
    values = ["total", "most"]
    delta = st.state_delta(new, old, values=values)
    assert rows(delta, "key", "change") == [("a", "put_changed"), ("b", "put_new"), ("c", "delete")]
    applied = st.apply_delta(old, delta, values=values)
    assert rows(applied, *ON, *values) == rows(new, *ON, *values)
    assert rows(st.ingest(old, new, values=values), "key", *values) == [
        ("a", 2.5, None), ("b", 1.0, 3), ("c", 1.0, 3)
    ]


def test_the_first_plan_of_a_group_counts(spark):
    plans = spark.createDataFrame([(2, 7, 3), (1, 7, 2)], "plan_id long, key_group int, target int")
    assert rows(st.moved_state(table(spark, (7, "a", 1)), plans), "owner") == [(2,)]


def test_isolation_check_sees_damage(spark):
    own = table(spark, (2, "own", 1), (3, "other", 1))
    damaged = table(spark, (2, "own", 9), (7, "moved", 1), (8, "stray", 1))
    assert rows(st.isolation_check(own, damaged, groups(spark, 7))) == [(0, 2, 1, 1)]


def test_comparison_after_a_wrong_delta_sees_it(spark):
    source, target = table(spark, (7, "a", 1), (7, "b", 2)), table(spark, (7, "b", 1))
    partial = st.state_delta(source, target).where("change = 'put_new'")
    applied = st.apply_delta(target, partial)
    assert st.state_delta(source, applied).count() == 1
    assert rows(st.compare(source, applied, [*ON, "n"]), "left_only", "right_only") == [(1, 1)]


def stored(spark):
    path = fresh_path(spark, "stored")
    return sinks.write_state(three_groups(spark), path), path


def files(spark, path):
    return rows(sinks.folder_files(spark, path))


def test_stored_delta_rewrites_changed_folders_once(spark):
    like, path = stored(spark)
    before = files(spark, path)
    wished = table(spark, (7, "key-7-0", 1), (7, "new", 5), (4, "first", 2), *[(3, f"key-3-{i}", 300 + i) for i in range(5)])
    delta = settle(st.state_delta(wished, three_groups(spark).where("key_group <> 9")), "delta")
    assert sinks.apply_delta(delta, path, like, "d1") == (2, 7)
    after = files(spark, path)
    untouched = lambda all_: [f for f in all_ if f[0] in (3, 9)]
    assert untouched(after) == untouched(before) and {f[0] for f in after} == {3, 4, 7, 9}
    want = rows(wished.unionByName(three_groups(spark).where("key_group = 9")).select(*like.columns))
    assert rows(sinks.read_state(spark, path, like)) == want
    assert sinks.apply_delta(delta, path, like, "d1") == (0, 0)
    assert files(spark, path) == after


def test_stored_delta_can_empty_a_group(spark):
    like, path = stored(spark)
    delta = settle(st.state_delta(three_groups(spark).where("key_group <> 7"), three_groups(spark)), "delta")
    assert sinks.apply_delta(delta, path, like, "gone") == (1, 5)
    assert rows(sinks.read_state(spark, path, like).select("key_group").distinct()) == [(3,), (9,)]


def test_pass_lost_before_its_note_can_be_repeated(spark, monkeypatch):
    like, path = stored(spark)
    wished = three_groups(spark).where("not (key_group = 9 and n > 901)")
    delta = settle(st.state_delta(wished, three_groups(spark)), "delta")
    overwrite = sinks.overwrite_groups

    def lost(moved, to):
        overwrite(moved, to)
        raise RuntimeError("lost")

    monkeypatch.setattr(sinks, "overwrite_groups", lost)
    with pytest.raises(RuntimeError):
        sinks.apply_delta(delta, path, like, "d")
    monkeypatch.undo()
    assert sinks.apply_delta(delta, path, like, "d") == (1, 3)
    assert rows(sinks.read_state(spark, path, like)) == rows(wished.select(*like.columns))
    assert sinks.applied_deltas(spark, path).count() == 1
