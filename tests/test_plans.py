"""What the physical plans must and must not contain."""

import contextlib
import io

import pytest

from keyferry.operators import counts, routing, state as st
from keyferry.plans import catalogue, inputs
from keyferry.scratch import fresh_path
from keyferry.sinks import tables as sinks
from keyferry.sources.tables import records, with_groups


def plan(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def exchanges(text: str) -> int:
    return text.split("===")[0].count("Exchange hashpartitioning")


@pytest.mark.parametrize(
    "name", ["word_count", "owner_load", "precopy_rounds", "route_effective", "handoff_integrity"]
)
def test_batch_plans_stay_in_the_jvm(spark, data, name):
    text = plan(catalogue.QUERIES[name](spark, data))
    assert "Python" not in text and "Pandas" not in text
    assert "CartesianProduct" not in text


def test_cut_reaches_the_scan(spark, data):
    text = plan(st.state_snapshot(records(spark, data), 100))
    assert "PushedFilters: [IsNotNull(event_id), LessThanOrEqual(event_id,100)]" in text
    assert "ReadSchema: struct<event_id:bigint,user_id:bigint>" in text


def test_routing_does_not_shuffle_records(spark, data):
    log = inputs.override_log(inputs.barriers(spark, data))
    text = plan(routing.route_effective(with_groups(records(spark, data)), log))
    assert "BroadcastHashJoin" in text and "Exchange hashpartitioning" not in text


def test_running_count_shuffles_once(spark, data):
    text = plan(counts.running_count(records(spark, data).select("seq", "key")))
    assert text.count("Exchange (") <= 2  # once in the tree, once in its details


def test_extracting_a_group_reads_only_its_folder(spark, data):
    b = inputs.bounds(spark, data)
    path = fresh_path(spark, "state")
    table = sinks.write_state(st.state_snapshot(records(spark, data), b.flip_seq), path)
    one = plan(table.where("key_group = 7"))
    assert "PartitionFilters: [isnotnull(key_group" in one
    moved = plan(st.extract_groups(table, inputs.plans(spark, data)))
    assert "dynamicpruning" in moved


def test_moving_groups_are_picked_before_the_shuffle(spark, data):
    b, groups = inputs.bounds(spark, data), inputs.plans(spark, data)
    tree = plan(st.state_snapshot(records(spark, data), b.flip_seq, groups=groups))
    tree = tree.split("===")[-1] if "Physical Plan" not in tree else tree
    lines = tree.splitlines()
    join = next(i for i, line in enumerate(lines) if "BroadcastHashJoin LeftSemi" in line)
    shuffle = next(i for i, line in enumerate(lines) if "Exchange (" in line and "Broadcast" not in line)
    assert shuffle < join  # the tree is printed from the top


def test_lookup_reads_only_the_keys_folders(spark, data):
    from keyferry.scratch import settle

    b = inputs.bounds(spark, data)
    path = fresh_path(spark, "state")
    state = sinks.write_state(st.state_snapshot(records(spark, data), b.flip_seq), path)
    wanted = settle(spark.createDataFrame([("7",)], "key string"))
    assert "dynamicpruning" in plan(st.state_lookup(state, wanted))
