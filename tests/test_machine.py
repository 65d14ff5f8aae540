"""State machines over given rows, against a plain loop."""

import random

import pytest
from conftest import rows

from keyferry.functions import states as S
from keyferry.operators import machine as mc

LIGHT = mc.Machine(
    ("red", "green", "yellow", "off"),
    (("red", "go", "green"), ("green", "slow", "yellow"), ("yellow", "stop", "red"),
     ("red", "break", "off"), ("green", "break", "off"), ("off", "mend", "red"), ("green", "go", "green")),
)


def plain(machine, log):
    moves = {(a, e): b for a, e, b in machine.moves}
    out = {}
    for seq, entity, event in sorted(log, key=lambda r: r[0]):
        state, n, refused, changed = out.get(entity, (machine.states[0], 0, 0, None))
        to = moves.get((state, event))
        if to is not None and to != state:
            changed = seq
        out[entity] = (to or state, n + 1, refused + (to is None), changed)
    return sorted([(e, *v) for e, v in out.items()], key=repr)


def some_log(rng, n, entities):
    events = [*LIGHT.events, "unheard", None]
    return [(i, rng.choice(entities), rng.choice(events)) for i in rng.sample(range(5 * n), n)]


@pytest.mark.parametrize("block, fan", [(65_536, 256), (7, 3), (50, 2)])
def test_fold_equals_a_plain_loop(spark, block, fan):
    """One entity and the null entity have a third of all rows each: both are split."""
    rng = random.Random(block)
    log = some_log(rng, 900, ["hot", "hot", "hot", None, None, None, "a", "b", "c"])
    df = spark.createDataFrame(log, "seq long, key string, event string").repartition(6)
    got = mc.machine_fold(df, LIGHT, block=block, fan=fan)
    assert rows(got) == plain(LIGHT, log)


def test_hot_entity_is_cut_into_blocks(spark):
    log = some_log(random.Random(1), 2_000, ["hot"] * 9 + ["cold"])
    df = spark.createDataFrame(log, "seq long, key string, event string")
    coded = df.selectExpr("key as entity", "seq", "0 as code")
    sizes = [r["n"] for r in mc.block_maps(LIGHT, coded.where("entity = 'hot'"), 500).collect()]
    assert len(sizes) == 20 and max(sizes) <= 500


def test_empty_log_and_other_columns(spark):
    df = spark.createDataFrame([], "seq long, key string, event string")
    assert mc.machine_fold(df, LIGHT).count() == 0
    clash = "entity block n map events h split code o state"
    df = spark.createDataFrame([(1, 7, "go")], "at long, who int, what string").selectExpr(
        "*", *[f"'x' as {c}" for c in clash.split()]
    )
    got = mc.machine_fold(df, LIGHT, "who", "what", "at")
    assert got.columns == ["who", "state", "events", "refused", "changed_seq"]
    assert rows(got) == [(7, "green", 1, 0, 1)]


def test_every_move_of_the_lifecycle(spark):
    """Each state, brought there by legal moves, is asked for each state: only legal moves act."""
    machine = mc.Machine.of_edges(S.STATES, S.LEGAL_MOVES)
    way = {"IDLE": []}
    for a, b in S.LEGAL_MOVES:
        way.setdefault(b, way[a] + [b])
    log, want = [], {}
    for a in S.STATES:
        for b in S.STATES:
            for event in [*way[a], b]:
                log.append((len(log), f"{a}>{b}", event))
            legal = (a, b) in S.LEGAL_MOVES
            want[f"{a}>{b}"] = (b if legal else a, int(not legal))
    df = spark.createDataFrame(log, "seq long, key string, event string")
    got = {r["key"]: (r["state"], r["refused"]) for r in mc.machine_fold(df, machine).collect()}
    assert got == want


def test_machines_are_checked():
    with pytest.raises(ValueError):
        mc.Machine(("a", "a"), ())
    with pytest.raises(ValueError):
        mc.Machine(("a", "b"), (("a", "x", "c"),))
    with pytest.raises(ValueError):
        mc.Machine(("a", "b"), (("a", "x", "a"), ("a", "x", "b")))


def test_occupancy_lists_every_state(spark):
    df = spark.createDataFrame([(1, "a", "go"), (2, "b", "stop")], "seq long, key string, event string")
    got = mc.occupancy(mc.machine_fold(df, LIGHT), LIGHT)
    assert rows(got) == [("green", 1, 1, 0), ("off", 0, 0, 0), ("red", 1, 1, 1), ("yellow", 0, 0, 0)]
