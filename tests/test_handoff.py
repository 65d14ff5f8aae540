from types import SimpleNamespace

from conftest import rows, stream

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from keyferry.operators import counts, cutover, integrity, state as st
from keyferry.scratch import settle
from keyferry.sources.tables import with_groups
from keyferry.streaming import processors

CUT = "key_group int, source int, target int, flip_seq long, release_seq long"


def phased(moved, background, per_phase):
    """Phases of moved keys ``per_phase`` times each, with every background key once per phase."""
    out, ends = [], []
    for times in per_phase:
        for i in range(times):
            out += moved
        out += background
        ends.append(len(out) - 1)
    return out, ends


def owned(spark, keys):
    return with_groups(counts.running_count(stream(spark, keys)))


def move(spark, keys, flip, release, target=None):
    """Cutovers for the groups of the given keys."""
    groups = with_groups(spark.createDataFrame([(k,) for k in keys], "key string"))
    to = (F.col("owner") + 1) % 4 if target is None else F.lit(target)
    return settle(groups.select(
        "key_group", F.col("owner").alias("source"), to.cast("int").alias("target"),
        F.lit(flip).cast("long").alias("flip_seq"), F.lit(release).cast("long").alias("release_seq"),
    ))


def lone_keys(spark, keys):
    """Keys alone in their key-group, with owners."""
    grouped = with_groups(spark.createDataFrame([(k,) for k in keys], "key string")).collect()
    alone = {}
    for r in grouped:
        alone.setdefault(r["key_group"], []).append(r)
    return [rs[0] for rs in alone.values() if len(rs) == 1]


def last_at(out, key, owner):
    return out.where((F.col("key") == key) & (F.col("owner") == owner)).agg(F.max("n")).first()[0]


def test_five_at_source_fourteen_at_target(spark):
    names = [f"key-{i}" for i in range(120)]
    moved = lone_keys(spark, names)[0]
    background = [k for k in names if k != moved["key"]]
    keys, ends = phased([moved["key"]], background, [5, 5, 4])
    out = settle(cutover.hold_replay(owned(spark, keys), move(spark, [moved["key"]], ends[0], ends[1])))
    target = (moved["owner"] + 1) % 4
    assert last_at(out, moved["key"], moved["owner"]) == 5
    assert last_at(out, moved["key"], target) == 14
    rest = out.where(F.col("key") != moved["key"]).groupBy("key").agg(
        F.max("n").alias("n"), F.count_distinct("owner").alias("owners")
    )
    assert rest.count() == 119 and rest.where("n <> 3 or owners <> 1").count() == 0
    assert rows(out.groupBy("phase").count()) == [
        ("held", 5), ("live", 4), ("other", 357), ("pre", 5)
    ]


def test_two_groups_move_at_once_to_one_target(spark):
    names = [f"key-{i}" for i in range(200)]
    alone = lone_keys(spark, names)
    first = alone[0]
    second = next(r for r in alone if r["owner"] != first["owner"])
    target = min({0, 1, 2, 3} - {first["owner"], second["owner"]})
    moved = [first["key"], second["key"]]
    keys, ends = phased(moved, [k for k in names if k not in moved], [4, 4, 4])
    cut = move(spark, moved, ends[0], ends[1], target)
    out = settle(cutover.hold_replay(owned(spark, keys), cut))
    for r in (first, second):
        assert last_at(out, r["key"], r["owner"]) == 4
        assert last_at(out, r["key"], target) == 12
    check = integrity.handoff_integrity(with_groups(stream(spark, keys)), out, cut)
    assert rows(check, "emitted", "at_source", "at_target", "lost", "duplicated", "cut_clean") == [
        (12, 4, 8, 0, 0, True)
    ] * 2
    assert rows(integrity.ownership_violations(out, cut)) == [(198, 0)]


@pytest.fixture(scope="module")
def handed_off(spark):
    names = [f"key-{i}" for i in range(60)]
    keys = [k for _ in range(6) for k in names]
    cut = move(spark, ["key-7"], 100, 250)
    processed = settle(cutover.hold_replay(owned(spark, keys), cut))
    return with_groups(stream(spark, keys)), processed, cut


def flags(emitted, processed, cut):
    out = integrity.handoff_integrity(emitted, processed, cut).where("key = 'key-7'").first()
    return out["lost"], out["duplicated"], out["cut_clean"]


def test_undamaged_output_is_clean(handed_off):
    assert flags(*handed_off) == (0, 0, True)


def test_a_dropped_row_is_lost(handed_off):
    emitted, processed, cut = handed_off
    damaged = processed.where("not (key = 'key-7' and seq = 67)")
    assert flags(emitted, damaged, cut) == (1, 0, True)


def test_a_doubled_row_is_a_duplicate(handed_off):
    emitted, processed, cut = handed_off
    damaged = processed.unionByName(processed.where("key = 'key-7' and seq = 67"))
    assert flags(emitted, damaged, cut) == (0, 1, True)


def test_a_row_on_the_wrong_side_breaks_the_cut(handed_off):
    emitted, processed, cut = handed_off
    wrong = F.when(
        (F.col("key") == "key-7") & (F.col("seq") == 307), cut.agg(F.max("source")).scalar()
    ).otherwise(F.col("owner"))
    assert flags(emitted, processed.withColumn("owner", wrong), cut) == (0, 0, False)
    third = F.when(
        (F.col("key") == "key-7") & (F.col("seq") == 307), F.lit(9)
    ).otherwise(F.col("owner"))
    assert flags(emitted, processed.withColumn("owner", third), cut) == (0, 0, False)


def test_a_stray_owner_of_a_staying_key_is_seen(handed_off):
    _, processed, cut = handed_off
    stray = F.when(F.col("seq") == 8, F.lit(9)).otherwise(F.col("owner"))
    violations = integrity.ownership_violations(processed.withColumn("owner", stray), cut).first()
    assert violations["keys_multi_owner"] == 1


def test_holding_changes_no_count(handed_off):
    emitted, processed, _ = handed_off
    plain = counts.running_count(emitted.select("seq", "key"))
    assert rows(st.compare(processed, plain, ["seq", "key", "n"])) == [(360, 360, 0, 0)]


def test_without_release_records_wait(spark):
    keys = ["key-7", "key-8"] * 5
    out = cutover.hold_replay(owned(spark, keys), move(spark, ["key-7"], 3, None))
    mine = out.where("key = 'key-7'")
    assert rows(mine, "seq", "phase", "effective_seq", "n") == [
        (0, "pre", 0, 1), (2, "pre", 2, 2),
        (4, "held", None, None), (6, "held", None, None), (8, "held", None, None),
    ]


class Lane:
    """State of one lane in memory, with the number of times a key was asked for."""

    def __init__(self):
        self.values, self.records, self.known, self.asked = {}, [], None, 0

    def getMapState(self, name, key, value):
        return self

    def getListState(self, name, value):
        return self

    def getValueState(self, name, value):
        lane = self
        return SimpleNamespace(get=lambda: lane.known, update=lambda move: setattr(lane, "known", move))

    def exists(self):
        return bool(self.values)

    def getValue(self, key):
        self.asked += 1
        return self.values.get(key)

    def updateValue(self, key, value):
        self.values[key] = value

    def appendList(self, rows):
        self.records += rows

    def get(self):
        return iter(self.records)

    def clear(self):
        self.records = []


def test_a_lane_without_values_asks_for_none(monkeypatch):
    """Columns come in any order; a lane that has nothing yet reads no key, also when its values are written in parts."""
    columns = ["lane", "seq", "key", "cents", "owner", "control", "key_group", *processors.MOVE]
    row = Row(*columns)
    rows = [row(0, i, f"k{i % 7}", i, 3, False, 5, 0, 1, 20, 40 if i > 50 else None, None) for i in range(60)]
    lane, out = Lane(), []
    processor = processors.HoldReplay(lambda s, r: (s[0] + r.cents,), "cents long", (0,), "cents long")
    processor.init(lane)
    out += processor.handleInputRows((5, 0), iter(rows[:30]), None)
    assert lane.asked == 0 and len(lane.records) == 9
    out += processor.handleInputRows((5, 0), iter(rows[30:]), None)
    assert lane.asked == 7
    so_far, want = {}, []
    for i in range(60):
        so_far[i % 7] = so_far.get(i % 7, 0) + i
        phase, owner, at = ("pre", 0, i) if i <= 20 else ("held", 1, 40) if i <= 40 else ("live", 1, i)
        want.append((i, f"k{i % 7}", 5, phase, owner, at, so_far[i % 7]))
    assert sorted(map(tuple, out)) == want
    monkeypatch.setattr(processors, "CHUNK", 3)
    small = Lane()
    processor.init(small)
    again = [*processor.handleInputRows((5, 0), iter(rows[:30]), None), *processor.handleInputRows((5, 0), iter(rows[30:]), None)]
    assert sorted(map(tuple, again)) == want
