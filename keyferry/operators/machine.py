"""Any finite state machine over a log of events, without one task per entity.

An event is a map from each state to the next one, and maps compose: what a run of events does is again such a
map, and the maps of neighbouring runs compose to that of both. So an entity with very many events is cut into
blocks of its log, every block is composed on its own, and the blocks' maps are composed in a tree
of fan-in ``FAN``. No task orders more than a block of events or ``FAN`` maps. Entities with few events are
folded from the start state in one go. The machine may have cycles and needs no final states.

An event that the current state has no move for is refused: the state stays, and it is counted.

Null entities are an entity like any other. A null or unknown event is refused in every state.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyferry.scratch import lookup_join, settle

#: An entity with more events than this is cut into blocks of as many sequence numbers.
BLOCK = 65_536
FAN = 256


@dataclass(frozen=True)
class Machine:
    """States (the first one is where every entity starts) and moves ``(state, event, next state)``."""

    states: tuple[str, ...]
    moves: tuple[tuple[str, str, str], ...]

    @classmethod
    def of_edges(cls, states: Iterable[str], edges: Iterable[tuple[str, str]]) -> Machine:
        """A machine whose events name the state that is asked for."""
        return cls(tuple(states), tuple((a, b, b) for a, b in edges))

    def __post_init__(self) -> None:
        known = set(self.states)
        if len(known) != len(self.states) or len({m[:2] for m in self.moves}) != len(self.moves):
            raise ValueError("states must differ, and a state has one move per event")
        if any(a not in known or b not in known for a, _, b in self.moves):
            raise ValueError("moves must be between known states")

    @property
    def events(self) -> list[str]:
        return sorted({e for _, e, _ in self.moves})

    def code(self, event: Column) -> Column:
        """The event's place in ``events``, or -1."""
        names = F.array(*[F.lit(e) for e in self.events]).cast("array<string>")
        return F.coalesce(F.array_position(names, event).cast("int") - 1, F.lit(-1))

    def next_state(self, state: Column, code: Column) -> Column:
        """Number of the next state; null if the event is refused."""
        to = {(a, e): self.states.index(b) for a, e, b in self.moves}
        rows = [
            F.array(*[F.lit(to.get((s, e))).cast("int") for s in self.states]) for e in self.events
        ]
        return F.get(F.get(F.array(*rows), code), state)

    def name(self, state: Column) -> Column:
        return F.get(F.array(*[F.lit(s) for s in self.states]), state)


# What a run of events does to one state: where it leads, how many events were refused, and the last
# event that changed the state.
def _outcome(to: Column, refused: Column, changed: Column) -> Column:
    return F.struct(
        to.cast("int").alias("to"),
        refused.cast("long").alias("refused"),
        changed.cast("long").alias("changed"),
    )


def _untouched(state: Column) -> Column:
    return _outcome(state, F.lit(0), F.lit(None))


def _run(machine: Machine, events: Column, state: Column) -> Column:
    """The outcome of sorted events ``(seq, code)`` from one state."""

    def step(acc: Column, event: Column) -> Column:
        to = machine.next_state(acc["to"], event["code"])
        return _outcome(
            F.coalesce(to, acc["to"]),
            acc["refused"] + F.when(to.isNull(), 1).otherwise(0),
            F.when(to != acc["to"], event["seq"]).otherwise(acc["changed"]),
        )

    return F.aggregate(events, _untouched(state), step)


def _compose(first: Column, second: Column) -> Column:
    """The map of two runs after one another; a map is an array with an outcome per state."""

    def both(a: Column) -> Column:
        b = F.get(second, a["to"])
        return _outcome(
            b["to"], a["refused"] + b["refused"], F.coalesce(b["changed"], a["changed"])
        )

    return F.transform(first, both)


def _numbers(machine: Machine) -> Column:
    return F.array(*[F.lit(i) for i in range(len(machine.states))])


def block_maps(machine: Machine, events: DataFrame, block: int) -> DataFrame:
    """``events`` (entity, seq, code) to entity, block, n and the block's map."""
    # seq is unique, so a block holds at most ``block`` events of an entity.
    sorted_events = F.sort_array(F.collect_list(F.struct("seq", "code")))
    return (
        events.withColumn("block", F.floor(F.col("seq") / block))
        .groupBy("entity", "block")
        .agg(F.count("*").alias("n"), sorted_events.alias("events"))
        .select(
            "entity",
            "block",
            "n",
            F.transform(_numbers(machine), lambda s: _run(machine, F.col("events"), s)).alias("map"),
        )
    )


def compose_blocks(machine: Machine, maps: DataFrame, fan: int = FAN) -> DataFrame:
    """entity, n and the map of all its blocks in order."""
    ends = maps.agg(F.max("block").alias("last"), F.min("block").alias("first")).first()
    if ends["last"] is None:
        return maps.select("entity", "n", "map")
    first, left = ends["first"], ends["last"] - ends["first"]
    level = maps.withColumn("block", F.col("block") - first)
    start = F.transform(_numbers(machine), _untouched)
    while True:
        parts = F.sort_array(F.collect_list(F.struct("block", "map")))
        level = (
            level.withColumn("above", F.floor(F.col("block") / fan))
            .groupBy("entity", "above")
            .agg(F.sum("n").alias("n"), parts.alias("parts"))
            .select(
                "entity",
                F.col("above").alias("block"),
                "n",
                F.aggregate("parts", start, lambda acc, p: _compose(acc, p["map"])).alias("map"),
            )
        )
        left //= fan
        if left == 0:
            return level.select("entity", "n", "map")
        level = settle(level, "composed")


def machine_fold(
    log: DataFrame,
    machine: Machine,
    entity: str = "key",
    event: str = "event",
    seq: str = "seq",
    block: int = BLOCK,
    fan: int = FAN,
) -> DataFrame:
    """Where each entity stands after its events in order of ``seq`` (a unique whole number).

    Gives the entity, ``state``, ``events``, ``refused`` and ``changed_seq`` (the event that last changed
    the state, null if none did).
    """
    coded = log.select(
        F.col(entity).alias("entity"),
        F.col(seq).cast("long").alias("seq"),
        machine.code(F.col(event)).alias("code"),
    )
    sizes = coded.groupBy("entity").agg(F.count("*").alias("n"))
    # A hash is never null, so a null entity can be split, too. Another entity of the same hash may be.
    hot = settle(
        sizes.where(F.col("n") > block).select(F.xxhash64("entity").alias("h")).distinct(), "hot"
    )
    if hot.isEmpty():
        few, folded = coded, None
    else:
        flagged = lookup_join(
            coded.withColumn("h", F.xxhash64("entity")),
            hot.withColumn("split", F.lit(True)),
            ["h"],
            F.col("seq"),
            "left",
        )
        few = flagged.where("split is null").select(*coded.columns)
        maps = settle(block_maps(machine, flagged.where("split"), block), "block-maps")
        folded = compose_blocks(machine, maps, fan).select(
            "entity", "n", F.get("map", F.lit(0)).alias("o")
        )
    sorted_events = F.sort_array(F.collect_list(F.struct("seq", "code")))
    plain = few.groupBy("entity").agg(
        F.count("*").alias("n"), _run(machine, sorted_events, F.lit(0)).alias("o")
    )
    return (plain if folded is None else plain.unionByName(folded)).select(
        F.col("entity").alias(entity),
        machine.name(F.col("o.to")).alias("state"),
        F.col("n").alias("events"),
        F.col("o.refused").alias("refused"),
        F.col("o.changed").alias("changed_seq"),
    )


def occupancy(folded: DataFrame, machine: Machine) -> DataFrame:
    """Each state, reached or not: entities in it, and the events and refused events of those."""
    spark = folded.sparkSession
    names = spark.createDataFrame([(s,) for s in machine.states], "state string")
    sums = folded.groupBy("state").agg(
        F.count("*").alias("entities"), F.sum("events").alias("events"), F.sum("refused").alias("refused")
    )
    zero = F.lit(0).cast("long")
    return names.join(F.broadcast(sums), "state", "left").select(
        "state", *[F.coalesce(c, zero).alias(c) for c in ("entities", "events", "refused")]
    )
