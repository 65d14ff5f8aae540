"""Streaming queries that run over what is there and stop, and the hand-off between two of them."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from keyferry.functions import keys
from keyferry.functions.text import explode_words
from keyferry.scratch import fresh_path, lookup_join
from keyferry.sinks.tables import batch_writer
from keyferry.sources import statestore, streams
from keyferry.streaming.processors import (
    MOVE, HoldReplay, Lifecycle, RunningCount, RunningFold, in_order,
)


@dataclass
class Job:
    """A streaming query's folders. Running it again goes on where it stopped."""

    build: Callable[[SparkSession], DataFrame]
    session: SparkSession
    mode: str = "append"
    name: str = "stream"
    root: str = field(init=False)

    def __post_init__(self) -> None:
        self.root = fresh_path(self.session, self.name)

    @property
    def output(self) -> str:
        return f"{self.root}/out"

    @property
    def checkpoint(self) -> str:
        return f"{self.root}/checkpoint"

    def run(self, sink: Callable[[DataFrame, int], None] | None = None) -> Job:
        """Process all files present, then stop at a committed batch: an aligned cut."""
        self._keep_partitions()
        query = (
            self.build(self.session)
            .writeStream.outputMode(self.mode)
            .option("checkpointLocation", self.checkpoint)
            .foreachBatch(sink or batch_writer(self.output))
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
        return self

    def _keep_partitions(self) -> None:
        """A state store keeps its number of partitions, so rows must be dealt and sorted by that one
        when the query starts again, whatever the session says by then."""
        name = "spark.sql.shuffle.partitions"
        try:
            lines = self.session.read.text(f"{self.checkpoint}/offsets/*").where(
                F.col("value").contains(name)
            )
            line = lines.first()
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return
        if line:
            self.session.conf.set(name, json.loads(line["value"])["conf"][name])

    def result(self, spark: SparkSession) -> DataFrame:
        """Output of all batches, with ``batch_id``."""
        return spark.read.parquet(self.output)

    @property
    def ledger(self) -> str:
        return f"{self.root}/ledger"

    def mark(self, seq: int) -> int:
        """Note in the ledger that all records up to ``seq``, and none after it, are processed now.

        However many micro-batches that took, its last one is the batch to read the state of. Gives
        that batch's number, -1 if there was none yet.
        """
        batch = -1
        try:
            commits = self.session.read.text(f"{self.checkpoint}/commits")
            number = F.regexp_extract(F.input_file_name(), "([0-9]+)$", 1).cast("long")
            batch = commits.select(number.alias("b")).agg(F.max("b")).first()[0]
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
        note = self.session.createDataFrame([(seq, batch)], "upto long, batch long")
        note.coalesce(1).write.mode("append").parquet(self.ledger)
        return batch

    def batch_at(self, seq: int) -> int:
        """The micro-batch after which all records up to ``seq``, and none after it, were processed."""
        found = self.session.read.parquet(self.ledger).where(F.col("upto") == seq).first()
        if found is None:
            raise ValueError(f"no micro-batch is known to end at record {seq}")
        return found["batch"]

    def phase(self, batch: Column) -> Column:
        """Number of the marked phase, from 0, that a batch belongs to. One value per mark."""
        ends = [r["batch"] for r in self.session.read.parquet(self.ledger).collect()]
        return F.size(F.filter(F.array(*[F.lit(end) for end in ends]), lambda end: end < batch))


def run_phases(
    job: Job, phases: Iterable[tuple[int, DataFrame]], inbox: str, files: int = 1
) -> Job:
    """Land one phase, run the job over it, mark its end, then open the gate for the next.

    ``phases`` are pairs of the last ``seq`` and the records; a phase comes in ``files`` files, and takes as
    many micro-batches as the source's bound asks for.
    """
    for last, phase in phases:
        for part in range(files):
            mine = F.pmod(F.xxhash64(*phase.columns), F.lit(files)) == part
            streams.land(phase.where(mine) if files > 1 else phase, inbox)
        job.run()
        job.mark(last)
    return job


def word_counts(docs: DataFrame) -> DataFrame:
    return explode_words(docs).groupBy("w").agg(F.count("*").alias("n"))


def key_counts(records: DataFrame) -> DataFrame:
    """Spark's own keyed count: combined map-side, state in the state store."""
    return records.groupBy("key").agg(F.count("*").alias("n"))


def running_counts(records: DataFrame, initial: DataFrame | None = None) -> DataFrame:
    """Every record with its key's count so far, from a moved state ``(key, n)`` if given."""
    return in_order(records.select("key", "seq"), ["key"], ["seq"]).transformWithState(
        RunningCount(),
        RunningCount.OUTPUT,
        "append",
        "none",
        initialState=None if initial is None else initial.select("key", "n").groupBy("key"),
    )


def running_fold(
    records: DataFrame,
    fold: Callable[[tuple, Row], tuple],
    state: str,
    start: tuple,
    initial: DataFrame | None = None,
) -> DataFrame:
    """Every record with its key's state after it: ``fold(state, record) -> state``.

    ``state`` names the state's columns as in ``"total double, most double"``; ``records`` has ``seq, key``
    and whatever the fold reads; ``initial`` is a moved state, ``key`` and the state's columns.
    """
    processor = RunningFold(fold, state, start)
    return in_order(records, ["key"], ["seq"]).transformWithState(
        processor, processor.output, "append", "none",
        initialState=None if initial is None else initial.groupBy("key"),
    )


def control_records(cutovers: DataFrame, lanes: int) -> DataFrame:
    """News of the moves: what the cutovers tell, one copy for every lane of its group."""
    if "cancel_seq" not in cutovers.columns:
        cutovers = cutovers.withColumn("cancel_seq", F.lit(None).cast("long"))
    return cutovers.select(
        "key_group", *MOVE, F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))).alias("lane")
    )


def hold_replay(
    records: DataFrame,
    control: DataFrame,
    lanes: int,
    cutovers: DataFrame | None = None,
    update: Callable[[int, Row], int] | None = None,
    fold: Callable[[tuple, Row], tuple] | None = None,
    state: str = "n long",
    start: tuple = (0,),
    initial: DataFrame | None = None,
) -> DataFrame:
    """Hold and replay over a stream of records and one of control records.

    A group is spread over ``lanes`` by key, so that a busy group is not one task. Phases follow the
    records' ``seq``. ``cutovers`` are the moves known when the query starts, a settled table of one row
    per key-group: a record meets its own move there, whenever it comes. What is known only later comes
    through ``control``; a micro-batch's news act before its records.

    ``fold(state, record) -> state`` is the keyed function; ``state`` names the columns of its state,
    ``"n long, most double"``, and ``start`` is its value before a key's first record. It gets the whole
    record, all further columns included, also when it was held. ``update(n, record) -> n`` does for a single
    number; without either, records are counted. ``initial`` is a moved state, see ``moved_state``.
    """
    own = ("seq", "key", "key_group", "owner", *MOVE)
    payload = [] if update is None and fold is None else [
        f for f in records.schema.fields if f.name not in own
    ]
    names = [f.name for f in payload]
    if update is not None:
        fold = lambda value, record: (update(value[0], record),)
    processor = HoldReplay(
        *([] if fold is None else [fold, state, start]),
        payload=", ".join(f"{f.name} {f.dataType.simpleString()}" for f in payload),
    )
    lane = F.pmod(F.xxhash64("key"), F.lit(lanes)).cast("int")
    unknown = {c: F.lit(None).cast("int" if c in ("source", "target") else "long") for c in MOVE}
    if cutovers is None:
        data = records.withColumns(unknown)
    else:
        missing = {c: unknown[c] for c in MOVE if c not in cutovers.columns}
        known = cutovers.withColumns(missing).select("key_group", *MOVE)
        data = lookup_join(records, known, ["key_group"], F.col("seq"), "left")
    data = data.select(
        "key_group", lane.alias("lane"), "seq", "key", "owner", *names, F.lit(False).alias("control"), *MOVE
    )
    marks = control.select(
        "key_group", "lane", F.lit(None).cast("long").alias("seq"),
        F.lit(None).cast("string").alias("key"), F.lit(None).cast("int").alias("owner"),
        *[F.lit(None).cast(f.dataType).alias(f.name) for f in payload],
        F.lit(True).alias("control"), *MOVE,
    )
    by = ["key_group", "lane"]
    moved = None if initial is None else in_order(initial, by, ["held.seq"])
    # News first, then records by seq: null sorts first.
    return in_order(data.unionByName(marks), by, ["seq"]).transformWithState(
        processor, processor.output, "append", "none", initialState=moved
    )


def moved_state(job: Job, seq: int, groups: DataFrame) -> DataFrame:
    """What a hold-and-replay query held of some key-groups when it had processed the records up to ``seq``:
    values, held records and what it knew of the moves, as the ``initial`` state of another one."""
    read = lambda name: statestore.read_state(
        job.session, job.checkpoint, job.batch_at(seq), name
    ).select("key.*", "*")
    values = read("counts").select(
        "key_group", "lane", F.lit("state").alias("kind"),
        F.col("user_map_key.key").alias("key"), F.col("user_map_value").alias("state"),
    )
    held = read("held").select(
        "key_group", "lane", F.lit("held").alias("kind"), F.col("list_element").alias("held")
    )
    moves = read("move").select(
        "key_group", "lane", F.lit("move").alias("kind"), F.col("value").alias("move")
    )
    every = values.unionByName(held, allowMissingColumns=True).unionByName(
        moves, allowMissingColumns=True
    )
    wanted = groups.select("key_group").distinct()
    # One row per key-group.
    return every.join(F.broadcast(wanted), "key_group", "left_semi")


def lifecycles(log: DataFrame, timeouts: dict[str, int] | None = None) -> DataFrame:
    """State changes of every migration in a stream of events, with event-time timers."""
    timed = log.select(
        "migration_id", "pos", F.col("at_ts").cast("timestamp").alias("at_ts"),
        "kind", "delta_size", "converged", "ok", "reason",
    ).withWatermark("at_ts", "0 seconds")
    return in_order(timed, ["migration_id"], ["pos"]).transformWithStateInPandas(
        Lifecycle(timeouts), Lifecycle.OUTPUT, "append", "EventTime"
    )


def reconcile(emitted: DataFrame, processed: DataFrame, delay: str = "1 hour") -> DataFrame:
    """What was emitted against what was processed, as both streams go on.

    Both have ``seq`` and ``ts`` (the record's own time), ``emitted`` also ``key``. Gives ``seq, key, status``:
    ``done`` for each pair, so a record that was processed twice has two; ``lost`` for a record that was not
    processed when the watermark of both streams had passed it, once; ``stray`` for a processed one that was not
    emitted, or came after the record's state was dropped. State is kept for ``delay`` of event time.
    """
    timed = lambda df: df.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    sent = timed(emitted.select("seq", "key", "ts"))
    done = timed(processed.select("seq", "ts")).select(
        F.col("seq").alias("done_seq"), F.col("ts").alias("done_ts")
    )
    same = (F.col("seq") == F.col("done_seq")) & (F.col("ts") == F.col("done_ts"))
    status = (
        F.when(F.col("done_seq").isNull(), "lost").when(F.col("seq").isNull(), "stray").otherwise("done")
    )
    return sent.join(done, same, "full_outer").select(
        F.coalesce("seq", "done_seq").alias("seq"), "key", status.alias("status")
    )


def first_arrivals_by_day(records: DataFrame) -> DataFrame:
    """Streaming minimum per (owner, channel, day)."""
    return records.groupBy(
        keys.owner_of_key(F.col("key")).alias("task"), "channel", F.to_date("ts").alias("day")
    ).agg(F.min("ts").alias("at_ts"))
