"""Every operator as a query over the given tables: ``(spark, sf_dir) -> DataFrame``."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from keyferry import params
from keyferry.functions import keys
from keyferry.operators import (
    barriers as bar,
    counts,
    cutover,
    integrity,
    lifecycle as life,
    machine as mc,
    placement,
    rounds,
    routing,
    state as st,
)
from keyferry.plans import inputs
from keyferry.plans.inputs import Bounds, bounds
from keyferry.scratch import fresh_path, settle
from keyferry.sinks import tables as sinks
from keyferry.sources import statestore, streams
from keyferry.sources.tables import documents, records, with_groups
from keyferry.streaming import jobs
from keyferry.streaming.routes import RoutedStream, in_band
from keyferry.streaming.totals import RunningTotals

LANES = 8
FEED_ROUNDS = 5
DROPPED = 1
SPREAD_ROWS = 65_536


# Words and counts


def tokens(spark: SparkSession, d: str) -> DataFrame:
    return counts.tokens(documents(spark, d))


def word_count(spark: SparkSession, d: str) -> DataFrame:
    return counts.word_count(documents(spark, d))


def stream_word_count(spark: SparkSession, d: str) -> DataFrame:
    job = jobs.Job(
        lambda s: jobs.word_counts(streams.table_stream(s, d, "documents")),
        streams.stream_session(spark), "update", "word-count",
    ).run()
    # Counts only grow, so the last update of a word is its largest.
    return job.result(spark).groupBy("w").agg(F.max("n").alias("n"))


def running_count(spark: SparkSession, d: str) -> DataFrame:
    return counts.running_count(records(spark, d).select("seq", "key"))


def stream_running_count(spark: SparkSession, d: str) -> DataFrame:
    job = jobs.Job(
        lambda s: streams.record_stream(s, d).select("seq", "key"),
        streams.stream_session(spark), name="running-count",
    )
    job.run(RunningTotals(job.output, f"{job.root}/totals"))
    return job.result(spark).select("seq", "key", "n")


def stream_running_fold(spark: SparkSession, d: str) -> DataFrame:
    """A user's own keyed function: number, sum in cents and maximum of ``value`` so far."""
    cents = F.round(F.col("value") * 100).cast("long").alias("cents")
    job = jobs.Job(
        lambda s: jobs.running_fold(
            streams.record_stream(s, d).select("seq", "key", cents),
            _value_fold, VALUE_STATE, VALUE_START,
        ),
        streams.stream_session(spark), name="running-fold",
    ).run()
    return job.result(spark).select("seq", "key", "n", "cents", "most")


def _routed(spark: SparkSession, d: str) -> DataFrame:
    log = inputs.override_log(inputs.barriers(spark, d))
    ev = with_groups(records(spark, d).select("seq", "key"))
    return routing.route_effective(ev, log)


def last_count_by_owner(spark: SparkSession, d: str) -> DataFrame:
    return counts.last_count_by_owner(_routed(spark, d))


def seen_by_owner(spark: SparkSession, d: str) -> DataFrame:
    return counts.seen_by_owner(_routed(spark, d))


def hot_key_totals(spark: SparkSession, d: str) -> DataFrame:
    return counts.hot_key_totals(records(spark, d))


# Placement


def key_group_assign(spark: SparkSession, d: str) -> DataFrame:
    return placement.key_group_assign(records(spark, d))


def owner_ranges(spark: SparkSession, d: str) -> DataFrame:
    return placement.owner_range_loads(records(spark, d))


def owner_load(spark: SparkSession, d: str) -> DataFrame:
    return placement.owner_load(records(spark, d))


def singleton_groups(spark: SparkSession, d: str) -> DataFrame:
    return placement.singleton_groups(records(spark, d))


def partition_size(spark: SparkSession, d: str) -> DataFrame:
    return placement.partition_size(records(spark, d))


def make_plans(spark: SparkSession, d: str) -> DataFrame:
    return placement.make_plans(records(spark, d))


def serve_check(spark: SparkSession, d: str) -> DataFrame:
    hosted = inputs.plans(spark, d).select(F.col("target").alias("owner"), "key_group")
    return routing.serve_check(_routed(spark, d), hosted)


def physical_route(spark: SparkSession, d: str) -> DataFrame:
    spread = keys.key_hash(F.col("key")) + F.floor(F.col("seq") / SPREAD_ROWS)
    placed = routing.physical_route(_routed(spark, d), params.NUM_OWNERS, LANES, spread)
    return routing.routed_partitions(placed)


# State tables


def _state(
    spark: SparkSession, d: str, b: Bounds, cut: int, groups: DataFrame | None = None
) -> DataFrame:
    return st.state_snapshot(records(spark, d), cut, b.recent_rows, groups=groups)


def state_snapshot(spark: SparkSession, d: str) -> DataFrame:
    b = bounds(spark, d)
    return _state(spark, d, b, b.flip_seq)


def _phases(spark: SparkSession, d: str, b: Bounds) -> list[tuple[int, DataFrame]]:
    """The stream up to the flip, up to the release, and the rest, each with its last ``seq``."""
    raw = spark.read.parquet(f"{d}/events.parquet")
    seq = F.col("event_id")
    return [
        (b.flip_seq, raw.where(seq <= b.flip_seq)),
        (b.release_seq, raw.where((seq > b.flip_seq) & (seq <= b.release_seq))),
        (b.max_seq, raw.where(seq > b.release_seq)),
    ]


def _phased(
    spark: SparkSession, d: str, b: Bounds, build, mode: str, name: str,
    max_bytes: int = params.MICRO_BATCH_BYTES, files: int = 1,
) -> jobs.Job:
    """Run a job over the three phases, with a mark after each."""
    session = streams.stream_session(spark)
    phases = _phases(spark, d, b)
    inbox, schema = fresh_path(spark, "inbox"), phases[0][1].schema
    source = lambda s: streams.file_stream(s, inbox, schema, max_bytes)
    job = jobs.Job(lambda s: build(source(s)), session, mode, name)
    return jobs.run_phases(job, phases, inbox, files)


def _keyed(raw: DataFrame) -> DataFrame:
    return raw.select(F.col("event_id").alias("seq"), F.col("user_id").cast("string").alias("key"))


def phase_stream(spark: SparkSession, d: str, **bound) -> DataFrame:
    job = _phased(spark, d, bounds(spark, d), lambda r: r.select("event_id"), "append", "phases", **bound)
    return job.result(job.session).groupBy(
        (job.phase(F.col("batch_id")) + 1).cast("int").alias("phase")
    ).agg(F.count("*").alias("records"))


def state_from_checkpoint(spark: SparkSession, d: str, **bound) -> DataFrame:
    """State at the flip, read from a query that has gone on since."""
    b = bounds(spark, d)
    job = _phased(spark, d, b, lambda r: jobs.key_counts(_keyed(r)), "update", "counts", **bound)
    key = F.col("key.key")
    return statestore.read_state(job.session, job.checkpoint, job.batch_at(b.flip_seq)).select(
        keys.key_group(key).alias("key_group"), key.alias("key"), F.col("value.count").alias("n")
    )


def state_change_feed(spark: SparkSession, d: str, **bound) -> DataFrame:
    """What each phase changed, the last change of a key only."""
    b = bounds(spark, d)
    job = _phased(spark, d, b, lambda r: jobs.key_counts(_keyed(r)), "update", "counts", **bound)
    feed = statestore.read_changes(job.session, job.checkpoint, 0, job.batch_at(b.max_seq))
    changes = feed.select(
        "batch_id", "change_type", F.col("key.key").alias("key"), F.col("value.count").alias("n")
    )
    phase = job.phase(F.col("batch_id")).cast("long")
    return rounds.latest_changes(changes.withColumn("phase", phase), ["phase", "key"], ["n"]).select(
        F.col("phase").alias("batch_id"), "key", "n"
    )


def precopy_from_changes(spark: SparkSession, d: str, **bound) -> DataFrame:
    """Daily rounds of an iterated copy, told by the change feed of a counting query: round 1 copies all that
    there is at the midpoint, each later round what changed in its day."""
    b = bounds(spark, d)
    raw = spark.read.parquet(f"{d}/events.parquet")
    day = F.datediff(F.col("ts"), F.lit(b.midpoint).cast("timestamp_ntz"))
    # One value per round: where the rounds end.
    ends = raw.groupBy(F.least(F.greatest(day + 2, F.lit(1)), F.lit(FEED_ROUNDS + 1)).alias("round")).agg(
        F.min("event_id").alias("first"), F.max("event_id").alias("last")
    ).sort("round").collect()
    seq = F.col("event_id")
    phases = [(r["last"], raw.where(seq.between(r["first"], r["last"]))) for r in ends]
    session, inbox = streams.stream_session(spark), fresh_path(spark, "inbox")
    max_bytes, files = bound.get("max_bytes", params.MICRO_BATCH_BYTES), bound.get("files", 1)
    job = jobs.Job(
        lambda s: jobs.key_counts(_keyed(streams.file_stream(s, inbox, raw.schema, max_bytes))),
        session, "update", "copied",
    )
    jobs.run_phases(job, phases, inbox, files)
    feed = statestore.read_changes(session, job.checkpoint, 0, job.batch_at(b.max_seq))
    numbers = F.array(*[F.lit(r["round"]) for r in ends])
    changes = feed.select(
        F.get(numbers, job.phase(F.col("batch_id"))).alias("round"), "batch_id", "change_type",
        F.col("key.key").alias("key"), F.col("value.count").alias("n"),
    )
    return rounds.rounds_from_changes(changes, FEED_ROUNDS)


def precopy_changes_outcome(spark: SparkSession, d: str) -> DataFrame:
    return rounds.precopy_outcome(settle(precopy_from_changes(spark, d), "rounds", spark))


def _written_state(spark: SparkSession, d: str, b: Bounds, cut: int) -> tuple[DataFrame, str]:
    path = fresh_path(spark, "state")
    return sinks.write_state(_state(spark, d, b, cut), path), path


def state_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Counter of each owner's busiest key (the smallest one on ties)."""
    b = bounds(spark, d)
    table, _ = _written_state(spark, d, b, b.release_seq)
    loads = placement.key_loads(records(spark, d), params.NUM_GROUPS, params.NUM_OWNERS)
    busiest = F.struct((-F.col("records")).alias("a"), F.col("key").alias("b"))
    wanted = settle(
        loads.groupBy("owner").agg(F.min_by("key", busiest).alias("key")).select("key"), "wanted"
    )
    return st.state_lookup(table.where("state_name = 'count'"), wanted).select("key", "n")


def extract_group(spark: SparkSession, d: str) -> DataFrame:
    b = bounds(spark, d)
    table, _ = _written_state(spark, d, b, b.flip_seq)
    return st.extract_groups(table, inputs.plans(spark, d)).select(*st.ENTRY, "n")


def _group_sums(table: DataFrame) -> DataFrame:
    return table.groupBy("key_group").agg(
        F.count("*").alias("entries"), F.sum("n").alias("sum_n")
    )


def export_group(spark: SparkSession, d: str) -> DataFrame:
    b = bounds(spark, d)
    moved = _state(spark, d, b, b.flip_seq, inputs.plans(spark, d))
    return _group_sums(sinks.write_state(moved, fresh_path(spark, "export")))


def bulk_load_group(spark: SparkSession, d: str) -> DataFrame:
    """Load the moved groups as of the release over a table as of the flip."""
    b = bounds(spark, d)
    table, path = _written_state(spark, d, b, b.flip_seq)
    exported = sinks.write_state(
        _state(spark, d, b, b.release_seq, inputs.plans(spark, d)),
        fresh_path(spark, "export"),
    )
    sinks.overwrite_groups(exported, path)
    return _group_sums(sinks.read_state(spark, path, table))


def _targets_and_moved(
    spark: SparkSession, d: str, plans: DataFrame | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All owners' tables with a first copy of the moving groups at their targets, the entries of a
    later round for those, and the ``(owner, key_group)`` pairs that are hosted."""
    b = bounds(spark, d)
    plans = inputs.plans(spark, d) if plans is None else plans
    before = _state(spark, d, b, b.flip_seq)
    target = st.own_state(before).unionByName(st.moved_state(before, plans))
    moved = st.moved_state(_state(spark, d, b, b.release_seq, plans), plans)
    pairs = plans.select(F.col("target").alias("owner"), "key_group")
    return target, moved, pairs


def ingest_group(spark: SparkSession, d: str) -> DataFrame:
    target, moved, _ = _targets_and_moved(spark, d)
    return st.ingest(target, moved, st.OWNED_ENTRY)


def replace_group(spark: SparkSession, d: str) -> DataFrame:
    target, moved, pairs = _targets_and_moved(spark, d)
    return st.replace_groups(target, moved, pairs, ("owner", "key_group")).select(
        *st.OWNED_ENTRY, "n"
    )


def state_delta(spark: SparkSession, d: str) -> DataFrame:
    b = bounds(spark, d)
    return st.state_delta(_state(spark, d, b, b.release_seq), _state(spark, d, b, b.flip_seq))


def state_delta_values(spark: SparkSession, d: str) -> DataFrame:
    """As ``state_delta`` for a state of two values: sum and maximum of ``value`` in cents."""
    b = bounds(spark, d)

    def snapshot(cut: int) -> DataFrame:
        cents = F.round(F.col("value") * 100).cast("long")
        return (
            records(spark, d).where(F.col("seq") <= cut).groupBy("key")
            .agg(F.sum(cents).alias("cents"), F.max(cents).alias("most"))
            .select(F.lit("value").alias("state_name"), keys.key_group(F.col("key")).alias("key_group"),
                    "key", "cents", "most")
        )

    return st.state_delta(snapshot(b.release_seq), snapshot(b.flip_seq), values=["cents", "most"])


def apply_delta(spark: SparkSession, d: str) -> DataFrame:
    b = bounds(spark, d)
    source = settle(_state(spark, d, b, b.release_seq), "source")
    target = settle(_state(spark, d, b, b.flip_seq), "target")
    delta = settle(st.state_delta(source, target), "delta")
    applied = settle(st.apply_delta(target, delta), "applied")
    again = st.state_delta(source, applied).agg(F.count("*"))
    same = st.compare(source, applied, [*st.ENTRY, "n"])
    return delta.agg(F.count("*").alias("changed_first")).select(
        "changed_first",
        again.scalar().alias("changed_second"),
        same.select(F.expr("left_only + right_only = 0")).scalar().alias("equal_after"),
    )


def apply_delta_stored(spark: SparkSession, d: str) -> DataFrame:
    """The moving groups' changes from flip to release, applied twice to a stored table: entries and folders
    changed by each pass, files of other folders that are not what they were, and whether the table is as wished."""
    b = bounds(spark, d)
    plans = inputs.plans(spark, d)
    table, path = _written_state(spark, d, b, b.flip_seq)
    wanted = settle(_state(spark, d, b, b.release_seq, plans), "wanted")
    delta = settle(st.state_delta(wanted, st.extract_groups(table, plans)), "delta")
    moving = plans.select("key_group")
    others = lambda: sinks.folder_files(spark, path).join(
        F.broadcast(moving), "key_group", "left_anti"
    )
    before = settle(others(), "files-before")
    first = sinks.apply_delta(delta, path, table, "flip-to-release")
    second = sinks.apply_delta(delta, path, table, "flip-to-release")
    touched = st.compare(before, others(), ["key_group", "file", "written"])
    after = st.extract_groups(sinks.read_state(spark, path, table), plans)
    same = st.compare(wanted, after, [*st.ENTRY, "n"])
    return same.select(
        F.lit(first[1]).cast("long").alias("entries_first"), F.lit(first[0]).cast("long").alias("folders_first"),
        F.lit(second[1]).cast("long").alias("entries_second"), F.lit(second[0]).cast("long").alias("folders_second"),
        touched.select(F.expr("left_only + right_only")).scalar().alias("other_files_touched"),
        F.expr("left_only + right_only = 0").alias("equal_after"),
    )


def delete_group(spark: SparkSession, d: str) -> DataFrame:
    """On commit the source drops the moved group."""
    b = bounds(spark, d)
    source = st.own_state(_state(spark, d, b, b.release_seq))
    return st.deletion_counts(source, inputs.plans(spark, d))


def state_equal(spark: SparkSession, d: str) -> DataFrame:
    """The moved groups at the source against the targets' after an ingest, which deletes nothing."""
    target, moved, pairs = _targets_and_moved(spark, d)
    hosted = st.ingest(target, moved, st.OWNED_ENTRY).join(
        F.broadcast(pairs), ["owner", "key_group"], "left_semi"
    )
    return st.compare(moved, hosted, [*st.OWNED_ENTRY, "n"])


def isolation_check(spark: SparkSession, d: str) -> DataFrame:
    b = bounds(spark, d)
    plans = inputs.plans(spark, d)
    own = st.own_state(_state(spark, d, b, b.flip_seq))
    _, moved, pairs = _targets_and_moved(spark, d, plans)
    after = st.replace_groups(own, moved, pairs, ("owner", "key_group"))
    return st.isolation_check(own, after, plans, st.OWNED_ENTRY)


def transfer_summary(spark: SparkSession, d: str) -> DataFrame:
    b = bounds(spark, d)
    return st.transfer_summary(_state(spark, d, b, b.release_seq, inputs.plans(spark, d)))


def abort_rollback(spark: SparkSession, d: str) -> DataFrame:
    """Copy, flip, abort at the release: the targets drop what they got, the flips are cleared.

    Records between flip and abort were routed to the targets; held there, they are replayed at their
    sources. So the final counts by owner, from the replayed stream, must be those of a run without a move.
    """
    b = bounds(spark, d)
    plans = inputs.plans(spark, d)
    copied, _, pairs = _targets_and_moved(spark, d, plans)
    copied = settle(copied, "copied")
    rolled_back = st.delete_groups(copied, pairs, ("owner", "key_group"))
    flips = plans.select(
        "key_group", F.lit(b.flip_seq).cast("long").alias("at_seq"), F.lit(0).alias("pos"), "target"
    )
    cleared = flips.withColumns(
        {"at_seq": F.lit(b.release_seq).cast("long"), "target": F.lit(None).cast("int")}
    )
    log = settle(flips.unionByName(cleared), "log")
    given_up = inputs.cutovers(spark, d, b).withColumns(
        {"release_seq": F.lit(None).cast("long"), "cancel_seq": F.lit(b.release_seq).cast("long")}
    )
    ev = with_groups(records(spark, d).select("seq", "key"))
    replayed = settle(cutover.hold_replay(counts.running_count(ev), settle(given_up, "given-up")), "replayed")
    after = replayed.groupBy("owner", "key").agg(F.max("n").alias("n"))
    plain = st.own_state(
        counts.key_counts(ev).withColumn("key_group", keys.key_group(F.col("key")))
    )
    same = st.compare(after, plain, ["owner", "key", "n"])
    moving = plans.select("key_group", "source", "target")
    left = rolled_back.join(F.broadcast(moving), "key_group")
    overrides = routing.route_current(log).agg(F.count("target"))
    return left.agg(
        F.count_if(F.col("owner") == F.col("source")).alias("source_entries"),
        F.count_if(F.col("owner") == F.col("target")).alias("target_entries"),
    ).select(
        "source_entries",
        "target_entries",
        overrides.scalar().alias("overrides_left"),
        same.select(F.expr("left_only + right_only = 0")).scalar().alias("equals_no_migration"),
    )


# Rounds


def precopy_rounds(spark: SparkSession, d: str) -> DataFrame:
    b = bounds(spark, d)
    schedule = rounds.round_schedule(spark, b.midpoint)
    ev = with_groups(records(spark, d).select("seq", "ts", "key"))
    return rounds.precopy_rounds(ev, schedule)


def precopy_outcome(spark: SparkSession, d: str) -> DataFrame:
    return rounds.precopy_outcome(inputs.round_table(spark, d, bounds(spark, d)))


# Routing


def route_current(spark: SparkSession, d: str) -> DataFrame:
    return routing.route_current(inputs.override_log(inputs.barriers(spark, d)))


def overrides_from_barriers(spark: SparkSession, d: str) -> DataFrame:
    return routing.overrides_from_barriers(inputs.barriers(spark, d))


def _by_owner(routed: DataFrame) -> DataFrame:
    return routed.groupBy("key_group", "owner").agg(
        F.count("*").alias("records"), F.min("seq").alias("min_seq"), F.max("seq").alias("max_seq")
    )


def route_effective(spark: SparkSession, d: str) -> DataFrame:
    return _by_owner(_routed(spark, d))


def stream_route_effective(
    spark: SparkSession, d: str, max_bytes: int = params.MICRO_BATCH_BYTES, parts: int = 3
) -> DataFrame:
    """As ``route_effective``, with the overrides in the stream: each comes ahead of the part of it that
    it begins in."""
    b = bounds(spark, d)
    log = settle(inputs.override_log(inputs.barriers(spark, d)), "overrides")
    rows = in_band(with_groups(records(spark, d).select("seq", "key")), log)
    inbox, width = fresh_path(spark, "inbox"), b.max_seq // parts + 1
    part = F.floor(F.coalesce(F.col("seq"), F.col("at_seq") + 1) / width)
    for number in range(parts):
        for kind in ("at_seq is not null", "at_seq is null"):
            streams.land(rows.where(part == number).where(kind), inbox)
    job = jobs.Job(
        lambda s: streams.file_stream(s, inbox, rows.schema, max_bytes),
        streams.stream_session(spark), name="routed",
    )
    job.run(RoutedStream(job.output, f"{job.root}/routes", delay=width))
    return _by_owner(job.result(spark))


# Barriers


def _per_group(rows: DataFrame) -> DataFrame:
    return rows.groupBy("key_group").agg(F.count("*").alias("records"))


def affected_records(spark: SparkSession, d: str) -> DataFrame:
    ev = with_groups(records(spark, d).select("seq", "key"))
    return _per_group(bar.affected_records(ev, inputs.barriers(spark, d)))


def unaffected_records(spark: SparkSession, d: str) -> DataFrame:
    ev = with_groups(records(spark, d).select("seq", "key"))
    return _per_group(bar.unaffected_records(ev, inputs.barriers(spark, d)))


def plan_for_partition(spark: SparkSession, d: str) -> DataFrame:
    return bar.plan_for_partition(inputs.barriers(spark, d))


def barrier_fanout(spark: SparkSession, d: str) -> DataFrame:
    return bar.barrier_fanout(inputs.barriers(spark, d), inputs.tasks(spark, d))


def _days(spark: SparkSession, d: str) -> DataFrame:
    return settle(bar.channel_days(with_groups(records(spark, d))), "channel-days")


def barrier_arrivals(spark: SparkSession, d: str) -> DataFrame:
    return bar.barrier_arrivals(inputs.arrivals_from_days(_days(spark, d)))


def _aligned(days: DataFrame) -> DataFrame:
    return bar.barrier_alignment(
        inputs.expected_channels(days), inputs.arrivals_from_days(days)
    )


def barrier_alignment(spark: SparkSession, d: str) -> DataFrame:
    return _aligned(_days(spark, d))


def stream_alignment(spark: SparkSession, d: str) -> DataFrame:
    """First arrivals kept by a streaming query, aligned from its updates."""
    job = jobs.Job(
        lambda s: jobs.first_arrivals_by_day(streams.record_stream(s, d)),
        streams.stream_session(spark), "update", "arrivals",
    ).run()
    days = job.result(spark).groupBy("task", "channel", "day").agg(F.min("at_ts").alias("at_ts"))
    return _aligned(days)


def migration_ready(spark: SparkSession, d: str) -> DataFrame:
    return bar.migration_ready(_aligned(_days(spark, d)), params.NUM_OWNERS)


# Hold and replay


def _counted(spark: SparkSession, d: str) -> DataFrame:
    return with_groups(counts.running_count(records(spark, d).select("seq", "ts", "key")))


def hold_replay(spark: SparkSession, d: str) -> DataFrame:
    cut = inputs.cutovers(spark, d, bounds(spark, d))
    return cutover.hold_replay(_counted(spark, d), cut)


def hold_cancel(spark: SparkSession, d: str) -> DataFrame:
    """As ``hold_replay``, but every second move is given up halfway through the stream."""
    cut = inputs.cancelled_cutovers(spark, d, bounds(spark, d))
    return cutover.hold_replay(_counted(spark, d), cut)


def _dropped(spark: SparkSession, d: str) -> DataFrame:
    b = bounds(spark, d)
    return settle(cutover.drop_owner(inputs.cutovers(spark, d, b), DROPPED, b.cancel_seq), "cutovers")


def hold_drop_owner(spark: SparkSession, d: str) -> DataFrame:
    """As ``hold_replay``, but an owner drops everything in flight halfway through the stream."""
    return cutover.hold_replay(_counted(spark, d), _dropped(spark, d))


def stream_hold_drop_owner(spark: SparkSession, d: str) -> DataFrame:
    return _stream_hold(spark, d, _dropped(spark, d), "hold-drop")


def _stream_hold(spark: SparkSession, d: str, cut: DataFrame, name: str) -> DataFrame:
    """The moves are known when the query starts, and come as news once more, as they would later."""
    control = jobs.control_records(cut, LANES)
    inbox = fresh_path(spark, "control")
    streams.land(control, inbox)
    job = jobs.Job(
        lambda s: jobs.hold_replay(
            with_groups(streams.record_stream(s, d)),
            streams.file_stream(s, inbox, control.schema),
            LANES,
            cut,
        ),
        streams.stream_session(spark), name=name,
    ).run()
    return job.result(spark).drop("batch_id")


def stream_hold_replay(spark: SparkSession, d: str) -> DataFrame:
    return _stream_hold(spark, d, inputs.cutovers(spark, d, bounds(spark, d)), "hold-replay")


def stream_hold_cancel(spark: SparkSession, d: str) -> DataFrame:
    cut = inputs.cancelled_cutovers(spark, d, bounds(spark, d))
    return _stream_hold(spark, d, cut, "hold-cancel")


def hold_stats(spark: SparkSession, d: str) -> DataFrame:
    b = bounds(spark, d)
    cut = inputs.cutovers(spark, d, b)
    ev = with_groups(records(spark, d).select("seq", "ts", "key"))
    release_ts = ev.where(F.col("seq") <= b.release_seq).agg(F.max("ts")).scalar()
    return cutover.hold_stats(
        cutover.with_phase(ev, cut).select("key_group", "phase", "ts"),
        cut.withColumn("release_ts", release_ts),
    )


# Reconciliation, always against written output


def _processed(spark: SparkSession, d: str, cut: DataFrame) -> DataFrame:
    return settle(cutover.hold_replay(_counted(spark, d), cut), "processed")


def handoff_integrity(spark: SparkSession, d: str) -> DataFrame:
    cut = inputs.cutovers(spark, d, bounds(spark, d))
    emitted = with_groups(records(spark, d).select("seq", "key"))
    return integrity.handoff_integrity(emitted, _processed(spark, d, cut), cut)


def stream_handoff_integrity(
    spark: SparkSession, d: str, max_bytes: int = params.MICRO_BATCH_BYTES, parts: int = 1
) -> DataFrame:
    """Records against a hand-off's output that lacks some of them and has others twice: lost and repeated ones
    by key, reported by a query over both streams."""
    b = bounds(spark, d)
    sent = records(spark, d).select("seq", "key", "ts")
    processed = _processed(spark, d, inputs.cutovers(spark, d, b)).select("seq")
    whole = processed.where("seq % 97 <> 5")
    damaged = whole.unionByName(whole.where("seq % 89 = 3")).join(sent.select("seq", "ts"), "seq")
    # A last pair of rows, a year on, lets the watermark pass all records; it has no number of a record.
    end = sent.agg(F.max("ts").alias("ts")).select(
        F.lit(-1).cast("long").alias("seq"), F.lit(None).cast("string").alias("key"),
        F.expr("ts + interval 1 year").alias("ts"),
    )
    left, right = fresh_path(spark, "emitted"), fresh_path(spark, "processed")
    job = jobs.Job(
        lambda s: jobs.reconcile(
            streams.file_stream(s, left, sent.schema, max_bytes),
            streams.file_stream(s, right, sent.drop("key").schema, max_bytes),
        ),
        streams.stream_session(spark), name="reconcile",
    )
    for part in range(parts):
        mine = F.col("seq").between(
            (b.max_seq + 1) * part // parts, (b.max_seq + 1) * (part + 1) // parts - 1
        )
        streams.land(sent.where(mine), left)
        streams.land(damaged.where(mine).select("seq", "ts"), right)
    job.run()
    streams.land(end, left)
    streams.land(end.select("seq", "ts"), right)
    job.run()
    # One more row per (key, seq) than were emitted is a repetition.
    found = job.result(spark).where("seq >= 0").groupBy("key", "seq").agg(
        F.count_if(F.col("status") != "lost").alias("times")
    )
    return found.groupBy("key").agg(
        F.count("*").alias("emitted"),
        F.count_if(F.col("times") == 0).alias("lost"),
        F.sum(F.greatest(F.col("times") - 1, F.lit(0))).cast("long").alias("repeated"),
    )


def ownership_violations(spark: SparkSession, d: str) -> DataFrame:
    cut = inputs.cutovers(spark, d, bounds(spark, d))
    return integrity.ownership_violations(_processed(spark, d, cut), cut)


def same_as_no_migration(spark: SparkSession, d: str) -> DataFrame:
    """The outputs of two streaming queries that handed state over, against a plain running count."""
    handed = settle(state_handoff(spark, d), "handed-over")
    return st.compare(handed, running_count(spark, d), ["seq", "key", "n"])


def handoff_reconciled(spark: SparkSession, d: str) -> DataFrame:
    """As ``handoff_integrity``, over what both streaming queries of a hand-off have put out."""
    b = bounds(spark, d)
    cut = inputs.cutovers(spark, d, b)
    handed = with_groups(settle(state_handoff(spark, d), "handed-over")).drop("owner")
    moves = F.broadcast(cut.select("key_group", "source", "target"))
    owned = handed.join(moves, "key_group").withColumn(
        "owner", F.when(F.col("query") == 1, F.col("source")).otherwise(F.col("target"))
    )
    emitted = with_groups(records(spark, d).select("seq", "key"))
    return integrity.handoff_integrity(emitted, owned, cut)


# Lifecycle


def admit_plans(spark: SparkSession, d: str) -> DataFrame:
    """The daily barriers' plans as requests, while the busiest groups are already moving."""
    daily = inputs.barriers(spark, d)
    requests = settle(
        daily.select("migration_id", F.posexplode("plans").alias("i", "plan")).select(
            ((F.col("migration_id") - 1) * params.NUM_OWNERS + F.col("i")).alias("pos"),
            "plan.key_group",
        ),
        "requests",
    )
    return life.admit_plans(requests, inputs.plans(spark, d))


def admit_over_time(spark: SparkSession, d: str) -> DataFrame:
    """Every record asks to move its key-group for as many hours as its value says."""
    hours = F.expr("make_dt_interval(0, 0, 0, cast(floor(coalesce(value, 0) * 3600) as bigint))")
    requests = with_groups(records(spark, d)).select(
        F.col("seq").alias("pos"), "key_group", F.col("ts").alias("at_ts"), (F.col("ts") + hours).alias("until_ts")
    )
    return life.admit_over_time(requests)


def _log(spark: SparkSession, d: str) -> DataFrame:
    b = bounds(spark, d)
    return inputs.event_log(spark, inputs.round_table(spark, d, b), b)


def lifecycle_fold(spark: SparkSession, d: str) -> DataFrame:
    return life.lifecycle_fold(life.lifecycle(_log(spark, d)))


def stream_lifecycle(spark: SparkSession, d: str) -> DataFrame:
    log = _log(spark, d)
    inbox = fresh_path(spark, "events")
    streams.land(log, inbox)
    job = jobs.Job(
        lambda s: jobs.lifecycles(streams.file_stream(s, inbox, log.schema)),
        streams.stream_session(spark), name="lifecycle",
    ).run()
    # Timestamps were written by a UTC session; read back as plain ones there.
    out = job.result(job.session)
    last = out.groupBy("migration_id").agg(
        F.max_by(F.struct("state", "reason", "at_ts"), "step").alias("l")
    )
    ended = F.col("l.state").isin("COMMITTED", "ABORTED")
    return last.select(
        "migration_id", "l.state", "l.reason",
        F.when(ended, F.col("l.at_ts").cast("timestamp_ntz")).alias("ended_at"),
    )


def invalid_transitions(spark: SparkSession, d: str) -> DataFrame:
    log = _log(spark, d)
    return life.invalid_transitions(log, life.lifecycle(log))


def timeouts(spark: SparkSession, d: str) -> DataFrame:
    return life.timeouts(life.lifecycle(_log(spark, d)))


def migration_metrics(spark: SparkSession, d: str) -> DataFrame:
    log = _log(spark, d)
    return life.migration_metrics(log, life.lifecycle(log))


def active_migrations(spark: SparkSession, d: str) -> DataFrame:
    return life.active_migrations(life.lifecycle(_log(spark, d)))


# State machines over the given rows

#: A customer's way through the site; it has cycles, and ``closed`` can be left again.
SITE = mc.Machine(
    ("new", "active", "engaged", "customer", "trouble", "closed"),
    (
        ("new", "signup", "active"), ("new", "view", "new"),
        ("active", "click", "engaged"), ("active", "view", "active"), ("active", "error", "trouble"),
        ("engaged", "purchase", "customer"), ("engaged", "view", "active"), ("engaged", "error", "trouble"),
        ("customer", "purchase", "customer"), ("customer", "view", "active"), ("customer", "error", "trouble"),
        ("trouble", "click", "active"), ("trouble", "error", "closed"),
        ("closed", "signup", "active"),
    ),
)


def machine_fold(spark: SparkSession, d: str) -> DataFrame:
    return mc.machine_fold(records(spark, d), SITE, event="channel")


def machine_occupancy(spark: SparkSession, d: str) -> DataFrame:
    return mc.occupancy(machine_fold(spark, d), SITE)


# Hand-off and restart of streaming queries


def state_handoff(spark: SparkSession, d: str) -> DataFrame:
    """Query 1 runs to the cut; query 2 takes over the moved groups with their state from query 1's
    checkpoint; query 1 goes on with the rest."""
    b = bounds(spark, d)
    session = streams.stream_session(spark)
    before, between, after = (records for _, records in _phases(spark, d, b))
    later = between.unionByName(after)
    moved_groups = inputs.plans(spark, d).select("key_group")
    grouped = later.withColumn("key_group", keys.key_group(F.col("user_id").cast("string")))
    later_moved = grouped.join(F.broadcast(moved_groups), "key_group", "left_semi")
    later_rest = grouped.join(F.broadcast(moved_groups), "key_group", "left_anti")

    inbox1, inbox2 = fresh_path(spark, "inbox"), fresh_path(spark, "inbox")
    schema = before.schema
    first = jobs.Job(
        lambda s: jobs.running_counts(_keyed(streams.file_stream(s, inbox1, schema))),
        session, name="handoff-1",
    )
    streams.land(before, inbox1)
    first.run()

    held = statestore.read_state(session, first.checkpoint, variable="count").select(
        F.col("key.key").alias("key"), F.col("value.n").alias("n")
    )
    held = settle(held.withColumn("key_group", keys.key_group(F.col("key"))), "held", spark)
    seed = settle(
        held.join(F.broadcast(moved_groups), "key_group", "left_semi").select("key", "n"),
        "seed", session,
    )
    second = jobs.Job(
        lambda s: jobs.running_counts(_keyed(streams.file_stream(s, inbox2, schema)), seed),
        session, name="handoff-2",
    )
    streams.land(later_moved.drop("key_group"), inbox2)
    second.run()
    streams.land(later_rest.drop("key_group"), inbox1)
    first.run()

    def out(job: jobs.Job, number: int) -> DataFrame:
        return job.result(spark).select("seq", "key", "n", F.lit(number).alias("query"))

    return out(first, 1).unionByName(out(second, 2))


def _value_fold(state: tuple, record: Row) -> tuple:
    """Number, sum in cents and maximum so far."""
    n, cents, most = state
    own = record.cents
    if own is None:
        return n + 1, cents, most
    return n + 1, cents + own, own if most is None or own > most else most


VALUE_STATE, VALUE_START = "n long, cents long, most long", (0, 0, None)


@dataclass
class HeldHandoff:
    """Two hold-and-replay queries: the first one runs until moving groups are held, halfway between flip
    and release, and the second one takes those over with their values, held records and moves."""

    first: jobs.Job
    second: jobs.Job
    at: int


def _held_handoff(spark: SparkSession, d: str, max_bytes: int, parts: int, go_on: bool) -> HeldHandoff:
    b = bounds(spark, d)
    at = b.cancel_seq
    session = streams.stream_session(spark)
    cut = inputs.cutovers(spark, d, b)
    open_moves = settle(cut.withColumn("release_seq", F.lit(None).cast("long")), "open-moves")
    news = jobs.control_records(cut, LANES)
    ev = with_groups(records(spark, d)).select(
        "seq", "key", "key_group", "owner", F.round(F.col("value") * 100).cast("long").alias("cents")
    )

    def query(name: str, initial: DataFrame | None = None) -> tuple[jobs.Job, str, str]:
        inbox, control = fresh_path(spark, "inbox"), fresh_path(spark, "control")
        job = jobs.Job(
            lambda s: jobs.hold_replay(
                streams.file_stream(s, inbox, ev.schema, max_bytes),
                streams.file_stream(s, control, news.schema), LANES, open_moves,
                fold=_value_fold, state=VALUE_STATE, start=VALUE_START, initial=initial,
            ),
            session, name=name,
        )
        return job, inbox, control

    def land(rows: DataFrame, inbox: str, low: int, high: int) -> None:
        """In files one after another, in order of seq."""
        edges = [low + (high - low) * i // parts for i in range(parts + 1)]
        for a, z in zip(edges, edges[1:], strict=False):
            streams.land(rows.where((F.col("seq") > a) & (F.col("seq") <= z)).coalesce(1 if parts > 1 else 8), inbox)

    first, inbox1, control1 = query("held-1")
    streams.land(news.limit(0), control1)
    land(ev, inbox1, -1, at)
    first.run()
    first.mark(at)
    initial = settle(jobs.moved_state(first, at, cut), "moved", session)
    second, inbox2, control2 = query("held-2", initial)
    moving = F.broadcast(cut.select("key_group"))
    if go_on:
        streams.land(news, control2)
        land(ev.join(moving, "key_group", "left_semi").select(*ev.columns), inbox2, at, b.max_seq)
        second.run()
    land(ev.join(moving, "key_group", "left_anti").select(*ev.columns), inbox1, at, b.max_seq)
    first.run()
    return HeldHandoff(first, second, at)


def state_handoff_fold(
    spark: SparkSession, d: str, max_bytes: int = params.MICRO_BATCH_BYTES, parts: int = 1
) -> DataFrame:
    """A user's fold is handed over while records are held: the second query replays them at the release."""
    both = _held_handoff(spark, d, max_bytes, parts, go_on=True)

    def out(job: jobs.Job, number: int) -> DataFrame:
        return job.result(spark).drop("batch_id").withColumn("query", F.lit(number))

    return out(both.first, 1).unionByName(out(both.second, 2))


def state_all_variables(
    spark: SparkSession, d: str, max_bytes: int = params.MICRO_BATCH_BYTES, parts: int = 1
) -> DataFrame:
    """All state variables of a query that holds records, as of the record halfway, read after it went on:
    values per key, held records, and the moves that it knew."""
    job = (both := _held_handoff(spark, d, max_bytes, parts, go_on=False)).first
    every = statestore.read_variables(job.session, job.checkpoint, job.batch_at(both.at))
    part = lambda name: F.get_json_object("value", f"$.{name}")
    group = F.get_json_object("key", "$.key_group").cast("int").alias("key_group")
    moves = F.concat_ws(":", part("source"), part("target"), part("flip_seq"))
    # Every lane of a group knows its move.
    return every.where((F.col("state_name") != "move") | part("flip_seq").isNotNull()).select(
        "state_name", group,
        F.coalesce(F.get_json_object("entry", "$.key"), part("key")).alias("key"),
        F.when(F.col("state_name") == "move", moves).otherwise(F.col("value")).alias("value"),
    ).distinct()


def restart_recovery(spark: SparkSession, d: str) -> DataFrame:
    """Final counts of a query whose sink fails in the second phase after a part was written, and that
    starts again from its checkpoint; with the owners after it: overrides of moves that the lifecycle
    says are committed stay, those in flight are gone."""
    b = bounds(spark, d)
    session = streams.stream_session(spark)
    phases = _phases(spark, d, b)
    inbox = fresh_path(spark, "inbox")
    job = jobs.Job(
        lambda s: jobs.key_counts(_keyed(streams.file_stream(s, inbox, phases[0][1].schema))),
        session, "update", "restart",
    )
    write = sinks.batch_writer(job.output)

    def failing(batch: DataFrame, batch_id: int) -> None:
        write(batch.where("n % 2 = 0"), batch_id)
        raise RuntimeError("the sink is lost")

    for number, (_, phase) in enumerate(phases):
        streams.land(phase, inbox)
        if number == 1:
            try:
                job.run(failing)
            except StreamingQueryException as error:
                if "the sink is lost" not in str(error):
                    raise
        job.run()
    totals = job.result(spark).groupBy("key").agg(F.max("n").alias("n"))
    ended = lifecycle_fold(spark, d).where("state = 'COMMITTED'")
    committed = inputs.plans(spark, d).join(
        ended.select(F.col("migration_id").alias("key_group")), "key_group", "left_semi"
    ).select("key_group", "target")
    return with_groups(totals).join(F.broadcast(committed), "key_group", "left").select(
        "key", F.coalesce("target", "owner").alias("owner"), "n"
    )


def shared_target(spark: SparkSession, d: str) -> DataFrame:
    """The plans of the first two owners, sent to one third party."""
    return placement.shared_target(inputs.plans(spark, d).where("source < 2"))


QUERIES = {
    f.__name__: f
    for f in (
        tokens, word_count, stream_word_count, running_count, stream_running_count,
        stream_running_fold, last_count_by_owner, seen_by_owner, hot_key_totals,
        key_group_assign, owner_ranges, owner_load, singleton_groups, partition_size, make_plans,
        shared_target, serve_check, physical_route, phase_stream,
        state_snapshot, state_from_checkpoint, state_lookup, extract_group, export_group,
        bulk_load_group, ingest_group, replace_group, state_delta, state_delta_values, apply_delta,
        apply_delta_stored, delete_group,
        state_equal, isolation_check, transfer_summary, abort_rollback,
        precopy_rounds, precopy_outcome, state_change_feed, precopy_from_changes, precopy_changes_outcome,
        route_current, overrides_from_barriers, route_effective, stream_route_effective,
        affected_records, unaffected_records, plan_for_partition, barrier_fanout,
        barrier_arrivals, barrier_alignment, stream_alignment, migration_ready,
        hold_replay, stream_hold_replay, hold_cancel, stream_hold_cancel,
        hold_drop_owner, stream_hold_drop_owner, hold_stats,
        handoff_integrity, stream_handoff_integrity, handoff_reconciled, ownership_violations, same_as_no_migration,
        admit_plans, admit_over_time, lifecycle_fold, stream_lifecycle, invalid_transitions, timeouts,
        migration_metrics, active_migrations, machine_fold, machine_occupancy,
        state_handoff, state_handoff_fold, state_all_variables, restart_recovery,
    )
}
