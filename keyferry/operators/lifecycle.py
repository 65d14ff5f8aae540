"""Lifecycle of long-running moves, derived from their event log.

The lifecycle is a line (IDLE, INIT, PRE_COPY, AWAIT_BARRIER, FINALIZING, COMMITTED) with an exit to
ABORTED from every live state. So no log is folded row by row: the event that ends a state is the
first one of its kind after the state began, which is one aggregation per state. A migration with
very many events costs no more than its share.

Log rows follow ``schemas.EVENT``; ``pos`` orders a migration's events.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from keyferry import params
from keyferry.functions import states as S
from keyferry.operators.rounds import first_decision
from keyferry.scratch import fits_broadcast, lookup_join, settle

MIGRATION = "migration_id"


def _first(condition: Column, *extra: str) -> Column:
    """First event that meets the condition, as ``(pos, at_ts, ...)``."""
    return F.min_by(
        F.when(condition, F.struct("pos", "at_ts", *extra)), F.when(condition, F.col("pos"))
    )


def milestones(
    log: DataFrame,
    max_rounds: int = params.MAX_ROUNDS,
    max_non_decreasing: int = params.MAX_NON_DECREASING,
    max_rows: int = params.BROADCAST_ROWS,
) -> DataFrame:
    """Per started migration the events that could end each state, timeouts not yet considered.

    A migration starts with its first prepare event; events before it, and those of migrations
    that never start, are ignored.
    """
    kind = F.col("kind")
    prepare = kind.isin(S.PREPARE_SOURCE, S.PREPARE_TARGET)
    ok = F.coalesce("ok", F.lit(True))
    started = settle(
        log.where(prepare)
        .groupBy(MIGRATION)
        .agg(
            _first(prepare).alias("start"),
            _first((kind == S.PREPARE_SOURCE) & ok).alias("_source"),
            _first((kind == S.PREPARE_TARGET) & ok).alias("_target"),
            _first(~ok).alias("_failed"),
        )
        .withColumn(
            "prepared",
            F.when(F.col("_source.pos") > F.col("_target.pos"), F.col("_source"))
            .when(F.col("_source.pos") < F.col("_target.pos"), F.col("_target")),
        )
        .withColumn(
            "prepare_failed",
            F.when(
                F.col("prepared").isNull() | (F.col("_failed.pos") < F.col("prepared.pos")),
                F.col("_failed"),
            ),
        )
        .select(MIGRATION, "start", "prepared", "prepare_failed"),
        "started",
    )
    # No stage has more rows than there are started migrations: one size check holds for all.
    fits = fits_broadcast(started, max_rows)

    def after(events: DataFrame, stage: DataFrame) -> DataFrame:
        joined = lookup_join(events, stage, [MIGRATION], F.col("pos"), fits=fits)
        return joined.where("pos > _since")

    starts = started.select(MIGRATION, F.col("start.pos").alias("_since"))
    aborted = after(log.where(kind == S.ABORT), starts).groupBy(MIGRATION).agg(
        _first(F.lit(True), "reason").alias("abort")
    )

    prepares = started.select(
        MIGRATION,
        F.col("start.pos").alias("_since"),
        F.col("prepared.pos").alias("_prepared"),
    )
    reports = after(log.where(kind == S.ROUND_COMPLETE), prepares)
    early = reports.where("_prepared is null or pos < _prepared").groupBy(MIGRATION).agg(
        F.count("*").alias("earlier")
    )
    counted = reports.where("pos > _prepared").select(
        MIGRATION, F.col("pos").alias("ord"), "at_ts", "delta_size", "converged"
    )
    decided = first_decision(counted, max_rounds, max_non_decreasing, early).select(
        MIGRATION, F.struct(F.col("ord").alias("pos"), "at_ts", "decision").alias("decided")
    )

    waiting = decided.where("decided.decision = 'AWAIT_BARRIER'").select(
        MIGRATION, F.col("decided.pos").alias("_since")
    )
    aligned = (
        after(log.where(kind == S.BARRIER_ALIGNED), waiting)
        .groupBy(MIGRATION)
        .agg(_first(F.lit(True)).alias("aligned"))
    )
    cut = aligned.select(MIGRATION, F.col("aligned.pos").alias("_since"))
    final = after(log.where(kind == S.FINAL_DELTA_COMPLETE), cut).groupBy(MIGRATION).agg(
        _first(F.lit(True), "ok").alias("final")
    )
    return (
        started.join(aborted, MIGRATION, "left")
        .join(decided, MIGRATION, "left")
        .join(aligned, MIGRATION, "left")
        .join(final, MIGRATION, "left")
    )


def resolve(
    stages: DataFrame, now: Column, timeouts: dict[str, int] | None = None
) -> DataFrame:
    """Final state of each migration from its milestones.

    A migration has at most six milestones; they are walked in log order. One that comes after the
    deadline of the present state finds the migration aborted at the deadline. ``now`` is looked at
    last, for migrations without a further milestone.
    """
    limits = {**params.TIMEOUTS_S, **(timeouts or {})}

    def step(of: str, since: str | None, to: str, why: str = "null") -> str:
        # ``since`` is the state the milestone ends; null is any.
        return (
            f"if({of} is null, null, named_struct('pos', {of}.pos, 'at_ts', {of}.at_ts, 'since', "
            f"cast({repr(since) if since else 'null'} as string), 'to', {to}, "
            f"'why', cast({why} as string)))"
        )

    steps = ", ".join([
        step("prepare_failed", "INIT", "'ABORTED'", "'prepare failed'"),
        step("prepared", "INIT", "'PRE_COPY'"),
        step(
            "decided", "PRE_COPY",
            "if(decided.decision = 'AWAIT_BARRIER', 'AWAIT_BARRIER', 'ABORTED')",
            "case decided.decision when 'DIVERGED' then 'divergence' "
            "when 'MAX_ROUNDS' then 'maximum rounds' end",
        ),
        step("aligned", "AWAIT_BARRIER", "'FINALIZING'"),
        step(
            "final", "FINALIZING", "if(coalesce(final.ok, true), 'COMMITTED', 'ABORTED')",
            "if(coalesce(final.ok, true), null, 'final delta failed')",
        ),
        step("abort", None, "'ABORTED'", "coalesce(abort.reason, 'abort')"),
    ])
    end_of_log = (
        "named_struct('pos', cast(null as bigint), 'at_ts', _now, 'since', 'none', "
        "'to', cast(null as string), 'why', cast(null as string))"
    )
    begin = (
        "named_struct('state', 'INIT', 'entered_at', start.at_ts, 'reason', cast(null as string), "
        "'ended_at', cast(null as timestamp_ntz), 'ended_pos', cast(null as bigint), "
        "'timed_out_in', cast(null as string), 'left_at', cast(null as timestamp_ntz))"
    )
    seconds = " ".join(f"when '{state}' then {limit}" for state, limit in limits.items())
    # Terminal states have no limit, so their deadline is null and nothing is late or moves.
    deadline = f"(a.entered_at + make_dt_interval(0, 0, 0, case a.state {seconds} end))"
    late = f"coalesce(m.at_ts > {deadline}, false)"
    moves = f"(not {late} and {deadline} is not null and (m.since is null or m.since = a.state))"
    ends = f"({moves} and m.to in ('COMMITTED', 'ABORTED'))"

    def pick(when_late: str, moved: str, when_moved: str, keep: str) -> str:
        return f"case when {late} then {when_late} when {moved} then {when_moved} else a.{keep} end"

    walk = ", ".join([
        "'state', " + pick("'ABORTED'", moves, "m.to", "state"),
        "'entered_at', " + pick(deadline, moves, "m.at_ts", "entered_at"),
        "'reason', " + pick("concat('timeout ', a.state)", moves, "m.why", "reason"),
        "'ended_at', " + pick(deadline, ends, "m.at_ts", "ended_at"),
        "'ended_pos', " + pick("a.ended_pos", ends, "m.pos", "ended_pos"),
        "'timed_out_in', " + pick("a.state", "false", "null", "timed_out_in"),
        "'left_at', " + pick("m.at_ts", "false", "null", "left_at"),
    ])
    in_order = f"concat(sort_array(filter(array({steps}), m -> m is not null)), array({end_of_log}))"
    end = F.expr(f"aggregate({in_order}, {begin}, (a, m) -> named_struct({walk}))")
    return stages.withColumn("_now", now).withColumn("_end", end).select(
        *stages.columns, "_end.*"
    )


def lifecycle(
    log: DataFrame,
    timeouts: dict[str, int] | None = None,
    max_rounds: int = params.MAX_ROUNDS,
    max_non_decreasing: int = params.MAX_NON_DECREASING,
    max_rows: int = params.BROADCAST_ROWS,
) -> DataFrame:
    """One settled row per started migration: milestones and final state, "now" being the log's end."""
    stages = milestones(log, max_rounds, max_non_decreasing, max_rows)
    now = log.agg(F.max("at_ts")).scalar()
    return settle(resolve(stages, now, timeouts), "lifecycle")


def lifecycle_fold(walked: DataFrame) -> DataFrame:
    return walked.select(MIGRATION, "state", "reason", "ended_at")


def _within(walked: DataFrame) -> Column:
    """Events a migration still looked at: after its start and not after its end."""
    ended_at, ended_pos = F.col("ended_at"), F.col("ended_pos")
    before_end = ended_at.isNull() | (
        F.when(ended_pos.isNotNull(), F.col("pos") <= ended_pos)
        .otherwise(F.col("at_ts") <= ended_at)
    )
    return (F.col("pos") >= F.col("start.pos")) & before_end


def _state_before(walked: DataFrame) -> Column:
    """State a migration was in when the event at ``pos`` came."""
    pos = F.col("pos")
    return (
        F.when(pos <= F.col("start.pos"), "IDLE")
        .when(~_within(walked), F.col("state"))
        .when(pos > F.col("aligned.pos"), "FINALIZING")
        .when(
            (pos > F.col("decided.pos")) & (F.col("decided.decision") == "AWAIT_BARRIER"),
            "AWAIT_BARRIER",
        )
        .when(pos > F.col("prepared.pos"), "PRE_COPY")
        .otherwise("INIT")
    )


def requested_state(kind: Column) -> Column:
    """State an event asks for; null for events that only report."""
    return (
        F.when(kind == S.START_PRE_COPY, "PRE_COPY")
        .when(kind == S.BARRIER_ALIGNED, "FINALIZING")
        .when(kind.isin(S.FINAL_DELTA_COMPLETE, S.COMMIT), "COMMITTED")
        .when(kind == S.ABORT, "ABORTED")
    )


def invalid_transitions(log: DataFrame, walked: DataFrame) -> DataFrame:
    """Requests that the transition table forbids, counted; a request for the present state is none."""
    seen = lookup_join(log, walked, [MIGRATION], F.col("pos"))
    from_state, to_state = _state_before(walked), requested_state(F.col("kind"))
    moves = seen.select(
        MIGRATION, from_state.alias("from_state"), to_state.alias("to_state")
    ).where("to_state is not null and from_state <> to_state")
    return (
        moves.where(~S.is_legal_move(F.col("from_state"), F.col("to_state")))
        .groupBy(MIGRATION, "from_state", "to_state")
        .agg(F.count("*").alias("events"))
    )


def timeouts(walked: DataFrame) -> DataFrame:
    """Migrations that outstayed a state, and by how much before its late event or "now" came."""
    overdue = F.expr("cast(cast(left_at - ended_at as interval second) as decimal(18, 6))")
    return walked.where("timed_out_in is not null").select(
        MIGRATION,
        F.col("timed_out_in").alias("state"),
        F.floor(overdue).cast("long").alias("overdue_s"),
    )


def migration_metrics(log: DataFrame, walked: DataFrame) -> DataFrame:
    """Rounds, bytes, last delta, duration in seconds and the two flags of each migration."""
    kind = F.col("kind")
    is_round, is_final = kind == S.ROUND_COMPLETE, kind == S.FINAL_DELTA_COMPLETE
    ends = walked.select(MIGRATION, "start", "ended_at", "ended_pos")
    seen = lookup_join(
        log.where(is_round | is_final), ends, [MIGRATION], F.col("pos")
    ).where(_within(ends))
    moved = F.when(is_round, F.col("bytes")).otherwise(F.col("delta_size"))
    sums = seen.groupBy(MIGRATION).agg(
        F.count_if(is_round).alias("_rounds"),
        F.sum(moved).alias("_bytes"),
        F.bool_or(is_final & F.coalesce("ok", F.lit(True))).alias("_final"),
        F.max_by(F.when(is_round, F.col("delta_size")), F.when(is_round, F.col("pos"))).alias("_last"),
    )
    now = log.agg(F.max("at_ts")).scalar()
    spent = walked.withColumn("_now", now).withColumn("_end", F.coalesce("ended_at", "_now"))
    seconds = F.expr("cast(cast(_end - start.at_ts as interval second) as decimal(18, 6))")
    injected = F.col("aligned").isNotNull() | (F.col("decided.decision") == "AWAIT_BARRIER")
    in_time = F.col("ended_at").isNull() | (
        F.when(F.col("ended_pos").isNotNull(), F.col("decided.pos") <= F.col("ended_pos"))
        .otherwise(F.col("decided.at_ts") <= F.col("ended_at"))
    )
    return spent.join(sums, MIGRATION, "left").select(
        MIGRATION,
        F.coalesce("_rounds", F.lit(0)).alias("rounds"),
        F.coalesce("_bytes", F.lit(0)).alias("bytes"),
        F.col("_last").alias("last_delta"),
        F.floor(seconds).cast("long").alias("duration_s"),
        F.coalesce(injected & in_time, F.lit(False)).alias("barrier_injected"),
        # The final copy is sent once barriers are aligned, so its success counts from then on only.
        (F.col("aligned").isNotNull() & F.coalesce("_final", F.lit(False))).alias("final_delta_sent"),
    )


def active_migrations(walked: DataFrame) -> DataFrame:
    """Number of migrations in each of the seven states."""
    counts = walked.groupBy("state").agg(F.count("*").alias("_n"))
    return S.state_table(walked.sparkSession).join(counts, "state", "left").select(
        "state", "is_terminal", "is_active", "background_ok",
        F.coalesce("_n", F.lit(0)).alias("migrations"),
    )


def admit_plans(requests: DataFrame, active: DataFrame) -> DataFrame:
    """Admit the first request of each key-group that is not migrating; number the admitted ones.

    ``requests`` is ``(pos, key_group)`` in order of ``pos``, ``active`` has the migrating
    key-groups. Refused requests get no id. Ids are given over at most one row per key-group.
    """
    free = (
        requests.groupBy("key_group").agg(F.min("pos").alias("pos"))
        .join(active.select("key_group").distinct(), "key_group", "left_anti")
    )
    admitted = settle(
        free.withColumn(
            "migration_id", F.row_number().over(W.orderBy("pos")).cast("long")
        ),
        "admitted",
    )
    return lookup_join(requests, admitted, ["key_group", "pos"], F.col("pos"), "left").select(
        "pos", "key_group", F.col("migration_id").isNotNull().alias("admitted"), "migration_id"
    )


#: Ranges that a global order is cut into; each table of ranges has at most so many rows per group.
RANGES = 256


def _ranges(df: DataFrame, column: str, ranges: int) -> Column:
    """Number of the range that a row's ``column`` falls in, of about equally full ones. One value is read."""
    steps = [i / ranges for i in range(1, ranges)]
    cuts = df.agg(F.percentile_approx(column, steps, 10 * ranges).alias("c")).first()["c"]
    ends = F.array(*[F.lit(c) for c in sorted(set(cuts or []))]).cast("array<long>")
    return F.size(F.filter(ends, lambda end: end < F.col(column)))


def _numbered(df: DataFrame, order: str, name: str, ranges: int) -> DataFrame:
    """Rows numbered from 1 in order, without one task that orders them all: numbers inside a range start
    from the rows in earlier ranges."""
    cut = settle(df.withColumn("_range", _ranges(df, order, ranges)), "ranges")
    # At most ``ranges`` rows.
    sizes = cut.groupBy("_range").agg(F.count("*").alias("_rows"))
    earlier = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    base = sizes.select("_range", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_base"))
    inside = F.row_number().over(W.partitionBy("_range").orderBy(order))
    return (
        cut.join(F.broadcast(base), "_range")
        .withColumn(name, (F.col("_base") + inside).cast("long"))
        .drop("_range", "_base")
    )


def admit_over_time(requests: DataFrame, ranges: int = RANGES) -> DataFrame:
    """Admit a request when its key-group is free, and let the group go again when the move ends.

    ``requests`` has ``pos`` (unique), ``key_group``, ``at_ts`` and ``until_ts``, the end of the move if it is
    admitted (null: never). Requests come in order of ``at_ts``, then ``pos``. A group is free from ``until_ts``
    on; a move that ends as it begins, or before, holds back no other. Admitted requests get ids in
    order of ``pos``, the others none. Requests without a time are refused; a null group is a group.

    Whoever is admitted, the next one admitted in its group is the first request at or after its end. These links
    don't depend on each other, so they are found at once, and what is admitted is what they reach from the
    group's first request: found by doubling the links, in as many rounds as the logarithm of the longest
    chain. A group's requests are cut in time ranges, so that a busy group is not one task.
    """
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    rows = requests.where("at_ts is not null").select(
        F.col("pos").cast("long").alias("pos"), "key_group", micros("at_ts").alias("at"),
        F.greatest(micros("until_ts"), micros("at_ts")).alias("_ends"),
        F.col("until_ts").isNull().alias("_endless"),
    )
    rows = settle(
        rows.select("pos", "key_group", "at", F.when(~F.col("_endless"), F.col("_ends")).alias("until")), "requests"
    )
    # A point in time is (time, pos); an end comes before the requests of its time, but after its own.
    first_pos = F.lit(-(1 << 63)).cast("long")
    starts = rows.select("key_group", "at", F.col("pos").alias("tie"), F.lit(0).alias("kind"), "pos")
    ends = rows.where("until is not null").select(
        "key_group", F.col("until").alias("at"),
        F.when(F.col("until") > F.col("at"), first_pos).otherwise(F.col("pos")).alias("tie"),
        F.lit(1).alias("kind"), "pos",
    )
    points = settle(
        starts.unionByName(ends).withColumn("range", _ranges(rows, "at", ranges)), "time-points"
    )
    request = F.when(F.col("kind") == 0, F.col("pos"))
    in_range = W.partitionBy("key_group", "range").orderBy("at", "tie", "kind")
    following = in_range.rowsBetween(1, W.unboundedFollowing)
    near = points.withColumn("near", F.first(request, ignorenulls=True).over(following)).where("kind = 1")
    # Per group at most ``ranges`` rows: the first request of each range, and the next range's.
    firsts = points.where("kind = 0").groupBy("key_group", "range").agg(
        F.min(F.struct("at", "tie", "pos"))["pos"].alias("first")
    )
    every = points.select("key_group", "range").distinct().join(
        firsts.withColumnsRenamed({"key_group": "_g", "range": "_r"}),
        F.col("key_group").eqNullSafe(F.col("_g")) & (F.col("range") == F.col("_r")), "left",
    )
    later = W.partitionBy("key_group").orderBy("range").rowsBetween(1, W.unboundedFollowing)
    nexts = settle(
        every.select("key_group", "range", F.first("first", ignorenulls=True).over(later).alias("far")), "next-ranges"
    )
    links = lookup_join(near, nexts, ["key_group", "range"], F.col("pos"), "left", nulls_match=True)
    jump = settle(
        links.select("pos", F.coalesce("near", "far").alias("to")).where("to is not null"), "next-moves"
    )
    reached = settle(
        rows.groupBy("key_group").agg(F.min(F.struct("at", "pos"))["pos"].alias("pos")).select("pos"), "admitted"
    )
    while True:
        more = reached.join(jump, "pos").select(F.col("to").alias("pos"))
        grown = settle(reached.unionByName(more).distinct(), "admitted")
        # Twice as long links; where they end, the chains have been followed to their ends.
        beyond = jump.select("pos", F.col("to").alias("mid")).join(
            jump.withColumnRenamed("pos", "mid"), "mid"
        )
        jump = settle(beyond.select("pos", "to"), "next-moves")
        reached = grown
        if jump.isEmpty():
            break
    numbered = _numbered(reached, "pos", "migration_id", ranges)
    # Positions are unique on both sides, so no key is hot.
    return requests.join(numbered, "pos", "left").select(
        "pos", "key_group", F.col("migration_id").isNotNull().alias("admitted"), "migration_id"
    )
