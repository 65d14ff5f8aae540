"""Control tables derived from the given tables: cuts, plans, barriers, overrides, event log."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from keyferry import params
from keyferry.functions import keys
from keyferry.functions import states as S
from keyferry.operators import placement, rounds, routing
from keyferry.scratch import settle
from keyferry.sources.tables import records, with_groups


@dataclass(frozen=True)
class Bounds:
    """Ends of the stream. One row of one column scan, so cuts become pushed-down literals."""

    max_seq: int
    first_day: date
    last_day: date

    @property
    def flip_seq(self) -> int:
        return self.max_seq * 2 // 5

    @property
    def release_seq(self) -> int:
        return self.max_seq * 3 // 5

    @property
    def cancel_seq(self) -> int:
        return self.max_seq // 2

    @property
    def recent_rows(self) -> int:
        return self.max_seq // 50

    @property
    def midpoint(self) -> str:
        middle = date.fromordinal((self.first_day.toordinal() + self.last_day.toordinal()) // 2)
        return f"{middle.isoformat()} 00:00:00"


def bounds(spark: SparkSession, sf_dir: str) -> Bounds:
    ends = records(spark, sf_dir).agg(
        F.max("seq").alias("max_seq"),
        F.to_date(F.min("ts")).alias("first_day"),
        F.to_date(F.max("ts")).alias("last_day"),
    )
    return Bounds(**ends.first().asDict())


def plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settle(placement.make_plans(records(spark, sf_dir)), "plans")


def cutovers(spark: SparkSession, sf_dir: str, b: Bounds) -> DataFrame:
    """Every plan flips at 40 % and is released at 60 % of the stream."""
    return settle(
        placement.make_plans(records(spark, sf_dir)).select(
            "key_group", "source", "target",
            F.lit(b.flip_seq).cast("long").alias("flip_seq"),
            F.lit(b.release_seq).cast("long").alias("release_seq"),
        ),
        "cutovers",
    )


def cancelled_cutovers(spark: SparkSession, sf_dir: str, b: Bounds) -> DataFrame:
    """As ``cutovers``; moves from an even owner are cancelled at 50 % of the stream."""
    return settle(
        cutovers(spark, sf_dir, b).withColumn(
            "cancel_seq", F.when(F.col("source") % 2 == 0, F.lit(b.cancel_seq).cast("long"))
        ),
        "cutovers",
    )


def barriers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One barrier at the end of each day with records, the last one after the stream's end.

    It moves each owner's busiest group of the day before to the next owner; the last one is final.
    ``name_part`` names the source tasks of the day's last channel. Day counts are combined map-side
    over (day, group); all later steps work on one row per day and group.
    """
    ev = with_groups(records(spark, sf_dir))
    last_channel = F.max_by("channel", "seq")
    per_group = ev.groupBy(F.to_date("ts").alias("day"), "owner", "key_group").agg(
        F.count("*").alias("_records"),
        F.max("seq").alias("_max_seq"),
        last_channel.alias("_channel"),
    )
    busiest = F.struct(F.col("_records"), -F.col("key_group"))
    per_owner = per_group.groupBy("day", "owner").agg(
        F.max_by("key_group", busiest).alias("key_group"),
        F.max("_max_seq").alias("_max_seq"),
        F.max_by("_channel", "_max_seq").alias("_channel"),
    )
    item = F.struct(
        "key_group", F.col("owner").alias("source"),
        keys.next_owner(F.col("owner")).alias("target"),
    )
    per_day = per_owner.groupBy("day").agg(
        F.sort_array(F.collect_list(F.struct("owner", item.alias("item")))).alias("_items"),
        F.max("_max_seq").alias("at_seq"),
        F.max_by("_channel", "_max_seq").alias("_channel"),
    )
    last = per_day.agg(F.max("day")).scalar()
    first = per_day.agg(F.min("day")).scalar()
    return settle(
        per_day.select(
            (F.datediff("day", first) + 1).cast("long").alias("migration_id"),
            (F.col("day") == last).alias("is_final"),
            F.date_add("day", 1).cast("timestamp_ntz").alias("at_ts"),
            "at_seq",
            F.concat(F.lit("Source: "), "_channel").alias("name_part"),
            F.col("_items.item").alias("plans"),
        ),
        "barriers",
    )


def override_log(daily: DataFrame) -> DataFrame:
    """The daily barriers' plans; every seventh barrier first clears all overrides."""
    moves = routing.override_log(daily)
    groups = moves.select("key_group").distinct()
    weekly = daily.where("migration_id % 7 = 0 and not is_final").select(F.col("at_seq").alias("w"))
    # One value: the positions of all clearings. Each group gets a row per clearing.
    clears = groups.select(
        "key_group",
        F.explode(weekly.agg(F.sort_array(F.collect_list("w"))).scalar()).alias("at_seq"),
        F.lit(-1).alias("pos"),
        F.lit(None).cast("int").alias("target"),
    )
    return moves.unionByName(clears)


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Task names: one source task per channel and owner, one counting task per owner."""
    ev = records(spark, sf_dir)
    seen = ev.groupBy("channel").agg(F.count("*").alias("_n")).select("channel")
    owners = F.explode(F.sequence(F.lit(1), F.lit(params.NUM_OWNERS))).alias("i")
    sources = seen.select("channel", owners).select(
        F.format_string(f"Source: %s (%d/{params.NUM_OWNERS})#0", "channel", "i").alias("task")
    )
    counters = placement.owner_load(ev).select(
        F.format_string(f"count (%d/{params.NUM_OWNERS})#0", F.col("owner") + 1).alias("task")
    )
    return settle(sources.unionByName(counters), "tasks")


def arrivals_from_days(days: DataFrame) -> DataFrame:
    """First arrivals per barrier from the first record per (task, channel, day).

    A channel's first record of a day is the arrival for every midnight since its previous day with
    records. Works on one row per task, channel and day.
    """
    before = F.lag("day").over(W.partitionBy("task", "channel").orderBy("day"))
    first = days.agg(F.min("day")).scalar()
    return (
        days.withColumn("_first", first)
        .withColumn("_since", F.date_add(F.coalesce(before, "_first"), 1))
        .where(F.col("_since") <= F.col("day"))
        .select(
            F.explode(F.sequence("_since", "day", F.expr("interval 1 day"))).alias("_at"),
            "task", "channel", "at_ts", "_first",
        )
        .select(
            F.datediff("_at", "_first").cast("long").alias("migration_id"),
            "task", "channel", "at_ts",
        )
    )


def expected_channels(days: DataFrame) -> DataFrame:
    """Every (barrier, task) with the task's number of channels."""
    ends = days.agg(F.min("day").alias("a"), F.max("day").alias("z"))
    number = F.datediff(ends.select("z").scalar(), ends.select("a").scalar()) + 1
    per_channel = days.select("task", "channel").distinct()
    return (
        per_channel.groupBy("task")
        .agg(F.count("*").alias("expected"))
        .withColumn("_last", number)
        .select(
            F.explode(F.sequence(F.lit(1).cast("long"), F.col("_last").cast("long")))
            .alias("migration_id"),
            "task", "expected",
        )
    )


def round_table(spark: SparkSession, sf_dir: str, b: Bounds) -> DataFrame:
    ev = with_groups(records(spark, sf_dir))
    schedule = rounds.round_schedule(spark, b.midpoint)
    return settle(rounds.precopy_rounds(ev, schedule), "rounds")


def event_log(spark: SparkSession, round_rows: DataFrame, b: Bounds) -> DataFrame:
    """Event log of one migration per key-group, on the real deltas of its rounds.

    Events come ten seconds apart from the midpoint on. By the migration's number: a command before
    the start (3 of 11), a failed prepare (9 of 23), a slow prepare (12 of 29), slow rounds
    (7 of 31), an abort (4 of 19), a late barrier (6 of 7), a failed final delta (4 of 5), no
    prepare at all (8 of 17), a late report (5 of 13).
    """
    outcome = rounds.precopy_outcome(round_rows).selectExpr(
        "migration_id as m",
        "round as last_round",
        "outcome = 'AWAIT_BARRIER' as converges",
        "if(migration_id % 31 = 7, 60, 10) as slow",
        "if(migration_id % 29 = 12, 60, 10) as prepare_s",
    ).selectExpr("*", "prepare_s + 10 + last_round * slow as late_s")
    reports = (
        round_rows.where("round >= 2")
        .join(outcome, F.col("migration_id") == F.col("m"))
        .where("round <= last_round or (m % 13 = 5 and round = last_round + 1)")
        .selectExpr(
            "migration_id",
            "cast(round + 2 as bigint) as pos",
            "prepare_s + 10 + (round - 1) * slow as at_s",
            f"'{S.ROUND_COMPLETE}' as kind",
            "delta_size", "bytes", "converged",
            "cast(null as boolean) as ok",
            "cast(null as string) as reason",
        )
    )

    def event(condition, pos, at_s, kind, size="null", ok="null", reason="null"):
        return (
            f"if({condition}, named_struct('pos', cast({pos} as bigint), 'at_s', {at_s}, "
            f"'kind', '{kind}', 'delta_size', cast({size} as bigint), 'ok', cast({ok} as boolean), "
            f"'reason', cast({reason} as string)), null)"
        )

    aligned_s = "late_s + if(m % 7 = 6, 120, 10)"
    control = ", ".join([
        event("m % 11 = 3", 0, 0, S.START_PRE_COPY),
        event("m % 17 <> 8", 1, 0, S.PREPARE_SOURCE, ok="true"),
        event("m % 17 <> 8", 2, "prepare_s", S.PREPARE_TARGET, ok="m % 23 <> 9"),
        event("true", 3, "prepare_s + 10", S.START_PRE_COPY),
        event("m % 19 = 4", "last_round + 4", "late_s + 1", S.ABORT, reason="'requested'"),
        event("converges", "last_round + 5", aligned_s, S.BARRIER_ALIGNED),
        event(
            "converges", "last_round + 6", f"{aligned_s} + 10", S.FINAL_DELTA_COMPLETE,
            size="m + 1", ok="m % 5 <> 4",
        ),
    ])
    control = outcome.selectExpr(
        "m", f"explode(filter(array({control}), e -> e is not null)) as e"
    ).selectExpr(
        "m as migration_id", "e.pos", "e.at_s", "e.kind", "e.delta_size",
        "cast(null as bigint) as bytes", "cast(null as boolean) as converged", "e.ok", "e.reason",
    )
    start = F.expr(f"timestamp_ntz'{b.midpoint}'")
    seconds = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("at_s"))
    log = reports.unionByName(control)
    return settle(
        log.select(
            "migration_id", "pos", (start + seconds).alias("at_ts"), "kind",
            F.col("migration_id").cast("int").alias("key_group"),
            "delta_size", "bytes", "converged", "ok", "reason",
        ),
        "event-log",
    )
