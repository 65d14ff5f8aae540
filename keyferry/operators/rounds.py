"""Iterated copy: what changes between rounds, and where the rounds lead."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from keyferry import params
from keyferry.functions import keys

DAY_MS = 86_400_000


def round_schedule(spark: SparkSession, start: str, rounds: int = 12) -> DataFrame:
    """Intervals ``[from_ts, to_ts)`` of the rounds of a copy that begins at ``start``.

    Round 1 is the full copy and has no ``from_ts``. After it, schedule 0 halves its interval each
    round from a day on, schedule 1 keeps a day. Two rows per round.
    """
    double = 2 * DAY_MS
    halving = [
        F.expr(f"{double}L - shiftright({double}L, cast(id as int) - {k})") for k in (2, 1)
    ]
    constant = [(F.col("id") - k) * DAY_MS for k in (2, 1)]
    spans = [
        F.struct(F.lit(i).alias("schedule"), lo.alias("from_ms"), hi.alias("to_ms"))
        for i, (lo, hi) in enumerate((halving, constant))
    ]
    begin = f"timestamp_ntz'{start}'"
    at = "make_dt_interval(0, 0, 0, {} / 1000)"
    return spark.range(1, rounds + 1).select(
        F.col("id").cast("int").alias("round"), F.explode(F.array(*spans)).alias("s")
    ).select(
        "s.schedule",
        "round",
        F.expr(f"if(round = 1, null, {begin} + {at.format('s.from_ms')})").alias("from_ts"),
        F.expr(f"if(round = 1, {begin}, {begin} + {at.format('s.to_ms')})").alias("to_ts"),
    )


def precopy_rounds(
    records: DataFrame,
    schedule: DataFrame,
    converged_below: int = params.CONVERGED_BELOW,
) -> DataFrame:
    """Every non-empty key-group as a migration: entries and bytes copied in each round.

    A round copies the keys changed in its interval, round 1 all keys so far; rounds without change
    have zeros. One scan: records are matched with the schedule, which has two rows per round, and
    reduced to distinct keys before they are shuffled. Records need ``key, ts, key_group``. The rounds
    are those of the schedule, however many it has.
    """
    every_round = F.array_sort(F.collect_set("round"))
    in_round = (
        (F.pmod(F.col("key_group"), F.lit(2)) == F.col("schedule"))
        & (F.col("from_ts").isNull() | (F.col("ts") >= F.col("from_ts")))
        & (F.col("ts") < F.col("to_ts"))
    )
    # Records outside all rounds stay, so that their group is seen.
    changed = records.join(F.broadcast(schedule), in_round, "left").select(
        "key_group", "round", "key"
    ).distinct()
    sizes = changed.groupBy("key_group", "round").agg(
        F.count("*").alias("entries"), F.sum(keys.entry_bytes(F.col("key"))).alias("bytes")
    )
    # At most one value per round and group.
    by_round = F.map_from_entries(F.collect_list(
        F.when(F.col("round").isNotNull(), F.struct("round", F.struct("entries", "bytes")))
    ))
    per_group = sizes.groupBy("key_group").agg(by_round.alias("_sizes")).select(
        "key_group", "_sizes", F.explode(schedule.agg(every_round).scalar()).alias("round")
    )
    size = F.try_element_at("_sizes", F.col("round"))
    entries = F.coalesce(size["entries"], F.lit(0))
    return per_group.select(
        F.col("key_group").cast("long").alias("migration_id"),
        "round",
        entries.alias("delta_size"),
        F.coalesce(size["bytes"], F.lit(0)).alias("bytes"),
        (entries < converged_below).alias("converged"),
    )


def latest_changes(changes: DataFrame, on: list[str], values: list[str]) -> DataFrame:
    """The last change of each entry ``on``, whatever number of batches brought changes to it.

    ``changes`` has ``batch_id`` and ``change_type`` (``update`` or ``delete``); a deletion stays as a row without
    values, a tombstone. Combined map-side.
    """
    last = F.max_by(F.struct("change_type", *values), "batch_id").alias("_last")
    return changes.groupBy(*on).agg(last).select(
        *on,
        (F.col("_last.change_type") == "delete").alias("deleted"),
        *[F.when(F.col("_last.change_type") != "delete", F.col(f"_last.{v}")).alias(v) for v in values],
    )


def rounds_from_changes(
    changes: DataFrame,
    last_round: int,
    converged_below: int = params.CONVERGED_BELOW,
    num_groups: int = params.NUM_GROUPS,
) -> DataFrame:
    """Rounds of an iterated copy as in ``precopy_rounds``, told by a change feed instead of the records.

    ``changes`` has ``round, batch_id, change_type, key``; changes after ``last_round`` belong to no round but show
    that their key-group is there. An entry that changed in several batches of a round is copied
    once; one that was deleted last is sent as a tombstone and counts, too.
    """
    latest = latest_changes(changes, ["round", "key"], []).withColumn(
        "key_group", keys.key_group(F.col("key"), num_groups)
    )
    in_round = F.col("round") <= last_round
    sizes = latest.groupBy("key_group", F.when(in_round, F.col("round")).alias("round")).agg(
        F.count("*").alias("entries"), F.sum(keys.entry_bytes(F.col("key"))).alias("bytes")
    )
    # At most one value per round and group.
    by_round = F.map_from_entries(F.collect_list(
        F.when(F.col("round").isNotNull(), F.struct("round", F.struct("entries", "bytes")))
    ))
    size = F.try_element_at("_sizes", F.col("round"))
    entries = F.coalesce(size["entries"], F.lit(0))
    return (
        sizes.groupBy("key_group").agg(by_round.alias("_sizes"))
        .select("key_group", "_sizes", F.explode(F.sequence(F.lit(1), F.lit(last_round))).alias("round"))
        .select(
            F.col("key_group").cast("long").alias("migration_id"), "round", entries.alias("delta_size"),
            F.coalesce(size["bytes"], F.lit(0)).alias("bytes"), (entries < converged_below).alias("converged"),
        )
    )


def first_decision(
    reports: DataFrame,
    max_rounds: int = params.MAX_ROUNDS,
    max_non_decreasing: int = params.MAX_NON_DECREASING,
    earlier: DataFrame | None = None,
) -> DataFrame:
    """The first report of each migration that ends its rounds, and why.

    ``reports`` has ``migration_id, ord, delta_size, converged`` and any further columns, which are
    kept; ``earlier`` has ``migration_id, earlier``, the number of reports counted before these. A
    report converges, else diverges if
    its delta is the ``max_non_decreasing``-th in a row that did not shrink, else is the last one
    allowed. No report after the ``max_rounds``-th can be the first decision, so those are dropped
    before the shuffle and a migration costs at most ``max_rounds`` rows.
    """
    in_order = W.partitionBy("migration_id").orderBy("ord")
    numbered = reports.withColumn("_i", F.row_number().over(in_order)).where(
        F.col("_i") <= max_rounds
    )
    if earlier is None:
        numbered = numbered.withColumn("earlier", F.lit(0))
    else:
        numbered = numbered.join(earlier, "migration_id", "left").withColumn(
            "earlier", F.coalesce("earlier", F.lit(0))
        )
    previous = F.lag("delta_size").over(in_order)
    flagged = numbered.withColumn("_stuck", F.coalesce(F.col("delta_size") >= previous, F.lit(False)))
    runs = flagged.withColumn("_run", F.count_if(~F.col("_stuck")).over(in_order))
    in_run = W.partitionBy("migration_id", "_run").orderBy("ord")
    streaks = runs.withColumn("_streak", F.count_if("_stuck").over(in_run))
    decided = streaks.withColumn(
        "decision",
        F.when(F.col("converged"), "AWAIT_BARRIER")
        .when(F.col("_streak") >= max_non_decreasing, "DIVERGED")
        .when(F.col("_i") + F.col("earlier") >= max_rounds, "MAX_ROUNDS"),
    )
    kept = [c for c in reports.columns if c != "migration_id"]
    return (
        decided.where("decision is not null")
        .groupBy("migration_id")
        .agg(F.min_by(F.struct(*kept, "decision"), "ord").alias("_d"))
        .select("migration_id", "_d.*")
    )


def precopy_outcome(
    rounds: DataFrame,
    max_rounds: int = params.MAX_ROUNDS,
    max_non_decreasing: int = params.MAX_NON_DECREASING,
) -> DataFrame:
    """Where each migration's reported rounds (2 and later) lead, and at which round."""
    reports = rounds.where("round >= 2").select(
        "migration_id", F.col("round").alias("ord"), "delta_size", "converged"
    )
    decided = first_decision(reports, max_rounds, max_non_decreasing)
    last = rounds.groupBy("migration_id").agg(F.max("round").alias("_last"))
    return last.join(decided, "migration_id", "left").select(
        "migration_id",
        F.coalesce("decision", F.lit("PRE_COPY")).alias("outcome"),
        F.coalesce("ord", "_last").alias("round"),
    )
