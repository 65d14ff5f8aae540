"""Hold and replay at the cut, over counted records.

A cutover ``(key_group, source, target, flip_seq, release_seq)``, one per key-group: records up to
``flip_seq`` belong to the source, later ones to the target; those up to ``release_seq`` are held
there until the last round of state has landed. A null ``release_seq`` is a move not released yet. A
``cancel_seq``, if the column is there, gives a move up that was not released before: records held so
far are replayed at the source, later ones go where they would without the move.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyferry.scratch import lookup_join


def _cancelled() -> Column:
    cancel, release = F.col("cancel_seq"), F.col("release_seq")
    return cancel.isNotNull() & (release.isNull() | (cancel < release))


def drop_owner(cutovers: DataFrame, owner: int, at_seq: int) -> DataFrame:
    """Everything that an owner has in flight is given up at a record: moves from it and to it that were not
    released before. As rows of ``cutovers`` or, through ``jobs.control_records``, as news to a running query."""
    if "cancel_seq" not in cutovers.columns:
        cutovers = cutovers.withColumn("cancel_seq", F.lit(None).cast("long"))
    its_own = (F.col("source") == owner) | (F.col("target") == owner)
    at = F.lit(at_seq).cast("long")
    # The earlier one of two cancellations counts.
    return cutovers.withColumn(
        "cancel_seq", F.when(its_own, F.least("cancel_seq", at)).otherwise(F.col("cancel_seq"))
    )


def with_phase(records: DataFrame, cutovers: DataFrame) -> DataFrame:
    """Add the group's cutover and ``phase``: pre, held, live, or other for groups that stay."""
    if "cancel_seq" not in cutovers.columns:
        cutovers = cutovers.withColumn("cancel_seq", F.lit(None).cast("long"))
    seq, flip, release = F.col("seq"), F.col("flip_seq"), F.col("release_seq")
    phase = (
        F.when(flip.isNull() | (_cancelled() & (seq > F.col("cancel_seq"))), "other")
        .when(seq <= flip, "pre")
        .when(_cancelled() | release.isNull() | (seq <= release), "held")
        .otherwise("live")
    )
    return lookup_join(records, cutovers, ["key_group"], seq, "left").withColumn("phase", phase)


def hold_replay(counted: DataFrame, cutovers: DataFrame) -> DataFrame:
    """Where, in what phase and with what count each record takes effect.

    Holding keeps the order, so ``n`` is the plain running count. A held record takes effect at
    the release, or at the source when the move is cancelled; if there is neither, it has neither
    count nor effect yet.
    """
    phase = F.col("phase")
    ends_at = F.when(_cancelled(), F.col("cancel_seq")).otherwise(F.col("release_seq"))
    waiting = (phase == "held") & ends_at.isNull()
    owner = (
        F.when(phase == "other", F.col("owner"))
        .when((phase == "pre") | _cancelled(), F.col("source"))
        .otherwise(F.col("target"))
    )
    return with_phase(counted, cutovers).select(
        "seq",
        "key",
        "key_group",
        "phase",
        owner.alias("owner"),
        F.when(phase == "held", ends_at).otherwise(F.col("seq")).alias("effective_seq"),
        F.when(~waiting, F.col("n")).alias("n"),
    )


def hold_stats(replayed: DataFrame, cutovers: DataFrame) -> DataFrame:
    """Per moved group: held records, longest wait, and held records of groups that do not move.

    ``replayed`` has ``key_group, phase, ts``; ``cutovers`` also ``release_ts``. The last column
    must be 0 and is repeated on every row.
    """
    held = replayed.where("phase = 'held'").groupBy("key_group").agg(
        F.count("*").alias("_held"), F.min("ts").alias("_first")
    )
    joined = cutovers.select("key_group", "release_ts", F.lit(True).alias("_planned")).join(
        held, "key_group", "full_outer"
    )
    # Difference of two timestamps without time zone, in whole seconds.
    wait = F.expr("cast(cast(release_ts - _first as interval second) as decimal(18, 6))")
    outside = F.coalesce(
        joined.where("_planned is null").agg(F.sum("_held")).scalar(), F.lit(0)
    )
    return joined.where("_planned").select(
        "key_group",
        F.coalesce("_held", F.lit(0)).alias("held"),
        F.floor(wait).cast("long").alias("max_wait_s"),
        outside.alias("held_outside_plans"),
    )
