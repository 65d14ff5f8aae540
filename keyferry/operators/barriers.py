"""Barriers: whom they touch, where they arrived, and when a task is aligned.

A barrier is ``(migration_id, is_final, at_ts, plans)``, ``plans`` an array of
``(key_group, source, target)``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyferry.scratch import lookup_join, settle


def barrier_groups(barriers: DataFrame) -> DataFrame:
    """Key-groups named by any barrier."""
    return barriers.select(F.explode("plans.key_group").alias("key_group")).distinct()


def affected_records(records: DataFrame, barriers: DataFrame) -> DataFrame:
    """Records of key-groups that a barrier moves."""
    groups = settle(barrier_groups(barriers), "barrier-groups")
    return lookup_join(records, groups, ["key_group"], F.col("seq"), "left_semi")


def unaffected_records(records: DataFrame, barriers: DataFrame) -> DataFrame:
    """Records of all other key-groups."""
    groups = settle(barrier_groups(barriers), "barrier-groups")
    return lookup_join(records, groups, ["key_group"], F.col("seq"), "left_anti")


def plan_for_partition(barriers: DataFrame) -> DataFrame:
    """Each barrier's plan for each key-group it names: the first one listed."""
    return (
        barriers.select("migration_id", F.posexplode("plans").alias("pos", "plan"))
        .groupBy("migration_id", F.col("plan.key_group").alias("key_group"))
        .agg(F.min_by(F.struct("plan.source", "plan.target"), "pos").alias("_p"))
        .select("migration_id", "key_group", "_p.source", "_p.target")
    )


def barrier_fanout(barriers: DataFrame, tasks: DataFrame) -> DataFrame:
    """How many tasks get each barrier: those whose name contains its ``name_part``.

    The text match runs once per distinct ``name_part``, not per barrier.
    """
    parts = barriers.select("name_part").distinct()
    matches = (
        parts.join(tasks, F.col("task").contains(F.col("name_part")))
        .groupBy("name_part")
        .agg(F.count("*").alias("_n"))
    )
    return barriers.join(matches, "name_part", "left").select(
        "migration_id", F.coalesce("_n", F.lit(0)).alias("injected")
    )


def first_arrivals(arrivals: DataFrame) -> DataFrame:
    """Earliest arrival per channel; repeated arrivals count once."""
    return arrivals.groupBy("migration_id", "task", "channel").agg(
        F.min("at_ts").alias("at_ts")
    )


def barrier_arrivals(arrivals: DataFrame) -> DataFrame:
    """Distinct channels each task has seen each barrier on."""
    return first_arrivals(arrivals).groupBy("migration_id", "task").agg(
        F.count("*").alias("channels_seen")
    )


def barrier_alignment(expected: DataFrame, arrivals: DataFrame) -> DataFrame:
    """A task is aligned once a barrier has come on every one of its input channels.

    ``expected`` is ``(migration_id, task, expected)``, one row per pair, also without arrivals.
    """
    seen = first_arrivals(arrivals).groupBy("migration_id", "task").agg(
        F.count("*").alias("_seen"), F.max("at_ts").alias("_last")
    )
    received = F.coalesce("_seen", F.lit(0))
    aligned = received >= F.col("expected")
    return expected.join(seen, ["migration_id", "task"], "left").select(
        "migration_id",
        "task",
        received.alias("received"),
        "expected",
        aligned.alias("aligned"),
        F.when(aligned, F.col("_last")).alias("aligned_at"),
    )


def migration_ready(alignment: DataFrame, num_tasks: int) -> DataFrame:
    """A migration is ready once all tasks are there and aligned."""
    tasks_aligned = F.count_if("aligned")
    return alignment.groupBy("migration_id").agg(
        tasks_aligned.alias("tasks_aligned"), (tasks_aligned == num_tasks).alias("ready")
    )


def channel_days(records: DataFrame) -> DataFrame:
    """First record of each (task, channel) per day; map-side combined."""
    return records.groupBy(
        F.col("owner").alias("task"), "channel", F.to_date("ts").alias("day")
    ).agg(F.min("ts").alias("at_ts"))
