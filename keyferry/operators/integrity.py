"""Reconciliation of what was emitted with what was processed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyferry.scratch import lookup_join


def handoff_integrity(emitted: DataFrame, processed: DataFrame, cutovers: DataFrame) -> DataFrame:
    """Per migrating key: was every record processed once, before the cut here and after it there?

    ``emitted`` has ``key, key_group, seq``; ``processed`` also the ``owner`` that counted it.
    Work is split by (key, seq) first, so a hot key costs no single task more than its share.
    """
    moves = cutovers.select("key_group", "source", "target")
    sent = emitted.select("key", "key_group", "seq", F.lit(None).cast("int").alias("owner"))
    done = processed.select("key", "key_group", "seq", "owner")
    rows = sent.withColumn("_sent", F.lit(1)).unionByName(done.withColumn("_sent", F.lit(0)))
    moving = lookup_join(rows, moves, ["key_group"], F.col("seq"), "inner")
    at_source = (F.col("_sent") == 0) & (F.col("owner") == F.col("source"))
    at_target = (F.col("_sent") == 0) & (F.col("owner") == F.col("target"))
    per_record = moving.groupBy("key", "seq").agg(
        F.sum("_sent").alias("_emitted"),
        F.count_if(F.col("_sent") == 0).alias("_done"),
        F.count_if(at_source).alias("_source"),
        F.count_if(at_target).alias("_target"),
    )
    extra = F.greatest(F.col("_done") - F.col("_emitted"), F.lit(0))
    missing = F.greatest(F.col("_emitted") - F.col("_done"), F.lit(0))
    last_source = F.max(F.when(F.col("_source") > 0, F.col("seq")))
    first_target = F.min(F.when(F.col("_target") > 0, F.col("seq")))
    elsewhere = F.sum(F.col("_done") - F.col("_source") - F.col("_target"))
    return per_record.groupBy("key").agg(
        F.sum("_emitted").alias("emitted"),
        F.sum("_source").alias("at_source"),
        F.sum("_target").alias("at_target"),
        F.sum(missing).alias("lost"),
        F.sum(extra).alias("duplicated"),
        (F.coalesce(last_source < first_target, F.lit(True)) & (elsewhere == 0)).alias("cut_clean"),
    )


def ownership_violations(processed: DataFrame, cutovers: DataFrame) -> DataFrame:
    """Keys that do not migrate must have one owner throughout."""
    moved = cutovers.select("key_group")
    staying = lookup_join(processed, moved, ["key_group"], F.col("seq"), "left_anti")
    return (
        staying.groupBy("key")
        .agg((F.min("owner") != F.max("owner")).alias("_multi"))
        .agg(
            F.count("*").alias("keys_checked"),
            F.count_if("_multi").alias("keys_multi_owner"),
        )
    )
