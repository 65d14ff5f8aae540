"""Sinks: state tables partitioned by key-group, and exactly-once output of streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyferry.operators.state import VALUES, extract_groups
from keyferry.operators.state import apply_delta as state_with_delta
from keyferry.scratch import settle


def write_state(state: DataFrame, path: str) -> DataFrame:
    """Write a state table with one directory per key-group and read it back.

    ``rebalance`` brings a group's entries together and lets adaptive execution split a group that
    is too big for one task. A group without entries leaves no directory.
    """
    state.hint("rebalance", F.col("key_group")).write.partitionBy("key_group").parquet(path)
    return read_state(state.sparkSession, path, state)


def read_state(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    return spark.read.schema(like.schema).parquet(path).select(*like.columns)


def overwrite_groups(moved: DataFrame, path: str) -> None:
    """Replace only the key-groups present in ``moved``; all other directories stay untouched."""
    (
        moved.hint("rebalance", F.col("key_group"))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("key_group")
        .parquet(path)
    )


def applied_deltas(spark: SparkSession, path: str) -> DataFrame:
    """Ledger of the deltas that were applied to the state table at ``path``: id, groups, entries."""
    schema = "delta_id string, groups long, entries long"
    try:
        return spark.read.schema(schema).parquet(f"{path}.deltas")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def apply_delta(
    delta: DataFrame, path: str, like: DataFrame, delta_id: str,
    on: list[str] | None = None, values: list[str] = VALUES,
) -> tuple[int, int]:
    """Apply a written delta (see ``operators.state.state_delta``) to the stored state table at ``path``.

    Only the folders of changed key-groups are read and rewritten. The ledger remembers the delta by its
    id, so a second pass writes nothing. A pass that was lost before it got there may be repeated: putting
    and deleting the same entries again gives the same table. Gives the numbers of groups and of
    entries that were changed, zeros if the delta was applied before.
    """
    spark = delta.sparkSession
    if not applied_deltas(spark, path).where(F.col("delta_id") == delta_id).isEmpty():
        return 0, 0
    sizes = delta.groupBy("key_group").agg(F.count("*").alias("entries"))
    # One row per key-group.
    changed = {r["key_group"]: r["entries"] for r in sizes.collect()}
    if changed:
        current = extract_groups(read_state(spark, path, like), sizes)
        applied = settle(state_with_delta(current, delta, on, values), "applied")
        overwrite_groups(applied.select(*like.columns), path)
        left = {r["key_group"] for r in applied.select("key_group").distinct().collect()}
        empty = spark.createDataFrame([], like.drop("key_group").schema)
        for group in sorted(set(changed) - left):
            # A group that lost its last entry has no rows that could replace its folder.
            empty.coalesce(1).write.mode("overwrite").parquet(f"{path}/key_group={group}")
    note = [(delta_id, len(changed), sum(changed.values()))]
    spark.createDataFrame(note, "delta_id string, groups long, entries long").coalesce(1).write.mode(
        "append"
    ).parquet(f"{path}.deltas")
    return len(changed), sum(changed.values())


def folder_files(spark: SparkSession, path: str) -> DataFrame:
    """The files of a state table by key-group, with their times."""
    return spark.read.parquet(path).select(
        "key_group", F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_modification_time").alias("written"),
    ).distinct()


def batch_writer(path: str) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` sink: batch ``n`` owns one directory, so a repeated batch replaces itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return write
