"""Keyed state of a streaming query as a table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_state(
    session: SparkSession, checkpoint: str, batch_id: int | None = None, variable: str | None = None
) -> DataFrame:
    """All entries of a state, at the end of ``batch_id`` or of the last committed batch."""
    reader = session.read.format("statestore")
    if batch_id is not None:
        reader = reader.option("batchId", batch_id)
    if variable is not None:
        reader = reader.option("stateVarName", variable)
    return reader.load(checkpoint)


def variables(session: SparkSession, checkpoint: str) -> list[tuple[int, str | None]]:
    """Operators of a query with the names of their state variables, from the checkpoint's own metadata.

    The state of an operator of Spark's own (an aggregation, say) has no name.
    """
    found = session.read.format("state-metadata").load(checkpoint).select(
        "operatorId",
        F.explode_outer(
            F.from_json(
                F.get_json_object("operatorProperties", "$.stateVariables"),
                "array<struct<stateName: string>>",
            )
        ).alias("v"),
    )
    # Timers and the like start with a dollar sign.
    names = found.select("operatorId", "v.stateName").where(
        "stateName is null or not startswith(stateName, '$')"
    ).distinct()
    return sorted(((r[0], r[1]) for r in names.collect()), key=str)


def read_variables(
    session: SparkSession, checkpoint: str, batch_id: int | None = None
) -> DataFrame:
    """Every entry of every state variable of a query, of whatever kind, as one table.

    ``operator``, ``state_name``, ``key`` (the grouping key), ``entry`` (the key inside a map) and ``value``; the
    last three as JSON, as their columns differ. A list has a row per element. The variables are
    known from metadata, and there are as many as the query's code names.
    """
    parts = []
    for operator, name in variables(session, checkpoint):
        reader = session.read.format("statestore").option("operatorId", operator)
        if batch_id is not None:
            reader = reader.option("batchId", batch_id)
        if name is not None:
            reader = reader.option("stateVarName", name)
        state = reader.load(checkpoint)
        value = next(c for c in ("user_map_value", "list_element", "value") if c in state.columns)
        entry = "user_map_key" if "user_map_key" in state.columns else None
        parts.append(
            state.select(
                F.lit(operator).alias("operator"),
                F.lit(name).alias("state_name"),
                F.to_json("key").alias("key"),
                (F.to_json(entry) if entry else F.lit(None)).cast("string").alias("entry"),
                F.to_json(value).alias("value"),
            )
        )
    return reduce(DataFrame.unionByName, parts)


def read_changes(
    session: SparkSession, checkpoint: str, first_batch: int, last_batch: int
) -> DataFrame:
    """Entries changed in each batch: what an iterated copy sends instead of comparing again."""
    return (
        session.read.format("statestore")
        .option("readChangeFeed", True)
        .option("changeStartBatchId", first_batch)
        .option("changeEndBatchId", last_batch)
        .load(checkpoint)
    )
