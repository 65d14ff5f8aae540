"""The seven lifecycle states: legal moves and predicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# States and the moves allowed between them.
STATES = ["IDLE", "INIT", "PRE_COPY", "AWAIT_BARRIER", "FINALIZING", "COMMITTED", "ABORTED"]
LEGAL_MOVES = [
    ("IDLE", "INIT"),
    ("INIT", "PRE_COPY"),
    ("INIT", "ABORTED"),
    ("PRE_COPY", "AWAIT_BARRIER"),
    ("PRE_COPY", "ABORTED"),
    ("AWAIT_BARRIER", "FINALIZING"),
    ("AWAIT_BARRIER", "ABORTED"),
    ("FINALIZING", "COMMITTED"),
    ("FINALIZING", "ABORTED"),
]
TERMINAL = ["COMMITTED", "ABORTED"]
BACKGROUND = ["PRE_COPY", "AWAIT_BARRIER"]

# Kinds of lifecycle events.
PREPARE_SOURCE = "PrepareMigrationSource"
PREPARE_TARGET = "PrepareMigrationTarget"
START_PRE_COPY = "StartPreCopy"
ROUND_COMPLETE = "PreCopyRoundComplete"
BARRIER_ALIGNED = "BarrierAligned"
FINAL_DELTA_COMPLETE = "FinalDeltaComplete"
ABORT = "AbortMigration"
COMMIT = "CommitMigration"


def is_terminal(state: Column) -> Column:
    return state.isin(TERMINAL)


def is_active(state: Column) -> Column:
    return ~state.isin("IDLE", *TERMINAL)


def allows_background(state: Column) -> Column:
    return state.isin(BACKGROUND)


def is_legal_move(from_state: Column, to_state: Column) -> Column:
    moves = [F.lit(f"{a}>{b}") for a, b in LEGAL_MOVES]
    return F.array_contains(F.array(*moves), F.concat_ws(">", from_state, to_state))


def state_table(spark: SparkSession) -> DataFrame:
    """One row per state with its three predicates."""
    state = F.col("state")
    names = F.explode(F.array(*[F.lit(s) for s in STATES])).alias("state")
    return spark.range(1).select(names).select(
        state,
        is_terminal(state).alias("is_terminal"),
        is_active(state).alias("is_active"),
        allows_background(state).alias("background_ok"),
    )
