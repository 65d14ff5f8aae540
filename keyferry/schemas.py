"""Table schemas. Given, never inferred."""

from __future__ import annotations

from pyspark.sql import types as T

PLAN_ITEM = T.StructType([
    T.StructField("key_group", T.IntegerType()),
    T.StructField("source", T.IntegerType()),
    T.StructField("target", T.IntegerType()),
])

STREAM = T.StructType([
    T.StructField("seq", T.LongType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("key", T.StringType()),
    T.StructField("channel", T.StringType()),
    T.StructField("value", T.DoubleType()),
])

STATE = T.StructType([
    T.StructField("state_name", T.StringType()),
    T.StructField("key_group", T.IntegerType()),
    T.StructField("key", T.StringType()),
    T.StructField("n", T.LongType()),
])

PLAN = T.StructType([
    T.StructField("plan_id", T.LongType()),
    T.StructField("key_group", T.IntegerType()),
    T.StructField("source", T.IntegerType()),
    T.StructField("target", T.IntegerType()),
    T.StructField("est_bytes", T.LongType()),
])

# target is null for a cleared override.
OVERRIDE = T.StructType([
    T.StructField("key_group", T.IntegerType()),
    T.StructField("at_seq", T.LongType()),
    T.StructField("pos", T.IntegerType()),
    T.StructField("target", T.IntegerType()),
])

CUTOVER = T.StructType([
    T.StructField("key_group", T.IntegerType()),
    T.StructField("source", T.IntegerType()),
    T.StructField("target", T.IntegerType()),
    T.StructField("flip_seq", T.LongType()),
    T.StructField("release_seq", T.LongType()),
])

BARRIER = T.StructType([
    T.StructField("migration_id", T.LongType()),
    T.StructField("is_final", T.BooleanType()),
    T.StructField("at_ts", T.TimestampNTZType()),
    T.StructField("plans", T.ArrayType(PLAN_ITEM)),
])

ARRIVAL = T.StructType([
    T.StructField("migration_id", T.LongType()),
    T.StructField("task", T.IntegerType()),
    T.StructField("channel", T.StringType()),
    T.StructField("at_ts", T.TimestampNTZType()),
])

ROUND = T.StructType([
    T.StructField("migration_id", T.LongType()),
    T.StructField("round", T.IntegerType()),
    T.StructField("delta_size", T.LongType()),
    T.StructField("bytes", T.LongType()),
    T.StructField("converged", T.BooleanType()),
])

EVENT = T.StructType([
    T.StructField("migration_id", T.LongType()),
    T.StructField("pos", T.LongType()),
    T.StructField("at_ts", T.TimestampNTZType()),
    T.StructField("kind", T.StringType()),
    T.StructField("key_group", T.IntegerType()),
    T.StructField("delta_size", T.LongType()),
    T.StructField("bytes", T.LongType()),
    T.StructField("converged", T.BooleanType()),
    T.StructField("ok", T.BooleanType()),
    T.StructField("reason", T.StringType()),
])
