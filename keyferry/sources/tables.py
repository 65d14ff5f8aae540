"""Batch sources: the record stream over a table, documents, and channels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keyferry.functions import keys
from keyferry.params import NUM_GROUPS, NUM_OWNERS


def record_columns() -> list[Column]:
    """The record stream's columns over the events table, for batch and streaming reads."""
    return [
        F.col("event_id").alias("seq"),
        F.col("ts"),
        F.col("user_id").cast("string").alias("key"),
        F.col("event_type").alias("channel"),
        F.col("value"),
    ]


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(*record_columns())


def with_groups(
    df: DataFrame, num_groups: int = NUM_GROUPS, num_owners: int = NUM_OWNERS
) -> DataFrame:
    """Add the key-group and its default owner."""
    return df.withColumn("key_group", keys.key_group(F.col("key"), num_groups)).withColumn(
        "owner", keys.owner_of_group(F.col("key_group"), num_groups, num_owners)
    )


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")


def channels(parts: dict[str, DataFrame]) -> DataFrame:
    """Several parallel channels as one stream with a ``channel`` column."""
    tagged = [df.withColumn("channel", F.lit(name)) for name, df in parts.items()]
    return reduce(DataFrame.unionByName, tagged)


def with_hot_key(base: DataFrame, key: str, times: int) -> DataFrame:
    """All rows of ``base`` once, then ``times`` more records of one key after them."""
    spark = base.sparkSession
    last = base.agg(F.max("seq").alias("last")).first()["last"]
    hot = spark.range(last + 1, last + 1 + times).select(
        F.col("id").alias("seq"), F.lit(key).alias("key")
    )
    return base.select("seq", "key").unionByName(hot)
