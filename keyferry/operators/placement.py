"""Which owner holds which keys, how much they hold, and what to move."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyferry import params
from keyferry.functions import keys
from keyferry.sources.tables import with_groups


def key_loads(records: DataFrame, num_groups: int, num_owners: int) -> DataFrame:
    """Records per key with group and owner; the hash runs once per key, not per record."""
    counted = records.groupBy("key").agg(F.count("*").alias("records"))
    return with_groups(counted, num_groups, num_owners)


def key_group_assign(
    records: DataFrame,
    num_groups: int = params.NUM_GROUPS,
    num_owners: int = params.NUM_OWNERS,
) -> DataFrame:
    return with_groups(records.select("key").distinct(), num_groups, num_owners)


def group_table(
    spark: SparkSession,
    num_groups: int = params.NUM_GROUPS,
    num_owners: int = params.NUM_OWNERS,
) -> DataFrame:
    """Every key-group with its default owner."""
    group = F.col("id").cast("int")
    return spark.range(num_groups).select(
        group.alias("key_group"),
        keys.owner_of_group(group, num_groups, num_owners).alias("owner"),
    )


def owner_ranges(
    spark: SparkSession,
    num_groups: int = params.NUM_GROUPS,
    num_owners: int = params.NUM_OWNERS,
) -> DataFrame:
    """Each owner's contiguous range of key-groups."""
    return (
        group_table(spark, num_groups, num_owners)
        .groupBy("owner")
        .agg(F.min("key_group").alias("first_group"), F.max("key_group").alias("last_group"))
    )


def owner_range_loads(
    records: DataFrame,
    num_groups: int = params.NUM_GROUPS,
    num_owners: int = params.NUM_OWNERS,
) -> DataFrame:
    """Each owner's range with the keys and records that fall into it; idle owners have zeros."""
    loads = (
        key_loads(records, num_groups, num_owners)
        .groupBy("owner")
        .agg(F.count("*").alias("_keys"), F.sum("records").alias("_records"))
    )
    return owner_ranges(records.sparkSession, num_groups, num_owners).join(
        loads, "owner", "left"
    ).select(
        "owner",
        "first_group",
        "last_group",
        F.coalesce("_keys", F.lit(0)).alias("keys"),
        F.coalesce("_records", F.lit(0)).alias("records"),
    )


def owner_load(
    records: DataFrame,
    num_groups: int = params.NUM_GROUPS,
    num_owners: int = params.NUM_OWNERS,
) -> DataFrame:
    """Non-empty key-groups, keys and records of each owner."""
    per_group = (
        key_loads(records, num_groups, num_owners)
        .groupBy("owner", "key_group")
        .agg(F.count("*").alias("_keys"), F.sum("records").alias("_records"))
    )
    return per_group.groupBy("owner").agg(
        F.count("*").alias("groups"),
        F.sum("_keys").alias("keys"),
        F.sum("_records").alias("records"),
    )


def singleton_groups(
    records: DataFrame,
    num_groups: int = params.NUM_GROUPS,
    num_owners: int = params.NUM_OWNERS,
) -> DataFrame:
    """Key-groups that hold exactly one key."""
    assigned = key_group_assign(records, num_groups, num_owners)
    return (
        assigned.groupBy("key_group", "owner")
        .agg(F.count("*").alias("_keys"), F.min("key").alias("key"))
        .where("_keys = 1")
        .drop("_keys")
    )


def partition_size(records: DataFrame, num_groups: int = params.NUM_GROUPS) -> DataFrame:
    """Entries and estimated bytes of each key-group's counter state."""
    distinct = records.select("key").distinct()
    return (
        distinct.withColumn("key_group", keys.key_group(F.col("key"), num_groups))
        .groupBy("key_group")
        .agg(
            F.count("*").alias("entries"),
            F.sum(keys.entry_bytes(F.col("key"))).alias("est_bytes"),
        )
    )


def make_plans(
    records: DataFrame,
    num_groups: int = params.NUM_GROUPS,
    num_owners: int = params.NUM_OWNERS,
) -> DataFrame:
    """One plan per owner that has data: move its busiest key-group to the next owner.

    Busiest is most records, the lowest group on ties. At most ``num_owners`` rows.
    """
    per_group = (
        key_loads(records, num_groups, num_owners)
        .groupBy("owner", "key_group")
        .agg(
            F.sum("records").alias("_records"),
            F.sum(keys.entry_bytes(F.col("key"))).alias("_bytes"),
        )
    )
    busiest = F.struct(F.col("_records"), -F.col("key_group"))
    return per_group.groupBy("owner").agg(
        F.max_by(F.struct("key_group", "_bytes"), busiest).alias("_best")
    ).select(
        (F.col("owner") + 1).cast("long").alias("plan_id"),
        F.col("_best.key_group").alias("key_group"),
        F.col("owner").alias("source"),
        keys.next_owner(F.col("owner"), num_owners).alias("target"),
        F.col("_best._bytes").alias("est_bytes"),
    )


def distinct_plans(plans: DataFrame) -> DataFrame:
    """Two plans are the same if group, source and target agree; size and id do not count."""
    return plans.groupBy("key_group", "source", "target").agg(
        F.min("plan_id").alias("plan_id"), F.max("est_bytes").alias("est_bytes")
    ).select("plan_id", "key_group", "source", "target", "est_bytes")


def shared_target(plans: DataFrame, num_owners: int = params.NUM_OWNERS) -> DataFrame:
    """Send several plans to one third party: the lowest owner that is no plan's source."""
    spark = plans.sparkSession
    free = (
        spark.range(num_owners)
        .select(F.col("id").cast("int").alias("source"))
        .join(plans.select("source"), "source", "left_anti")
    )
    return plans.withColumn("target", free.agg(F.min("source")).scalar())
