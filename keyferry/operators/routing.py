"""Owner of each record under a log of routing overrides.

An override ``(key_group, at_seq, pos, target)`` holds for records with ``seq > at_seq`` until the
group's next one; ``pos`` orders overrides of the same ``at_seq``; a null ``target`` clears.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from keyferry import params
from keyferry.operators.placement import group_table
from keyferry.scratch import settle


def overrides_from_barriers(barriers: DataFrame) -> DataFrame:
    """Overrides in force after all barriers: per group the latest plan; final barriers set none."""
    items = barriers.where(~F.col("is_final")).select(
        "migration_id", "at_ts", F.posexplode("plans").alias("pos", "plan")
    )
    latest = F.max_by(F.struct("plan.target", "migration_id"), F.struct("at_ts", "pos"))
    return items.groupBy(F.col("plan.key_group").alias("key_group")).agg(
        latest.alias("_l")
    ).select("key_group", "_l.target", "_l.migration_id")


def override_log(barriers: DataFrame) -> DataFrame:
    """The barriers' plans as overrides that begin after each barrier's ``at_seq``."""
    return barriers.where(~F.col("is_final")).select(
        "at_seq", F.posexplode("plans").alias("pos", "plan")
    ).select("plan.key_group", "at_seq", "pos", "plan.target")


def clear_overrides(groups: DataFrame, at_seq: int) -> DataFrame:
    """Log rows that clear the overrides of the given groups at ``at_seq``, before any new plan."""
    return groups.select("key_group").distinct().select(
        "key_group",
        F.lit(at_seq).cast("long").alias("at_seq"),
        F.lit(-1).alias("pos"),
        F.lit(None).cast("int").alias("target"),
    )


def route_current(
    log: DataFrame,
    num_groups: int = params.NUM_GROUPS,
    num_owners: int = params.NUM_OWNERS,
) -> DataFrame:
    """Every key-group's default owner, override if any, and owner, at the end of the log."""
    last = log.groupBy("key_group").agg(
        F.max_by("target", F.struct("at_seq", "pos")).alias("target")
    )
    groups = group_table(log.sparkSession, num_groups, num_owners)
    return groups.withColumnRenamed("owner", "default_owner").join(
        last, "key_group", "left"
    ).select(
        "key_group",
        "default_owner",
        "target",
        F.coalesce("target", "default_owner").alias("owner"),
    )


def override_intervals(log: DataFrame) -> DataFrame:
    """``(key_group, since_seq, until_seq, target)``; the last interval of a group is open."""
    in_group = W.partitionBy("key_group").orderBy("at_seq", "pos")
    return (
        log.withColumn("until_seq", F.lead("at_seq").over(in_group))
        .where("until_seq is null or until_seq > at_seq")
        .select("key_group", F.col("at_seq").alias("since_seq"), "until_seq", "target")
    )


def route_effective(
    records: DataFrame,
    log: DataFrame,
    max_rows: int = params.BROADCAST_ROWS,
    pieces: int = params.INTERVAL_PIECES,
    block: int = params.BLOCK,
) -> DataFrame:
    """Set ``owner`` to the one in force at each record; ``since_seq`` is where that began.

    ``records`` has ``seq, key_group, owner`` (the default). The log is broadcast as intervals and records
    stay where they are. Intervals are cut at up to ``pieces`` places of ``seq``, so that a record is
    compared with the few of its group and piece, however long the log. Only a log of more than
    ``max_rows`` intervals goes through ``_route_by_blocks``.
    """
    intervals = settle(override_intervals(log), "intervals")
    size = intervals.groupBy("key_group").agg(
        F.count("*").alias("n"), F.min("since_seq").alias("lo"), F.max("since_seq").alias("hi")
    ).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
        F.coalesce(F.max("n"), F.lit(0)).alias("most"),
        F.coalesce(F.min("lo"), F.lit(0)).alias("lo"),
        F.coalesce(F.max("hi"), F.lit(0)).alias("hi"),
    ).first()
    if size["rows"] > max_rows:
        return _route_by_blocks(records, log, block)
    count = max(1, min(pieces, size["most"]))
    width = (size["hi"] - size["lo"]) // count + 1

    def piece(seq: str) -> Column:
        number = F.expr(f"({seq} - ({size['lo']}L)) div {width}L")
        return F.greatest(F.lit(0).cast("long"), F.least(number, F.lit(count - 1).cast("long")))

    last = F.when(F.col("until_seq").isNull(), F.lit(count - 1).cast("long")).otherwise(
        piece("until_seq")
    )
    cut = intervals.withColumn("_piece", F.explode(F.sequence(piece("since_seq"), last)))
    i = F.broadcast(cut).alias("i")
    r = records.withColumn("_piece", piece("seq")).alias("r")
    inside = (
        (F.col("r.key_group") == F.col("i.key_group"))
        & (F.col("r._piece") == F.col("i._piece"))
        & (F.col("r.seq") > F.col("i.since_seq"))
        & (F.col("i.until_seq").isNull() | (F.col("r.seq") <= F.col("i.until_seq")))
    )
    kept = [F.col(f"r.{c}") for c in records.columns if c != "owner"]
    return r.join(i, inside, "left").select(
        *kept,
        F.coalesce("i.target", "r.owner").alias("owner"),
        F.coalesce("i.since_seq", F.lit(-1)).alias("since_seq"),
    )


def _route_by_blocks(records: DataFrame, log: DataFrame, block: int) -> DataFrame:
    """As-of join for a log of any size.

    Work is split by (key_group, block of ``seq``), so a hot group spreads over as many tasks as it
    has blocks. A block starts from the last override of the group's earlier blocks.
    """
    first_seq = F.col("at_seq") + 1
    state = F.struct(F.col("at_seq").alias("since_seq"), F.col("target"))
    changes = log.select(
        "key_group", first_seq.alias("seq"), "pos", "at_seq", state.alias("_set"),
        F.floor(first_seq / block).alias("_block"),
    )
    blocked = records.withColumn("_block", F.floor(F.col("seq") / block))

    ends = changes.groupBy("key_group", "_block").agg(
        F.max_by("_set", F.struct("at_seq", "pos")).alias("_end")
    )
    touched = (
        blocked.select("key_group", "_block").distinct()
        .join(ends, ["key_group", "_block"], "full_outer")
    )
    earlier = W.partitionBy("key_group").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    carried = touched.select(
        "key_group", "_block", F.last("_end", ignorenulls=True).over(earlier).alias("_set")
    )
    rows = (
        blocked.withColumn("_ord", F.lit(2))
        .unionByName(
            changes.drop("at_seq").withColumn("_ord", F.lit(1)), allowMissingColumns=True
        )
        .unionByName(carried.withColumn("_ord", F.lit(0)), allowMissingColumns=True)
    )
    so_far = (
        W.partitionBy("key_group", "_block")
        .orderBy(F.col("seq").asc_nulls_first(), "_ord", "pos")
        .rowsBetween(W.unboundedPreceding, W.currentRow)
    )
    kept = [c for c in records.columns if c != "owner"]
    return (
        rows.withColumn("_now", F.last("_set", ignorenulls=True).over(so_far))
        .where("_ord = 2")
        .select(
            *kept,
            F.coalesce("_now.target", "owner").alias("owner"),
            F.coalesce("_now.since_seq", F.lit(-1)).alias("since_seq"),
        )
    )


def physical_route(
    records: DataFrame,
    num_owners: int = params.NUM_OWNERS,
    lanes: int = 1,
    spread: F.Column | None = None,
) -> DataFrame:
    """Place each record in its owner's partitions: ``lanes`` neighbouring ones per owner.

    With one lane, partition number and owner are the same. ``spread`` says which lane.
    """
    lane = F.lit(0) if spread is None else F.pmod(spread, F.lit(lanes))
    return records.repartitionById(
        num_owners * lanes, (F.col("owner") * lanes + lane).cast("int")
    )


def routed_partitions(placed: DataFrame) -> DataFrame:
    """Per owner: partitions that hold its records, and records."""
    per_partition = placed.groupBy("owner", F.spark_partition_id().alias("_p")).agg(
        F.count("*").alias("_records")
    )
    return per_partition.groupBy("owner").agg(
        F.count("*").alias("partitions"), F.sum("_records").alias("records")
    )


def serve_check(
    routed: DataFrame,
    hosted: DataFrame,
    num_groups: int = params.NUM_GROUPS,
    num_owners: int = params.NUM_OWNERS,
) -> DataFrame:
    """May each record's owner serve it? Counts inside its range, hosted besides, and rejected.

    ``hosted`` is a settled table of distinct ``(owner, key_group)``; at most one row per pair.
    """
    per_group = routed.groupBy("owner", "key_group").agg(F.count("*").alias("_records"))
    default = group_table(routed.sparkSession, num_groups, num_owners).withColumnRenamed(
        "owner", "_default"
    )
    extra = hosted.select("owner", "key_group").distinct().withColumn("_hosted", F.lit(True))
    rows = per_group.join(default, "key_group").join(extra, ["owner", "key_group"], "left")
    own = F.col("owner") == F.col("_default")
    is_hosted = F.coalesce("_hosted", F.lit(False))

    def records_where(cond) -> F.Column:
        return F.sum(F.when(cond, F.col("_records")).otherwise(0))

    return rows.groupBy("owner").agg(
        records_where(own).alias("in_range"),
        records_where(~own & is_hosted).alias("hosted"),
        records_where(~own & ~is_hosted).alias("rejected"),
    )
