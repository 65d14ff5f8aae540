"""State tables ``(state_name, key_group, key, n)``: snapshots, transfer, diff, comparison.

Entries are told apart by ``on``; a null key is a key like any other. What an entry holds is ``n``, or the
columns named in ``values``. Tables of plans and key-groups are broadcast: they are first reduced to one
row per key-group, and there are ``num_groups`` of those.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyferry import params
from keyferry.functions import keys
from keyferry.scratch import fits_broadcast

ENTRY = ["state_name", "key_group", "key"]
OWNED_ENTRY = ["owner", *ENTRY]
VALUES = ["n"]


def _sides(
    old: DataFrame, new: DataFrame, on: list[str], values: list[str]
) -> DataFrame:
    """Entries of both tables side by side, nulls in ``on`` being equal: ``old_*``, ``new_*`` values, and
    ``_in_old``, ``_in_new``. One shuffle, combined map-side; entries are unique in each table."""
    def tag(df: DataFrame, is_new: bool) -> DataFrame:
        return df.select(*on, *values, F.lit(is_new).alias("_is_new"))

    def of(is_new: bool, value: str) -> Column:
        mine = F.when(F.col("_is_new") == F.lit(is_new), F.col(value))
        return F.any_value(mine, F.lit(True)).alias(f"{'new' if is_new else 'old'}_{value}")

    return (
        tag(old, False)
        .unionByName(tag(new, True))
        .groupBy(*on)
        .agg(
            *[of(False, v) for v in values],
            *[of(True, v) for v in values],
            (F.count_if(~F.col("_is_new")) > 0).alias("_in_old"),
            (F.count_if("_is_new") > 0).alias("_in_new"),
        )
    )


def _same_values(values: list[str]) -> Column:
    same = F.lit(True)
    for v in values:
        same = same & F.col(f"old_{v}").eqNullSafe(F.col(f"new_{v}"))
    return same


def state_snapshot(
    records: DataFrame,
    cut_seq: int,
    recent_rows: int | None = None,
    num_groups: int = params.NUM_GROUPS,
    groups: DataFrame | None = None,
) -> DataFrame:
    """State of the counters after the record ``cut_seq``, of all key-groups or of ``groups`` only, whose
    records are picked before they are shuffled.

    State ``count`` has every key so far. With ``recent_rows``, state ``recent`` counts the last
    that many sequence numbers, so its entries also disappear. Both come from one aggregation.
    """
    upto = records.where(F.col("seq") <= cut_seq)
    if groups is not None:
        grouped = upto.withColumn("key_group", keys.key_group(F.col("key"), num_groups))
        upto = extract_groups(grouped, groups).drop("key_group")
    items = [F.struct(F.lit("count").alias("state_name"), F.col("_all").alias("n"))]
    aggs = [F.count("*").alias("_all")]
    if recent_rows is not None:
        aggs.append(F.count_if(F.col("seq") > cut_seq - recent_rows).alias("_recent"))
        items.append(F.struct(F.lit("recent").alias("state_name"), F.col("_recent").alias("n")))
    return (
        upto.groupBy("key")
        .agg(*aggs)
        .select("key", F.explode(F.array(*items)).alias("_s"))
        .where("_s.n > 0")
        .select(
            "_s.state_name",
            keys.key_group(F.col("key"), num_groups).alias("key_group"),
            "key",
            "_s.n",
        )
    )


def extract_groups(state: DataFrame, groups: DataFrame) -> DataFrame:
    """Entries of exactly the given key-groups, of every named state.

    On a table partitioned by ``key_group`` only those directories are read: the filter on the small
    side, which all groups pass, is what makes the optimizer prune partitions at run time.
    """
    wanted = groups.select("key_group").where("key_group >= 0").distinct()
    return state.join(F.broadcast(wanted), "key_group", "left_semi")


def state_lookup(state: DataFrame, wanted: DataFrame, num_groups: int = params.NUM_GROUPS):
    """Values of single keys. ``wanted`` is a settled table of distinct keys.

    Only the folders of the keys' groups are read. Few keys are broadcast; state keys are unique, so
    beyond that a plain shuffled join has no hot key.
    """
    located = wanted.select(
        keys.key_group(F.col("key"), num_groups).alias("key_group"), F.col("key").alias("_key")
    )
    near = extract_groups(state, located)
    names = located.select("_key")
    if fits_broadcast(wanted):
        names = F.broadcast(names)
    return near.join(names, near.key.eqNullSafe(F.col("_key")), "left_semi")


def ingest(
    target: DataFrame, moved: DataFrame, on: list[str] | None = None, values: list[str] = VALUES
) -> DataFrame:
    """Put the moved entries into the target; other entries stay as they are."""
    on = on or ENTRY
    return _sides(target, moved, on, values).select(
        *on, *[F.when(F.col("_in_new"), F.col(f"new_{v}")).otherwise(F.col(f"old_{v}")).alias(v) for v in values]
    )


def delete_groups(
    state: DataFrame, groups: DataFrame, by: tuple[str, ...] = ("key_group",)
) -> DataFrame:
    """Drop all entries of the given key-groups, of every named state.

    ``by`` is ``("owner", "key_group")`` on a table of several owners.
    """
    gone = groups.select(*by).distinct()
    return state.join(F.broadcast(gone), list(by), "left_anti")


def replace_groups(
    target: DataFrame, moved: DataFrame, groups: DataFrame, by: tuple[str, ...] = ("key_group",)
) -> DataFrame:
    """Drop the given key-groups and take the moved entries instead: a full, repeatable copy."""
    return delete_groups(target, groups, by).unionByName(moved)


def own_state(
    state: DataFrame,
    num_groups: int = params.NUM_GROUPS,
    num_owners: int = params.NUM_OWNERS,
) -> DataFrame:
    """The state as held by the default owners."""
    return state.withColumn(
        "owner", keys.owner_of_group(F.col("key_group"), num_groups, num_owners)
    )


def moved_state(state: DataFrame, plans: DataFrame) -> DataFrame:
    """The moving key-groups' entries as the targets of the plans get them. Of several plans for a
    group the first one counts."""
    first = F.min_by("target", "plan_id") if "plan_id" in plans.columns else F.min("target")
    target = plans.groupBy("key_group").agg(first.alias("owner"))
    return state.join(F.broadcast(target), "key_group").select(*state.columns, "owner")


def deletion_counts(state: DataFrame, groups: DataFrame) -> DataFrame:
    """Per owner: entries that deleting the given key-groups removes, and entries that remain."""
    gone = groups.select("key_group").distinct().withColumn("_gone", F.lit(True))
    return (
        state.join(F.broadcast(gone), "key_group", "left")
        .groupBy("owner")
        .agg(
            F.count_if(F.col("_gone")).alias("deleted"),
            F.count_if(F.col("_gone").isNull()).alias("remaining"),
        )
    )


def state_delta(
    source: DataFrame, target: DataFrame, on: list[str] | None = None, values: list[str] = VALUES
) -> DataFrame:
    """What must happen to ``target`` to become ``source``; equal entries give no row."""
    on = on or ENTRY
    change = (
        F.when(~F.col("_in_old"), "put_new")
        .when(~F.col("_in_new"), "delete")
        .when(~_same_values(values), "put_changed")
    )
    return (
        _sides(target, source, on, values)
        .withColumn("change", change)
        .where("change is not null")
        .select(*on, "change", *[f"old_{v}" for v in values], *[f"new_{v}" for v in values])
    )


def apply_delta(
    target: DataFrame, delta: DataFrame, on: list[str] | None = None, values: list[str] = VALUES
) -> DataFrame:
    on = on or ENTRY
    changes = delta.select(
        *on, F.col("change").alias("_change"), *[F.col(f"new_{v}").alias(v) for v in values]
    )
    both = _sides(
        target.withColumn("_change", F.lit(None).cast("string")), changes, on, [*values, "_change"]
    )
    return both.where("new__change is null or new__change <> 'delete'").select(
        *on,
        *[F.when(F.col("_in_new"), F.col(f"new_{v}")).otherwise(F.col(f"old_{v}")).alias(v) for v in values],
    )


def compare(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Multiset comparison over the columns ``on``, one shuffle with map-side sums.

    One row: rows of each side, and rows that only one side has.
    """
    tagged = left.select(*on, F.lit(1).alias("_l"), F.lit(0).alias("_r")).unionByName(
        right.select(*on, F.lit(0).alias("_l"), F.lit(1).alias("_r"))
    )
    sides = tagged.groupBy(*on).agg(F.sum("_l").alias("_l"), F.sum("_r").alias("_r"))

    def total(value: Column) -> Column:
        return F.coalesce(F.sum(value), F.lit(0)).cast("long")

    return sides.agg(
        total(F.col("_l")).alias("left_rows"),
        total(F.col("_r")).alias("right_rows"),
        total(F.greatest(F.col("_l") - F.col("_r"), F.lit(0))).alias("left_only"),
        total(F.greatest(F.col("_r") - F.col("_l"), F.lit(0))).alias("right_only"),
    )


def isolation_check(
    before: DataFrame,
    after: DataFrame,
    moved_groups: DataFrame,
    on: list[str] | None = None,
    values: list[str] = VALUES,
) -> DataFrame:
    """Own entries of a target must stay; the only new ones may be those of the moved groups."""
    on = on or ENTRY
    moved = moved_groups.select("key_group").distinct().withColumn("_moved", F.lit(True))
    rows = _sides(before, after, on, values).join(F.broadcast(moved), "key_group", "left")
    both, same = F.col("_in_old") & F.col("_in_new"), _same_values(values)
    return rows.agg(
        F.count_if(both & same).alias("kept"),
        F.count_if((both & ~same) | ~F.col("_in_new")).alias("changed"),
        F.count_if(~F.col("_in_old") & F.col("_moved").isNotNull()).alias("new_moved"),
        F.count_if(~F.col("_in_old") & F.col("_moved").isNull()).alias("new_other"),
    )


def transfer_summary(moved: DataFrame) -> DataFrame:
    """Entries and bytes of each moved key-group."""
    return moved.groupBy("key_group").agg(
        F.count("*").alias("entries"),
        F.sum(keys.entry_bytes(F.col("key"))).alias("bytes"),
    )
