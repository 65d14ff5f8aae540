"""Keyed counts: words, running counts, and what each owner has seen."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from keyferry import params
from keyferry.functions.text import explode_words
from keyferry.scratch import lookup_join, settle


def tokens(docs: DataFrame) -> DataFrame:
    """Words of each document with their number."""
    return (
        explode_words(docs, "text", "doc_id")
        .groupBy("doc_id", "w")
        .agg(F.count("*").alias("n"))
    )


def word_count(docs: DataFrame) -> DataFrame:
    """Final count per word. A word's running count ends at its number of records."""
    return explode_words(docs).groupBy("w").agg(F.count("*").alias("n"))


def key_counts(records: DataFrame) -> DataFrame:
    return records.groupBy("key").agg(F.count("*").alias("n"))


def running_count(
    records: DataFrame,
    hot_rows: int = params.HOT_ROWS,
    block: int = params.BLOCK,
) -> DataFrame:
    """Add ``n``, the number of records of the same key up to this one in ``seq`` order.

    Keys with at most ``hot_rows`` records are numbered in one window. Hotter ones are cut into
    blocks of ``block`` sequence numbers: rows are numbered inside (key, block) and start from the
    key's total in earlier blocks, so that no task ever sorts more than a block of a hot key.
    ``seq`` must be unique.
    """
    hot = settle(key_counts(records).where(F.col("n") > hot_rows).select("key"), "hot-keys")
    in_key = W.partitionBy("key").orderBy("seq")
    if hot.isEmpty():
        return records.withColumn("n", F.row_number().over(in_key).cast("long"))

    flagged = lookup_join(
        records, hot.withColumn("_hot", F.lit(True)), ["key"], F.col("seq"), "left", nulls_match=True
    )
    blocked = flagged.withColumn(
        "_block", F.when(F.col("_hot"), F.floor(F.col("seq") / block)).otherwise(F.lit(-1))
    ).drop("_hot")
    earlier = W.partitionBy("key").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    offsets = settle(
        blocked.where("_block >= 0")
        .groupBy("key", "_block")
        .agg(F.count("*").alias("_rows"))
        .select("key", "_block", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_base")),
        "count-offsets",
    )
    in_block = W.partitionBy("key", "_block").orderBy("seq")
    numbered = blocked.withColumn("_i", F.row_number().over(in_block))
    return (
        lookup_join(numbered, offsets, ["key", "_block"], F.col("seq"), "left", nulls_match=True)
        .withColumn("n", (F.col("_i") + F.coalesce("_base", F.lit(0))).cast("long"))
        .drop("_block", "_i", "_base")
    )


def last_count_by_owner(routed: DataFrame) -> DataFrame:
    """Latest running count of each key at each owner that served it.

    ``routed`` has ``key, seq, owner, since_seq``; ``since_seq`` marks the routing interval. Counts
    add up over a key's intervals in order, so records are only aggregated, never sorted.
    """
    per_interval = routed.groupBy("key", "owner", "since_seq").agg(
        F.count("*").alias("_rows"), F.max("seq").alias("last_seq")
    )
    so_far = W.partitionBy("key").orderBy("since_seq")
    return (
        per_interval.withColumn("_n", F.sum("_rows").over(so_far))
        .groupBy("owner", "key")
        .agg(F.max("_n").alias("n"), F.max("last_seq").alias("last_seq"))
    )


def seen_by_owner(routed: DataFrame) -> DataFrame:
    """Which sequence numbers each owner saw of each key, as count, ends and sum."""
    return routed.groupBy("owner", "key").agg(
        F.count("*").alias("cnt"),
        F.min("seq").alias("min_seq"),
        F.max("seq").alias("max_seq"),
        F.sum("seq").alias("sum_seq"),
    )


def hot_key_totals(records: DataFrame) -> DataFrame:
    """All records, and those of the most frequent key (the smallest one on ties)."""
    hottest_first = F.struct((-F.col("n")).alias("a"), F.col("key").alias("b"))
    return key_counts(records).agg(
        F.sum("n").alias("records"),
        F.min_by("key", hottest_first).alias("hot_key"),
        F.max("n").alias("hot_records"),
    )
