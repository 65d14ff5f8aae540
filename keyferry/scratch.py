"""Written intermediate tables in the cluster's shared folder, and the size check for broadcasts."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keyferry import params

_local_root: str | None = None


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; a temporary one only in local mode."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that every executor can reach")
    global _local_root
    if _local_root is None:
        _local_root = tempfile.mkdtemp(prefix="keyferry-")
    return _local_root


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def settle(
    df: DataFrame, name: str = "table", session: SparkSession | None = None
) -> DataFrame:
    """Write ``df`` once and read it back, in another session if given.

    Cuts the lineage at a table that survives lost executors, and gives the optimizer the true
    size of a derived table, which it would otherwise overestimate.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return (session or spark).read.schema(df.schema).parquet(path)


def fits_broadcast(settled: DataFrame, max_rows: int = params.BROADCAST_ROWS) -> bool:
    """Counting a written table reads its file footers only."""
    return settled.count() <= max_rows


def lookup_join(
    big: DataFrame,
    lookup: DataFrame,
    on: list[str],
    spread_by: Column,
    how: str = "inner",
    max_rows: int = params.BROADCAST_ROWS,
    salts: int = params.SALTS,
    fits: bool | None = None,
    nulls_match: bool = False,
) -> DataFrame:
    """Join ``big`` to a ``lookup`` with one row per key, however skewed ``big`` is.

    The lookup must be settled, so that counting it is cheap, or ``fits`` says whether it is small.

    Small lookups are broadcast, so ``big`` is not shuffled. Beyond ``max_rows`` each lookup row is
    copied ``salts`` times and the join runs on (key, salt), so that one key of ``big`` spreads over
    ``salts`` tasks. ``how`` is ``inner``, ``left``, ``left_semi`` or ``left_anti``. With ``nulls_match`` a null
    key meets a null key.
    """
    small = fits_broadcast(lookup, max_rows) if fits is None else fits
    theirs: dict[str, str] = {}
    if nulls_match:
        theirs = {f"_lookup_{c}": c for c in on}
        lookup = lookup.withColumnsRenamed({c: name for name, c in theirs.items()})
    same = [F.col(c).eqNullSafe(F.col(name)) for name, c in theirs.items()]
    if small:
        met: list[str] | Column = reduce(Column.__and__, same) if nulls_match else on
        return big.join(F.broadcast(lookup), met, how).drop(*theirs)
    salted = lookup.withColumn("_lookup_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    spread = big.withColumn("_salt", F.pmod(F.xxhash64(spread_by), F.lit(salts)).cast("int"))
    if nulls_match:
        met = reduce(Column.__and__, same, F.col("_salt") == F.col("_lookup_salt"))
        return spread.join(salted, met, how).drop("_salt", "_lookup_salt", *theirs)
    return spread.join(salted.withColumnRenamed("_lookup_salt", "_salt"), [*on, "_salt"], how).drop("_salt")
