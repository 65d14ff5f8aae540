"""Running counts of a stream without per-record Python: totals in tables, ranks from a micro-batch.

A micro-batch's records are numbered per key by Spark's own windows (hot keys in blocks, see
``counts.running_count``), and start from the key's total in earlier batches. Totals are tables with a version
per batch: ``changes/v=<batch>`` has the keys of that batch, and every ``compact``-th batch writes all keys to
``full/v=<batch>`` instead. A batch reads versions before its own only, and overwrites its own; so one that is
repeated after a failure finds the totals it started from, wherever the failure was.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyferry import params
from keyferry.operators import counts
from keyferry.scratch import lookup_join, settle
from keyferry.sinks.tables import batch_writer

TOTALS = "key string, n long, last long"


class RunningTotals:
    """A ``foreachBatch`` sink for records ``(seq, key)``: writes ``seq, key, n`` to ``output``.

    Records of a key must come in order of ``seq`` across batches; the query fails otherwise.
    """

    def __init__(
        self,
        output: str,
        totals: str,
        compact: int = 16,
        hot_rows: int = params.HOT_ROWS,
        block: int = params.BLOCK,
    ) -> None:
        self.write, self.totals = batch_writer(output), totals
        self.compact, self.hot_rows, self.block = compact, hot_rows, block

    def _path(self, kind: str, version: int) -> str:
        return f"{self.totals}/{kind}/v={version}"

    def before(self, spark: SparkSession, batch_id: int) -> DataFrame:
        """key, n, last: totals before a batch, from the last full table and the changes since."""
        full = max(batch_id - 1, 0) // self.compact * self.compact
        paths = [self._path("full", full)] if full else []
        paths += [self._path("changes", v) for v in range(full + 1 if full else 0, batch_id)]
        if not paths:
            return spark.createDataFrame([], TOTALS)
        # Totals only grow, so the largest one is the latest.
        versions = spark.read.schema(TOTALS).parquet(*paths)
        return versions.groupBy("key").agg(F.max("n").alias("n"), F.max("last").alias("last"))

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = batch.select("seq", "key")
        found = rows.groupBy("key").agg(
            F.count("*").alias("rows"), F.min("seq").alias("first"), F.max("seq").alias("end")
        )
        known = self.before(spark, batch_id).select(F.col("key").alias("_key"), "n", "last")
        base = settle(
            found.join(known, F.col("key").eqNullSafe(F.col("_key")), "left").select(
                "key", "rows", "first", "end", F.coalesce("n", F.lit(0)).alias("base"), "last"
            ),
            "totals-before",
        )
        late = base.where(F.col("first") <= F.col("last")).first()
        if late:
            raise ValueError(
                f"record {late['first']} of key {late['key']} came after record {late['last']}"
            )
        ranked = counts.running_count(rows, self.hot_rows, self.block)
        counted = lookup_join(
            ranked, base.select("key", "base"), ["key"], F.col("seq"), "left", nulls_match=True
        )
        self.write(
            counted.select("seq", "key", (F.col("base") + F.col("n")).cast("long").alias("n")), batch_id
        )
        changed = base.select(
            "key", (F.col("base") + F.col("rows")).cast("long").alias("n"), F.col("end").alias("last")
        )
        if batch_id > 0 and batch_id % self.compact == 0:
            everything = (
                self.before(spark, batch_id).unionByName(changed)
                .groupBy("key").agg(F.max("n").alias("n"), F.max("last").alias("last"))
            )
            everything.write.mode("overwrite").parquet(self._path("full", batch_id))
        else:
            changed.write.mode("overwrite").parquet(self._path("changes", batch_id))
