"""Routing inside a stream: overrides travel with the records and hold for those after them.

A micro-batch's records are joined with its overrides and with those still in force from earlier batches, as
``routing.route_effective`` does, so records stay where they are and no Python sees them. Overrides in
force are a table with a version per batch: of each key-group the last one before the watermark and all after
it. A batch reads the version before its own and overwrites its own, so a repeated batch finds the overrides it
started from.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from keyferry import params
from keyferry.operators import routing
from keyferry.sinks.tables import batch_writer

OVERRIDES = "key_group int, at_seq long, pos int, target int"


def in_band(records: DataFrame, log: DataFrame) -> DataFrame:
    """Records ``(seq, key_group, owner, ...)`` and overrides as one table to be landed; the latter have no ``seq``."""
    news = log.select(
        F.col("key_group").cast("int"), F.col("at_seq").cast("long"),
        F.col("pos").cast("int"), F.col("target").cast("int"),
    )
    return records.unionByName(news, allowMissingColumns=True)


class RoutedStream:
    """A ``foreachBatch`` sink for ``in_band`` rows: writes the records with ``owner``, ``since_seq`` and ``late``.

    Records may come up to ``delay`` numbers after the greatest ``seq`` of earlier batches (the watermark is that
    far behind it) and are routed right. A record at or before the watermark is ``late``: overrides of its time may
    be gone, so it goes where the oldest one that is kept says, if that began before it, else to its default
    owner. An override should come no later than the first record after it. One that comes later holds for the
    records that come with or after it; those that went before keep their owner. ``late_overrides`` lists those
    that began before the watermark.
    """

    def __init__(
        self, output: str, state: str, delay: int = 0, max_rows: int = params.BROADCAST_ROWS
    ) -> None:
        self.write, self.state = batch_writer(output), state
        self.delay, self.max_rows = delay, max_rows

    def _path(self, kind: str, version: int) -> str:
        return f"{self.state}/{kind}/v={version}"

    def overrides(self, spark: SparkSession, batch_id: int) -> DataFrame:
        """Overrides kept when a batch begins."""
        if batch_id == 0:
            return spark.createDataFrame([], OVERRIDES)
        return spark.read.schema(OVERRIDES).parquet(self._path("overrides", batch_id - 1))

    def last_seq(self, spark: SparkSession, batch_id: int) -> int | None:
        """Greatest ``seq`` of the batches before."""
        if batch_id == 0:
            return None
        return spark.read.schema("seq long").parquet(self._path("last", batch_id - 1)).first()["seq"]

    def late_overrides(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(f"{OVERRIDES}, v long").parquet(f"{self.state}/late")

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = batch.where("at_seq is null").drop("at_seq", "pos", "target")
        news = batch.where("at_seq is not null").select("key_group", "at_seq", "pos", "target")
        before = self.last_seq(spark, batch_id)
        passed = F.lit(None if before is None else before - self.delay).cast("long")
        news.where(F.col("at_seq") < passed).write.mode("overwrite").parquet(self._path("late", batch_id))
        log = self.overrides(spark, batch_id).unionByName(news).distinct()
        late = F.coalesce(F.col("seq") <= passed, F.lit(False))
        self.write(
            routing.route_effective(rows.withColumn("late", late), log, max_rows=self.max_rows), batch_id
        )
        last = rows.agg(F.greatest(F.max("seq"), F.lit(before).cast("long")).alias("seq"))
        last.write.mode("overwrite").parquet(self._path("last", batch_id))
        after = self.last_seq(spark, batch_id + 1)
        # The next override of the group begins at or before the watermark: this one is over by then.
        following = F.lead("at_seq").over(W.partitionBy("key_group").orderBy("at_seq", "pos"))
        ended = F.coalesce(following <= F.lit(None if after is None else after - self.delay), F.lit(False))
        log.withColumn("_ended", ended).where("not _ended").drop("_ended").write.mode("overwrite").parquet(
            self._path("overrides", batch_id)
        )
