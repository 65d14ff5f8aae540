"""Streaming sources: tables as streams, phases behind a gate, generated words."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyferry.params import MICRO_BATCH_BYTES
from keyferry.sources.tables import record_columns

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_session(spark: SparkSession) -> SparkSession:
    """A session of the same application with the settings stateful queries need.

    The caller's session keeps its own. A state store keeps its number of partitions for life: on a
    cluster it is the caller's ``spark.sql.shuffle.partitions``, in local mode at most one per core.
    """
    session = spark.newSession()
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if spark.sparkContext.master.startswith("local"):
        partitions = min(partitions, spark.sparkContext.defaultParallelism)
    for name, value in {
        "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
        "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": str(partitions),
        # Sorting inside the partitions of a micro-batch is well defined, but the check refuses
        # every sort on a stream. See streaming.processors.in_order.
        "spark.sql.streaming.unsupportedOperationCheck": "false",
    }.items():
        session.conf.set(name, value)
    return session


def file_stream(
    session: SparkSession, path: str, schema, max_bytes: int = MICRO_BATCH_BYTES
) -> DataFrame:
    """Parquet files under ``path`` as a stream; ``max_bytes`` bounds a micro-batch."""
    reader = session.readStream.schema(schema).option("maxBytesPerTrigger", max_bytes)
    return reader.parquet(path)


def table_stream(
    session: SparkSession, sf_dir: str, table: str, max_bytes: int = MICRO_BATCH_BYTES
) -> DataFrame:
    """One of the given tables as a stream. A streaming read takes no plain file name, but a glob."""
    schema = session.read.parquet(f"{sf_dir}/{table}.parquet").schema
    glob = f"{sf_dir}/[{table[0]}]{table[1:]}.parquet"
    return file_stream(session, glob, schema, max_bytes)


def record_stream(
    session: SparkSession, sf_dir: str, max_bytes: int = MICRO_BATCH_BYTES
) -> DataFrame:
    return table_stream(session, sf_dir, "events", max_bytes).select(*record_columns())


def land(phase: DataFrame, path: str) -> None:
    """Open the gate for one phase: add its files to the folder a file stream watches."""
    phase.write.mode("append").parquet(path)


def word_rate_stream(session: SparkSession, words: list[str], per_second: int = 1000) -> DataFrame:
    """Unbounded random words at a fixed rate; a demo source."""
    choice = F.pmod(F.hash("value"), F.lit(len(words))) + 1
    return (
        session.readStream.format("rate").option("rowsPerSecond", per_second).load()
        .select("timestamp", F.element_at(F.array(*[F.lit(w) for w in words]), choice).alias("w"))
    )
