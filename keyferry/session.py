"""Settings a session should have, for tests, bench and clusters."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # State servers of Python stateful operators listen on a file, not on a port.
    "spark.python.unix.domain.socket.enabled": "true",
    "spark.ui.enabled": "false",
}


def local_session(
    cores: str = "*",
    partitions: int = 8,
    memory: str = "8g",
    settings: dict[str, str] | None = None,
) -> SparkSession:
    builder = SparkSession.builder.master(f"local[{cores}]").appName("keyferry")
    for name, value in {**SETTINGS, **(settings or {})}.items():
        builder = builder.config(name, value)
    spark = (
        builder.config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", memory)
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
