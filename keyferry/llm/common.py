"""Helpers the operators share: Arrow text buffers as numpy arrays, and the table paths of queries."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: A-Z to a-z over bytes. UTF-8 bytes of other letters are above 0x7F and stay.
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8_rows(texts: pa.Array) -> list[bytes]:
    """Each text's UTF-8 bytes; a null text is empty."""
    return [t or b"" for t in texts.cast(pa.binary()).to_pylist()]


def unicode_rows(texts: pa.Array) -> list[str]:
    """Each text as a string; a null text is empty, a malformed byte becomes U+FFFD."""
    return [t.decode("utf-8", "replace") for t in utf8_rows(texts)]


def utf8_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts end to end, and the offsets of the rows in them (one more than rows)."""
    rows = texts.cast(pa.binary()).cast(pa.large_binary())
    if rows.null_count:
        rows = rows.fill_null(b"")
    if len(rows) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = rows.buffers()
    at = np.frombuffer(offsets, np.int64)[rows.offset : rows.offset + len(rows) + 1]
    if data is None:
        return np.empty(0, np.uint8), at - at[0]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def list_array(flat: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Rows of ``counts`` values each, cut from ``flat``."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
