"""Word splitting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def words(text: Column) -> Column:
    """Lower-case and split on runs of non-word characters; may hold an empty first or last item."""
    return F.split(F.lower(text), r"\W+")


def explode_words(docs: DataFrame, text: str = "text", *keep: str) -> DataFrame:
    """One row per non-empty word. Works on batch and streaming frames."""
    return docs.select(*keep, F.explode(words(F.col(text))).alias("w")).where("w <> ''")
