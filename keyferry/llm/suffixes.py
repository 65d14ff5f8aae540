"""Exact substring deduplication with a sparse suffix array.

A passage counts as repeated if ``LENGTH`` (50) words in a row stand in two documents. Suffixes are kept at
content-selected places only: where the hash of ``SEED`` words is least among ``SPREAD`` neighbours. Every
window of ``LENGTH`` words has such a place among its first ``SPREAD``, and the same one in each document.
So two documents that share a window have suffixes that share at least ``LENGTH - SPREAD + 1`` words.

Suffixes are brought together by a hash of those words; those that have no equal in another document go.
From each one left, the match is extended to the left and right: the windows that belong to its place are
sorted by class and hash and compared with their neighbours, and those that another document has, too,
make one stretch of words around the place. Stretches are joined into maximal passages. No window is
missed, and a window is told by two hashes of 64 bits (its suffix's and its own).

Counts per hash are combined before the shuffle. Classes of up to ``BLOCK`` suffixes are sorted inside
partitions. In larger ones places with equal windows are merged first, map-side; what the patterns share is
counted and joined, and joined back to the places, which can be split over tasks.

Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z. Rows: null texts and those of fewer than ``LENGTH`` words
have no passage. Rows that repeat both id and text are one document (told by a 64-bit hash); other rows
that repeat an id are documents of their own. Copies of a document repeat it whole. Other columns are
not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as Win
from pyspark.sql import functions as F

from keyferry.llm import words as W
from keyferry.llm.common import list_array, table, utf8_buffer
from keyferry.scratch import settle

LENGTH = 50
SPREAD = 32
SEED = 8
BLOCK = 1_000


def _places(hashes: np.ndarray, first: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Every window's start, within one row, and the place selected in it."""
    count = max(len(hashes) - length + 1, 0)
    _, at = W.window_minima(W.ngram_hashes(hashes, SEED), SPREAD)
    starts = np.arange(count)
    row = np.searchsorted(first, starts, "right") - 1
    inside = starts + length <= first[row + 1]
    return starts[inside], at[:count][inside]


def _blocks(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows with their word hashes and each row's first word."""
    data, offsets = utf8_buffer(texts)
    for lo, hi in W.row_blocks(offsets):
        part = W.LOWER[data[offsets[lo] : offsets[hi]]]
        starts, ends, first = W.find_words(part, offsets[lo : hi + 1] - offsets[lo], W.VISIBLE)
        yield lo, hi, W.word_hashes(part, starts, ends), first


def _suffixes(length: int):
    """Column function: places of the kept suffixes and the hash of what they share."""
    shared = length - SPREAD + 1
    kind = "struct<at array<int>, hash array<bigint>>"

    @F.arrow_udf(kind)
    def suffixes(texts: pa.Array) -> pa.Array:
        places, values, counts = [], [], []
        for _, _, hashes, first in _blocks(texts):
            _, at = _places(hashes, first, length)
            kept = np.unique(at)
            row = np.searchsorted(first, kept, "right") - 1
            counts.append(np.bincount(row, minlength=len(first) - 1))
            places.append((kept - first[row]).astype(np.int32))
            values.append(W.ngram_hashes(hashes, shared)[kept].astype(np.int64))
        if not counts:
            return pa.array([], pa.struct([("at", pa.list_(pa.int32())), ("hash", pa.list_(pa.int64()))]))
        n = np.concatenate(counts)
        return pa.StructArray.from_arrays(
            [list_array(np.concatenate(places), n), list_array(np.concatenate(values), n)],
            names=["at", "hash"],
        )

    return suffixes


PLACE = "hash bigint, hot boolean, d bigint, at int, back array<int>, window array<bigint>"


def _windows(length: int):
    """mapInArrow: for each given place its windows, as words back from it and their hashes."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            given = batch.column(2)
            counts = np.diff(given.offsets.to_numpy())
            at = given.flatten().field(0).to_numpy(zero_copy_only=False)
            hot = given.flatten().field(1).to_numpy(zero_copy_only=False)
            upto = np.concatenate([[0], np.cumsum(counts)])
            for lo, hi, hashes, first in _blocks(batch.column(1)):
                row = np.repeat(np.arange(lo, hi), counts[lo:hi])
                marked = first[row - lo] + at[upto[lo] : upto[hi]]
                order = np.argsort(marked, kind="stable")
                wanted = np.zeros(len(hashes) + 1, bool)
                wanted[marked] = True
                starts, place = _places(hashes, first, length)
                starts, place = starts[wanted[place]], place[wanted[place]]
                by_place = np.argsort(place, kind="stable")
                starts, place = starts[by_place], place[by_place]
                n = np.searchsorted(place, marked[order], "right") - np.searchsorted(place, marked[order])
                whole = W.ngram_hashes(hashes, length)[starts].astype(np.int64)
                shared = W.ngram_hashes(hashes, length - SPREAD + 1)
                yield pa.record_batch(
                    [
                        pa.array(shared[marked[order]].astype(np.int64)),
                        pa.array(hot[upto[lo] : upto[hi]][order]),
                        batch.column(0).take(pa.array(row[order])),
                        pa.array((marked[order] - first[row[order] - lo]).astype(np.int32)),
                        list_array((place - starts).astype(np.int32), n),
                        list_array(whole, n),
                    ],
                    names=["hash", "hot", "d", "at", "back", "window"],
                )

    return windows


def _runs(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last place of every run of equal rows."""
    n = len(columns[0])
    fresh = np.arange(n) == 0
    for c in columns:
        fresh[1:] |= c[1:] != c[:-1]
    first = np.flatnonzero(fresh)
    return first, np.append(first[1:], n)[: len(first)] - 1


def _stretches(length: int):
    """mapInArrow over places sorted by class: what each has in common with another document's. The
    last class of a batch waits for the next batch."""

    def compare(part: pa.Table) -> pa.RecordBatch:
        part = part.combine_chunks().to_batches()[0]
        counts = np.diff(part.column("back").offsets.to_numpy())
        row = np.repeat(np.arange(len(counts)), counts)
        kind = part.column("hash").to_numpy()[row]
        d, at = part.column("d").to_numpy()[row], part.column("at").to_numpy()[row]
        window = part.column("window").flatten().to_numpy()
        start = at - part.column("back").flatten().to_numpy()
        order = np.lexsort((d, window, kind))
        kind, window, d, at, start = (x[order] for x in (kind, window, d, at, start))
        edge, last = _runs(kind, window)
        found = np.repeat(d[edge] != d[last], last - edge + 1)
        order = np.lexsort((start[found], at[found], d[found]))
        d, at, start = (x[found][order] for x in (d, at, start))
        edge, last = _runs(d, at)
        return pa.record_batch(
            [
                pa.array(d[edge]),
                pa.array(start[edge].astype(np.int32)),
                pa.array((start[last] + length).astype(np.int32)),
            ],
            names=["d", "start", "end"],
        )

    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            fresh = pa.Table.from_batches([batch])
            held = fresh if held is None else pa.concat_tables([held, fresh])
            if len(held) == 0:
                continue
            kinds = held.column("hash").to_numpy()
            cut = int(np.searchsorted(kinds, kinds[-1]))
            if cut:
                yield compare(held.slice(0, cut))
                held = held.slice(cut)
        if held is not None and len(held):
            yield compare(held)

    return stretches


def _in_two_documents(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that stand in two documents at least, and the number of their rows."""
    return (
        rows.groupBy(*keys)
        .agg(F.min("d").alias("_a"), F.max("d").alias("_b"), F.count("*").alias("n"))
        .where("_a <> _b")
        .drop("_a", "_b")
    )


def repeated_passages(docs: DataFrame, length: int = LENGTH, block: int = BLOCK) -> DataFrame:
    """doc_id, start_word, end_word (exclusive): maximal passages of every document made of windows
    that another document has, too."""
    texts = docs.where(F.col("text").isNotNull()).select(
        "doc_id", F.xxhash64("doc_id", "text").alias("d"), "text"
    )
    kept = settle(
        texts.select("d", _suffixes(length)(F.col("text")).alias("s"))
        .where(F.size("s.at") > 0)
        .select("d", F.inline(F.arrays_zip("s.at", "s.hash")))
        .toDF("d", "at", "hash"),
        "suffixes",
    )
    marked = (
        kept.join(_in_two_documents(kept, ["hash"]), "hash")
        .groupBy("d")
        .agg(F.collect_set(F.struct("at", (F.col("n") > block).alias("hot"))).alias("places"))
        .withColumnRenamed("d", "_d")
    )
    again = texts.join(marked, F.col("d") == F.col("_d")).select("d", "text", "places")
    places = settle(again.mapInArrow(_windows(length), PLACE), "places")
    few = (
        places.where("not hot")
        .repartition("hash")
        .sortWithinPartitions("hash")
        .mapInArrow(_stretches(length), "d bigint, start int, end int")
    )
    # Copies of a passage have the same windows around a place: compare patterns, then meet their places.
    hot = places.where("hot").withColumn("pattern", F.xxhash64("back", "window"))
    each = (
        hot.groupBy("hash", "pattern")
        .agg(
            F.min("d").alias("a"), F.max("d").alias("b"),
            F.first("back").alias("back"), F.first("window").alias("window"),
        )
        .select("hash", "pattern", "a", "b", F.inline(F.arrays_zip("back", "window")))
    )
    shared = (
        each.groupBy("hash", "window")
        .agg(F.min("a").alias("a"), F.max("b").alias("b"))
        .where("a <> b")
        .select("hash", "window")
    )
    common = (
        each.join(shared, ["hash", "window"], "left_semi")
        .groupBy("hash", "pattern")
        .agg(F.max("back").alias("most"), F.min("back").alias("least"))
    )
    many = hot.select("hash", "pattern", "d", "at").join(common, ["hash", "pattern"]).select(
        "d",
        (F.col("at") - F.col("most")).alias("start"),
        (F.col("at") - F.col("least") + length).alias("end"),
    )
    stretches = few.unionByName(many)
    order = Win.partitionBy("d").orderBy("start", "end")
    reached = F.max("end").over(order.rowsBetween(Win.unboundedPreceding, -1))
    fresh = F.coalesce(F.col("start") > reached, F.lit(True)).cast("int")
    passages = (
        stretches.withColumn("fresh", fresh)
        .withColumn("passage", F.sum("fresh").over(order.rowsBetween(Win.unboundedPreceding, 0)))
        .groupBy("d", "passage")
        .agg(F.min("start").alias("start_word"), F.max("end").alias("end_word"))
    )
    ids = texts.select("d", "doc_id").distinct()
    return passages.join(ids, "d").select("doc_id", "start_word", "end_word")


def op9_sparse_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents")).select(
        "doc_id",
        F.col("start_word").cast("long"),
        F.col("end_word").cast("long"),
        (F.col("end_word") - F.col("start_word")).cast("long").alias("n_words"),
    )


OP9_SQL = r"""
with d as (
  select doc_id, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') as w
  from documents where text is not null
), s as (
  select doc_id, w, unnest(range(0, len(w) - 49)) as i from d where len(w) >= 50
), x as (
  select doc_id, i, md5(array_to_string(w[i + 1:i + 50], ' ')) as h from s
), r as (
  select h from x group by h having min(doc_id) <> max(doc_id)
), k as (
  select doc_id, i, case when i - lag(i) over (partition by doc_id order by i) <= 50 then 0 else 1 end
    as fresh
  from x where h in (select h from r)
), g as (
  select doc_id, i, sum(fresh) over (partition by doc_id order by i) as passage from k
)
select doc_id, min(i) as start_word, max(i) + 50 as end_word, max(i) + 50 - min(i) as n_words
from g group by doc_id, passage
"""
