"""Benchmark decontamination by winnowing.

Both sides keep the least hash of ``k`` words among every ``w`` such hashes in a row, with
``k + w - 1`` the window's words (13). A window that occurs in a document therefore has the same
fingerprint there, at the same place in the window: no shared window is missed. Fingerprints are joined
by hash, each hit is extended to the windows that have it there, and words are compared, so that a
hash collision adds nothing. Items shorter than a window are windows of their own length, with
fingerprints for that length.

Documents keep only fingerprints whose bit is set in a filter of fixed size (``FILTER_BITS``) made from
the benchmark; the join decides. The benchmark's windows are broadcast up to ``MAX_BROADCAST``, and
joined with salt beyond.

Rows: a null or wordless text has no words and is not contaminated. Null or wordless items have no
windows; an item without id marks words but is not listed. Every row of ``docs`` gives one result row,
repeated ones too. Other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keyferry.llm import words as W
from keyferry.llm.common import table, utf8_buffer
from keyferry.scratch import lookup_join, settle

WINDOW = 13
K = 5
FILTER_BITS = 25
MAX_BROADCAST = 50_000
HITS = (
    "struct<n_words bigint, hits array<struct<hash bigint, at bigint, lead int, "
    "near array<string>>>>"
)
WINDOWS = "array<struct<hash bigint, lead int, words array<string>>>"


def _shape(length: int) -> tuple[int, int]:
    """Words of a fingerprint and hashes of a winnowing window for windows of ``length`` words."""
    k = min(K, length)
    return k, length - k + 1


def _fingerprints(words: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprint and its place for each window of ``length`` words."""
    k, w = _shape(length)
    return W.window_minima(W.ngram_hashes(words, k) ^ np.uint64(length), w)


def _slots(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def benchmark_windows(bench: DataFrame, window: int = WINDOW) -> DataFrame:
    """Distinct windows of all items: ``hash``, ``lead`` (words before the fingerprint), ``words``,
    ``n`` (how many), ``items`` (ids as strings)."""

    @F.arrow_udf(WINDOWS)
    def windows(texts: pa.Array) -> pa.Array:
        out = []
        data, offsets = utf8_buffer(texts)
        data = W.LOWER[data]
        starts, ends, first = W.find_words(data, offsets, W.ALNUM)
        hashes = W.word_hashes(data, starts, ends)
        for a, b in zip(first[:-1], first[1:], strict=True):
            found: list[dict] = []
            if b > a:
                length = min(window, int(b - a))
                spelled = [
                    data[s:e].tobytes().decode("utf-8", "replace")
                    for s, e in zip(starts[a:b], ends[a:b], strict=True)
                ]
                least, at = _fingerprints(hashes[a:b], length)
                for i, (h, p) in enumerate(zip(least.astype(np.int64), at, strict=True)):
                    found.append(
                        {"hash": int(h), "lead": int(p) - i, "words": spelled[i : i + length]}
                    )
            out.append(found)
        return pa.array(out, pa.list_(_struct("hash", "lead", words=True)))

    rows = bench.select(
        F.col("item_id").cast("string").alias("item"), F.explode(windows("text")).alias("w")
    )
    return (
        rows.groupBy("w")
        .agg(F.collect_set("item").alias("items"))
        .select("w.*", F.size("w.words").alias("n"), "items")
    )


def _struct(*numbers: str, words: bool = False, near: bool = False) -> pa.DataType:
    kinds = {"hash": pa.int64(), "at": pa.int64(), "lead": pa.int32()}
    fields = [pa.field(n, kinds[n]) for n in numbers]
    if words or near:
        fields.append(pa.field("words" if words else "near", pa.list_(pa.string())))
    return pa.struct(fields)


def _filter(windows: DataFrame) -> np.ndarray:
    """A bit per slot that holds a fingerprint. Its size is fixed, whatever the benchmark's."""
    slot = F.expr(f"shiftrightunsigned(hash, {64 - FILTER_BITS})")
    bits = (
        windows.select(slot.alias("slot"))
        .groupBy(F.shiftright("slot", 6).alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("bits"))
    )
    out = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    for row in bits.toLocalIterator():
        out[row["word"]] = row["bits"]
    return np.unpackbits(out.view(np.uint8), bitorder="little").astype(bool)


def _scan(shared, lengths: list[int]):
    """Column function: a text's number of words and its fingerprints that pass the filter, each with
    the words around it that a window could have."""

    @F.arrow_udf(HITS)
    def scan(texts: pa.Array) -> pa.Array:
        passes = shared.value
        all_data, all_offsets = utf8_buffer(texts)
        counts: list[np.ndarray] = []
        out: list[list[dict]] = []
        for lo, hi in W.row_blocks(all_offsets):
            data = W.LOWER[all_data[all_offsets[lo] : all_offsets[hi]]]
            starts, ends, first = W.find_words(
                data, all_offsets[lo : hi + 1] - all_offsets[lo], W.ALNUM
            )
            hashes = W.word_hashes(data, starts, ends)
            counts.append(np.diff(first))
            found: list[list[dict]] = [[] for _ in range(hi - lo)]
            for length in lengths:
                least, at = _fingerprints(hashes, length)
                # The row where a window starts must be the one where it ends.
                hit = np.flatnonzero(passes[_slots(least)])
                row = np.searchsorted(first, hit, "right") - 1
                inside = hit + length <= first[row + 1]
                place, once = np.unique(at[hit[inside]], return_index=True)
                values = least[hit[inside]][once].astype(np.int64)
                k, w = _shape(length)
                for r, p, h in zip(row[inside][once], place, values, strict=True):
                    a, b = max(first[r], p - w + 1), min(first[r + 1], p + k + w - 1)
                    near = data[starts[a] : ends[b - 1]].tobytes()
                    spelled = [
                        near[s:e].decode("utf-8", "replace")
                        for s, e in zip(
                            (starts[a:b] - starts[a]).tolist(),
                            (ends[a:b] - starts[a]).tolist(),
                            strict=True,
                        )
                    ]
                    found[r].append(
                        {"hash": h, "at": p - first[r], "lead": p - a, "near": spelled}
                    )
            out += found
        n_words = np.concatenate(counts) if counts else np.empty(0, np.int64)
        hits = pa.array(out, pa.list_(_struct("hash", "at", "lead", near=True)))
        return pa.StructArray.from_arrays(
            [pa.array(n_words, pa.int64()), hits], names=["n_words", "hits"]
        )

    return scan


def _covered(spans: Column) -> Column:
    """How many places the sorted spans cover."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("upto"))
    return F.aggregate(
        spans,
        start,
        lambda acc, s: F.struct(
            (acc["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(s["start"], acc["upto"])))
            .cast("long")
            .alias("n"),
            F.greatest(acc["upto"], s["end"]).alias("upto"),
        ),
        lambda acc: acc["n"],
    )


def contamination(
    docs: DataFrame, bench: DataFrame, window: int = WINDOW, doc_id: str = "doc_id"
) -> DataFrame:
    """One row per row of ``docs``: its id, ``text_hash``, ``n_words``, ``spans`` (word places of the
    windows found, sorted), ``n_hit`` (words in any of them) and ``items`` (sorted)."""
    spark = docs.sparkSession
    windows = settle(benchmark_windows(bench, window), "bench-windows")
    lengths = [r["n"] for r in windows.select("n").distinct().sort("n").collect()]
    shared = spark.sparkContext.broadcast(_filter(windows))
    scanned = settle(
        docs.select(
            F.col(doc_id).alias("doc_id"),
            F.xxhash64("text").alias("text_hash"),
            _scan(shared, lengths)(F.col("text")).alias("s"),
        ).select("doc_id", "text_hash", "s.*"),
        "doc-fingerprints",
    )
    hits = scanned.select("doc_id", "text_hash", F.inline("hits"))
    found = (
        lookup_join(
            hits,
            windows.withColumnRenamed("lead", "want"),
            ["hash"],
            F.struct("doc_id", "text_hash", "at"),
            max_rows=MAX_BROADCAST,
        )
        .where(
            (F.col("lead") >= F.col("want"))
            & (F.slice("near", F.col("lead") - F.col("want") + 1, F.col("n")) == F.col("words"))
        )
        .select(
            "doc_id",
            "text_hash",
            F.struct(
                (F.col("at") - F.col("want")).alias("start"),
                (F.col("at") - F.col("want") + F.col("n")).alias("end"),
            ).alias("span"),
            "items",
        )
        .groupBy("doc_id", "text_hash")
        .agg(
            F.sort_array(F.collect_set("span")).alias("spans"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
        )
    )
    same = found.select(
        F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "spans", "items"
    )
    joined = scanned.select("doc_id", "text_hash", "n_words").join(
        same,
        F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("text_hash").eqNullSafe(F.col("_hash")),
        "left",
    )
    none = F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)")
    return joined.select(
        "doc_id",
        "text_hash",
        "n_words",
        F.coalesce("spans", none).alias("spans"),
        F.coalesce(_covered(F.col("spans")), F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("items", F.expr("cast(array() as array<string>)")).alias("items"),
    )


def is_contaminated() -> Column:
    """Any hit, and at least one word in twenty."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def drop_contaminated(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """``docs`` without the contaminated ones."""
    bad = settle(
        contamination(docs, bench)
        .where(is_contaminated())
        .select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_id"), "text_hash")
        .distinct(),
        "contaminated",
    ).withColumnRenamed("text_hash", "_hash")
    keyed = docs.select(
        F.struct("*").alias("doc"),
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_id"),
        F.xxhash64("text").alias("_hash"),
    )
    return lookup_join(keyed, bad, ["_id", "_hash"], F.col("_id"), "left_anti").select("doc.*")


def op2_benchmark_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        is_contaminated().alias("contaminated"),
    )


OP2_SQL = r"""
with d as (
  select doc_id, text, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from documents
), b as (
  select item_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from benchmark
), bs as (
  select item_id, w, least(13, len(w)) as n, unnest(range(1, len(w) - least(13, len(w)) + 2)) as i
  from b where len(w) > 0
), bw as (
  select distinct item_id, n, array_to_string(w[i:i + n - 1], ' ') as words from bs
), ns as (select distinct n from bw
), ds as (
  select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from d, ns where len(w) >= n
), hit as (
  select ds.doc_id, ds.i, ds.n, bw.item_id
  from ds join bw on ds.n = bw.n and array_to_string(ds.w[ds.i:ds.i + ds.n - 1], ' ') = bw.words
), place as (
  select doc_id, count(distinct p) as n_hit
  from (select doc_id, unnest(range(i, i + n)) as p from hit) group by doc_id
), item as (
  select doc_id, count(*) as n_items, string_agg(id, ',' order by id) as ids
  from (select distinct doc_id, cast(item_id as varchar) as id from hit) group by doc_id
)
select d.doc_id, cast(len(d.w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit,
  coalesce(n_items, 0) as n_items, sha256(coalesce(ids, '')) as items_sha256,
  coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(d.w) as contaminated
from d left join place using (doc_id) left join item using (doc_id)
"""
