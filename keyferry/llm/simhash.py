"""SimHash near-duplicate detection with Golay-code keys.

A fingerprint's 64 bits are cut into three segments (22, 21 and 21 bits, each padded to 23). Decoding a
segment and its one-bit neighbours with the perfect (23, 12) Golay code gives one or six codeword
indices; two segments that differ in two bits or fewer always share one, because a word between
them is a neighbour of both. Of four wrong bits over three segments, either

* one segment has none, and another has at most two: its exact bits and the other's index agree, or
* all have at least one, so two of them have exactly one: a half of each is exact. Segments one bit apart
  differ in parity, so it is enough that even ones give all their indices and odd ones their own.

So the keys (exact segment, index of another) for all six ordered pairs, and (exact half of one, its index,
exact half of another) for all three pairs and their halves, bring together every pair of fingerprints
within four bits. Every key has 33 or 34 bits, so few rows meet by chance. Equal fingerprints are
merged before.

A key's rows are linked as a forest: a search from one fingerprint takes all unvisited ones in reach,
and goes on from those. That needs no pair of every two near copies, and leaves out no fingerprint
that any of them reaches. Keys with more than ``BLOCK`` rows are cut into blocks, and every two
blocks are searched together, so no task holds more than two blocks.

Rows: a null, empty or blank text has fingerprint zero, which links like any other. Rows without
``doc_id`` get a fingerprint; they take their component from the other rows and are never its
smallest. Repeated rows give repeated results. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyferry.llm.common import LOWER, table, utf8_rows
from keyferry.llm.components import components
from keyferry.scratch import settle

SHINGLE = 4
SEED = 42
DISTANCE = 4
BLOCK = 20_000
#: First bit and width of the segments.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Generator polynomial of the Golay code, x^11 + x^9 + x^7 + x^6 + x^5 + x + 1 (a fixed value).
GOLAY = 0b101011100011


def fingerprint(text: bytes) -> int:
    words = text.translate(LOWER).split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    n = max(len(words) - SHINGLE + 1, 1)
    first = np.concatenate([[0], ends[: n - 1] + 1]).tolist()
    last = ends[min(SHINGLE, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array(
        [digest(line[a:b], SEED) for a, b in zip(first, last, strict=True)], np.uint64
    )
    return int(_majority(hashes))


def _majority(hashes: np.ndarray) -> np.uint64:
    """Bits that are set in over half of the hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0]


@F.arrow_udf(T.LongType())
def fingerprints(texts: pa.Array) -> pa.Array:
    """The fingerprint's 64 bits as a long."""
    rows = [fingerprint(t) for t in utf8_rows(texts)]
    return pa.array(np.array(rows, np.uint64).view(np.int64))


@lru_cache(1)
def _corrections() -> np.ndarray:
    """By syndrome (11 bits) the error of up to three bits that explains it."""
    table_ = np.zeros(2048, np.uint32)
    units = [_syndrome(np.uint32(1 << b)) for b in range(23)]
    for weight in (1, 2, 3):
        for bits in combinations(range(23), weight):
            at = 0
            for b in bits:
                at ^= int(units[b])
            table_[at] = sum(1 << b for b in bits)
    return table_


def _syndrome(words: np.ndarray) -> np.ndarray:
    """The remainder modulo the generator polynomial."""
    rest = np.array(words, np.uint32)
    for b in range(22, 10, -1):
        rest ^= ((rest >> np.uint32(b)) & np.uint32(1)) * np.uint32(GOLAY << (b - 11))
    return rest


def codeword_indices(segments: np.ndarray, own: np.ndarray | None = None) -> np.ndarray:
    """One row per segment: the sorted indices of the codewords nearest to it and to each of its
    one-bit neighbours, repeated ones as -1. Segments marked in ``own`` give just their own."""
    flips = np.concatenate([[0], 1 << np.arange(23)]).astype(np.uint32)
    around = segments.astype(np.uint32)[:, None] ^ flips[None, :]
    if own is not None:
        around[own] = around[own, :1]
    code = around ^ _corrections()[_syndrome(around)]
    index = np.sort((code >> np.uint32(11)).astype(np.int64), axis=1)
    index[:, 1:][index[:, 1:] == index[:, :-1]] = -1
    return index


def fuzzy_keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the fingerprints and, for each key, the fingerprint's place."""
    bits = prints.view(np.uint64)
    parts = [
        ((bits >> np.uint64(at)) & np.uint64((1 << width) - 1)).astype(np.int64)
        for at, width in SEGMENTS
    ]
    keys, rows = [], []

    def add(tag: int, exact: np.ndarray, index: np.ndarray) -> None:
        row, col = np.nonzero(index >= 0)
        keys.append(tag << 40 | exact[row] << 12 | index[row, col])
        rows.append(row)

    for j in range(3):
        index = codeword_indices(parts[j])
        for i in range(3):
            if i != j:
                add(3 * i + j, parts[i], index)
    halves = [(p & 2047, p >> 11) for p in parts]
    for i, j in combinations(range(3), 2):
        index = codeword_indices(parts[i], own=np.bitwise_count(parts[i]) % 2 == 1)
        for a in range(2):
            for b in range(2):
                tag = 16 + 4 * (3 * i + j) + 2 * a + b
                add(tag, halves[i][a] << 11 | halves[j][b], index)
    return np.concatenate(keys), np.concatenate(rows)


def _emit_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = batch.column(0).to_numpy(zero_copy_only=False)
        for at in range(0, len(prints), 4096):
            part = prints[at : at + 4096]
            keys, rows = fuzzy_keys(part)
            yield pa.record_batch([pa.array(keys), pa.array(part[rows])], names=["key", "f"])


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count((a ^ b).view(np.uint64))  # of signed numbers it counts the absolute value's bits


def forest(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (member, the one it was reached from) that connect whatever is in reach of each other."""
    rest, a, b = prints, [], []
    while len(rest) > 1:
        frontier, rest = [rest[:1]], rest[1:]
        while frontier and len(rest):
            at = frontier.pop()
            near = _distance(rest, at) <= DISTANCE
            if near.any():
                found = rest[near]
                rest = rest[~near]
                a.append(found)
                b.append(np.repeat(at, len(found)))
                frontier += np.split(found, len(found))
    none = np.empty(0, prints.dtype)
    return np.concatenate([none, *a]), np.concatenate([none, *b])


#: Rows that share a key up to which all pairs are compared at once.
FEW = 16


def _link_runs(keys: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links within each run of equal keys."""
    edge = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    size = np.diff(np.append(edge, len(keys)))
    a, b = [], []
    small = np.repeat(size <= FEW, size)
    for lag in range(1, min(FEW, len(keys))):
        near = (
            (keys[lag:] == keys[:-lag])
            & small[lag:]
            & (_distance(prints[lag:], prints[:-lag]) <= DISTANCE)
        )
        at = np.flatnonzero(near)
        a.append(prints[lag:][at])
        b.append(prints[:-lag][at])
    for at, n in zip(edge[size > FEW], size[size > FEW], strict=True):
        more = forest(prints[at : at + n])
        a.append(more[0])
        b.append(more[1])
    none = np.empty(0, np.int64)
    return np.concatenate([none, *a]), np.concatenate([none, *b])


def _link_sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links from rows sorted by key; the last key of a batch waits for the next batch."""
    keys, prints = np.empty(0, np.int64), np.empty(0, np.int64)
    for batch in batches:
        keys = np.concatenate([keys, batch.column(0).to_numpy(zero_copy_only=False)])
        prints = np.concatenate([prints, batch.column(1).to_numpy(zero_copy_only=False)])
        if len(keys) == 0:
            continue
        cut = int(np.searchsorted(keys, keys[-1], "left"))
        if cut:
            yield _pairs(*_link_runs(keys[:cut], prints[:cut]))
            keys, prints = keys[cut:], prints[cut:]
    if len(keys):
        yield _pairs(*_link_runs(keys, prints))


def _pairs(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    pairs = np.unique(np.stack([np.maximum(a, b), np.minimum(a, b)]), axis=1)
    return pa.record_batch([pa.array(pairs[0]), pa.array(pairs[1])], names=["a", "b"])


def link_fingerprints(prints: DataFrame, block: int = BLOCK) -> DataFrame:
    """Links (a, b) that connect all distinct fingerprints (column ``f``) within four bits."""
    keyed = settle(prints.select("f").mapInArrow(_emit_keys, "key bigint, f bigint"), "golay-keys")
    sizes = keyed.groupBy("key").count()
    shared = sizes.where(F.col("count").between(2, block)).select("key")
    hot = settle(sizes.where(F.col("count") > block), "hot-keys")
    linked = _sorted_links(keyed.join(shared, "key", "left_semi").select("key", "f"))
    if hot.isEmpty():
        return linked
    # Every two blocks of a hot key meet under a key of their own.
    blocks = F.ceil(F.col("count") / block).cast("int")
    mine = F.pmod(F.xxhash64("f"), F.col("n")).cast("int")
    big = (
        keyed.join(hot.select("key", blocks.alias("n")), "key")
        .withColumn("mine", mine)
        .withColumn("other", F.explode(F.expr("sequence(0, n - 1)")))
        .select(
            F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other")).alias("key"),
            "f",
        )
    )
    return linked.unionByName(_sorted_links(big))


def _sorted_links(keyed: DataFrame) -> DataFrame:
    return (
        keyed.repartition("key")
        .sortWithinPartitions("key", "f")
        .mapInArrow(_link_sorted, "a bigint, b bigint")
    )


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``text_hash``, ``f`` (fingerprint as a long), ``root``
    (the same for all of a component) and ``component_id``, the smallest id that links lead to."""
    printed = settle(
        docs.select(
            F.col(doc_id).cast("long").alias("doc_id"),
            F.xxhash64(text).alias("text_hash"),
            fingerprints(F.col(text)).alias("f"),
        ),
        "fingerprints",
    )
    least = settle(printed.groupBy("f").agg(F.min("doc_id").alias("least")), "distinct-prints")
    roots = components(link_fingerprints(least))
    rooted = least.join(roots, least.f == roots.node, "left").select(
        "f", F.coalesce("root", "f").alias("root"), "least"
    )
    by_root = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(by_root, "root").select("f", "root", "component_id")
    return printed.join(named, "f").select("doc_id", "text_hash", "f", "root", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one whole row of each component: the one of smallest id, and of smallest text hash
    if several rows have that id. A component without any id keeps a row, too."""
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")).alias("first")
    found = settle(near_duplicates(docs), "near-duplicates")
    chosen = settle(
        found.groupBy("root")
        .agg(first)
        .select(F.col("first.doc_id").alias("_cid"), F.col("first.text_hash").alias("_chash")),
        "kept-rows",
    )
    repeated = (
        found.groupBy("doc_id", "text_hash").count().where("count > 1").limit(1).count() > 0
    )
    keyed = docs.select(
        F.struct("*").alias("doc"),
        F.col("doc_id").cast("long").alias("id"),
        F.xxhash64("text").alias("hash"),
    )
    same = F.col("id").eqNullSafe(F.col("_cid")) & (F.col("hash") == F.col("_chash"))
    kept = keyed.join(chosen, same, "left_semi")
    if repeated:
        kept = kept.dropDuplicates(["id", "hash"])
    return kept.select("doc.*")


def op7_simhash_golay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select(
        "doc_id",
        F.lpad(F.lower(F.hex("f")), 16, "0").alias("fingerprint"),
        "component_id",
    )
