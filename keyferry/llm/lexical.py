"""Ranked lexical search for many items at once, with shared parts of the items computed once.

An item is a sum over its terms, and items share terms. Terms that occur together in several items are merged
pair by pair, the most frequent pair first; a merged pair is a symbol of its own and can be merged again. That
gives a graph of shared term sets: every set is the sum of two smaller ones, and an item is the sum of
a few sets and single terms. For a run of documents, a term's contributions to all its documents are one
row of a matrix (the term's accumulator); the sets' rows are added up level by level, each once however
many items hold it, and the items' rows last. Sums are of whole numbers, so the order of adding
changes nothing.

Terms that several items hold are merged in bands of ``BAND`` terms of similar frequency among the items, so that
the pairs that are counted stay in proportion to the items' length. That decides how much is shared, never a score.

Every document is one row of one task: texts are read once, written as (term, count) of the items' terms, counted
for statistics by a map-side combined aggregation, and scored from what was written. A task keeps ``k``
documents an item over all its rows, and only those are shuffled. Items are worked off in blocks of about
``BLOCK_TERMS`` terms, each of them with its terms and its graph broadcast: what is broadcast doesn't grow
with the items, and one scan of the documents serves a block.

Rows: a null text has no terms, and a document without terms counts nowhere. Documents without id count in the
statistics and are never a result. Documents that repeat an id are documents of their own. Rows that repeat
an item's id are one item with the terms of all; items without id or terms have no result. Equal scores go
by ascending id. Other columns are not looked at.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as Win
from pyspark.sql import functions as F

from keyferry.llm.common import LOWER, list_array, table, utf8_rows
from keyferry.scratch import settle

K = 20
#: Terms: 0-9, A-Z, a-z and all that isn't ASCII. On UTF-8 bytes all bytes from 0x80 on are the latter.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
TERM_BYTES = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
BLOCK_TERMS = 50_000
BAND = 256
#: Bytes of a matrix of accumulators.
MATRIX = 64 << 20


def item_terms(items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """item_id, term, q (occurrences in all rows of the item)."""
    lower = F.translate(text, UPPER, UPPER.lower())
    return (
        items.where(F.col(item_id).isNotNull())
        .select(
            F.col(item_id).cast("long").alias("item_id"),
            F.explode(F.regexp_extract_all(lower, F.lit(TERM), F.lit(0))).alias("term"),
        )
        .groupBy("item_id", "term")
        .agg(F.count("*").alias("q"))
    )


def mine_shared(
    rows: list[list[int]], symbols: int, band: int = BAND
) -> tuple[list[int], list[int], list[list[int]]]:
    """Merge symbols that occur together in several rows.

    Gives the two parts of each merged set, numbered on from ``symbols``, and each row as a list of
    sets and symbols that hold the row's symbols once.
    """
    frequency = Counter(s for row in rows for s in row)
    shared = sorted((s for s, n in frequency.items() if n > 1), key=lambda s: (-frequency[s], s))
    place = {s: i // band for i, s in enumerate(shared)}
    parts: dict[int, list[tuple[int, set[int]]]] = defaultdict(list)
    for r, row in enumerate(rows):
        by_band: dict[int, set[int]] = defaultdict(set)
        for s in row:
            if s in place:
                by_band[place[s]].add(s)
        for b, held in by_band.items():
            parts[b].append((r, held))
    left: list[int] = []
    right: list[int] = []
    out = [[s for s in row if s not in place] for row in rows]
    for b in sorted(parts):
        sets = [held for _, held in parts[b]]
        _merge_pairs(sets, symbols, left, right)
        for (r, _), held in zip(parts[b], sets, strict=True):
            out[r] += sorted(held)
    return left, right, out


def _merge_pairs(sets: list[set[int]], symbols: int, left: list[int], right: list[int]) -> None:
    """Replace, while any two symbols are together in two sets, the pair that is in most sets."""
    counted = Counter(p for held in sets for p in combinations(sorted(held), 2))
    holders: dict[tuple[int, int], set[int]] = {p: set() for p, n in counted.items() if n > 1}
    for i, held in enumerate(sets):
        for p in combinations(sorted(held), 2):
            if p in holders:
                holders[p].add(i)
    heap = [(-len(at), p) for p, at in holders.items()]
    heapq.heapify(heap)
    while heap:
        n, pair = heapq.heappop(heap)
        at = holders[pair]
        if len(at) != -n:
            if len(at) > 1:
                heapq.heappush(heap, (-len(at), pair))
            continue
        new = symbols + len(left)
        left.append(pair[0])
        right.append(pair[1])
        beside: dict[int, set[int]] = defaultdict(set)
        for i in list(at):
            held = sets[i]
            held -= {*pair}
            for other in held:
                for s in pair:
                    known = holders.get((min(s, other), max(s, other)))
                    if known is not None:
                        known.discard(i)
                beside[other].add(i)
            held.add(new)
        at.clear()
        for other, together in beside.items():
            if len(together) > 1:
                holders[other, new] = together
                heapq.heappush(heap, (-len(together), (other, new)))


PLAN = (
    "block int, terms array<string>, items array<bigint>, symbol_term array<int>, symbol_q array<bigint>, "
    "left array<int>, right array<int>, roots array<int>, root_counts array<int>"
)


def _plan(rows: pd.DataFrame) -> pd.DataFrame:
    """A block's terms, items, symbols (a term with its count in an item) and sharing graph."""
    rows = rows.sort_values(["item_id", "term"])
    terms = sorted(set(rows["term"]))
    number = {t: i for i, t in enumerate(terms)}
    symbols: dict[tuple[int, int], int] = {}
    items: dict[int, list[int]] = {}
    for item, term, q in zip(rows["item_id"], rows["term"], rows["q"], strict=True):
        symbol = symbols.setdefault((number[term], int(q)), len(symbols))
        items.setdefault(int(item), []).append(symbol)
    left, right, roots = mine_shared(list(items.values()), len(symbols))
    return pd.DataFrame(
        {
            "block": [int(rows["block"].iloc[0])],
            "terms": [terms],
            "items": [list(items)],
            "symbol_term": [[t for t, _ in symbols]],
            "symbol_q": [[q for _, q in symbols]],
            "left": [left],
            "right": [right],
            "roots": [[s for row in roots for s in row]],
            "root_counts": [[len(row) for row in roots]],
        }
    )


class Sharing:
    """A block's sharing graph, by levels, ready to add up accumulators."""

    def __init__(self, plan):
        self.items = np.array(plan["items"], np.int64)
        self.terms = len(plan["terms"])
        self.symbol_term = np.array(plan["symbol_term"], np.int64)
        self.symbol_q = np.array(plan["symbol_q"], np.int64)
        left, right = np.array(plan["left"], np.int64), np.array(plan["right"], np.int64)
        symbols = len(self.symbol_term)
        level = np.zeros(symbols + len(left), np.int64)
        for i, (a, b) in enumerate(zip(left, right, strict=True)):
            level[symbols + i] = 1 + max(level[a], level[b])
        self.levels = []
        for n in range(1, int(level.max(initial=0)) + 1):
            at = np.flatnonzero(level == n)
            self.levels.append((at, left[at - symbols], right[at - symbols]))
        self.rows = len(level)
        self.roots = np.array(plan["roots"], np.int64)
        counts = np.array(plan["root_counts"], np.int64)
        self.first = np.cumsum(counts) - counts
        #: Additions a document for all items, and what they would be without sharing.
        self.additions = len(left) + len(self.roots)
        self.plain = int(self._sizes(left, right, symbols)[self.roots].sum())

    def _sizes(self, left: np.ndarray, right: np.ndarray, symbols: int) -> np.ndarray:
        size = np.ones(self.rows, np.int64)
        for i, (a, b) in enumerate(zip(left, right, strict=True)):
            size[symbols + i] = size[a] + size[b]
        return size

    def scores(self, impacts: np.ndarray) -> np.ndarray:
        """Items by documents, from terms by documents."""
        acc = np.empty((self.rows, impacts.shape[1]), np.int64)
        symbols = len(self.symbol_term)
        acc[:symbols] = impacts[self.symbol_term] * self.symbol_q[:, None]
        for at, a, b in self.levels:
            acc[at] = acc[a] + acc[b]
        return np.add.reduceat(acc[self.roots], self.first, axis=0)


def _count_terms(shared):
    """Documents with terms: id, n (all terms), and the block's terms in them with their counts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = {t.encode(): i for i, t in enumerate(shared.value)}.get
        for batch in batches:
            n, sizes, terms, counts, kept = [], [], [], [], []
            for row, text in enumerate(utf8_rows(batch.column(1))):
                words = TERM_BYTES.findall(text.translate(LOWER))
                if not words:
                    continue
                places = np.fromiter(map(find, words, repeat(-1)), np.int32, len(words))
                found, times = np.unique(places[places >= 0], return_counts=True)
                kept.append(row)
                n.append(len(words))
                sizes.append(len(found))
                terms.append(found)
                counts.append(times)
            if not kept:
                continue
            none = [np.empty(0, np.int32)]
            yield pa.record_batch(
                [
                    batch.column(0).take(pa.array(kept, pa.int64())),
                    pa.array(n, pa.int64()),
                    list_array(np.concatenate(none + terms), np.array(sizes)),
                    list_array(np.concatenate(none + counts).astype(np.int64), np.array(sizes)),
                ],
                names=["doc_id", "n", "t", "tf"],
            )

    return count


COUNTED = "doc_id bigint, n bigint, t array<int>, tf array<bigint>"


def _best(item: np.ndarray, doc: np.ndarray, score: np.ndarray, k: int) -> list[np.ndarray]:
    """Each item's ``k`` best of these, by item."""
    order = np.lexsort((doc, -score, item))
    item = item[order]
    first = np.searchsorted(item, item)
    keep = order[np.arange(len(item)) - first < k]
    keep_item = item[np.arange(len(item)) - first < k]
    return [keep_item, doc[keep], score[keep]]


def _score(shared, k: int):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sharing, weights, documents, words = shared.value
        best = [np.empty(0, np.int64)] * 3
        least = np.zeros(len(sharing.items), np.int64)
        step = max(16, MATRIX // (8 * (sharing.rows + sharing.terms + len(sharing.roots))))
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                rows = batch.slice(at, step)
                doc, n = (rows.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
                t, tf = (rows.column(i).flatten().to_numpy() for i in (2, 3))
                place = np.repeat(np.arange(len(doc)), rows.column(2).value_lengths().to_numpy())
                m = 100 - 25 + (25 * n * documents) // words
                impact = weights[t] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m[place]))
                matrix = np.zeros((sharing.terms, len(doc)), np.int64)
                matrix[t, place] = impact
                scores = sharing.scores(matrix)
                item, d = np.nonzero((scores > 0) & (scores >= least[:, None]))
                if len(item) == 0:
                    continue
                found = [item, doc[d], scores[item, d]]
                best = _best(*[np.concatenate(x) for x in zip(best, found, strict=True)], k)
                full = np.bincount(best[0], minlength=len(least)) == k
                last = np.searchsorted(best[0], np.arange(len(least)), "right") - 1
                least[full] = best[2][last[full]]
        yield pa.record_batch(
            [pa.array(sharing.items[best[0]]), pa.array(best[1]), pa.array(best[2])],
            names=["item_id", "doc_id", "score"],
        )

    return score


FOUND = "item_id bigint, doc_id bigint, score bigint"


def weight(documents: int, holding: int) -> int:
    """A term's weight by the number of documents that hold it."""
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def sharing_plans(items: DataFrame, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """One row per block of items: its terms, items and sharing graph (a written table)."""
    terms = settle(item_terms(items), "item-terms")
    blocks = -(-terms.count() // block_terms)
    block = F.pmod(F.xxhash64("item_id"), F.lit(max(blocks, 1))).cast("int")
    return settle(
        terms.withColumn("block", block).groupBy("block").applyInPandas(_plan, PLAN), "sharing-plans"
    )


def rank_documents(
    docs: DataFrame, items: DataFrame, k: int = K, block_terms: int = BLOCK_TERMS
) -> DataFrame:
    """item_id, rank, doc_id, score: each item's ``k`` documents of highest score above 0."""
    spark = docs.sparkSession
    plans = sharing_plans(items, block_terms)
    texts = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")
    )
    found = spark.createDataFrame([], FOUND)
    for row in plans.select("block").sort("block").collect():
        plan = plans.where(F.col("block") == row["block"]).first()
        words = spark.sparkContext.broadcast(plan["terms"])
        counted = settle(texts.mapInArrow(_count_terms(words), COUNTED), "term-counts")
        documents, total = counted.agg(F.count("*"), F.sum("n")).first()
        if documents == 0:
            break
        holding = np.zeros(len(plan["terms"]), np.int64)
        for r in counted.select(F.explode("t").alias("t")).groupBy("t").count().collect():
            holding[r["t"]] = r["count"]
        weights = np.array([weight(documents, int(df)) for df in holding], np.int64)
        shared = spark.sparkContext.broadcast((Sharing(plan), weights, documents, total))
        named = counted.where(F.col("doc_id").isNotNull())
        found = found.unionByName(settle(named.mapInArrow(_score(shared, k), FOUND), "item-bests"))
    place = Win.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    return (
        found.withColumn("rank", F.row_number().over(place))
        .where(F.col("rank") <= k)
        .select("item_id", "rank", "doc_id", "score")
    )


def op13_shared_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP13_SQL = r"""
with d as (
  select row_number() over () as r, doc_id, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as w
  from documents
), q as (
  select item_id, term, count(*) as q from (
    select item_id, unnest(regexp_extract_all(
      translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
    from benchmark where item_id is not null
  ) group by all
), n as (
  select count(*) as docs, cast(sum(len(w)) as bigint) as words from d where len(w) > 0
), p as materialized (
  select r, term, count(*) as tf from (select r, unnest(w) as term from d) group by all
), f as (
  select term, count(*) as df from p group by term
), c as (
  select p.r, p.term,
    cast(floor(1000 * ln(cast(2 * docs + 2 as double) / cast(2 * df + 1 as double))) as bigint)
      * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + ((25 * len(d.w) * docs) // words)))) as x
  from p join f using (term) join d using (r), n
), s as (
  select item_id, r, cast(sum(q * x) as bigint) as score from q join c using (term) group by all
)
select item_id, cast(rank as integer) as rank, doc_id, score from (
  select item_id, doc_id, score, row_number() over (partition by item_id order by score desc, doc_id) as rank
  from s join d using (r) where score > 0 and doc_id is not null
) where rank <= 20
"""
