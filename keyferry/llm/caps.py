"""Near-duplicate vectors by spherical-cap filters.

A filter is a direction, and a vector belongs to every filter with which it has an inner product of ``alpha``
or more: those are the filters in whose cap its direction lies. Vectors that are close lie in common caps. The
directions come from structured random product codes: space is turned at random and cut into two
halves, each with a code of m random unit vectors, and every pair of their codewords is a
direction. So m^2 directions need 2m inner products, and a vector's filters are list-decoded: a first codeword
is followed up only as far as its best partner can still reach ``alpha``. There are ``CODES`` such codes, each
turned on its own.

``alpha`` follows from the geometry of the sphere. Each code has to give two vectors at exactly the threshold's
angle ``SHARED`` common filters on average, whatever their place, as the turns are random. Then ten codes
miss about 2 in 1,000 such pairs, and fewer of closer ones, at every table size. The size of a code grows with the
root of the number of vectors (2,048 at most), so that a filter holds few unrelated vectors; ``alpha`` grows with it.

Vectors of one label and filter are compared in double precision. A pair that has several filters in common is
counted only in the smallest of them, so no pair is written, and no list of pairs has to be made
distinct: a filter gives each of its vectors a number of links, and links enough to connect what is linked there. A
filter with more than ``BLOCK`` vectors is cut into blocks, and every two blocks meet in a task of their own. Equal
vectors of a label are one class with a count before anything else, so copies meet nobody twice.

Rows: every row gives one result row. Vectors that are null, zero, or hold null or non-finite components, and rows
without label, link with nothing. Vectors are compared with others of their length only. Rows that repeat an id are
vectors of their own. Rows without id link like any other, but name no component; a component without any id
has null. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyferry.llm.common import list_array, table
from keyferry.llm.components import components
from keyferry.scratch import lookup_join, settle

LEAST = 0.93
SHARED = 2.0
CODES = 10
SMALLEST, LARGEST = 64, 2_048
BLOCK = 2_000
SEED = 29
#: Shorter vectors are filled up with zeros to this length for the codes.
DIM = 8


def code_size(vectors: int) -> int:
    """Codewords of a half: a power of two near the root of the number of vectors."""
    m = SMALLEST
    while m < LARGEST and m * m < vectors:
        m *= 2
    return m


@lru_cache(64)
def cap_height(d: int, size: int, least: float, shared: float) -> float:
    """``alpha`` for which two unit vectors of cosine ``least`` have ``shared`` of size^2 directions in common.

    A random direction's part in the plane of the two vectors has density (1 - r^2)^((d - 4) / 2).
    """
    at = (np.arange(2_000) + 0.5) / 1_000 - 1
    x, y = np.meshgrid(at, at, indexing="ij")
    density = np.maximum(1 - x * x - y * y, 0) ** ((d - 4) / 2)
    both = np.minimum(x, least * x + np.sqrt(1 - least * least) * y).ravel()
    order = np.argsort(-both)
    share = np.cumsum(density.ravel()[order]) / density.sum()
    place = min(int(np.searchsorted(share, shared / size**2)), len(order) - 1)
    # Coarse, so that every machine finds the same.
    return float(np.floor(both[order[place]] * 1_000) / 1_000)


class ProductCode:
    """One turned product code over vectors of ``d`` components."""

    def __init__(self, d: int, size: int, number: int, alpha: float):
        rng = np.random.default_rng([SEED, d, size, number])
        turn = np.linalg.qr(rng.normal(size=(d, d)))[0]
        self.size, self.reach, self.halves = size, alpha * np.sqrt(2), []
        for part in np.array_split(turn, 2, axis=1):
            words = rng.normal(size=(size, part.shape[1]))
            words /= np.linalg.norm(words, axis=1, keepdims=True)
            self.halves.append(part @ words.T)

    def decode(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and the numbers of all directions that they reach."""
        first, second = (units @ h for h in self.halves)
        row, a = np.nonzero(first + second.max(1, keepdims=True) >= self.reach)
        rows, keys = [row[:0]], [a[:0]]
        step = max(1, (1 << 22) // self.size)
        for at in range(0, len(row), step):
            r, c = row[at : at + step], a[at : at + step]
            i, b = np.nonzero(first[r, c][:, None] + second[r] >= self.reach)
            rows.append(r[i])
            keys.append(c[i] * self.size + b)
        return np.concatenate(rows), np.concatenate(keys)


@lru_cache(16)
def _codes(d: int, size: int, alpha: float) -> list[ProductCode]:
    return [ProductCode(d, size, n, alpha) for n in range(CODES)]


def filters(units: np.ndarray, size: int, alpha: float) -> tuple[np.ndarray, np.ndarray]:
    """All filters of unit vectors: their numbers, sorted in each row, and how many a row has."""
    if units.shape[1] < DIM:
        units = np.pad(units, ((0, 0), (0, DIM - units.shape[1])))
    rows, keys = [], []
    for n, code in enumerate(_codes(units.shape[1], size, alpha)):
        row, key = code.decode(units)
        rows.append(row)
        keys.append(n * size * size + key)
    row, key = np.concatenate(rows), np.concatenate(keys)
    order = np.lexsort((key, row))
    return key[order], np.bincount(row, minlength=len(units))


def _filters_of(size: int, alphas: dict[int, float]):
    @F.arrow_udf(T.ArrayType(T.LongType()))
    def found(v: pa.Array) -> pa.Array:
        counts, keys = np.zeros(len(v), np.int64), np.empty(len(v), object)
        lengths = v.value_lengths().to_numpy()
        for d in np.unique(lengths).tolist():
            at = np.flatnonzero(lengths == d)
            for rows in np.array_split(at, -(-len(at) // 512)):
                flat, n = filters(_units(v.take(pa.array(rows))), size, alphas[d])
                counts[rows] = n
                for row, part in zip(rows, np.split(flat, np.cumsum(n)[:-1]), strict=True):
                    keys[row] = part
        return list_array(np.concatenate([np.empty(0, np.int64), *keys]), counts)

    return found


def _units(v: pa.Array) -> np.ndarray:
    """Unit vectors. Dividing by the largest component first keeps squares in range."""
    flat = v.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    m = flat.reshape(len(v), -1)
    m = m / np.abs(m).max(1, keepdims=True)
    return m / np.sqrt((m * m).sum(1, keepdims=True))


#: Vectors of a filter up to which runs are compared by lags.
FEW = 8


class _Run:
    """Rows of filters, in order: class, copies, block, vector and all filters that it shares with others.
    ``cross``: only rows of different blocks are to be compared."""

    def __init__(self, batch: pa.RecordBatch):
        column = lambda name: batch.column(name).to_numpy(zero_copy_only=False)
        self.f, self.cid, self.n = (column(c) for c in ("f", "cid", "n"))
        self.mine, self.cross = column("mine"), column("cross")
        self.v = batch.column("v")
        shared = batch.column("shared")
        self.flat = shared.flatten().to_numpy(zero_copy_only=False)
        self.at = np.concatenate([[0], np.cumsum(shared.value_lengths().to_numpy())])

    def first_common(self, i: int, j: int) -> int:
        a, b = self.flat[self.at[i] : self.at[i + 1]], self.flat[self.at[j] : self.at[j + 1]]
        return int(np.intersect1d(a, b, assume_unique=True)[0])


def _compare(run: _Run, begin: int, end: int, least: float, out: list) -> None:
    """Links among the rows of one filter, or between two blocks of it."""
    rows = np.arange(begin, end)
    units = _units(run.v.slice(begin, end - begin))
    linked = units @ units.T >= least
    np.fill_diagonal(linked, False)
    if run.cross[begin]:
        linked &= run.mine[rows, None] != run.mine[None, rows]
    if not linked.any():
        return
    _forest(run.cid[rows], linked, out)
    # Pairs that have met in a smaller filter count there.
    f = run.f[begin]
    row = np.repeat(np.arange(len(rows)), np.diff(run.at[begin : end + 1]))
    key = run.flat[run.at[begin] : run.at[end]]
    held = key < f
    row, key = row[held], key[held]
    order = np.argsort(key, kind="stable")
    row, key = row[order], key[order]
    edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else []
    for together in np.split(row, edge[1:]) if len(key) else []:
        if len(together) == len(rows):
            return
        if len(together) > 1:
            linked[np.ix_(together, together)] = False
    links = linked @ run.n[rows]
    some = links > 0
    out.append((run.cid[rows][some], np.full(int(some.sum()), -1), links[some]))


def _forest(cid: np.ndarray, linked: np.ndarray, out: list) -> None:
    """Links that connect all linked rows: each row to the one that a search reached it from."""
    rest = linked.any(0)
    while rest.any():
        frontier = [int(np.flatnonzero(rest)[0])]
        rest[frontier[0]] = False
        while frontier:
            at = frontier.pop()
            near = np.flatnonzero(linked[at] & rest)
            rest[near] = False
            frontier += near.tolist()
            out.append((cid[near], np.full(len(near), cid[at]), np.zeros(len(near), np.int64)))


def _compare_small(run: _Run, group: np.ndarray, least: float, out: list) -> None:
    """All pairs of filters with few rows, by their distance in the order. ``group``: the row's, or -1."""
    lengths = run.v.value_lengths().to_numpy()
    for d in np.unique(lengths[group >= 0]).tolist():
        at = np.flatnonzero((group >= 0) & (lengths == d))
        units = _units(run.v.take(pa.array(at)))
        g = group[at]
        for lag in range(1, min(FEW, len(at))):
            same = np.flatnonzero(g[lag:] == g[:-lag])
            close = (units[same] * units[same + lag]).sum(1) >= least
            for i, j in zip(at[same[close]].tolist(), at[same[close] + lag].tolist(), strict=True):
                if run.first_common(i, j) != run.f[i]:
                    continue
                a, b = run.cid[i], run.cid[j]
                out.append(
                    (
                        np.array([a, b, max(a, b)]),
                        np.array([-1, -1, min(a, b)]),
                        np.array([run.n[j], run.n[i], 0]),
                    )
                )


LINKS = "a bigint, b bigint, n bigint"


def _edges(rows: pa.Table | pa.RecordBatch) -> np.ndarray:
    """Where the rows of another filter or pair of blocks begin."""
    g, f = rows.column("g").to_numpy(), rows.column("f").to_numpy()
    return np.flatnonzero(np.concatenate([[True], (g[1:] != g[:-1]) | (f[1:] != f[:-1])]))


def _links(least: float):
    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """From rows in order of filter and blocks: numbers of links (b is -1), and connecting links."""
        rest = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = pa.concat_tables([rest, rows]) if rest is not None else rows
            if rows.num_rows == 0:
                continue
            cut = int(_edges(rows)[-1])
            if cut:
                yield from _linked(rows.slice(0, cut), least)
            rest = rows.slice(cut)
        if rest is not None and rest.num_rows:
            yield from _linked(rest, least)

    return links


def _linked(table_: pa.Table, least: float) -> Iterator[pa.RecordBatch]:
    rows = table_.combine_chunks().to_batches()[0]
    run, out = _Run(rows), []
    edge = _edges(rows)
    size = np.diff(np.append(edge, rows.num_rows))
    alone = (size <= FEW) & (run.cross[edge] == 0)
    _compare_small(run, np.repeat(np.where(alone, np.arange(len(size)), -1), size), least, out)
    for at, n in zip(edge[~alone].tolist(), size[~alone].tolist(), strict=True):
        _compare(run, at, at + n, least, out)
    if out:
        columns = [np.concatenate(c).astype(np.int64) for c in zip(*out, strict=True)]
        yield pa.record_batch(columns, names=["a", "b", "n"])


def link_classes(classes: DataFrame, least: float = LEAST, block: int = BLOCK) -> DataFrame:
    """``classes`` (written: cid, label, v, n) to a, b, n: class ``a`` has ``n`` linked vectors in other
    classes (b is -1; several rows are to be added), or ``a`` is linked with ``b``."""
    size = code_size(classes.count())
    dims = [r[0] for r in classes.select(F.size("v")).distinct().collect()]
    alphas = {d: cap_height(max(d, DIM), size, least, SHARED) for d in dims}
    keyed = settle(
        classes.select(
            "cid", "label", F.size("v").alias("d"), _filters_of(size, alphas)("v").alias("fs")
        ),
        "cap-filters",
    )
    each = keyed.select("cid", "label", "d", F.explode("fs").alias("f"))
    sizes = (
        each.groupBy("label", "d", "f")
        .agg(F.count("*").alias("rows"))
        .where("rows > 1")
        .select("label", "d", "f", F.ceil(F.col("rows") / block).cast("int").alias("blocks"))
    )
    shared = (
        each.join(sizes, ["label", "d", "f"])
        .groupBy("cid")
        .agg(F.sort_array(F.collect_list(F.struct("f", "blocks"))).alias("held"))
    )
    rows = (
        classes.join(shared, "cid")
        .withColumn("own", F.pmod(F.xxhash64("cid"), F.lit(1 << 30)))
        .select("*", F.col("held.f").alias("shared"), F.explode("held").alias("at"))
        .select(
            *("label", "cid", "n", "v", "shared"),
            F.size("v").alias("d"),
            F.col("at.f").alias("f"),
            (F.col("own") % F.col("at.blocks")).cast("int").alias("mine"),
            F.explode(F.sequence(F.lit(0), F.col("at.blocks") - 1)).alias("other"),
        )
        # Every two blocks meet once.
        .withColumn("low", F.least("mine", "other"))
        .withColumn("high", F.greatest("mine", "other"))
    )
    keys = ["label", "d", "f", "low", "high"]
    cross = (F.col("low") < F.col("high")).cast("int").alias("cross")
    return (
        rows.repartition(*keys)
        .sortWithinPartitions(*keys)
        .select(F.xxhash64(*keys).alias("g"), "f", "cid", "n", "mine", cross, "v", "shared")
        .mapInArrow(_links(least), LINKS)
    )


def usable(vectors: DataFrame, vec_id: str, embedding: str, label: str) -> DataFrame:
    """vec_id, label, v (null if the vector links with nothing), h (two hashes of label and v)."""
    kind = vectors.schema[embedding].dataType
    single = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType)
    number = "float" if single else "double"
    # Adding zero makes -0.0 the same as 0.0.
    v = F.transform(
        F.col(embedding).cast(f"array<{number}>"), lambda x: x + F.lit(0).cast(number)
    )
    fine = F.forall(
        "v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    ) & F.exists("v", lambda x: x != 0)
    rows = vectors.select(
        F.col(vec_id).cast("long").alias("vec_id"), F.col(label).alias("label"), v.alias("v")
    ).withColumn("v", F.when(F.col("label").isNotNull() & fine, F.col("v")))
    h = F.struct(F.xxhash64("label", "v").alias("x"), F.xxhash64(F.lit(1), "v", "label").alias("y"))
    return rows.withColumn("h", F.when(F.col("v").isNotNull(), h))


def near_vectors(
    vectors: DataFrame,
    least: float = LEAST,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    label: str = "label",
    block: int = BLOCK,
) -> DataFrame:
    """One row per row of ``vectors``: vec_id, n_links (other vectors linked directly) and component_id."""
    rows = usable(vectors, vec_id, embedding, label)
    classes = settle(
        rows.where(F.col("v").isNotNull())
        .groupBy("label", "v", "h")
        .agg(F.count("*").alias("n"), F.min("vec_id").alias("smallest"))
        .withColumn("cid", F.monotonically_increasing_id()),
        "vector-classes",
    )
    links = settle(link_classes(classes, least, block), "cap-links")
    counts = links.where("b < 0").groupBy(F.col("a").alias("cid")).agg(F.sum("n").alias("others"))
    roots = components(links.where("b >= 0").select("a", "b"))
    named = roots.join(classes.select(F.col("cid").alias("node"), "smallest"), "node")
    by_root = named.groupBy("root").agg(F.min("smallest").alias("component"))
    component = roots.join(by_root, "root").select(F.col("node").alias("cid"), "component")
    found = settle(
        classes.select("cid", "h", "n", "smallest")
        .join(counts, "cid", "left")
        .join(component.withColumn("linked", F.lit(True)), "cid", "left")
        .where("linked or n > 1")
        .select(
            "h",
            (F.coalesce("others", F.lit(0)) + F.col("n") - 1).alias("n_links"),
            F.when(F.col("linked"), F.col("component")).otherwise(F.col("smallest")).alias("component_id"),
            F.lit(True).alias("found"),
        ),
        "linked-classes",
    )
    return lookup_join(rows.select("vec_id", "h"), found, ["h"], F.col("vec_id"), "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        F.when(F.col("found"), F.col("component_id")).otherwise(F.col("vec_id")).alias("component_id"),
    )


def op11_cap_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False))
    return near_vectors(table(spark, sf_dir, "embeddings")).withColumn("kept", kept)


OP11_SQL = """
with recursive v as materialized (
  select row_number() over () as r, vec_id, label, cast(embedding as double[]) as e,
    label is not null and len(embedding) > 0
      and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = len(embedding)
      and len(list_filter(embedding, lambda x: x <> 0)) > 0 as fine
  from embeddings
), f as materialized (
  select r, vec_id, label, len(e) as d, e, sqrt(list_inner_product(e, e)) as norm from v where fine
), link as materialized (
  select a.r as a, b.r as b
  from f a join f b on a.label = b.label and a.d = b.d and a.r <> b.r
  where list_inner_product(a.e, b.e) / (a.norm * b.norm) >= 0.93
), reach as (
  select r as a, r as b from v
  union
  select reach.a, link.b from reach join link on reach.b = link.a
)
select v.vec_id, coalesce(n, 0) as n_links, m.component_id,
  coalesce(v.vec_id = m.component_id, false) as kept
from v
join (select a, min(vec_id) as component_id from reach join v on reach.b = v.r group by a) m on m.a = v.r
left join (select a, count(*) as n from link group by a) l on l.a = v.r
"""
