"""Centroid clustering in whole numbers by bisector tournaments.

A vector's components x become the integers floor(``SCALE`` * x). Between two centroids lies a bisector: with
the normal 2 * (c_i - c_j) and the threshold |c_i|^2 - |c_j|^2, the sign of (normal . v - threshold) tells
which one is nearer. Normals and thresholds of all pairs are computed once a round and sent to the
tasks. The centroids meet in a tournament of k - 1 such tests per vector. Zero favours the smaller
number, so the winner is the nearest centroid, and the smallest number among equally near ones. Only the
winner's distance is computed, exactly.

The first round of the tournament has the same pairs for every vector and is one matrix product; the later ones
pick each vector's normal by its two remaining centroids.

A task adds up its vectors by centroid before anything is shuffled, so a round moves k rows a task, and the
driver gets k rows a round, however many vectors there are. What is broadcast has k^2 normals. A round that changes no centroid ends the rounds: all later ones would give the same.

All numbers are exact. Whole numbers up to ``FAST`` in size are held in doubles, which hold every sum of the test
exactly; a batch or a centroid beyond that is computed in Python's integers. Sums travel in limbs of 32 bits.

Rows: a vector takes part if it has exactly ``dim`` components, none null or non-finite (also not after
scaling). Rows that repeat an id, or have none, are vectors of their own; rows without id never start a
centroid. Starts of equal hash are taken by their components. Fewer vectors than ``k``: as many centroids. A
distance or sum that no long holds is null. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyferry.llm.common import table
from keyferry.scratch import settle

K = 40
DIM = 64
ROUNDS = 5
SCALE = 256
#: Up to this size all sums of a test fit into the 53 bits of a double, for up to 64 components.
FAST = 1 << 22
ROWS = 2_048
LIMB = 32


class Bisectors:
    """All pairs' normals and thresholds, and the tournament over them. ``exact``: in Python's integers."""

    def __init__(self, centroids: list[list[int]], exact: bool = False):
        size = max(abs(x) for c in centroids for x in c)
        self.fast = not exact and size <= FAST and len(centroids[0]) <= DIM
        self.whole = centroids
        self.centroids = c = np.array(centroids, np.float64 if self.fast else object)
        square = (c * c).sum(1)
        self.normals = 2 * (c[:, None, :] - c[None, :, :])
        self.thresholds = square[:, None] - square[None, :]
        self.first = np.arange(0, len(c) - 1, 2)
        self.first_normals = self.normals[self.first, self.first + 1]
        self.first_thresholds = self.thresholds[self.first, self.first + 1]

    def nearest(self, v: np.ndarray) -> np.ndarray:
        """The number of each vector's nearest centroid."""
        if len(v) == 0:
            return np.empty(0, np.int64)
        k = len(self.centroids)
        lost = v @ self.first_normals.T < self.first_thresholds
        left = self.first[None, :] + lost.astype(np.int64)
        if k % 2:
            left = np.concatenate([left, np.full((len(v), 1), k - 1)], axis=1)
        while left.shape[1] > 1:
            # Columns stay sorted by number, so the left one of a pair is the smaller.
            last = left[:, -1:] if left.shape[1] % 2 else left[:, :0]
            kept = []
            for at in range(0, left.shape[1] - 1, 2):
                a, b = left[:, at], left[:, at + 1]
                side = (v * self.normals[a, b]).sum(1) - self.thresholds[a, b]
                kept.append(np.where(side >= 0, a, b))
            left = np.concatenate([np.stack(kept, axis=1), last], axis=1)
        return left[:, 0]

    def distances(self, v: np.ndarray, cluster: np.ndarray) -> np.ndarray:
        gap = v - self.centroids[cluster]
        return (gap * gap).sum(1)


def whole_numbers(lists: pa.Array, exact: bool = False) -> np.ndarray:
    """A matrix of floor(SCALE * x) for rows that take part: doubles that hold them exactly, or integers."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    v = np.floor(lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * SCALE)
    if exact:
        v = np.array([int(x) for x in v], object)
    return v.reshape(len(lists), -1) if len(lists) else v.reshape(0, DIM)


def _blocks(
    batches: Iterator[pa.RecordBatch], bisectors: Bisectors
) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, Bisectors]]:
    """Rows, their numbers, their nearest centroids, and the bisectors that were used."""
    exact = None
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            rows = batch.slice(at, ROWS)
            v = whole_numbers(rows.column("v"))
            used = bisectors
            if not bisectors.fast or np.abs(v).max(initial=0) > FAST:
                exact = exact or Bisectors(bisectors.whole, exact=True)
                used, v = exact, whole_numbers(rows.column("v"), exact=True)
            yield rows, v, used.nearest(v), used


SUMS = "cluster int, limb int, n bigint, s array<bigint>"


def _partial_sums(shared):
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A task's sums by centroid, in limbs."""
        shape = np.shape(shared.value.whole)
        total, count = np.zeros(shape, object), np.zeros(shape[0], np.int64)
        for _, v, cluster, used in _blocks(batches, shared.value):
            order = np.argsort(cluster, kind="stable")
            found, first = np.unique(cluster[order], return_index=True)
            part = np.add.reduceat(v[order], first, axis=0)
            total[found] += part.astype(np.int64).astype(object) if used.fast else part
            count += np.bincount(cluster, minlength=shape[0])
        rest, sign, limb = np.abs(total), np.where(total < 0, -1, 1), 0
        while limb == 0 or rest.any():
            yield pa.record_batch(
                [
                    pa.array(np.arange(shape[0]), pa.int32()),
                    pa.array(np.full(shape[0], limb), pa.int32()),
                    pa.array(count if limb == 0 else 0 * count),
                    pa.array((sign * (rest & ((1 << LIMB) - 1))).tolist(), pa.list_(pa.int64())),
                ],
                names=["cluster", "limb", "n", "s"],
            )
            rest, limb = rest >> LIMB, limb + 1

    return sums


def _assign(shared):
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, v, cluster, used in _blocks(batches, shared.value):
            distance = [int(x) if x < 1 << 63 else None for x in used.distances(v, cluster)]
            yield pa.record_batch(
                [
                    rows.column("vec_id"),
                    pa.array(cluster.astype(np.int32)),
                    pa.array(distance, pa.int64()),
                ],
                names=["vec_id", "cluster", "distance"],
            )

    return assign


def kept_vectors(
    vectors: DataFrame, dim: int = DIM, vec_id: str = "vec_id", embedding: str = "embedding"
) -> DataFrame:
    """vec_id, v (array of doubles): the vectors that take part."""
    fine = F.forall(
        "v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) * SCALE < F.lit(float("inf")))
    )
    v = F.col(embedding).cast("array<double>")
    return vectors.select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("v")).where(
        F.coalesce((F.size("v") == dim) & fine, F.lit(False))
    )


def start(rows: DataFrame, k: int = K) -> list[list[int]]:
    """The ``k`` vectors of smallest sha256 of ``2:<vec_id>``, as whole numbers."""
    first = (
        rows.where(F.col("vec_id").isNotNull())
        .select(F.sha2(F.concat(F.lit("2:"), F.col("vec_id").cast("string")), 256).alias("h"), "v")
        .sort("h", "v")
        .limit(k)
        .collect()
    )
    return [[int(np.floor(x * SCALE)) for x in r["v"]] for r in first]


def next_centroids(rows: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """Every centroid that is nearest to some vector becomes their floored mean."""
    shared = rows.sparkSession.sparkContext.broadcast(Bisectors(centroids))
    d = len(centroids[0])
    summed = (
        rows.mapInArrow(_partial_sums(shared), SUMS)
        .select("cluster", "limb", "n", F.posexplode("s").alias("place", "part"))
        .groupBy("cluster", "limb", "place")
        .agg(F.sum("n").alias("n"), F.sum("part").alias("part"))
        .collect()
    )
    shared.unpersist()
    count = [0] * len(centroids)
    total = [[0] * d for _ in centroids]
    for r in summed:
        if r["place"] == 0:
            count[r["cluster"]] += r["n"]
        total[r["cluster"]][r["place"]] += r["part"] << (LIMB * r["limb"])
    return [
        [x // n for x in sums] if n else old
        for old, n, sums in zip(centroids, count, total, strict=True)
    ]


def cluster(
    vectors: DataFrame, k: int = K, dim: int = DIM, rounds: int = ROUNDS
) -> tuple[DataFrame, list[list[int]]]:
    """vec_id, cluster, distance for every vector that takes part, and the final centroids."""
    rows = settle(kept_vectors(vectors, dim), "kept-vectors")
    centroids = start(rows, k)
    if not centroids:
        return rows.sparkSession.createDataFrame([], "vec_id long, cluster int, distance long"), []
    for _ in range(rounds):
        moved = next_centroids(rows, centroids)
        if moved == centroids:
            break
        centroids = moved
    shared = rows.sparkSession.sparkContext.broadcast(Bisectors(centroids))
    found = rows.mapInArrow(_assign(shared), "vec_id long, cluster int, distance long")
    return settle(found, "clustered"), centroids


def inertias(found: DataFrame) -> DataFrame:
    """cluster, cluster_inertia, inertia: at most k rows."""
    exact = F.sum(F.col("distance").cast("decimal(38,0)"))
    # A null distance has no long, so its sums have none.
    whole = F.when(F.count("distance") == F.count("*"), exact)
    by_cluster = found.groupBy("cluster").agg(whole.alias("d"))
    everything = found.agg(whole.alias("all"))
    return by_cluster.join(F.broadcast(everything)).select(
        "cluster",
        F.expr("try_cast(d as bigint)").alias("cluster_inertia"),
        F.expr("try_cast(all as bigint)").alias("inertia"),
    )


def op12_bisector_tournament(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, centroids = cluster(table(spark, sf_dir, "embeddings"))
    digests = spark.createDataFrame(
        [
            (i, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest())
            for i, c in enumerate(centroids)
        ],
        "cluster int, centroid_sha256 string",
    )
    # At most k rows.
    about = F.broadcast(inertias(found).join(F.broadcast(digests), "cluster"))
    return found.join(about, "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )


def _op12_sql(k: int = K, dim: int = DIM, rounds: int = ROUNDS) -> str:
    parts = [
        f"""v as materialized (
  select row_number() over () as r, vec_id,
    list_transform(embedding, lambda x: cast(floor({SCALE} * cast(x as double)) as bigint)) as e
  from embeddings
  where len(embedding) = {dim}
    and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = {dim}
), x as materialized (
  select r, unnest(range(1, {dim} + 1)) as p, unnest(e) as x from v
), s as (
  select r, row_number() over (order by sha256('2:' || vec_id), e) - 1 as c
  from v where vec_id is not null qualify c < {k}
), c0 as materialized (select s.c, x.p, x.x from s join x using (r))"""
    ]
    for i in range(rounds + 1):
        parts.append(
            f"""d{i} as materialized (
  select x.r, c.c, sum((x.x - c.x) * (x.x - c.x)) as d from x join c{i} c using (p) group by all
), a{i} as materialized (
  select r, c, d from d{i} qualify row_number() over (partition by r order by d, c) = 1
)"""
        )
        if i < rounds:
            parts.append(
                f"""m{i} as (
  select a.c, x.p, sum(x.x) as s, count(*) as n from a{i} a join x using (r) group by all
), c{i + 1} as materialized (
  select c.c, c.p, case when n is null then c.x
    else cast((s - ((s % n) + n) % n) // n as bigint) end as x
  from c{i} c left join m{i} m using (c, p)
)"""
            )
    return (
        "with "
        + ",\n".join(parts)
        + f""",
h as (select c, sha256(string_agg(cast(x as varchar), ',' order by p)) as h from c{rounds} group by c)
select v.vec_id, cast(a.c as integer) as cluster, cast(a.d as bigint) as distance,
  cast(sum(a.d) over (partition by a.c) as bigint) as cluster_inertia,
  cast(sum(a.d) over () as bigint) as inertia, h.h as centroid_sha256
from a{rounds} a join v using (r) join h using (c)
"""
    )


OP12_SQL = _op12_sql()
