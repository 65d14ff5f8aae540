"""Approximate nearest neighbours by learned partitions.

A sample's neighbour graph (largest inner products) is cut into partitions of nearly equal size: halving along
the main axis gives a start, then vectors move to the partition where most of their neighbours are,
while there is room. A small network learns from a vector which partitions hold it and its neighbours.
It puts every row of the table into its most probable partition, and sends a query to the most probable ones
until their probabilities reach a bound (at least ``PROBES``). The bound is set on a tenth of the sample that
the network didn't learn from: the least one that finds ``RECALL`` of their neighbours in the sample. All
candidates in those partitions are compared in double precision.

The fit reads a sample of about ``SAMPLE`` vectors, whatever the table's size; every row is indexed. The
number of partitions follows the root of the number of rows (one per ``ROOT``, at most ``MAX_PARTS``), so that
a query's partial results grow slower than the table. A partition is searched in blocks of about
``BLOCK`` rows and ``BLOCK`` queries, so one that holds very many copies is spread over many tasks, and each block
gives a query's best only.

Rows: vectors that are null, zero, or hold null or non-finite components, and rows without id, take no
part; neither do vectors of another length than most (the shorter on a tie). Rows that repeat an id
count as one, with the least vector. Equal scores go to the smaller id. Fewer than ``k`` candidates in
the partitions asked: the query is sent to all. Other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as Win
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyferry.llm.common import table
from keyferry.scratch import settle

K = 20
SAMPLE = 8_000
ROOT = 14
MAX_PARTS = 256
GRAPH = 16
HIDDEN = 128
EPOCHS = 15
RECALL = 0.95
PROBES = 3
BLOCK = 4_096
SEED = 11


def neighbour_graph(vectors: np.ndarray, k: int = GRAPH) -> np.ndarray:
    """Each vector's ``k`` largest inner products among the others."""
    k = min(k, len(vectors) - 1)
    out = np.empty((len(vectors), k), np.int64)
    for at in range(0, len(vectors), 1024):
        score = vectors[at : at + 1024] @ vectors.T
        score[np.arange(len(score)), at + np.arange(len(score))] = -np.inf
        out[at : at + 1024] = np.argpartition(-score, k - 1, axis=1)[:, :k]
    return out


def _halve(vectors: np.ndarray, rows: np.ndarray, parts: int, first: int, out: np.ndarray) -> None:
    if parts == 1:
        out[rows] = first
        return
    centred = vectors[rows] - vectors[rows].mean(0)
    axis = np.linalg.eigh(centred.T @ centred)[1][:, -1]
    order = rows[np.argsort(centred @ axis, kind="stable")]
    left = parts // 2
    cut = len(rows) * left // parts
    _halve(vectors, order[:cut], left, first, out)
    _halve(vectors, order[cut:], parts - left, first + left, out)


def balanced_partition(
    vectors: np.ndarray, graph: np.ndarray, parts: int, rounds: int = 12, slack: float = 0.08
) -> np.ndarray:
    """A partition number for each vector; no partition gets more than its share and ``slack``."""
    part = np.zeros(len(vectors), np.int64)
    _halve(vectors, np.arange(len(vectors)), parts, 0, part)
    room = int(np.ceil(len(vectors) / parts * (1 + slack)))
    # Links count both ways.
    a = np.concatenate([np.repeat(np.arange(len(graph)), graph.shape[1]), graph.ravel()])
    b = np.concatenate([graph.ravel(), np.repeat(np.arange(len(graph)), graph.shape[1])])
    for _ in range(rounds):
        links = np.bincount(a * parts + part[b], minlength=len(part) * parts).reshape(-1, parts)
        gain = links - links[np.arange(len(part)), part][:, None]
        best = gain.argmax(1)
        size = np.bincount(part, minlength=parts)
        moved = 0
        for i in np.argsort(-gain.max(1), kind="stable"):
            if gain[i, best[i]] <= 0:
                break
            if size[best[i]] < room:
                size[part[i]] -= 1
                size[best[i]] += 1
                part[i] = best[i]
                moved += 1
        if moved < len(part) // 500:
            break
    return part


class Router:
    """A network of one hidden layer from a vector to partition probabilities."""

    def __init__(self, sample: np.ndarray, parts: int, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.parts, self.scale = parts, float(np.sqrt((sample**2).sum(1).mean())) or 1.0
        every = (sample / self.scale).astype(np.float32)
        tests = np.arange(len(every)) % 10 == 0 if len(every) >= 20 else np.zeros(len(every), bool)
        x = every[~tests]
        graph = neighbour_graph(x)
        part = balanced_partition(x.astype(np.float64), graph, parts)
        target = np.zeros((len(x), parts), np.float32)
        np.add.at(target, (np.repeat(np.arange(len(x)), graph.shape[1]), part[graph.ravel()]), 1)
        target /= max(graph.shape[1], 1)
        target[np.arange(len(x)), part] += 1
        target /= target.sum(1, keepdims=True)
        d = x.shape[1]
        self.p = [
            rng.normal(0, np.sqrt(2 / d), (d, HIDDEN)).astype(np.float32),
            np.zeros(HIDDEN, np.float32),
            rng.normal(0, np.sqrt(1 / HIDDEN), (HIDDEN, parts)).astype(np.float32),
            np.zeros(parts, np.float32),
        ]
        self._train(x, target, rng)
        self.reach = self._bound(every[tests], x) if tests.any() else 1.0

    def _bound(self, queries: np.ndarray, others: np.ndarray) -> float:
        """The least bound with which the queries reach ``RECALL`` of their nearest others."""
        k = min(5, len(others))
        near = np.argpartition(-(queries @ others.T), k - 1, axis=1)[:, :k]
        home = self.probabilities(others * self.scale).argmax(1)[near]
        p = self.probabilities(queries * self.scale)
        order = np.argsort(-p, axis=1, kind="stable")
        before = np.cumsum(np.take_along_axis(p, order, 1), 1) - np.take_along_axis(p, order, 1)
        place = np.argsort(order, axis=1)
        # A neighbour is found if less than the bound lies before its partition.
        needed = np.where(
            np.take_along_axis(place, home, 1) < PROBES,
            0.0,
            np.take_along_axis(before, np.take_along_axis(place, home, 1), 1),
        )
        return float(np.quantile(needed, RECALL, method="higher")) + 1e-6

    def _train(self, x: np.ndarray, target: np.ndarray, rng: np.random.Generator) -> None:
        m, v, step = [np.zeros_like(w) for w in self.p], [np.zeros_like(w) for w in self.p], 0
        for epoch in range(EPOCHS):
            rate = 4e-3 * (1 - epoch / EPOCHS) + 1e-4
            order = rng.permutation(len(x))
            for at in range(0, len(order), 128):
                pick = order[at : at + 128]
                hidden = np.maximum(x[pick] @ self.p[0] + self.p[1], 0)
                dz = (_softmax(hidden @ self.p[2] + self.p[3]) - target[pick]) / len(pick)
                dh = (dz @ self.p[2].T) * (hidden > 0)
                step += 1
                for w, g in enumerate([x[pick].T @ dh, dh.sum(0), hidden.T @ dz, dz.sum(0)]):
                    m[w] = 0.9 * m[w] + 0.1 * g
                    v[w] = 0.999 * v[w] + 0.001 * g * g
                    self.p[w] -= rate * (m[w] / (1 - 0.9**step)) / (
                        np.sqrt(v[w] / (1 - 0.999**step)) + 1e-8
                    )

    def probabilities(self, vectors: np.ndarray) -> np.ndarray:
        x = (vectors / self.scale).astype(np.float32)
        hidden = np.maximum(x @ self.p[0] + self.p[1], 0)
        return _softmax(hidden @ self.p[2] + self.p[3])


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(1, keepdims=True))
    return z / z.sum(1, keepdims=True)


def _matrix(lists: pa.Array, kind=np.float64) -> np.ndarray:
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(kind)
    return flat.reshape(len(lists), -1) if len(lists) else flat.reshape(0, 0)


def usable(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id, v (array of doubles): the rows that take part."""
    v = F.col(embedding).cast("array<double>")
    fine = F.forall(
        "v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    ) & F.exists("v", lambda x: x != 0)
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("v")).where(
        F.col("vec_id").isNotNull() & F.col("v").isNotNull() & F.coalesce(fine, F.lit(False))
    )
    sizes = rows.groupBy(F.size("v").alias("d")).count().sort(F.desc("count"), "d").first()
    if sizes is None:
        return rows
    rows = rows.where(F.size("v") == sizes["d"])
    ids = rows.groupBy("vec_id").count()
    if ids.where("count > 1").limit(1).count():
        rows = rows.groupBy("vec_id").agg(F.min("v").alias("v"))
    return rows


def fit(rows: DataFrame, sample: int = SAMPLE) -> tuple[Router | None, int]:
    """The router, and how many rows there are. ``rows`` is a written table: counting reads footers."""
    n = rows.count()
    if n == 0:
        return None, 0
    share = int(min(1.0, sample / n) * (1 << 30))
    drawn = rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) < share).sort("vec_id")
    vectors = _matrix(drawn.select("v").toArrow().column(0))
    if len(vectors) < 2:
        vectors = _matrix(rows.sort("vec_id").limit(2).select("v").toArrow().column(0))
    parts = int(np.clip(n**0.5 // ROOT, 1, min(MAX_PARTS, max(len(vectors) // 16, 1))))
    return Router(vectors, parts), n


def _route(shared, queries: bool):
    """A column function: vector to its partitions, most probable first."""

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def route(v: pa.Array) -> pa.Array:
        router = shared.value
        p = router.probabilities(_matrix(v)) if len(v) else np.empty((0, 1))
        order = np.argsort(-p, axis=1, kind="stable")
        if not queries:
            return pa.array(order[:, :1].astype(np.int32).tolist(), pa.list_(pa.int32()))
        ranked = np.take_along_axis(p, order, 1)
        asked = np.maximum((np.cumsum(ranked, 1) - ranked < router.reach).sum(1), PROBES)
        return pa.array(
            [o[:n].tolist() for o, n in zip(order.astype(np.int32), asked, strict=True)],
            pa.list_(pa.int32()),
        )

    return route


RESULT = "query_id bigint, vec_id bigint, score double"


def _best_in_block(k: int):
    def best(queries: pa.Table, items: pa.Table) -> pa.Table:
        q_ids, v_ids = (t.column("vec_id").to_numpy() for t in (queries, items))
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if len(q_ids) and len(v_ids):
            order = np.argsort(v_ids, kind="stable")
            v_ids, v = v_ids[order], _matrix(items.column("v"))[order]
            q = _matrix(queries.column("v"))
            for at in range(0, len(q), 256):
                rough = q[at : at + 256] @ v.T
                rough[q_ids[at : at + 256, None] == v_ids[None, :]] = -np.inf
                for i, row in enumerate(rough):
                    if len(row) > k:
                        least = np.partition(row, len(row) - k)[len(row) - k]
                        # Rounding of the rough scores must not decide; equal vectors score equally below.
                        slack = 1e-9 * (1.0 + np.abs(row[np.isfinite(row)]).max(initial=0.0))
                        near = np.flatnonzero(row >= least - slack)
                    else:
                        near = np.arange(len(row))
                    near = near[np.isfinite(row[near])]
                    exact = (v[near] * q[at + i]).sum(1)
                    top = np.argsort(-exact, kind="stable")[:k]
                    out.append((np.full(len(top), q_ids[at + i]), v_ids[near[top]], exact[top]))
        if not out:
            out = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
        columns = [np.concatenate(c) for c in zip(*out, strict=True)]
        return pa.table(dict(zip(("query_id", "vec_id", "score"), columns, strict=True)))

    return best


def _search(items: DataFrame, asked: DataFrame, k: int, block: int) -> DataFrame:
    """items (vec_id, v, part), asked (vec_id, v, part): each query's best in each block."""
    counts = settle(
        items.groupBy("part").agg(F.count("*").alias("items")).join(
            asked.groupBy("part").agg(F.count("*").alias("queries")), "part"
        ),
        "part-sizes",
    )
    # At most MAX_PARTS rows.
    blocks = F.broadcast(
        counts.select(
            "part",
            F.ceil(F.col("items") / block).cast("int").alias("i_blocks"),
            F.ceil(F.col("queries") / block).cast("int").alias("q_blocks"),
        )
    )
    mine = lambda n: F.pmod(F.xxhash64("vec_id"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = (
        asked.join(blocks, "part")
        .withColumn("qb", mine("q_blocks"))
        .withColumn("ib", each("i_blocks"))
        .select("part", "ib", "qb", "vec_id", "v")
    )
    right = (
        items.join(blocks, "part")
        .withColumn("ib", mine("i_blocks"))
        .withColumn("qb", each("q_blocks"))
        .select("part", "ib", "qb", "vec_id", "v")
    )
    keys = ["part", "ib", "qb"]
    return left.groupBy(keys).cogroup(right.groupBy(keys)).applyInArrow(_best_in_block(k), RESULT)


def _first(found: DataFrame, k: int) -> DataFrame:
    place = Win.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(place))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def nearest(vectors: DataFrame, is_query: Column, k: int = K, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: for each row that ``is_query`` (of vec_id), its ``k`` best others."""
    spark = vectors.sparkSession
    rows = settle(usable(vectors), "vectors")
    router, n = fit(rows)
    if router is None or n < 2:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    shared = spark.sparkContext.broadcast(router)
    items = settle(
        rows.withColumn("part", F.element_at(_route(shared, False)(F.col("v")), 1)), "routed"
    )
    queries = rows.where(is_query)
    asked = queries.withColumn("part", F.explode(_route(shared, True)(F.col("v"))))
    found = _first(_search(items, asked, k, block), k)
    want = min(k, n - 1)
    found = settle(found, "found")
    short = found.groupBy("query_id").agg(F.count("*").alias("n"))
    missing = queries.join(
        short.where(F.col("n") >= want), queries.vec_id == short.query_id, "left_anti"
    )
    missing = settle(missing, "short-queries")
    if missing.isEmpty():
        return found
    everywhere = missing.withColumn(
        "part", F.explode(F.sequence(F.lit(0), F.lit(router.parts - 1)))
    )
    again = _first(_search(items, everywhere, k, block), k)
    done = missing.select(F.col("vec_id").alias("query_id"))
    return found.join(done, "query_id", "left_anti").unionByName(again)


def op6_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
