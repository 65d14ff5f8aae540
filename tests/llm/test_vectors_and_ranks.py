"""Spherical-cap filters, bisector tournaments and shared-term ranking against plain loops."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from keyferry.llm import caps, centroids, lexical
from keyferry.llm.queries import QUERIES

# Spherical-cap filters


def plain_links(rows, least=0.93):
    """Number of links and component of each row (id, vector, label)."""
    n, root = [0] * len(rows), list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, (_, u, x) in enumerate(rows):
        for j, (_, v, y) in enumerate(rows[:i]):
            if x is None or x != y or len(u) != len(v):
                continue
            if np.dot(u, v) / math.sqrt(np.dot(u, u) * np.dot(v, v)) >= least:
                n[i] += 1
                n[j] += 1
                root[max(find(i), find(j))] = min(find(i), find(j))
    members = {}
    for i in range(len(rows)):
        members.setdefault(find(i), []).append(rows[i][0])
    least_id = {r: min((m for m in ids if m is not None), default=None) for r, ids in members.items()}
    return sorted(
        [(rows[i][0], n[i], least_id[find(i)]) for i in range(len(rows))], key=repr
    )


def near(rng, centre, angle):
    """A vector at an angle (degrees) from the centre."""
    side = rng.normal(size=len(centre))
    centre = centre / np.linalg.norm(centre)
    side -= side @ centre * centre
    side /= np.linalg.norm(side)
    a = math.radians(angle)
    return (math.cos(a) * centre + math.sin(a) * side) * rng.uniform(0.5, 3)


def grouped_vectors(rng, d=64):
    rows, at = [], 0
    for size in (1, 2, 3, 8, 9, 40, 130):
        centre = rng.normal(size=d)
        for _ in range(size):
            rows.append((at, near(rng, centre, rng.uniform(0, 6)).tolist(), at % 2))
            at += 1
    rows += [(at + i, rows[100 - i % 7][1], rows[100 - i % 7][2]) for i in range(30)]
    return rows


def found(spark, rows, **kw):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    return sorted([tuple(r) for r in caps.near_vectors(df, **kw).collect()], key=repr)


@pytest.mark.parametrize("block", [2_000, 12])
def test_groups_and_copies_are_linked(spark, block):
    rows = grouped_vectors(np.random.default_rng(4))
    assert found(spark, rows, block=block) == plain_links(rows)


def test_lengths_labels_and_missing_ids(spark):
    rng = np.random.default_rng(5)
    c3, c5 = rng.normal(size=3), rng.normal(size=5)
    rows = [(i, near(rng, c3, 3).tolist(), 1) for i in range(6)]
    rows += [(i + 6, near(rng, c5, 3).tolist(), i % 3 or None) for i in range(9)]
    rows += [(None, rows[0][1], 1), (None, near(rng, c5, 80).tolist(), 7), (3, rows[6][1], 2)]
    assert found(spark, rows) == plain_links(rows)


@pytest.mark.parametrize("d", [8, 64, 256])
def test_filters_meet_at_the_threshold(d):
    """Pairs at exactly the threshold's angle: the hardest ones."""
    rng = np.random.default_rng(d)
    for size in (64, 256):
        u = rng.normal(size=(1500, d))
        u /= np.linalg.norm(u, axis=1, keepdims=True)
        v = np.array([near(rng, x, math.degrees(math.acos(0.93))) for x in u])
        v /= np.linalg.norm(v, axis=1, keepdims=True)
        alpha = caps.cap_height(d, size, 0.93, caps.SHARED)
        a, b = caps.filters(u, size, alpha), caps.filters(v, size, alpha)
        keys = [set(p.tolist()) for p in np.split(a[0], np.cumsum(a[1])[:-1])]
        other = [set(p.tolist()) for p in np.split(b[0], np.cumsum(b[1])[:-1])]
        together = np.mean([bool(x & y) for x, y in zip(keys, other, strict=True)])
        assert together >= 0.99, (d, size, together)


def test_list_decoding_finds_all_directions():
    rng = np.random.default_rng(6)
    u = rng.normal(size=(40, 16))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    code = caps.ProductCode(16, 64, 3, 0.5)
    first, second = (u @ h for h in code.halves)
    every = (first[:, :, None] + second[:, None, :]) / math.sqrt(2)
    row, key = code.decode(u)
    assert sorted(zip(row.tolist(), key.tolist(), strict=True)) == [
        (r, a * 64 + b) for r, a, b in np.argwhere(every >= 0.5).tolist()
    ]
    lengths = [np.linalg.norm(h, axis=0) for h in code.halves]
    assert all(np.allclose(x, 1) for x in lengths)


# Bisector tournament


def plain_nearest(vectors, points):
    return [
        min(range(len(points)), key=lambda c: (sum((x - y) ** 2 for x, y in zip(v, points[c], strict=True)), c))
        for v in vectors
    ]


@given(
    st.integers(1, 9).flatmap(
        lambda d: st.tuples(
            st.lists(st.lists(st.integers(-3, 3), min_size=d, max_size=d), min_size=1, max_size=12),
            st.lists(st.lists(st.integers(-3, 3), min_size=d, max_size=d), min_size=1, max_size=20),
        )
    ),
    st.sampled_from([1, 1 << 20, 1 << 40, 1 << 200]),
)
@settings(max_examples=200, deadline=None)
def test_tournament_finds_the_nearest(case, scale):
    points, vectors = ([[x * scale for x in row] for row in part] for part in case)
    bisectors = centroids.Bisectors(points)
    assert bisectors.fast == (max(abs(x) for c in points for x in c) <= centroids.FAST)
    if bisectors.fast and max(abs(x) for v in vectors for x in v) > centroids.FAST:
        bisectors = centroids.Bisectors(points, exact=True)
    v = np.array(vectors, float if bisectors.fast else object)
    won = bisectors.nearest(v)
    assert won.tolist() == plain_nearest(vectors, points)
    want = [sum((x - y) ** 2 for x, y in zip(v, points[c], strict=True)) for v, c in zip(vectors, won, strict=True)]
    assert [int(x) for x in bisectors.distances(v, won)] == want


def plain_clusters(rows, k, rounds=5):
    whole = [(i, [math.floor(256 * x) for x in v]) for i, v in rows]
    named = [(hashlib.sha256(f"2:{i}".encode()).hexdigest(), v) for i, v in whole if i is not None]
    points = [v for _, v in sorted(named)[:k]]
    for _ in range(rounds):
        won = plain_nearest([v for _, v in whole], points)
        for c in range(len(points)):
            mine = [v for (_, v), w in zip(whole, won, strict=True) if w == c]
            if mine:
                points[c] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    won = plain_nearest([v for _, v in whole], points)
    far = [sum((x - y) ** 2 for x, y in zip(v, points[c], strict=True)) for (_, v), c in zip(whole, won, strict=True)]
    return [(i, c, d) for (i, _), c, d in zip(whole, won, far, strict=True)], points


@pytest.mark.parametrize("size", [1.0, 1e9])
def test_clusters_equal_a_plain_loop(spark, size):
    rng = np.random.default_rng(7)
    rows = [(i, (rng.normal(size=5) * size).tolist()) for i in range(60)]
    rows += [(None, rows[3][1]), (7, rows[9][1]), (8, rows[8][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got, points = centroids.cluster(df, k=7, dim=5)
    want, means = plain_clusters(rows, 7)
    fits = [(i, c, d if d < 1 << 63 else None) for i, c, d in want]
    assert sorted([tuple(r) for r in got.collect()], key=repr) == sorted(fits, key=repr)
    assert points == means
    sums = {r["cluster"]: (r["cluster_inertia"], r["inertia"]) for r in centroids.inertias(got).collect()}
    for c in sums:
        held = [d for _, own, d in fits if own == c]
        assert sums[c][0] == (sum(held) if None not in held and sum(held) < 1 << 63 else None)
    every = [d for _, _, d in fits]
    total = sum(every) if None not in every and sum(every) < 1 << 63 else None
    assert {t for _, t in sums.values()} == {total}


def test_fewer_vectors_than_centroids_and_other_lengths(spark):
    rows = [(1, [0.5] * 64), (2, [1.0] * 64), (3, [1.0] * 63), (4, [math.nan] * 64), (5, [None] * 64), (6, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got, points = centroids.cluster(df)
    assert len(points) == 2 and {(r["vec_id"], r["distance"]) for r in got.collect()} == {(1, 0), (2, 0)}


# Shared terms


@given(st.lists(st.lists(st.integers(0, 12), max_size=9, unique=True), max_size=12), st.sampled_from([2, 5, 256]))
@settings(max_examples=200, deadline=None)
def test_shared_sets_add_up_to_the_rows(rows, band):
    left, right, roots = lexical.mine_shared(rows, 13, band)
    held = [{s} for s in range(13)]
    for a, b in zip(left, right, strict=True):
        assert not held[a] & held[b]
        held.append(held[a] | held[b])
    for row, parts in zip(rows, roots, strict=True):
        assert sorted(s for p in parts for s in held[p]) == sorted(row)
    assert len(left) + sum(map(len, roots)) <= sum(map(len, rows))


def test_frequent_sets_are_computed_once():
    rows = [[0, 1, 2, 3, 10 + i] for i in range(6)]
    left, _, roots = lexical.mine_shared(rows, 20)
    assert len(left) == 3 and all(len(parts) == 2 for parts in roots)


def plain_ranks(docs, items, k=20):
    terms = lambda t: lexical.TERM_BYTES.findall((t or "").encode().translate(lexical.LOWER))
    counted = [(i, Counter(terms(t))) for i, t in docs]
    counted = [(i, c, sum(c.values())) for i, c in counted if c]
    total, words = len(counted), sum(n for _, _, n in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    asked = {}
    for item, text in items:
        if item is not None:
            asked.setdefault(item, Counter()).update(terms(text))
    out = []
    for item, query in asked.items():
        scores = []
        for i, c, n in counted:
            m = 75 + (25 * n * total) // words
            score = sum(
                q * math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1)))
                * ((1_000_000_000 * c[t]) // (1000 * c[t] + 12 * m))
                for t, q in query.items() if t in c
            )
            if score > 0 and i is not None:
                scores.append((-score, i))
        out += [(item, r, i, -s) for r, (s, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("block_terms", [50_000, 40])
def test_ranks_equal_a_plain_loop(spark, monkeypatch, block_terms):
    monkeypatch.setattr(lexical, "MATRIX", 1)
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(60)] + ["Ärger", "naïve", "漢字", "ÉCLAIR", "X1"]
    say = lambda n: " ".join(rng.choice(vocabulary[: rng.randint(2, 65)]) for _ in range(n))
    docs = [(i, say(rng.randint(0, 30))) for i in range(150)]
    docs += [(i, docs[i][1].upper()) for i in range(10)] + [(None, say(9)), (200, None), (201, "-- !")]
    docs += [(202, "w1 " * 5000)]
    items = [(i, say(rng.randint(1, 12)) + " the common part w1 w2 w3") for i in range(12)]
    items += [(3, "w7 w7"), (None, "w1"), (50, None), (51, ""), (52, "unheard")]
    got = lexical.rank_documents(
        spark.createDataFrame(docs, "doc_id long, text string").repartition(5),
        spark.createDataFrame(items, "item_id long, text string"),
        block_terms=block_terms,
    )
    assert sorted(tuple(r) for r in got.collect()) == plain_ranks(docs, items)


def test_ties_go_by_id(spark):
    texts = [(i, "same words here" if i < 50 else "another thing") for i in range(130)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    items = spark.createDataFrame([(1, "words")], "item_id long, text string")
    got = lexical.rank_documents(docs.sort(F.rand(1)), items).sort("rank").collect()
    assert [(r["rank"], r["doc_id"]) for r in got] == [(i + 1, i) for i in range(20)]


def test_sharing_saves_additions(spark, data):
    plan = lexical.sharing_plans(spark.read.parquet(f"{data}/benchmark.parquet")).first()
    sharing = lexical.Sharing(plan)
    assert sharing.additions < sharing.plain


def test_registered_queries(spark, data):
    rows = spark.read.parquet(f"{data}/embeddings.parquet").count()
    for name in ("op11_cap_filters", "op12_bisector_tournament"):
        assert QUERIES[name](spark, data).count() == rows
