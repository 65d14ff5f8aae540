"""The operators' methods against plain loops, round trips, held-out accuracy and their SQL twins."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter
from itertools import combinations, product

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
import xxhash
from conftest import DATA
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from keyferry.llm import bpe, chains, chat, langid, neighbours, quality, simhash, suffixes
from keyferry.llm import words as W
from keyferry.llm.common import utf8_buffer
from keyferry.llm.components import components
from keyferry.llm.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in ("documents", "benchmark", "labels", "embeddings", "conversations"):
        con.execute(f"create view {name} as select * from '{DATA}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, data, duck, name):
    out = QUERIES[name](spark, data)
    columns = sorted(out.columns)
    got = sorted((tuple(r) for r in out.select(*columns).collect()), key=repr)
    result = duck.execute(ORACLES[name])
    names = [c[0] for c in result.description]
    want = sorted((tuple(r[names.index(c)] for c in columns) for r in result.fetchall()), key=repr)
    assert sorted(names) == columns and got == want


# Byte-level BPE


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary(*bpe.default_vocabulary())


@pytest.fixture(scope="module")
def reference_encoding(vocabulary):
    return tiktoken.Encoding(
        "own",
        pat_str=public_tokenizers.PATTERN,
        mergeable_ranks=vocabulary.rank,
        special_tokens={},
    )


@settings(max_examples=400, deadline=None)
@given(st.text(max_size=60))
def test_bpe_equals_the_library(vocabulary, reference_encoding, text):
    text = text.encode("utf-8", "replace").decode()
    assert vocabulary.encode(text).tolist() == reference_encoding.encode_ordinary(text)


def test_bpe_of_random_pieces(vocabulary, reference_encoding):
    rng = random.Random(5)
    for _ in range(3000):
        letters = rng.choice(["ab", "aàé ", "theing", "\t \n", "漢字の", "01.,-"])
        text = "".join(rng.choice(letters) for _ in range(rng.randint(1, 80)))
        assert vocabulary.encode(text).tolist() == reference_encoding.encode_ordinary(text)


def test_op1_equals_the_library(spark, data, reference_encoding):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    for r in QUERIES["op1_byte_bpe"](spark, data).collect():
        ids = reference_encoding.encode_ordinary(texts[r["doc_id"]])
        joined = ",".join(map(str, ids)).encode()
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(joined).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


# Language


def code_length(counts, text):
    """PPM by a plain loop: counts[context tuple, oldest first][byte]."""
    bits, history = 0.0, [0] * langid.ORDER
    for byte in text:
        for order in range(langid.ORDER, -1, -1):
            seen = counts.get(tuple(history[langid.ORDER - order :]))
            if seen is None:
                continue
            total = sum(seen.values()) + len(seen)
            if byte in seen:
                bits -= math.log2(seen[byte] / total)
                break
            bits -= math.log2(len(seen) / total)
        else:
            bits += 8
        history = history[1:] + [byte]
    return bits


def test_ppm_code_lengths_are_exact():
    texts = [("en", "the cat sat on the mat"), ("de", "der hund und die katze"), ("en", "then that")]
    batch = pa.record_batch([pa.array([a for a, _ in texts]), pa.array([b for _, b in texts])], names=["l", "t"])
    counts = Counter()
    for out in langid._count_grams(iter([batch])):
        for lang, gram, n in zip(*(c.to_pylist() for c in out.columns), strict=True):
            counts[lang, gram] += n
    model = langid.Model(sorted((a, b, n) for (a, b), n in counts.items()))
    trees = {}
    for lang, text in texts:
        history = [0] * langid.ORDER
        for byte in text.encode():
            for order in range(langid.ORDER + 1):
                context = tuple(history[langid.ORDER - order :])
                trees.setdefault(lang, {}).setdefault(context, Counter())[byte] += 1
            history = history[1:] + [byte]
    for text in ("the dog", "Katze", "", "ÿ und x"):
        got = model.code_lengths(*utf8_buffer(pa.array([text])))[0]
        want = [code_length(trees[lang], text.encode()) for lang in model.langs]
        assert np.allclose(got, want, rtol=1e-5)


def test_ppm_keeps_every_context():
    """Eight scripts with far more than 16,000 contexts of three bytes; frequent and single ones count alike."""
    rng = np.random.default_rng(5)
    texts = []
    for lang, first in enumerate((0x61, 0x3B1, 0x430, 0x5D0, 0x627, 0x905, 0x10D0, 0x4E00)):
        letters = np.array([*(chr(first + i) for i in range(60)), " "])
        texts.append((f"l{lang}", "".join(rng.choice(letters, 12_000))))
    batch = pa.record_batch([pa.array([a for a, _ in texts]), pa.array([b for _, b in texts])], names=["l", "t"])
    rows = [r for out in langid._count_grams(iter([batch])) for r in zip(*(c.to_pylist() for c in out.columns), strict=True)]
    model = langid.Model(sorted(rows))
    assert len(model.trees[langid.ORDER].contexts) > 16_000
    trees = {}
    for lang, text in texts:
        history = [0] * langid.ORDER
        for byte in text.encode():
            for order in range(langid.ORDER + 1):
                context = tuple(history[langid.ORDER - order :])
                trees.setdefault(lang, {}).setdefault(context, Counter())[byte] += 1
            history = history[1:] + [byte]
    probes = [text[k : k + 40] for k, (_, text) in enumerate(texts)] + ["abc αβγ xyz 12", ""]
    got = model.code_lengths(*utf8_buffer(pa.array(probes)))
    want = [[code_length(trees[lang], text.encode()) for lang in model.langs] for text in probes]
    assert np.allclose(got, want, rtol=1e-5)


def test_a_model_too_large_to_send_is_refused(spark, monkeypatch):
    monkeypatch.setattr(langid, "MODEL_BYTES", 100)
    df = spark.createDataFrame([(1, "some text", "en")], "doc_id long, text string, lang string")
    with pytest.raises(ValueError, match="smaller sample"):
        langid.identify(df, langid.learn(df))


def test_language_of_held_out_documents(spark):
    path = "/root/testdata/sf0.01"
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{path}/documents.parquet").collect()}
    got = [r for r in QUERIES["op3_ppm_language"](spark, path).collect() if r["held_out"]]
    assert all((zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    assert np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in got]) > 0.95


# Quality


def test_short_texts_of_several_languages_stay(spark):
    rows = [(i, "radio taxi hotel" if i < 40 else "12 34", "abcd"[i % 4]) for i in range(44)]
    df = spark.createDataFrame([*rows, (44, None, "a")], "doc_id long, text string, lang string")
    guess = langid.identify(df, langid.learn(df)).where("doc_id < 40")
    assert guess.agg(F.max("score")).first()[0] < 0.5
    assert {r["doc_id"] for r in langid.known_language(df).collect()} == set(range(40))


def test_network_gradients_are_right():
    net = quality.Network(3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    texts = [b"hello world " * 50, b"", b"*** ### " * 90, b"ab"]
    data = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    label, weight = np.array([1, 0, 0, 1.0]), np.ones(4)

    def loss():
        p = net.probability(data, offsets)
        return -np.mean(label * np.log(p) + (1 - label) * np.log(1 - p))

    got = net.gradients(data, offsets, label, weight)
    rng = np.random.default_rng(0)
    for name, g in got.items():
        flat = net.p[name].reshape(-1)
        for at in rng.choice(flat.size, min(5, flat.size), replace=False):
            old, step = flat[at], 1e-2
            flat[at] = old + step
            up = loss()
            flat[at] = old - step
            slope = (up - loss()) / (2 * step)
            flat[at] = old
            assert abs(slope - np.asarray(g).reshape(-1)[at]) < 2e-3, name


ECHOING = [b"abcdefgh" * 30, b"abcdefgh", b"h" * 7, b"", b"zz abcdefgh abcdefgh", bytes(range(32, 120)) * 20, b"fgh" * 200]


def joined(texts):
    return (
        np.frombuffer(b"".join(texts), np.uint8),
        np.concatenate([[0], np.cumsum([len(t) for t in texts])]),
    )


def test_a_score_depends_on_the_text_alone():
    net = quality.Network(5)
    alone = [net.probability(*joined([t]))[0] for t in ECHOING]
    rng = random.Random(3)
    for _ in range(20):
        order = [rng.randrange(len(ECHOING)) for _ in range(12)]
        got = net.probability(*joined([ECHOING[i] for i in order]))
        assert got.tolist() == [alone[i] for i in order]


def test_features_equal_a_plain_convolution():
    net = quality.Network(6)
    got = net.features(*joined(ECHOING))
    for text, mine in zip(ECHOING, got, strict=True):
        cells = []
        for at, byte in enumerate(text):
            echo = any(
                at - 5 - lag >= 0 and text[at - 5 : at + 1] == text[at - 5 - lag : at + 1 - lag]
                for lag in range(2, quality.LAGS + 1)
            )
            cells.append(net.p["byte"][byte] + (net.p["echo"] if echo else 0))
        cells += [np.zeros(quality.EMBED)] * quality.WIDTH
        answers = {
            at: np.maximum(
                sum(cells[at + j] @ net.p["filter"][j] for j in range(quality.WIDTH)) + net.p["bias"], 0
            )
            for at in range(0, len(text), quality.STEP)
        }
        half, none = quality.CHUNK // 2, np.zeros(quality.FILTERS)
        begins = range(0, max(len(text) - half, 1), half)
        chunks = [
            np.max([none, *(a for at, a in answers.items() if b <= at < b + quality.CHUNK)], axis=0) for b in begins
        ]
        want = np.concatenate([np.mean(chunks, axis=0), np.max(chunks, axis=0)])
        assert np.allclose(mine, want, atol=1e-4)


def test_quality_of_held_out_documents(spark):
    path = "/root/testdata/sf0.01"
    marks = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{path}/labels.parquet").collect()}
    got = [r for r in QUERIES["op4_byte_cnn_quality"](spark, path).collect() if r["held_out"]]
    known = [(r["score"], marks[r["doc_id"]]) for r in got if r["doc_id"] in marks]
    good, bad = [s for s, m in known if m == 1], [s for s, m in known if m == 0]
    assert np.mean([g > b for g in good for b in bad]) > 0.95


# Chat


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="<\\|>im_startend\n ax", max_size=12), min_size=1, max_size=5))
def test_escapes_are_reversible(texts):
    for text in texts:
        hidden = re.sub(r"<(\\*)\|", r"<\1\\|", text)
        assert "<|" not in hidden
        assert re.sub(r"<(\\*)\\\|", r"<\1|", hidden) == text


def test_escape_functions_are_reversible(spark):
    texts = ["<|", "<\\|", "<\\\\|im_end|>", "\\<|", "<<||", "plain", "", "<|nl|>"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select(chat.escape(F.col("t")).alias("e"), chat.unescape(chat.escape(F.col("t"))).alias("u")).collect()
    assert [r["u"] for r in got] == texts and not any("<|" in r["e"] for r in got)


def test_each_example_trains_one_reply(spark):
    turns = [(1, 0, "system", "s"), (1, 1, "user", "u"), (1, 2, "assistant", "first"), (1, 3, "user", "v"),
             (1, 4, "assistant", "second"), (1, 5, "user", "w")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    got = chat.examples(df).sort("example").collect()
    assert [r["target"] for r in got] == [3, 5, None]
    assert [r["text"][r["loss_start"] : r["loss_end"]] for r in got] == ["first", "second", ""]
    for shorter, longer in zip(got, got[1:], strict=False):
        assert longer["text"].startswith(shorter["text"])


# Neighbours


def test_neighbours_against_brute_force(spark, data):
    rows = spark.read.parquet(f"{data}/embeddings.parquet").collect()
    ids = np.array([r["vec_id"] for r in rows])
    vectors = np.array([r["embedding"] for r in rows], np.float64)
    got = {}
    for r in QUERIES["op6_learned_partitions"](spark, data).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    found = total = 0
    for q in np.flatnonzero(ids % 20 == 0):
        score = vectors @ vectors[q]
        order = [i for i in np.lexsort((ids, -score)) if i != q][:20]
        mine = sorted(got[ids[q]])
        assert [m[0] for m in mine] == list(range(1, 21))
        found += len({ids[i] for i in order} & {m[1] for m in mine})
        total += 20
    assert found / total >= 0.9


def test_many_partitions_small_blocks_and_copies(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "ROOT", 3)
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 8))
    vectors = (centres[rng.integers(0, 12, 1500)] + 0.2 * rng.normal(size=(1500, 8))).astype(np.float32)
    vectors[500:1000] = vectors[3]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>")
    got = neighbours.nearest(df, F.col("vec_id") % 100 == 3, k=10, block=64).collect()
    wide = vectors.astype(np.float64)
    hits = 0
    for q in range(3, 1500, 100):
        score = (wide * wide[q]).sum(1)
        want = [i for i in np.lexsort((np.arange(1500), -score)) if i != q][:10]
        mine = [r["vec_id"] for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])]
        assert len(mine) == 10
        hits += len(set(want) & set(mine))
    assert hits / 150 >= 0.9
    ties = [r["vec_id"] for r in sorted((r for r in got if r["query_id"] == 503), key=lambda r: r["rank"])]
    best = max((wide * wide[503]).sum(1))
    if (wide[3] * wide[503]).sum() == best:
        assert ties[0] == 3 and ties[1:] == list(range(500, 503)) + list(range(504, 510))


def test_balanced_partition_keeps_its_bound():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(900, 6)).astype(np.float32)
    part = neighbours.balanced_partition(x.astype(np.float64), neighbours.neighbour_graph(x), 7)
    size = np.bincount(part, minlength=7)
    assert size.max() <= np.ceil(900 / 7 * 1.08) and size.min() > 0


# SimHash


def test_golay_keys_meet_within_four_bits():
    rng = np.random.default_rng(4)
    prints = rng.integers(-(2**63), 2**63 - 1, 3000)
    others = prints.view(np.uint64).copy()
    for i in range(len(others)):
        for bit in rng.choice(64, rng.integers(0, 5), replace=False):
            others[i] ^= np.uint64(1 << int(bit))
    keys = [{}, {}]
    for found, values in zip(keys, (prints, others.view(np.int64)), strict=True):
        key, row = simhash.fuzzy_keys(values)
        for k, r in zip(key.tolist(), row.tolist(), strict=True):
            found.setdefault(r, set()).add(k)
    assert all(keys[0][i] & keys[1][i] for i in range(len(prints)))


def plain_fingerprint(text):
    words = [w for w in re.split(rb"[\x20\x09-\x0d]+", text.lower()) if w]
    if not words:
        return 0
    hashes = [
        xxhash.xxh64_intdigest(b" ".join(words[i : i + 4]), 42) for i in range(max(1, len(words) - 3))
    ]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def union_find(pairs):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {x: find(x) for x in root}


def test_op7_against_all_pairs(spark, data):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    prints = {i: plain_fingerprint(t.encode()) for i, t in texts.items()}
    links = [
        (a, b) for a, b in combinations(sorted(prints), 2) if (prints[a] ^ prints[b]).bit_count() <= 4
    ]
    root = union_find(links)
    for r in QUERIES["op7_simhash_golay"](spark, data).collect():
        assert r["fingerprint"] == f"{prints[r['doc_id']]:016x}"
        assert r["component_id"] == root.get(r["doc_id"], r["doc_id"])


def test_hot_keys_are_cut_into_blocks(spark):
    rng = np.random.default_rng(6)
    centre = int(rng.integers(0, 2**62))
    prints = {centre ^ sum(1 << int(b) for b in rng.choice(62, 3, replace=False)) for _ in range(400)}
    prints |= {int(x) for x in rng.integers(0, 2**62, 100)}
    df = spark.createDataFrame([(p,) for p in prints], "f long")
    want = union_find(
        [(a, b) for a, b in combinations(sorted(prints), 2) if (a ^ b).bit_count() <= 4]
    )
    for block in (20_000, 40):
        got = union_find([(r["a"], r["b"]) for r in simhash.link_fingerprints(df, block).collect()])
        assert got == want


def test_components_of_chains_stars_and_random_links(spark):
    rng = random.Random(3)
    pairs = [(i, i + 1) for i in range(100, 400)] + [(1000, i) for i in range(1001, 1400)]
    pairs += [(rng.randint(2000, 2600), rng.randint(2000, 2600)) for _ in range(300)] + [(5, 5)]
    df = spark.createDataFrame([*pairs, (None, 7)], "a long, b long")
    got = {r["node"]: r["root"] for r in components(df).collect()}
    want = union_find([p for p in pairs if p[0] != p[1]])
    assert got == want


# Fuzzy passages


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        fresh = [0]
        for j, y in enumerate(b):
            fresh.append(row[j] + 1 if x == y else max(row[j + 1], fresh[j]))
        row = fresh
    return row[-1]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=20), st.lists(st.integers(0, 4), max_size=20))
def test_common_words_is_the_longest_subsequence(a, b):
    assert chains.common_words(np.array(a), np.array(b)) == plain_lcs(a, b)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 60), st.integers(0, 60), st.integers(5, 12)), min_size=1, max_size=9))
def test_best_chain_equals_a_plain_search(parts):
    a, b, n = (np.array(x) for x in zip(*sorted(set(parts), key=lambda p: (p[1], p[0])), strict=True))
    score, before = n.astype(float), [-1] * len(a)
    for i in range(len(a)):
        best, who = -np.inf, -1
        for j in range(len(a)):
            if a[j] + n[j] <= a[i] and b[j] + n[j] <= b[i]:
                value = score[j] - chains.GAP_COST / 2 * (a[i] - a[j] - n[j] + b[i] - b[j] - n[j])
                if value > best:
                    best, who = value, j
        if who >= 0 and best > 0 and max(a[i] - a[who] - n[who], b[i] - b[who] - n[who]) <= chains.GAP:
            score[i] += best
    path = chains.chain(a, b, n)[0]
    total = n[path[0]].astype(float)
    for j, i in zip(path, path[1:], strict=False):
        total += n[i] - chains.GAP_COST / 2 * (a[i] - a[j] - n[j] + b[i] - b[j] - n[j])
        assert a[j] + n[j] <= a[i] and b[j] + n[j] <= b[i]
    assert abs(total - score.max()) < 1e-9


def test_edited_passages_are_found(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    noise = lambda n: [word() for _ in range(n)]
    passage = noise(120)
    edited = [word() if i % 12 == 5 else w for i, w in enumerate(passage)]
    cut = [w for i, w in enumerate(passage) if i % 15 != 7]
    docs = [(1, noise(80) + passage + noise(50)), (2, noise(30) + edited), (3, cut + noise(60)), (4, noise(300)),
            (5, noise(40) + passage[:20] + noise(100))]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in docs], "doc_id long, text string")
    got = {r["doc_id"]: r for r in chains.fuzzy_passages(df).collect()}
    assert set(got) == {1, 2, 3} and {r["class_id"] for r in got.values()} == {1}
    start, end = map(int, got[1]["spans"].split(":"))
    assert start <= 85 and end >= 195


def spelled(rng):
    return "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7))


def fuzzy_rows(spark, texts):
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string")
    return {r["doc_id"]: r for r in chains.fuzzy_passages(df).collect()}


@pytest.mark.parametrize("block", [100, 2])
def test_all_texts_of_a_seed_are_linked(spark, monkeypatch, block):
    monkeypatch.setattr(chains, "BLOCK", block)
    rng = random.Random(4)
    noise = lambda n: [spelled(rng) for _ in range(n)]
    passage, lines = noise(60), [noise(15) for _ in range(4)]
    texts = [noise(20) + passage + noise(i) for i in range(9)]
    # Two texts with the same four lines, each of which many other texts hold, too.
    texts += [noise(10) + sum(lines, []) + noise(30) for _ in range(2)]
    texts += [noise(30) + lines[i % 4] + noise(30) for i in range(40)]
    got = fuzzy_rows(spark, texts)
    assert set(got) == set(range(11))
    assert [got[i]["n_links"] for i in range(11)] == [8] * 9 + [1] * 2
    assert {got[i]["spans"] for i in range(9)} == {"20:80"} and {got[i]["spans"] for i in (9, 10)} == {"10:70"}


def some_pair(rng, most=90):
    """Two texts of few words, the second often with a changed copy of the first's start."""
    kinds = int(rng.choice([2, 5, 30, 400]))
    a, b = (rng.integers(0, kinds, rng.integers(0, most)).astype(np.uint64) for _ in range(2))
    n = min(len(a), len(b))
    changed = rng.random(n) < 0.15
    if rng.random() < 0.8:
        b[:n] = np.where(changed, b[:n], a[:n])
    return chains.Words(a), chains.Words(b)


def test_segments_and_groups_equal_plain_loops():
    rng = np.random.default_rng(11)
    for _ in range(40):
        one, two = some_pair(rng)
        a, b = one.seeds.tolist(), two.seeds.tolist()
        want = []
        for y, x in product(range(len(b)), range(len(a))):
            if a[x] == b[y] and not (x and y and a[x - 1] == b[y - 1]):
                n = 0
                while x + n < len(a) and y + n < len(b) and a[x + n] == b[y + n]:
                    n += 1
                want.append((x, y, n + chains.SEED - 1))
        sa, sb, n = chains.segments(one.seeds, two.seeds)
        assert list(zip(sa.tolist(), sb.tolist(), n.tolist(), strict=True)) == want
        of = list(range(len(want)))
        for i, j in combinations(range(len(want)), 2):
            (xa, ya, na), (xb, yb, nb) = want[i], want[j]
            near = ya + na >= yb - chains.GAP and xa + na >= xb - chains.GAP and xa <= xb + nb
            if near and of[i] != of[j]:
                of = [of[j] if o == of[i] else o for o in of]
        plain = {tuple(i for i, o in enumerate(of) if o == root) for root in of}
        assert {tuple(g.tolist()) for g in chains.groups(sa, sb, n)} == plain


def test_alike_parts_equal_a_plain_search():
    rng = np.random.default_rng(12)
    for _ in range(60):
        size = int(rng.integers(0, 120))
        x, y = (np.sort(rng.choice(150, size, replace=False)) for _ in range(2))
        found = set()
        for i, j in combinations(range(size), 2):
            longer, shorter = max(x[j] - x[i], y[j] - y[i]) + 1, min(x[j] - x[i], y[j] - y[i]) + 1
            if shorter >= chains.LENGTH and j - i + 1 >= chains.SIMILARITY * longer - 1e-9:
                found.update(range(i, j + 1))
        got = chains.parts_alike(x, y)
        assert set().union(*(range(i, j + 1) for i, j in got)) == found


def test_repetitive_texts_are_cheap():
    """One word throughout, and one line between other words: work grows with what can be a passage."""
    same = [chains.Words(np.full(2_000, 7, np.uint64)) for _ in range(2)]
    assert [p[:4] for p in chains.passages_of(*same)] == [(0, 2_000, 0, 2_000)]
    rng = np.random.default_rng(13)
    line = rng.integers(0, 1 << 60, 12)
    lined = [
        chains.Words(np.concatenate([np.append(line, rng.integers(0, 1 << 60, 20)) for _ in range(240)]).astype(np.uint64))
        for _ in range(2)
    ]
    begun = time.process_time()
    assert chains.passages_of(*lined) == []
    assert time.process_time() - begun < 5


def test_only_texts_with_a_partner_are_carried(spark, monkeypatch):
    """Lines of which any two texts have one in common bring all of them together, but no two are compared."""
    rng = random.Random(17)
    noise = lambda n: [spelled(rng) for _ in range(n)]
    lines, passage = [[noise(4) for _ in range(7)] for _ in range(7)], noise(60)
    texts = [noise(30) + sum((lines[x][(m * x + c) % 7] for x in range(7)), []) + noise(30) for m in range(7) for c in range(7)]
    texts += [noise(20) + passage + noise(5) for _ in range(2)]
    written, settle = {}, chains.settle
    monkeypatch.setattr(chains, "settle", lambda df, name: written.setdefault(name, settle(df, name)))
    got = fuzzy_rows(spark, texts)
    assert {i: (r["n_links"], r["spans"]) for i, r in got.items()} == {49: (1, "20:80"), 50: (1, "20:80")}
    assert written["classes"].select("t").distinct().count() == 51
    assert written["chained"].count() == 2


def test_seeds_find_their_equals_over_flushes(spark, monkeypatch):
    """Texts of other flushes, places beyond 16 bits, copies and a text without seeds."""
    monkeypatch.setattr(chains, "FLUSH", 100)
    rng = random.Random(18)
    noise = lambda n: [spelled(rng) for _ in range(n)]
    passage = noise(60)
    texts = [noise(70_000) + passage, noise(40), noise(10) + passage, [], noise(2), noise(80)]
    got = fuzzy_rows(spark, [*texts, texts[2], texts[5]])
    want = {0: (0, 1, "70000:70060"), 2: (0, 1, "0:70"), 6: (0, 1, "0:70"), 5: (5, 0, "0:80"), 7: (5, 0, "0:80")}
    assert {i: (r["class_id"], r["n_links"], r["spans"]) for i, r in got.items()} == want


def test_runs_of_a_word_give_few_passages():
    """A chain for every shift of the runs; those between two that were told add nothing."""
    rng = np.random.default_rng(19)
    one, two = (
        chains.Words(np.concatenate([rng.integers(8, 1 << 60, 40), np.full(n, 7), rng.integers(8, 1 << 60, 40)]).astype(np.uint64))
        for n in (100, 950)
    )
    found = chains.passages_of(one, two)
    covered = [set().union(*(range(p[k], p[k + 1]) for p in found)) for k in (0, 2)]
    assert covered == [set(range(40, 140)), set(range(40, 990))]
    assert len(found) < 60


def texts_met(texts):
    """Links, and covered words of each text, if every two of these lists of words meet in one block."""
    rows = [(0, 0, 0, k, list(range(k)), " ".join(map(str, t))) for k, t in enumerate(texts)]
    types = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.string()]
    columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), types, strict=True)]
    links, covered = set(), [set() for _ in texts]
    for batch in chains._meet(iter([pa.record_batch(columns, names=["head", "i", "j", "t", "others", "text"])])):
        for a, b, a_start, a_end, b_start, b_end, similarity in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            assert min(a_end - a_start, b_end - b_start) >= chains.LENGTH and similarity >= chains.SIMILARITY - 1e-9
            links.add((a, b))
            covered[a].update(range(a_start, a_end))
            covered[b].update(range(b_start, b_end))
    return links, covered


def test_a_block_gives_the_links_and_places_of_its_pairs(monkeypatch):
    """Near copies, moved and edited passages, runs of a word, few and many different words, and nothing in common."""
    rng = np.random.default_rng(23)
    for _ in range(12):
        kinds = int(rng.choice([4, 40, 4_000]))
        base, other = rng.integers(0, kinds, 160), rng.integers(0, kinds, 90)
        texts = [rng.integers(0, kinds, rng.integers(3, 300)) for _ in range(3)]
        for rate in (0.01, 0.03, 0.06, 0.1, 0.15):
            changed = np.where(rng.random(160) < rate, rng.integers(0, kinds, 160), base)
            texts += [changed, np.delete(changed, rng.integers(0, 160, 3)), np.concatenate([other, changed[:70], other[:30]])]
        runs = [np.full(rng.integers(10, 120), w) for w in rng.integers(0, 3, 12)]
        texts += [np.concatenate(runs[k : k + 3]) for k in range(0, 12, 3)] + [np.concatenate([runs[0], base[:80], runs[1]])]
        texts = [texts[k] for k in rng.permutation(len(texts))]
        words = list(chains._hashes(pa.array([" ".join(map(str, t)) for t in texts])))
        links, covered = set(), [set() for _ in texts]
        for b, a in ((b, a) for b in range(len(texts)) for a in range(b)):
            for a_start, a_end, b_start, b_end, _ in chains.passages_of(chains.Words(words[a]), chains.Words(words[b])):
                links.add((a, b))
                covered[a].update(range(a_start, a_end))
                covered[b].update(range(b_start, b_end))
        assert texts_met(texts) == (links, covered)
        assert links
        monkeypatch.setattr(chains, "PART_WORDS", int(rng.choice([200, 1_000, 300_000])))


def test_near_copies_are_not_all_aligned(monkeypatch):
    """Of a family of near copies most pairs are told by words in a row; the others need a piece of an alignment."""
    gaps, matches = [], chains._matches
    monkeypatch.setattr(chains, "_matches", lambda a, b: gaps.append(1) or matches(a, b))
    rng = np.random.default_rng(24)
    base = rng.integers(0, 5_000, 400)
    texts = [np.where(rng.random(400) < 0.04, rng.integers(5_000, 9_000, 400), base) for _ in range(60)]
    links, covered = texts_met(texts)
    assert len(links) == 60 * 59 / 2 and min(map(len, covered)) > 390
    # All 1,770 alignments look into 9,793 gaps.
    assert len(gaps) < 6_000


def test_numbers_in_common_are_counted():
    rng = np.random.default_rng(25)
    n = rng.integers(0, 30, 12)
    sets = [rng.integers(0, 60, k).tolist() for k in n]
    got = [chains._together(np.concatenate(sets).astype(np.int64), n, limit) for limit in (7, 1 << 16)]
    want = [[sum(v in two for v in one) for two in sets] for one in sets]
    assert [g.tolist() for g in got] == [want, want]


def test_parts_of_a_failing_chain_are_kept():
    rng = np.random.default_rng(5)
    noise = lambda n: rng.integers(1, 2**62, n).astype(np.uint64)
    first, last = noise(50), noise(10)
    one, two = (chains.Words(np.concatenate([noise(7), first, noise(20), last, noise(9)])) for _ in range(2))
    assert [p[:4] for p in chains.passages_of(one, two)] == [(7, 57, 7, 57)]
    paragraphs = [noise(50) for _ in range(3)]
    texts = [np.concatenate([x for p in paragraphs for x in (p, noise(20))]) for _ in range(2)]
    covered = set()
    for start, end, *_ in chains.passages_of(*map(chains.Words, texts)):
        covered |= set(range(start, end))
    assert {p for k in (0, 70, 140) for p in range(k, k + 50)} <= covered


def test_texts_with_enough_common_seeds_meet():
    """Whatever else two texts have and however frequent seeds are, ``SUPPORT`` common ones in a window have two in common."""
    rng = np.random.default_rng(27)
    for _ in range(400):
        common = rng.choice(2**31, chains.SUPPORT, replace=False)
        if rng.random() < 0.3:
            common[rng.integers(0, chains.SUPPORT, 5)] = common[0]
        level = {k: int(rng.integers(0, 4)) for k in common[rng.random(chains.SUPPORT) < rng.random()].tolist()}
        met, texts = [], []
        for _ in range(2):
            at = np.sort(rng.choice(chains.WINDOW, chains.SUPPORT, replace=False)) + rng.integers(0, 200)
            seeds = dict(zip(rng.integers(0, 300, 60).tolist(), rng.integers(2**31, 2**32, 60).tolist(), strict=True))
            seeds |= dict(zip(at.tolist(), common.tolist(), strict=True))
            places = np.array(sorted(seeds))
            kinds = np.array([seeds[p] for p in places.tolist()], np.uint32)
            often = np.array([level.get(k, int(k % 4) if k >= 2**31 else 0) for k in kinds.tolist()], np.int8)
            first, second = chains.twos(kinds, places + chains.WINDOW, often)
            met.append(set(zip(kinds[first].tolist(), kinds[second].tolist(), strict=True)))
            texts.append((kinds.view(np.int32), places))
        assert met[0] & met[1]
        one = np.array([[False, True], [False, False]])
        assert (chains._beside(*map(list, zip(*texts, strict=True)), one) == one).all()


def test_near_copies_give_a_row_each(spark, monkeypatch):
    """Links of a family of near copies are counted where they meet, not written one by one."""
    rng = random.Random(29)
    base = [spelled(rng) for _ in range(150)]
    texts = [[spelled(rng) if rng.random() < 0.02 else w for w in base] for _ in range(40)]
    written, settle = {}, chains.settle
    monkeypatch.setattr(chains, "settle", lambda df, name: written.setdefault(name, settle(df, name)))
    got = fuzzy_rows(spark, texts)
    different = len(set(map(tuple, texts)))
    assert {(r["class_id"], r["n_links"]) for r in got.values()} == {(0, different - 1)} and len(got) == 40
    assert written["passages"].count() <= 120


def test_groups_taken_one_after_another_give_the_same(spark, monkeypatch):
    """Texts that meet in many groups, sent in passes of few rows."""
    rng = random.Random(26)
    noise = lambda n: [spelled(rng) for _ in range(n)]
    passages = [noise(60) for _ in range(6)]
    texts = [noise(9) + passages[k % 6] + noise(9) + passages[(k * 5 + 1) % 6] for k in range(14)]
    once = fuzzy_rows(spark, texts)
    monkeypatch.setattr(chains, "PASS_ROWS", 12)
    written, settle = [], chains.settle
    monkeypatch.setattr(chains, "settle", lambda df, name: written.append(name) or settle(df, name))
    assert fuzzy_rows(spark, texts) == once and set(once) == set(range(14))
    assert written.count("pairs") > 1


def test_substituted_words_leave_enough_seeds(spark):
    rng = random.Random(8)
    noise = lambda n: [spelled(rng) for _ in range(n)]
    texts = []
    for k in range(60):
        passage = noise(52)
        # Every fifth word differs, or ten words in any place between.
        other = set(range(5, 50, 5)) if k < 10 else set(rng.sample(range(2, 50), 10))
        texts += [noise(20) + passage + noise(20)]
        texts += [noise(31) + [spelled(rng) if i in other else w for i, w in enumerate(passage)] + noise(9)]
    got = fuzzy_rows(spark, texts)
    assert set(got) == set(range(120)) and {r["n_links"] for r in got.values()} == {1}


def test_exact_passages_are_among_the_fuzzy_ones(spark, data):
    fuzzy = {}
    for r in QUERIES["op10_collinear_chains"](spark, data).collect():
        fuzzy[r["doc_id"]] = {p for s in r["spans"].split(",") for p in range(*map(int, s.split(":")))}
    for r in QUERIES["op9_sparse_suffixes"](spark, data).collect():
        assert set(range(r["start_word"], r["end_word"])) <= fuzzy.get(r["doc_id"], set())


def test_large_classes_of_suffixes_give_the_same(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    few, many = (
        sorted(tuple(r) for r in suffixes.repeated_passages(docs, block=b).collect()) for b in (10**6, 1)
    )
    assert few == many and few


# Words


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="aB é\t\n.9z", max_size=30), max_size=5))
def test_words_by_pattern(texts):
    data, offsets = utf8_buffer(pa.array(texts, pa.string()))
    data = W.LOWER[data]
    for kind, pattern in ((W.ALNUM, rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), (W.VISIBLE, rb"[^\x20\x09-\x0D]+")):
        starts, ends, first = W.find_words(data, offsets, kind)
        for row, text in enumerate(texts):
            spelled = [data[s:e].tobytes() for s, e in zip(starts, ends, strict=True)][first[row] : first[row + 1]]
            assert spelled == re.findall(pattern, re.sub(rb"[A-Z]", lambda m: m[0].lower(), text.encode()))


# Pipeline


def test_pipeline_equals_its_operators(spark, data, duck):
    """Each stage's decision, taken alone, on what its predecessor kept."""
    docs = spark.read.parquet(f"{data}/documents.parquet")
    (_, language), (_, dedup), (_, bench), (_, hide), (_, tokens) = corpus_pipeline.STAGES
    first = language(spark, docs, data)
    told = {
        r["doc_id"] for r in QUERIES["op3_ppm_language"](spark, data).collect() if r["lang_pred"] != "und"
    }
    assert {r["doc_id"] for r in first.collect()} == told
    second = dedup(spark, first, data)
    texts = {r["doc_id"]: r["text"] for r in first.collect()}
    prints = {i: plain_fingerprint(t.encode()) for i, t in texts.items()}
    root = union_find([(a, b) for a, b in combinations(sorted(prints), 2) if (prints[a] ^ prints[b]).bit_count() <= 4])
    assert {r["doc_id"] for r in second.collect()} == {i for i in texts if root.get(i, i) == i}
    third = bench(spark, second, data)
    bad = duck.execute(f"select doc_id from ({ORACLES['op2_benchmark_winnowing']}) where contaminated").fetchall()
    assert {r["doc_id"] for r in third.collect()} == {r["doc_id"] for r in second.collect()} - {b[0] for b in bad}
    fourth = hide(spark, third, data)
    before = {r["doc_id"]: r["text"] for r in third.collect()}
    spans = dict(duck.execute(f"select doc_id, spans from ({ORACLES['op8_credential_links']})").fetchall())
    for r in fourth.collect():
        want, last = [], 0
        for start, end in sorted(tuple(map(int, s.split(":")[1:])) for s in spans[r["doc_id"]].split(",") if s):
            if start >= last or not want:
                want.append(before[r["doc_id"]][last:start])
            last = max(last, end)
        want.append(before[r["doc_id"]][last:])
        assert r["text"] == "[SECRET]".join(want)
    last = tokens(spark, fourth, data).collect()
    assert len(last) == len(before) and all(r["round_trip"] for r in last)
    assert corpus_pipeline.run(spark, data).count() == len(before)
