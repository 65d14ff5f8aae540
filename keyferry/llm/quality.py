"""Quality scores from a byte-level convolutional network, in numpy.

A byte is embedded together with an echo bit: do this byte and the five before it repeat what stood 2 to
``LAGS`` bytes earlier in the text? Learned filters of ``WIDTH`` bytes slide over the text in steps of ``STEP``. The text is
covered by chunks of ``CHUNK`` bytes that overlap by half; a filter's largest answer in each chunk (cut at
zero) is that chunk's feature. Means and maxima of the features over all chunks go through one logistic unit.

Learning reads at most about ``SAMPLE`` labelled documents of each label, picked by a hash of id and
text, whole texts of them, with Adam steps from a fixed seed. Scoring covers every text whole, a
bounded piece at a time.

Rows: a null or empty text scores as a text without features does. Null labels and the labels of
unknown ids teach nothing; an id whose labels differ teaches the lowest. Without any label all scores
are 0.5. A score depends on the text alone, so repeated rows give repeated results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyferry.llm.common import table, utf8_buffer
from keyferry.llm.langid import held_out
from keyferry.llm.words import row_blocks

SAMPLE = 1500
FILTERS = 16
WIDTH = 8
STEP = 2
CHUNK = 512
LAGS = 32
EMBED = 8
EPOCHS = 12
BATCH = 32
SEED = 7
THRESHOLD = 0.3
_HALF = CHUNK // 2
#: The symbol after a text's end.
_END = 512


def _echo(data: np.ndarray) -> np.ndarray:
    """The echo bits along the last axis."""
    echo = np.zeros(data.shape, bool)
    for lag in range(2, LAGS + 1):
        same = data[..., lag:] == data[..., :-lag]
        two = same[..., 1:] & same[..., :-1]
        six = two[..., 4:] & two[..., 2:-2] & two[..., :-4]
        echo[..., lag + 5 :] |= six
    return echo


def symbols(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Each byte of the texts, end to end, with its echo bit (256)."""
    echo = _echo(data)
    # Only a text's first bytes can look back into the text before; they are looked at on their own.
    places = offsets[:-1, None] + np.arange(LAGS + 5)
    inside = places < offsets[1:, None]
    if inside.any():
        heads = data[np.minimum(places, len(data) - 1)]
        echo[places[inside]] = _echo(heads)[inside]
    return data.astype(np.int16) + (echo.astype(np.int16) << 8)


def _padded(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all rows, each filled up to whole half chunks, and the first half chunk of each row."""
    sizes = np.diff(offsets)
    halves = np.maximum(-(-sizes // _HALF), 1)
    first = np.concatenate([[0], np.cumsum(halves)])
    out = np.full(first[-1] * _HALF + WIDTH, _END, np.int16)
    marked = symbols(data, offsets)
    for row, (a, b) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
        at = first[row] * _HALF
        out[at : at + b - a] = marked[a:b]
    return out, first


class Network:
    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.p = {
            "byte": rng.normal(0, 0.5, (256, EMBED)).astype(np.float32),
            "echo": rng.normal(0, 0.5, EMBED).astype(np.float32),
            "filter": rng.normal(0, 1 / np.sqrt(WIDTH * EMBED), (WIDTH, EMBED, FILTERS)).astype(
                np.float32
            ),
            "bias": np.zeros(FILTERS, np.float32),
            "out": rng.normal(0, 0.1, 2 * FILTERS).astype(np.float32),
            "base": np.zeros(1, np.float32),
        }

    def _embedding(self) -> np.ndarray:
        byte, echo = self.p["byte"], self.p["echo"]
        return np.concatenate([byte, byte + echo, np.zeros((1, EMBED), np.float32)])

    def _tables(self) -> np.ndarray:
        """Each filter's answer to a symbol at each of its places; none starts after the end."""
        tables = np.einsum("se,wef->wsf", self._embedding(), self.p["filter"])
        tables[0] += self.p["bias"]
        tables[0, _END] = -1e9
        return np.ascontiguousarray(tables, np.float32)

    def _answers(self, padded: np.ndarray, tables: np.ndarray) -> np.ndarray:
        """(half chunk, place, filter)"""
        n = (len(padded) - WIDTH) // STEP
        out = tables[0].take(padded[: n * STEP : STEP], 0)
        for j in range(1, WIDTH):
            out += tables[j].take(padded[j : j + n * STEP : STEP], 0)
        return out.reshape(-1, _HALF // STEP, FILTERS)

    @staticmethod
    def _chunks(halves: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which half chunk begins each chunk, and the first chunk of each row."""
        count = np.maximum(np.diff(first) - 1, 1)
        row_first = np.concatenate([[0], np.cumsum(count)])
        begin = np.arange(row_first[-1]) - np.repeat(row_first[:-1] - first[:-1], count)
        return begin, row_first

    def features(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """(row, 2 * FILTERS) for scoring; long rows are answered in pieces of bounded size."""
        tables = self._tables()
        out = np.zeros((len(offsets) - 1, 2 * FILTERS), np.float32)
        for lo, hi in row_blocks(offsets, 200_000):
            part = data[offsets[lo] : offsets[hi]]
            padded, first = _padded(part, offsets[lo : hi + 1] - offsets[lo])
            pieces = []
            for at in range(0, int(first[-1]), 1024):
                end = min(at + 1024, int(first[-1]))
                piece = padded[at * _HALF : end * _HALF + WIDTH]
                pieces.append(self._answers(piece, tables).max(1))
            best = np.maximum(np.concatenate(pieces), 0)
            out[lo:hi] = self._pool(best, first)
        return out

    def _pool(self, best: np.ndarray, first: np.ndarray) -> np.ndarray:
        begin, row_first = self._chunks(best, first)
        last = np.repeat(first[1:] - 1, np.diff(row_first))
        chunk = np.maximum(best[begin], best[np.minimum(begin + 1, last)])
        mean = np.add.reduceat(chunk, row_first[:-1]) / np.diff(row_first)[:, None]
        return np.concatenate([mean, np.maximum.reduceat(chunk, row_first[:-1])], axis=1)

    def probability(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        if len(offsets) < 2:
            return np.empty(0)
        # Not a matrix product: its rounding may depend on the number of rows.
        z = (self.features(data, offsets) * self.p["out"]).sum(1, dtype=np.float64) + self.p["base"]
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))

    def gradients(
        self, data: np.ndarray, offsets: np.ndarray, label: np.ndarray, weight: np.ndarray
    ) -> dict[str, np.ndarray]:
        """Of the weighted log loss over the rows."""
        padded, first = _padded(data, offsets)
        answers = self._answers(padded, self._tables())
        place = answers.argmax(1)
        half = np.take_along_axis(answers, place[:, None, :], 1)[:, 0]
        best = np.maximum(half, 0)
        begin, row_first = self._chunks(best, first)
        count = np.diff(row_first)
        last = np.repeat(first[1:] - 1, count)
        second = np.minimum(begin + 1, last)
        chunk = np.maximum(best[begin], best[second])
        winner = np.where(best[begin] >= best[second], begin[:, None], second[:, None])
        row = np.repeat(np.arange(len(label)), count)
        mean = np.add.reduceat(chunk, row_first[:-1]) / count[:, None]
        top = np.maximum.reduceat(chunk, row_first[:-1])
        z = np.concatenate([mean, top], 1)
        p = 1 / (1 + np.exp(-np.clip(z @ self.p["out"] + self.p["base"], -40, 40)))
        dz = ((p - label) * weight / weight.sum()).astype(np.float32)
        back = dz[:, None] * self.p["out"][None, :]
        d_chunk = back[row, :FILTERS] / count[row][:, None]
        is_top = chunk == top[row]
        ties = np.add.reduceat(is_top.astype(np.float32), row_first[:-1])
        d_chunk = d_chunk + np.where(is_top, back[row, FILTERS:] / ties[row], 0)
        d_half = np.zeros_like(half)
        np.add.at(d_half, (winner, np.arange(FILTERS)[None, :]), d_chunk)
        d_half[half <= 0] = 0
        at = (np.arange(len(half))[:, None] * _HALF + place * STEP).ravel()
        filt = np.tile(np.arange(FILTERS), len(half))
        grad = d_half.ravel()
        used = grad != 0
        at, filt, grad = at[used], filt[used], grad[used]
        embedding = self._embedding()
        d_embedding = np.zeros_like(embedding)
        d_filter = np.zeros_like(self.p["filter"])
        for j in range(WIDTH):
            cell = padded[at + j].astype(np.int64) * FILTERS + filt
            d_table = np.bincount(cell, grad, (_END + 1) * FILTERS).reshape(_END + 1, FILTERS)
            d_table[_END] = 0
            d_filter[j] = embedding.T @ d_table
            d_embedding += d_table @ self.p["filter"][j].T
        return {
            "byte": d_embedding[:256] + d_embedding[256:512],
            "echo": d_embedding[256:512].sum(0),
            "filter": d_filter,
            "bias": d_half.sum(0),
            "out": z.T @ dz,
            "base": np.array([dz.sum()], np.float32),
        }


def train(texts: list[bytes], labels: np.ndarray, epochs: int = EPOCHS, seed: int = SEED) -> Network:
    """Adam over shuffled batches; both labels weigh the same in the first half, then as they occur."""
    net = Network(seed)
    rng = np.random.default_rng(seed)
    first = {k: np.zeros_like(v) for k, v in net.p.items()}
    second = {k: np.zeros_like(v) for k, v in net.p.items()}
    step = 0
    for epoch in range(epochs):
        rate = 0.01 * 0.5 * (1 + np.cos(np.pi * epoch / epochs)) + 1e-4
        order = rng.permutation(len(texts))
        for lo in range(0, len(order), BATCH):
            pick = order[lo : lo + BATCH]
            offsets = np.concatenate([[0], np.cumsum([len(texts[i]) for i in pick])])
            data = np.frombuffer(b"".join(texts[i] for i in pick), np.uint8)
            grads = net.gradients(data, offsets, labels[pick], np.ones(len(pick), np.float32))
            step += 1
            for k, g in grads.items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                move = (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
                net.p[k] -= (rate * move).astype(np.float32)
    return net


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """text and quality of about ``sample`` documents of each label (all, if there are fewer)."""
    marks = (
        labels.where(
            F.col("quality").isNotNull()
            & F.col("doc_id").isNotNull()
            & ~held_out(F.col("doc_id"))
        )
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"))
    )
    sizes = {r["quality"]: r["count"] for r in marks.groupBy("quality").count().collect()}
    share = F.lit(0.0)
    for mark, n in sorted(sizes.items()):
        share = F.when(F.col("quality") == mark, F.lit(sample / n)).otherwise(share)
    drawn = marks.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share * (1 << 30))
    # The draw has about ``sample`` ids of each label, however many rows there are.
    return docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id").select(
        F.col("text"), "quality"
    )


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Network | None:
    rows = training_rows(docs, labels, sample).distinct().toArrow()
    texts = [t or b"" for t in rows.column("text").cast(pa.binary()).to_pylist()]
    marks = rows.column("quality").to_pylist()
    both = sorted(zip(texts, marks, strict=True))
    if not both:
        return None
    return train([t for t, _ in both], np.array([m for _, m in both], np.float32))


def scorer(spark: SparkSession, net: Network | None):
    """A column function: text to the probability of quality 1."""
    shared = spark.sparkContext.broadcast(net)

    @F.arrow_udf(T.DoubleType())
    def score(texts: pa.Array) -> pa.Array:
        known = shared.value
        if known is None:
            return pa.array(np.full(len(texts), 0.5))
        return pa.array(known.probability(*utf8_buffer(texts)))

    return score


def op4_byte_cnn_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    score = scorer(spark, learn(docs, table(spark, sf_dir, "labels")))
    scored = docs.select("doc_id", score("text").alias("score"))
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
