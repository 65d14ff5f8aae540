"""Language identification by prediction with partial matching (PPM) over bytes.

Each language has a tree of byte contexts up to ``ORDER`` bytes long with its counts. A byte that a
context has not seen costs an escape and is looked for in the context one byte shorter, down to a
uniform choice among all bytes (escape method C: an escape is as likely as a new byte was so far, n
distinct bytes after t in all give n / (n + t)). A text's code length under a language is the sum over
its bytes, exactly as an arithmetic coder with these frozen statistics would need. The language
with the shortest code wins; the score is its posterior with equal priors.

With bounded contexts and frozen counts a byte's cost depends on the ``ORDER`` bytes before it alone. So the costs
of all runs of bytes that any language has seen are laid out once by order, next to the escapes of their
contexts, and texts are scored by looking their runs up.

Learning reads at most about ``SAMPLE`` documents a language, picked by a hash of their id and text,
and of those whole texts; every context of them is kept. Counting runs in Spark; only the model reaches the
driver. It has a row per distinct run of up to ``ORDER`` + 1 bytes in that sample, and is not sent to executors if
it takes more than ``MODEL_BYTES``: learning then needs a smaller sample.

Rows: a null text, or one without a letter, is ``und`` with score 0. Documents of null language teach
nothing. With nothing to learn from, all are ``und``. Ties go to the language first in order. Repeated rows
give repeated results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyferry.llm.common import table, utf8_buffer
from keyferry.llm.words import row_blocks

ORDER = 3
SAMPLE = 1500
MODEL_BYTES = 512 << 20
UNKNOWN = "und"


def held_out(doc_id: Column) -> Column:
    """One id in five, by checksum, is kept from learning; a null id is not."""
    rest = F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5))
    return F.coalesce(rest == 0, F.lit(False))


def training_rows(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """text and lang of about ``sample`` documents per language (all, if there are fewer)."""
    known = docs.where(
        ~held_out(F.col("doc_id"))
        & F.col("lang").isNotNull()
        & F.col("text").isNotNull()
    ).select("lang", "text", F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)).alias("draw"))
    sizes = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    share = F.lit(None).cast("double")
    for lang, n in sorted(sizes.items()):
        share = F.when(F.col("lang") == lang, F.lit(sample / n)).otherwise(share)
    return known.where(F.col("draw") < share * (1 << 30)).select("lang", "text")


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, gram (ORDER + 1 bytes as a number, zeros before the text), n."""
    for batch in batches:
        langs = np.array(batch.column(0).to_pylist(), object)
        data, offsets = utf8_buffer(batch.column(1))
        for lo, hi in row_blocks(offsets):
            part = data[offsets[lo] : offsets[hi]]
            grams = _grams(part, offsets[lo : hi + 1] - offsets[lo])
            names = np.repeat(langs[lo:hi], np.diff(offsets[lo : hi + 1]))
            for lang in sorted(set(langs[lo:hi])):
                values, n = np.unique(grams[names == lang], return_counts=True)
                yield pa.record_batch(
                    [pa.array([lang] * len(n), pa.string()), pa.array(values), pa.array(n)],
                    names=["lang", "gram", "n"],
                )


def _history(classes: np.ndarray, offsets: np.ndarray, back: int) -> np.ndarray:
    """The class ``back`` places before each place of its row, 0 before the row's start."""
    out = np.zeros_like(classes)
    out[back:] = classes[:-back] if back else classes
    for k in range(min(back, len(classes))):
        at = offsets[:-1] + k
        out[at[at < offsets[1:]]] = 0
    return out


def _grams(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    out = data.astype(np.int64)
    for back in range(1, ORDER + 1):
        out |= _history(data, offsets, back).astype(np.int64) << (8 * back)
    return out


def _find(sorted_codes: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each code is, and whether it is there."""
    at = np.minimum(np.searchsorted(sorted_codes, codes), len(sorted_codes) - 1)
    return at, sorted_codes[at] == codes


class Tree:
    """The contexts of one order: ``cost`` in bits of each byte met in a context (``runs`` holds both as one number,
    the byte lowest), and ``escape`` of each context, by language."""

    def __init__(self, order: int, grams: np.ndarray, n: np.ndarray, lang: np.ndarray, languages: int, below: Tree | None):
        self.mask = (1 << 8 * (order + 1)) - 1
        self.runs, at = np.unique(grams & self.mask, return_inverse=True)
        count = np.zeros((len(self.runs), languages))
        np.add.at(count, (at, lang), n)
        self.contexts, first, of = np.unique(self.runs >> 8, return_index=True, return_inverse=True)
        total, kinds = np.add.reduceat(count, first), np.add.reduceat(count > 0, first, dtype=np.int64)
        lower = np.full(count.shape, 8.0)
        if below:
            lower = below.cost[_find(below.runs, self.runs & below.mask)[0]]
        with np.errstate(divide="ignore", invalid="ignore"):
            # A context that a language has not met costs it nothing: it acts as the order below.
            escape = np.where(total > 0, -np.log2(kinds / (total + kinds)), 0.0)
            direct = -np.log2(count / (total + kinds)[of])
        self.cost = np.where(count > 0, direct, escape[of] + lower).astype(np.float32)
        self.escape = escape.astype(np.float32)

    @property
    def nbytes(self) -> int:
        return sum(a.nbytes for a in (self.runs, self.contexts, self.cost, self.escape))


class Model:
    """Frozen code lengths by language, from (language, gram, count) rows."""

    def __init__(self, counts: list[tuple[str, int, int]]):
        self.langs = sorted({lang for lang, _, _ in counts})
        number = {lang: i for i, lang in enumerate(self.langs)}
        grams = np.array([g for _, g, _ in counts], np.int64)
        n = np.array([c for _, _, c in counts], np.float64)
        lang = np.array([number[x] for x, _, _ in counts], np.int64)
        self.trees: list[Tree] = []
        for order in range(ORDER + 1):
            below = self.trees[-1] if self.trees else None
            self.trees.append(Tree(order, grams, n, lang, len(self.langs), below))

    @property
    def nbytes(self) -> int:
        return sum(tree.nbytes for tree in self.trees)

    def code_lengths(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Bits of each row under each language."""
        out = np.zeros((len(offsets) - 1, len(self.langs)))
        for lo, hi in row_blocks(offsets, 500_000):
            at = offsets[lo : hi + 1] - offsets[lo]
            grams = _grams(data[offsets[lo] : offsets[hi]], at)
            if len(grams) == 0:
                continue
            # Each distinct run of the block is looked up once, in the longest context first.
            grams, of = np.unique(grams, return_inverse=True)
            costs = np.zeros((len(grams), len(self.langs)), np.float32)
            left = np.arange(len(grams))
            for tree in reversed(self.trees):
                code = grams[left] & tree.mask
                row, met = _find(tree.runs, code)
                costs[left[met]] += tree.cost[row[met]]
                left, code = left[~met], code[~met]
                row, met = _find(tree.contexts, code >> 8)
                costs[left[met]] += tree.escape[row[met]]
            costs[left] += 8
            full = np.flatnonzero(at[1:] > at[:-1])
            out[lo + full] = np.add.reduceat(costs[of], at[full], axis=0, dtype=np.float64)
        return out


def learn(docs: DataFrame, sample: int = SAMPLE) -> Model | None:
    """Count the grams of the training rows in Spark and lay out the model; None if there are none."""
    counts = (
        training_rows(docs, sample)
        .mapInArrow(_count_grams, "lang string, gram bigint, n bigint")
        .groupBy("lang", "gram")
        .agg(F.sum("n").alias("n"))
        .toArrow()
        .to_pydict()
    )
    rows = sorted(zip(counts["lang"], counts["gram"], counts["n"], strict=True))
    return Model(rows) if rows else None


PREDICTION = T.StructType([T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType())])


def predictor(spark: SparkSession, model: Model | None):
    """A column function: text to (lang, score)."""
    if model is not None and model.nbytes > MODEL_BYTES:
        raise ValueError(f"the model takes {model.nbytes} bytes, over {MODEL_BYTES}; learn from a smaller sample")
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf(PREDICTION)
    def predict(texts: pa.Array) -> pa.Array:
        known = shared.value
        if known is None:
            lang, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
        else:
            bits = known.code_lengths(*utf8_buffer(texts))
            best = bits.argmin(1)
            odds = np.exp2(-np.minimum(bits - bits.min(1, keepdims=True), 1000))
            lang = [known.langs[i] for i in best]
            score = 1 / odds.sum(1)
        return pa.StructArray.from_arrays(
            [pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["lang", "score"]
        )

    return predict


def identify(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``."""
    guess = predictor(docs.sparkSession, model)(F.col(text))
    lettered = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    return (
        docs.withColumn("_guess", guess)
        .withColumn("lang_pred", F.when(lettered, F.col("_guess.lang")).otherwise(UNKNOWN))
        .withColumn(
            "score",
            F.when(F.col("lang_pred") == UNKNOWN, 0.0).otherwise(F.col("_guess.score")),
        )
        .drop("_guess")
    )


def known_language(docs: DataFrame) -> DataFrame:
    """``docs`` with a language: all but those that are ``und``. A short text that fits several languages stays."""
    found = identify(docs.select(F.struct("*").alias("doc"), "text"), learn(docs))
    return found.where(F.col("lang_pred") != UNKNOWN).select("doc.*")


def op3_ppm_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return identify(docs, learn(docs)).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score"
    )
