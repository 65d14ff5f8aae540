"""Byte-level BPE encoding and decoding by longest matches and backtracking.

A vocabulary's bytes are mapped to Latin-1 characters, so that an Aho-Corasick automaton over
characters finds the tokens that start at each byte of a piece. The encoder takes the longest token
at a position, and goes on to shorter ones, or one token back, while the last two tokens could not
stand side by side in a merged text. Which pairs can is memoised. A position found to be a dead end is
never tried again, so the time is linear in the piece. The result is exactly that of merging pairs by
rank.

Rows: a null text is empty and has no ids. A malformed UTF-8 byte counts as U+FFFD. Repeated rows
give repeated results. A column of the result's name is replaced. Ids that are null or outside the
vocabulary make the decoded value null.
"""

from __future__ import annotations

import base64
import re
from array import array

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keyferry.llm.common import list_array, table, unicode_rows
from keyferry.llm.words import row_blocks

#: Pieces and pairs that a worker remembers before it starts afresh; results don't depend on it.
MEMO = 600_000


def read_ranks(path: str) -> bytes:
    """The vocabulary file: a base64 token and its rank per line."""
    with open(path, "rb") as file:
        return file.read()


class Vocabulary:
    """A rank file's tokens, and how they merge."""

    def __init__(self, ranks: bytes, pattern: str):
        pairs = [line.split() for line in ranks.splitlines() if line.strip()]
        self.rank = {base64.b64decode(token): int(rank) for token, rank in pairs}
        size = max(self.rank.values()) + 1
        self.token: list[bytes | None] = [None] * size
        for token, rank in self.rank.items():
            self.token[rank] = token
        self.length = [len(t) if t is not None else 0 for t in self.token]
        self.split = [(r, r) for r in range(size)]
        self.merged: dict[int, int] = {}
        self.shorter = [-1] * size
        self._fits: dict[int, bool] = {}
        self._learn_merges()
        self.pieces = _Pieces(self)
        self._wide = regex.compile(pattern)
        self._narrow = re.compile(_latin1_only(pattern))

    def _learn_merges(self) -> None:
        """Find for each token, by rank, the two tokens that it is merged from."""
        mergeable = set()
        for rank, token in sorted((r, t) for t, r in self.rank.items()):
            prefixes = [token[:k] for k in range(len(token) - 1, 0, -1)]
            for left in (self.rank[p] for p in prefixes if p in self.rank):
                right = self.rank.get(token[self.length[left] :], -1)
                if right < 0 or max(left, right) >= rank:
                    continue
                if self._may_meet(left, right):
                    self.merged[left << 32 | right] = rank
                    self.split[rank] = (left, right)
                    mergeable.add(token)
                    break
            if len(token) == 1:
                mergeable.add(token)
        self.automaton = ahocorasick.Automaton()
        for token in mergeable:
            self.automaton.add_word(token.decode("latin-1"), self.rank[token])
            for k in range(len(token) - 1, 0, -1):
                if token[:k] in mergeable:
                    self.shorter[self.rank[token]] = self.rank[token[:k]]
                    break
        self.automaton.make_automaton()

    def _may_meet(self, left: int, right: int) -> bool:
        """Would merging by rank leave these two tokens side by side?

        Undo the later of both merges again and again. If at any time the two halves at the border
        would have merged with each other before the halves' own merge, the border can't stand.
        """
        before = 1 << 62
        while True:
            if self.merged.get(left << 32 | right, before) < before:
                return False
            if left > right:
                before, (_, inner) = left, self.split[left]
                if inner != left:
                    left = inner
                    continue
                before, (outer, _) = right + 1, self.split[right]
                if outer == right:
                    return True
                right = outer
            else:
                before, (outer, _) = right + 1, self.split[right]
                if outer != right:
                    right = outer
                    continue
                before, (_, inner) = left, self.split[left]
                if inner == left:
                    return True
                left = inner

    def fits(self, left: int, right: int) -> bool:
        key = left << 32 | right
        known = self._fits.get(key)
        if known is None:
            if len(self._fits) >= MEMO:
                self._fits.clear()
            known = self._fits[key] = self._may_meet(left, right)
        return known

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one match of the splitting pattern."""
        if piece in self.rank:
            return [self.rank[piece]]
        length, shorter, fits, known = self.length, self.shorter, self.fits, self._fits.get
        longest = [-1] * (len(piece) + 1)
        for end, token in self.automaton.iter(piece.decode("latin-1")):
            longest[end + 1 - length[token]] = token  # longer tokens end later
        open_at = bytearray(b"\1") * (len(piece) + 1)
        out: list[int] = []
        at, token, last, size = 0, longest[0], -1, len(piece)
        while at < size:
            end = at + length[token]
            may = open_at[end]
            if may and last >= 0:
                may = known(last << 32 | token)
                if may is None:
                    may = fits(last, token)
            if may:
                out.append(token)
                at, last, token = end, token, longest[end]
            elif shorter[token] >= 0:
                token = shorter[token]
            else:
                open_at[at] = 0
                token = out.pop()
                at -= length[token]
                last = out[-1] if out else -1
        return out

    def split_text(self, text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self._wide.findall(text)
        return self._narrow.findall(text)

    def encode(self, text: str) -> np.ndarray:
        self.pieces.make_room()
        joined = b"".join(map(self.pieces.__getitem__, self.split_text(text)))
        return np.frombuffer(joined, np.int32)


    def decode_rows(self, rows: pa.ListArray) -> pa.Array:
        """The bytes of each row of ids; null for a null row and one with a null or unknown id."""
        counts = rows.value_lengths().fill_null(0).to_numpy()
        starts = np.concatenate([[0], np.cumsum(counts)])
        flat = rows.flatten()
        # One more token, without bytes, stands for all null and unknown ids.
        sizes, spelled, data = np.array([*self.length, 0]), [*self.token, b""], []
        ends, valid = np.zeros(len(rows) + 1, np.int64), rows.is_valid().to_numpy(zero_copy_only=False).copy()
        for lo, hi in row_blocks(starts, 200_000):
            a, z = starts[lo], starts[hi]
            ids = flat.slice(a, z - a).cast(pa.int64()).fill_null(-1).to_numpy()
            ids = np.where((ids >= 0) & (ids < len(self.token)), ids, -1)
            ids[sizes[ids] == 0] = -1
            data.append(b"".join(map(spelled.__getitem__, ids.tolist())))
            at = np.concatenate([[0], np.cumsum(sizes[ids])])
            ends[lo + 1 : hi + 1] = ends[lo] + at[starts[lo + 1 : hi + 1] - a]
            bad = np.concatenate([[0], np.cumsum(ids < 0)])[starts[lo : hi + 1] - a]
            valid[lo:hi] &= bad[1:] == bad[:-1]
        return pa.Array.from_buffers(
            pa.binary(),
            len(rows),
            [
                pa.py_buffer(np.packbits(valid, bitorder="little")),
                pa.py_buffer(ends.astype(np.int32)),
                pa.py_buffer(b"".join(data)),
            ],
        )


class _Pieces(dict):
    """Ids of the pieces met so far, as 32-bit integers in bytes."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, piece: str) -> bytes:
        ids = array("i", self.vocabulary.encode_piece(piece.encode())).tobytes()
        if len(piece) <= 64:
            self[piece] = ids
        return ids

    def make_room(self) -> None:
        if len(self) >= MEMO:
            self.clear()


def _latin1_only(pattern: str) -> str:
    """The same pattern for texts within Latin-1, with its classes spelled out: ``re`` is faster there."""
    spelled = {
        name: "".join(f"\\x{c:02x}" for c in range(256) if regex.match(name, chr(c)))
        for name in (r"\p{L}", r"\p{N}", r"\s")
    }
    inside = re.sub(
        r"\[[^\]]*\]", lambda m: re.sub(r"\\p\{[LN]\}|\\s", lambda n: spelled[n[0]], m[0]), pattern
    )
    outside = re.sub(r"\\p\{[LN]\}|\\s", lambda m: f"[{spelled[m[0]]}]", inside)
    return outside.replace(r"\S", f"[^{spelled[chr(92) + 's']}]")


_loaded: dict[tuple[int, str], Vocabulary] = {}


def _vocabulary(shared, pattern: str) -> Vocabulary:
    """One vocabulary per worker process, however many batches it gets."""
    key = (hash(shared.value), pattern)
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Vocabulary(shared.value, pattern)
    return _loaded[key]


def encoder(spark: SparkSession, ranks: bytes, pattern: str):
    """A column function: text to array of token ids. ``ranks`` is the vocabulary file's content."""
    shared = spark.sparkContext.broadcast(ranks)

    @F.arrow_udf("array<int>")
    def encode(texts: pa.Array) -> pa.Array:
        vocabulary = _vocabulary(shared, pattern)
        rows = [vocabulary.encode(text) for text in unicode_rows(texts)]
        flat = np.concatenate(rows) if rows else np.empty(0, np.int32)
        return list_array(flat, np.array([len(r) for r in rows], np.int64))

    return encode


def decoder(spark: SparkSession, ranks: bytes, pattern: str):
    """A column function: array of token ids to bytes."""
    shared = spark.sparkContext.broadcast(ranks)

    @F.arrow_udf("binary")
    def decode(ids: pa.Array) -> pa.Array:
        return _vocabulary(shared, pattern).decode_rows(ids)

    return decode


def encode_documents(
    docs: DataFrame, ranks: bytes, pattern: str, text: str = "text", ids: str = "ids"
) -> DataFrame:
    """``docs`` with a column of token ids."""
    return docs.withColumn(ids, encoder(docs.sparkSession, ranks, pattern)(F.col(text)))


def decode_documents(
    docs: DataFrame, ranks: bytes, pattern: str, ids: str = "ids", decoded: str = "decoded"
) -> DataFrame:
    """``docs`` with the bytes that the ids stand for."""
    return docs.withColumn(decoded, decoder(docs.sparkSession, ranks, pattern)(F.col(ids)))


def digest(ids: Column) -> Column:
    return F.sha2(F.array_join(ids.cast("array<string>"), ","), 256)


def default_vocabulary() -> tuple[bytes, str]:
    """The multilingual public vocabulary and its splitting pattern."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return read_ranks(path), public_tokenizers.PATTERN


def encoded_digests(docs: DataFrame, ranks: bytes, pattern: str) -> DataFrame:
    both = decode_documents(
        encode_documents(docs.select("doc_id", "text"), ranks, pattern), ranks, pattern
    )
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        digest(F.col("ids")).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded_digests(table(spark, sf_dir, "documents"), *default_vocabulary())
