"""Words of many texts at once, as numpy arrays over their UTF-8 bytes: bounds, hashes, n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Odd 64-bit multipliers for the hashes below. Hash hits are compared with the words themselves.
_BYTE, _WORD, _MIX = (
    np.uint64(0x9E3779B97F4A7C15),
    np.uint64(0xC2B2AE3D27D4EB4F),
    np.uint64(0xD6E8FEB86659FD93),
)
_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)

#: Word bytes of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]``, after lower-casing: 0-9, a-z and all non-ASCII.
ALNUM = np.array([48 <= b < 58 or 97 <= b < 123 or b >= 128 for b in range(256)])
#: Word bytes of ``[^\x20\x09-\x0D]``: all but ASCII white space.
VISIBLE = np.array([b != 32 and not 9 <= b <= 13 for b in range(256)])
LOWER = np.array([b + 32 if 65 <= b < 91 else b for b in range(256)], np.uint8)


def row_blocks(offsets: np.ndarray, limit: int = 500_000) -> Iterator[tuple[int, int]]:
    """Cut the rows into runs of about ``limit`` bytes; a longer row is a run of its own."""
    rows, at = len(offsets) - 1, 0
    while at < rows:
        end = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
        end = min(max(end, at + 1), rows)
        yield at, end
        at = end


def find_words(
    data: np.ndarray, offsets: np.ndarray, kind: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and each row's first word (one more than rows).

    ``data`` holds the rows end to end, ``offsets`` start at 0; a word never spans two rows.
    """
    inside = kind[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.empty(len(data), bool)
    before[:1] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.empty(len(data), bool)
    after[-1:] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def _power_table(size: int) -> np.ndarray:
    global _powers
    if len(_powers) < size:
        grown = np.full(max(size, 64), _BYTE, np.uint64)
        grown[0] = 1
        _powers = np.multiply.accumulate(grown)
    return _powers


def _inverse_table(size: int) -> np.ndarray:
    """Powers of the number that gives 1 times ``_BYTE``, modulo 2^64."""
    global _inverses
    if len(_inverses) < size:
        grown = np.full(max(size, 64), pow(int(_BYTE), -1, 1 << 64), np.uint64)
        grown[0] = 1
        _inverses = np.multiply.accumulate(grown)
    return _inverses


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX
    h = (h ^ (h >> np.uint64(29))) * _MIX
    return h ^ (h >> np.uint64(32))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    if len(starts) == 0:
        return np.empty(0, np.uint64)
    # Letters times powers, summed: of running sums over all bytes, the power at a word's start is taken out again.
    base = int(starts[0])
    size = int(ends[-1]) - base
    if size > 1_000_000 and len(starts) > 1:
        half = len(starts) // 2
        return np.concatenate([word_hashes(data, starts[k], ends[k]) for k in (slice(half), slice(half, None))])
    letters = data[base : base + size].astype(np.uint64)
    letters += np.uint64(1)
    letters *= _power_table(size)[:size]
    sums = np.zeros(size + 1, np.uint64)
    np.cumsum(letters, out=sums[1:])
    return mix((sums[ends - base] - sums[starts - base]) * _inverse_table(size)[starts - base])


def ngram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of every ``n`` words in a row (of all rows: the caller drops those across rows)."""
    count = len(words) - n + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(count, np.uint64)
    for k in range(n):
        out *= _WORD
        out += words[k : k + count]
    return mix(out)


def window_minima(values: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The least of every ``width`` values in a row, and where it is first found."""
    count = len(values) - width + 1
    if count <= 0:
        return np.empty(0, values.dtype), np.empty(0, np.int64)
    least, span = values, 1
    while span * 2 <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    least = np.minimum(least[:count], least[width - span :][:count])
    at = np.zeros(count, np.int64)
    for k in range(width - 1, -1, -1):
        at[values[k : k + count] == least] = k
    return least, at + np.arange(count)
