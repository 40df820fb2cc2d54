"""Words and word windows of whole Arrow batches as 64-bit hashes, in numpy.

A text is read as its UTF-8 bytes. A table of 256 entries maps each byte to itself, to its lower
case, or to 0 for a separator, so a word is a run of bytes that are not 0. Hashes are polynomials
over the bytes (or over the words of a window) modulo 2**64 with a final mix; memory stays within a
few bytes per byte of a batch, and hashing goes by segments, so one very long text is fine.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text worked on at once; a longer single text is one batch of its own.
BATCH_BYTES = 4 << 20
SEGMENT = 1 << 20

_LETTERS = np.random.default_rng(20240517).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
#: Odd multipliers of the byte polynomial and of the two window polynomials, with their inverses.
_BASES = [0x9E3779B97F4A7C15, 0xD1342543DE82EF95, 0xC2B2AE3D27D4EB4F]
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """``base**i`` and ``base**-i`` modulo 2**64 for i < n."""
    known = _POWERS.get(base)
    if known is None or len(known[0]) < n:
        size = max(n, 1 << 16)
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        known = (out[0], out[1])
        if size <= SEGMENT:
            _POWERS[base] = known
    return known


def mix(h: np.ndarray) -> np.ndarray:
    """Final avalanche of a 64-bit hash."""
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def lower_alnum() -> np.ndarray:
    """Words of digits, letters and all non-ASCII characters; A-Z become a-z."""
    table = np.zeros(256, np.uint8)
    for lo, hi in ((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF)):
        table[lo : hi + 1] = np.arange(lo, hi + 1)
    table[0x41:0x5B] = np.arange(0x61, 0x7B)
    return table


def not_space() -> np.ndarray:
    """Words of anything but ASCII white space, unchanged."""
    table = np.arange(256, dtype=np.uint8)
    table[0] = 1  # a NUL belongs to a word; \x01 stands for both in hashes only
    table[[0x20, *range(0x09, 0x0E)]] = 0
    return table


class Texts(NamedTuple):
    """Texts of a batch: their bytes end to end, and where each begins and ends."""

    data: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1


def texts_of(column: pa.Array | pa.ChunkedArray) -> Texts:
    """The bytes of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return Texts(whole[at[0] : at[-1]], at - at[0])


def pieces(batches: Iterator[pa.RecordBatch], *texts: str, most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``most`` bytes of text, counted over the columns ``texts``."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.cumsum(sum(np.diff(texts_of(batch.column(c)).offsets) for c in texts or ("text",)))
        start = 0
        while start < batch.num_rows:
            before = sizes[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(sizes, before + most, "right")))
            yield batch.slice(start, stop - start)
            start = stop


class Words(NamedTuple):
    """Words of a batch of texts in order: byte range, text number, hash; and words before each text."""

    start: np.ndarray
    end: np.ndarray
    text: np.ndarray
    hash: np.ndarray
    first: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def words_of(texts: Texts, table: np.ndarray, hashed: bool = True) -> Words:
    """All words of the texts; a word never reaches over the end of its text."""
    norm = table[texts.data]
    inside = norm != 0
    edge = np.unique(texts.offsets[(texts.offsets > 0) & (texts.offsets < len(norm))])
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    starts[edge] = inside[edge]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    ends[edge - 1] = inside[edge - 1]
    start, end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    first = np.searchsorted(start, texts.offsets)
    first[-1] = len(start)
    text = np.repeat(np.arange(len(texts)), np.diff(first))
    return Words(start, end, text, hashes(norm, start, end) if hashed else np.zeros(0, np.uint64), first)


def hashes(norm: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each byte range; ranges are in order of their start."""
    out = np.empty(len(start), np.uint64)
    at = 0
    while at < len(start):
        low = start[at]
        stop = max(at + 1, int(np.searchsorted(end, low + SEGMENT, "right")))
        high = int(end[at:stop].max())
        power, inverse = _powers(_BASES[0], high - low + 1)
        total = np.zeros(high - low + 1, np.uint64)
        np.cumsum(_LETTERS[norm[low:high]] * power[: high - low], out=total[1:])
        s, e = start[at:stop] - low, end[at:stop] - low
        out[at:stop] = mix((total[e] - total[s]) * inverse[s])
        at = stop
    return out


def windows(hash_: np.ndarray, n: int, which: int = 1) -> np.ndarray:
    """Hash of each ``n`` consecutive words, regardless of texts; ``which`` (1, 2) picks one of two
    independent hashes."""
    count = len(hash_) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    out = np.empty(count, np.uint64)
    for low in range(0, count, SEGMENT):
        high = min(count, low + SEGMENT)
        part = hash_[low : high + n - 1]
        power, inverse = _powers(_BASES[which], len(part) + 1)
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(mix(part + np.uint64(which)) * power[: len(part)], out=total[1:])
        out[low:high] = mix((total[n:] - total[: high - low]) * inverse[: high - low])
    return out


def whole(words: Words, n: int) -> np.ndarray:
    """Whether the window of ``n`` words that starts at each place lies in one text."""
    count = len(words.text) - n + 1
    if count <= 0:
        return np.zeros(0, bool)
    return words.text[:count] == words.text[n - 1 :]


def long_of(h: np.ndarray) -> np.ndarray:
    """Spark has no unsigned long."""
    return h.view(np.int64)
