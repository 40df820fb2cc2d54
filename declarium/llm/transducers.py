"""Weighted acyclic automata that map phrases of up to three symbols to counts, in numpy.

A transducer has a layer of transitions for each word of a phrase. A transition has a symbol, a weight (how
often the phrase read so far occurs; 0 if it is only a beginning) and the state that follows. It is built from
phrases in sorted order, so all that begin alike stand together: a state is complete where the next phrase
leaves its prefix, and a complete state equal to an earlier one of its layer is that one. So the many
prefixes with the same few, mostly single, continuations share their states.

A union adds up the weights of phrases; a composition with a sorted list of phrases looks their weights up,
a layer at a time.
"""

from __future__ import annotations

import struct
from typing import NamedTuple

import numpy as np
import pyarrow as pa

from declarium.llm.words import mix

LAYERS = 3
#: Bits of a symbol's number in a packed phrase.
BITS = 21
MOST_PACKED = (1 << BITS) - 2


class Phrases(NamedTuple):
    """Sorted distinct phrases: by word the symbol's number plus 1, 0 where the phrase has ended."""

    words: list[np.ndarray]
    count: np.ndarray


class Layer(NamedTuple):
    """Transitions of state ``s`` are those from ``first[s]`` to ``first[s + 1]``, by symbol."""

    first: np.ndarray
    symbol: np.ndarray
    weight: np.ndarray
    target: np.ndarray


class Transducer(NamedTuple):
    """``symbols``, sorted, name the numbers in the layers. The first layer has one state, the start."""

    symbols: np.ndarray
    layers: list[Layer]


def keys(words: list[np.ndarray]) -> np.ndarray:
    """Phrases as one number each, in the same order; for symbols up to ``MOST_PACKED``."""
    key = np.zeros(len(words[0]), np.uint64)
    for w in words:
        key <<= np.uint64(BITS)
        key |= w.astype(np.uint64)
    return key


def _summed(new: np.ndarray, count: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Where a new phrase begins, and the sum of its counts."""
    at = np.flatnonzero(new)
    if count is None:
        return at, np.diff(np.append(at, len(new)))
    return at, np.add.reduceat(count, at) if len(at) else np.zeros(0, np.int64)


def counted_keys(key: np.ndarray, count: np.ndarray | None) -> Phrases:
    """Equal phrases once, sorted, with the sum of their counts (how often they are listed without any)."""
    if count is None:
        key.sort()
    else:
        order = np.argsort(key)
        key, count = key[order], count[order]
        del order
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    at, count = _summed(new, count)
    key, low = key[at], np.uint64((1 << BITS) - 1)
    return Phrases([(key >> np.uint64(BITS * (LAYERS - 1 - k)) & low).astype(np.int32) for k in range(LAYERS)], count)


def counted(words: list[np.ndarray], count: np.ndarray | None, n_symbols: int) -> Phrases:
    """The same of phrases as their words."""
    if n_symbols <= MOST_PACKED:
        return counted_keys(keys(words), count)
    order = np.lexsort(words[::-1])
    words = [w[order] for w in words]
    new = np.ones(len(order), bool)
    new[1:] = np.logical_or.reduce([w[1:] != w[:-1] for w in words])
    at, count = _summed(new, None if count is None else count[order])
    return Phrases([w[at] for w in words], count)


def _shared(first: np.ndarray, columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Number of the state each slice becomes, and the slices and columns that are kept, each once."""
    size = np.diff(first)
    h = size.astype(np.uint64)
    if len(columns[0]):
        own = np.zeros(len(columns[0]), np.uint64)
        for c in columns:
            own = mix(own + c.astype(np.uint64) + np.uint64(1))
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(own)])
        h = mix(h + total[first[1:]] - total[first[:-1]])
    _, at, number = np.unique(h, return_index=True, return_inverse=True)
    like = first[at[number]]
    where = np.arange(len(columns[0])) + np.repeat(like - first[:-1], size)
    same = size == size[at[number]]
    if not same.all() or any((c != c[np.minimum(where, len(c) - 1)]).any() for c in columns):
        return np.arange(len(size)), first, columns  # two states of one hash: none are shared
    kept = _slices(first, at)
    return number, np.concatenate([[0], np.cumsum(size[at])]), [c[kept] for c in columns]


def _slices(first: np.ndarray, states: np.ndarray) -> np.ndarray:
    """Places of all transitions of the states, one state after another."""
    size = first[states + 1] - first[states]
    return np.arange(size.sum()) + np.repeat(first[states] - np.concatenate([[0], np.cumsum(size)[:-1]]), size)


def build(symbols: np.ndarray, phrases: Phrases) -> Transducer:
    """The transducer of sorted phrases, with the symbols they use."""
    used = np.unique(np.concatenate(phrases.words))
    used = used[used > 0]
    symbols = symbols[used - 1]
    words = [np.where(w > 0, np.searchsorted(used, w) + 1, 0) for w in phrases.words]
    n = len(phrases.count)
    begins = np.zeros(n, bool)
    begins[:1] = True
    layers: list[Layer] = []
    starts = []
    for w in words:
        # Where a phrase differs from the one before in its words so far; it has that many words.
        begins[1:] |= w[1:] != w[:-1]
        starts.append(np.flatnonzero(begins & (w > 0)))
    target = None
    for k in reversed(range(LAYERS)):
        at = starts[k]
        ends = np.ones(len(at), bool) if k == LAYERS - 1 else words[k + 1][at] == 0
        weight = np.where(ends, phrases.count[at], 0)
        target = np.zeros(len(at), np.int64) if target is None else target
        above = starts[k - 1] if k else np.zeros(1, np.int64)
        first = np.append(np.searchsorted(at, above), len(at))
        if not k:
            first[0] = 0
        states, first, columns = _shared(first, [words[k][at], weight, target]) if k else (None, first, [words[k][at], weight, target])
        layers.insert(0, Layer(first, *columns))
        target = states
    return Transducer(symbols, layers)


def paths(t: Transducer) -> Phrases:
    """All phrases of a weight above 0, in no particular order of their lengths."""
    words, counts = [[] for _ in range(LAYERS)], []
    state, prefix = np.zeros(1, np.int64), []
    for k, layer in enumerate(t.layers):
        at = _slices(layer.first, state)
        size = layer.first[state + 1] - layer.first[state]
        prefix = [np.repeat(p, size) for p in prefix] + [layer.symbol[at]]
        keep = layer.weight[at] > 0
        counts.append(layer.weight[at][keep])
        for j in range(LAYERS):
            words[j].append(prefix[j][keep] if j <= k else np.zeros(int(keep.sum()), np.int64))
        state = layer.target[at]
    return Phrases([np.concatenate(w) for w in words], np.concatenate(counts))


def united(parts: list[bytes]) -> tuple[np.ndarray, Phrases]:
    """The union of packed transducers with the sums of their weights, as symbols and sorted phrases."""
    symbols = np.unique(np.concatenate([np.zeros(0, np.uint64), *(next(_arrays(p)) for p in parts)]))
    small, found, counts = len(symbols) <= MOST_PACKED, [], []
    for p in parts:
        t = unpacked(p)
        own = paths(t)
        number = np.concatenate([[0], np.searchsorted(symbols, t.symbols) + 1])
        words = [number[w] for w in own.words]
        found.append([keys(words)] if small else words)
        counts.append(own.count)
    none = np.zeros(0, np.uint64 if small else np.int64)
    columns = [np.concatenate([none, *x]) for x in (zip(*found) if found else [()] * (1 if small else LAYERS))]
    count = np.concatenate([np.zeros(0, np.int64), *counts])
    del found, counts
    return symbols, counted_keys(columns[0], count) if small else counted(columns, count, len(symbols))


def looked_up(t: Transducer, phrases: list[np.ndarray]) -> np.ndarray:
    """Weights of phrases given by symbol, 0 where a phrase has ended; 0 for those the transducer has not."""
    n = len(phrases[0])
    weight, state, alive = np.zeros(n, np.int64), np.zeros(n, np.int64), np.ones(n, bool)
    if not len(t.symbols):
        return weight
    for layer, s in zip(t.layers, phrases):
        alive &= s > 0
        number = np.minimum(np.searchsorted(t.symbols, s), len(t.symbols) - 1)
        alive &= t.symbols[number] == s
        own = np.repeat(np.arange(len(layer.first) - 1), np.diff(layer.first)) << 32 | layer.symbol
        key = state << 32 | (number + 1)
        at = np.minimum(np.searchsorted(own, key), max(0, len(own) - 1))
        alive &= own[at] == key if len(own) else False
        weight = np.where(s > 0, 0, weight)
        weight[alive] = layer.weight[at[alive]]
        state = np.where(alive, layer.target[at] if len(own) else 0, 0)
    return weight


def _least(x: np.ndarray) -> np.ndarray:
    """The numbers in as few bytes each as they need."""
    most = int(x.max()) if len(x) else 0
    return x.astype(next(k for k in (np.uint8, np.uint16, np.uint32, np.uint64) if most <= np.iinfo(k).max))


def packed(t: Transducer) -> bytes:
    arrays = [t.symbols] + [_least(np.diff(x) if k == 0 else x) for layer in t.layers for k, x in enumerate(layer)]
    head = struct.pack(f"<{2 * len(arrays)}I", *[v for a in arrays for v in (a.itemsize, len(a))])
    raw = head + b"".join(a.tobytes() for a in arrays)
    return struct.pack("<Q", len(raw)) + pa.compress(raw, codec="zstd", asbytes=True)


def _arrays(data: bytes):
    """The symbols, then the arrays of each layer."""
    size, n = struct.unpack("<Q", data[:8])[0], 1 + LAYERS * 4
    raw = pa.decompress(data[8:], decompressed_size=size, codec="zstd", asbytes=True)
    head, at = struct.unpack(f"<{2 * n}I", raw[: 8 * n]), 8 * n
    for width, length in zip(head[::2], head[1::2]):
        yield np.frombuffer(raw, f"<u{width}", length, at)
        at += width * length


def unpacked(data: bytes) -> Transducer:
    symbols, *rest = _arrays(data)
    rest = [a.astype(np.int64) for a in rest]
    layers = [Layer(np.concatenate([[0], np.cumsum(rest[k])]), *rest[k + 1 : k + 4]) for k in range(0, len(rest), 4)]
    return Transducer(symbols, layers)
