"""Packing of documents into sequences of fixed capacity.

A document is its token ids and an end mark. A longer one than a sequence is cut into pieces of the capacity, of
which the first may be shorter; all others are one piece. A piece lies whole in one sequence, pieces follow
each other without gaps, and there are as few sequences as the method finds.

The lengths of all pieces are counted exactly; that histogram, of at most ``capacity`` numbers, is all that is
solved for, however many pieces there are:

1. A configuration is a multiset of lengths that fits a sequence. The configuration linear program asks how often
   to use each so that all pieces are covered by the fewest sequences. It is solved by multiplicative weights: every
   length has a price, at first its share of a sequence, that falls exponentially with the share of its pieces
   covered so far. Each turn prices configurations by the knapsack recursion over the capacity, which
   gives the best configuration with each length in it at once; those within ``SLACK`` of the best of all are
   used for a small share of the pieces. The prices of each turn also prove a lower bound.
2. Rounding. Each configuration is used as often as the whole part of its value and the pieces left allow.
   What is left is solved for again, while it is much; then configurations are filled up one by one, with the
   longest piece left and beside it the exact fullest set (a knapsack over the pieces left), or the longest that fit,
   whichever ends with fewer sequences, each used as often as it can be. Every turn here uses up a length, so
   turns do not grow with the pieces.
3. A piece's rank among those of its length, from the counts of each task, tells its configuration, sequence
   and offset: a look-up in a table whose size only the capacity and the number of turns bound.

Defined cases: null and empty texts are documents of the end mark alone; a very long text is many pieces; rows that
repeat an id are documents each; an empty table gives no pieces; columns beside id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from declarium.llm import store
from declarium.llm.tokens import JsonVocabulary
from declarium.llm.words import pieces

#: Turns of pricing of the first solution, for large problems and for small ones; the share of them for what is
#: left, and how often that is solved.
TURNS, MOST_TURNS, LEFT, ROUNDS = 200, 2000, 0.3, 6
#: A turn covers at most this share of a length; a configuration may be this far from the best of its turn.
STEP, SLACK = 0.01, 0.01
#: How fast the price of a length falls with the share of its pieces that is covered.
RATE = 5.0
#: Rows of a table of tasks and lengths that may be sent to all tasks.
MOST_SENT = 200_000


class Packing(NamedTuple):
    """``configurations`` (lengths and how often each stands in it) with the number of sequences of each, and a
    proven lower bound of the number of sequences."""

    configurations: list[tuple[tuple[tuple[int, int], ...], int]]
    lower_bound: int

    @property
    def sequences(self) -> int:
        return sum(times for _, times in self.configurations)


def _knapsack(lengths: np.ndarray, price: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The greatest price of lengths within each capacity, and the number of a length that is in it (-1: none)."""
    best, chosen = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    fits = np.searchsorted(lengths, np.arange(capacity + 1), "right")
    for room in range(1, capacity + 1):
        best[room], chosen[room] = best[room - 1], -1
        if fits[room]:
            value = best[room - lengths[: fits[room]]] + price[: fits[room]]
            k = int(value.argmax())
            if value[k] > best[room]:
                best[room], chosen[room] = value[k], k
    return best, chosen


def _traced(chosen: np.ndarray, lengths: np.ndarray, room: int, first: int) -> tuple[tuple[int, int], ...]:
    """The configuration of the length numbered ``first`` and the best that fits beside it."""
    used = {first: 1}
    room -= int(lengths[first])
    while room > 0:
        k = int(chosen[room])
        if k < 0:
            room -= 1
        else:
            used[k] = used.get(k, 0) + 1
            room -= int(lengths[k])
    return tuple(sorted(used.items()))


def _fractional(lengths: np.ndarray, count: np.ndarray, capacity: int, turns: int) -> tuple[dict[tuple, float], float]:
    """Multiplicative weights: configurations (by numbers of lengths) with their values, and a lower bound. The
    values are those of the later half of the turns, when prices have settled."""
    values: dict[tuple, float] = {}
    covered = np.zeros(len(lengths))
    area, bound = lengths / capacity, 0.0
    for number in range(turns):
        price = area * np.exp(-RATE * (covered - covered.min()))
        best, chosen = _knapsack(lengths, price, capacity)
        bound = max(bound, float((count * price).sum() / best[capacity]))
        value = price + best[capacity - lengths]
        turn = {}
        for k in np.flatnonzero(value >= (1 - SLACK) * best[capacity]).tolist():
            c = _traced(chosen, lengths, capacity, k)
            own = min(count[i] / a for i, a in c)
            turn[c] = max(turn.get(c, 0.0), own)
        if not turn:
            break
        used = np.zeros(len(lengths))
        for c, amount in turn.items():
            for i, a in c:
                used[i] += a * amount
        share = count / np.maximum(used, count)
        for c, amount in turn.items():
            amount *= STEP * min(share[i] for i, _ in c)
            if number >= turns // 2:
                values[c] = values.get(c, 0.0) + amount
            for i, a in c:
                covered[i] += a * amount / count[i]
    # As much text as there is.
    total = sum(v * sum(a * lengths[i] for i, a in c) for c, v in values.items())
    scale = (count * lengths).sum() / total if total else 0.0
    return {c: v * scale for c, v in values.items()}, bound


def _fullest(lengths: np.ndarray, left: np.ndarray, room: int) -> list[tuple[int, int]]:
    """Numbers of lengths, and how often, of the fullest set of the pieces ``left`` within ``room``."""
    reach, steps = 1, []
    limit = (1 << room + 1) - 1
    for k in range(len(lengths) - 1, -1, -1):
        n = int(lengths[k])
        if left[k] <= 0 or n > room:
            continue
        before = reach
        for _ in range(min(int(left[k]), room // n)):
            wider = reach | (reach << n) & limit
            if wider == reach:
                break
            reach = wider
        steps.append((k, n, before))
        if reach >> room & 1:
            break
    at, out = reach.bit_length() - 1, []
    for k, n, before in reversed(steps):
        times = 0
        while not before >> at & 1:
            at -= n
            times += 1
        if times:
            out.append((k, times))
    return out


def _longest(lengths: np.ndarray, left: np.ndarray, room: int) -> list[tuple[int, int]]:
    """The same of the longest piece that fits, and the longest that fits then, and so on."""
    out = []
    for k in range(len(lengths) - 1, -1, -1):
        times = min(int(left[k]), room // int(lengths[k]))
        if times > 0:
            out.append((k, times))
            room -= times * int(lengths[k])
    return out


def _filled(lengths: np.ndarray, left: np.ndarray, capacity: int, beside) -> list[tuple[tuple, int]]:
    """Configurations for all pieces ``left``: the longest, and what ``beside`` finds to it, as often as there are such pieces."""
    left, out = left.copy(), []
    while left.any():
        longest = int(np.flatnonzero(left)[-1])
        left[longest] -= 1
        c = dict(beside(lengths, left, capacity - int(lengths[longest])))
        left[longest] += 1
        c[longest] = c.get(longest, 0) + 1
        times = min(int(left[i]) // a for i, a in c.items())
        for i, a in c.items():
            left[i] -= a * times
        out.append((tuple(sorted(c.items())), times))
    return out


def solve(histogram: dict[int, int], capacity: int) -> Packing:
    """Configurations that hold exactly the pieces of the histogram (length to number)."""
    full = histogram.get(capacity, 0)
    listed = sorted((n, c) for n, c in histogram.items() if c > 0 and n < capacity)
    lengths, left = np.array([n for n, _ in listed], np.int64), np.array([c for _, c in listed], np.int64)
    used: dict[tuple, int] = {}

    def take(c: tuple, times: int) -> None:
        times = min([times, *(int(left[i]) // a for i, a in c)])
        if times > 0:
            used[c] = used.get(c, 0) + times
            for i, a in c:
                left[i] -= a * times

    # No two pieces of more than half a sequence stand together.
    bound = max(-(-int((lengths * left).sum()) // capacity), int(left[2 * lengths > capacity].sum()))
    for turn in range(ROUNDS):
        some = np.flatnonzero(left)
        if len(some) < 2 or (lengths * left).sum() < 4 * len(some) * capacity:
            break
        # A turn looks at every capacity and traces a configuration for every length.
        turns = min(MOST_TURNS, max(TURNS, 400_000 // (capacity + 4 * len(some))))
        values, proven = _fractional(lengths[some], left[some].astype(float), capacity, int(turns * LEFT) if turn else turns)
        if not turn:
            bound = max(bound, int(np.ceil(proven * (1 - 1e-9))))
        before = left.sum()
        for c, v in sorted(values.items(), key=lambda x: (-x[1], x[0])):
            take(tuple((int(some[i]), a) for i, a in c), int(v))
        if left.sum() == before:
            break
    rest = min((_filled(lengths, left, capacity, beside) for beside in (_fullest, _longest)), key=lambda f: sum(times for _, times in f))
    for c, times in rest:
        used[c] = used.get(c, 0) + times
    out = [(((capacity, 1),), full)] if full else []
    out += [(tuple((int(lengths[i]), a) for i, a in c), times) for c, times in used.items()]
    return Packing(out, bound + full)


def _places(packing: Packing) -> dict[str, np.ndarray]:
    """By length and rank within it, from where on: the first sequence, how many stand in each, at which offset."""
    rows, done, begin = [], {}, 0
    for c, times in packing.configurations:
        offset = 0
        for n, a in c:
            rows.append((n, done.get(n, 0), begin, a, offset))
            done[n] = done.get(n, 0) + times * a
            offset += n * a
        begin += times
    x = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return {"key": x[:, 0] << 44 | x[:, 1], "rank": x[:, 1], "begin": x[:, 2], "each": x[:, 3], "offset": x[:, 4]}


def cut_documents(docs: DataFrame, vocabulary: JsonVocabulary, capacity: int, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """A row per piece: ``part`` and ``place`` (the task, and the rank among its pieces of that length), ``doc_id``,
    ``piece``, ``start``, ``length`` and ``ids`` (little-endian unsigned 32-bit)."""
    sent = store.sent(docs.sparkSession, vocabulary)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, part = sent(), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in pieces(batches):
            ids, at = v.encode(batch.column("text"))
            n = np.diff(at) + 1
            marked = np.insert(ids, at[1:], v.end).astype("<u4")
            begin = at[:-1] + np.arange(len(n))
            many = -(-n // capacity)
            owner = np.repeat(np.arange(len(n)), many)
            piece = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
            short = n - (many - 1) * capacity
            start = np.where(piece > 0, short[owner] + (piece - 1) * capacity, 0)
            length = np.where(piece > 0, capacity, short[owner])
            order = np.argsort(length, kind="stable")
            own = np.bincount(length, minlength=capacity + 1)
            place = np.empty(len(length), np.int64)
            place[order] = np.arange(len(length)) - np.repeat(np.cumsum(own) - own, own) + seen[length[order]]
            seen += own
            offsets = np.append((begin[owner] + start), len(marked)) * 4
            packed = pa.Array.from_buffers(pa.binary(), len(owner), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(marked.tobytes())])
            columns = [np.full(len(owner), part, np.int64), place, batch.column("doc_id").take(pa.array(owner)), piece.astype(np.int32), start, length]
            yield pa.RecordBatch.from_arrays([*(c if isinstance(c, pa.Array) else pa.array(c) for c in columns), packed], ["part", "place", "doc_id", "piece", "start", "length", "ids"])

    texts = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    return texts.mapInArrow(cut, "part long, place long, doc_id long, piece int, start long, length long, ids binary")


def pack(docs: DataFrame, path: str, end: int = 2, capacity: int = 1024, id_column: str = "doc_id", text_column: str = "text") -> tuple[DataFrame, Packing]:
    """A row per piece: ``doc_id``, ``piece``, ``start``, ``length``, ``ids``, ``sequence_id`` (from 0) and ``offset``; and
    the packing. ``path`` is the vocabulary as JSON, ``end`` the id that ends a document."""
    if not 1 <= capacity < 1 << 19:
        raise ValueError("a capacity from 1 to 524287")
    spark = docs.sparkSession
    table, _ = store.parked(cut_documents(docs, JsonVocabulary(path, end), capacity, id_column, text_column))
    counts, folder = store.parked(table.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")))
    packing = solve({r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}, capacity)
    # At most a row per task of a length: no length is too much for one window.
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    begins, _ = store.parked(counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("begin")))
    store.remove(spark, folder)
    sent = store.sent(spark, _places(packing))

    @F.pandas_udf("sequence_id long, offset long")
    def placed(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        t, n, r = sent(), length.to_numpy(), rank.to_numpy()
        at = np.searchsorted(t["key"], n << 44 | r, "right") - 1
        along = r - t["rank"][at]
        return pd.DataFrame({"sequence_id": t["begin"][at] + along // t["each"][at], "offset": t["offset"][at] + along % t["each"][at] * n})

    side = F.broadcast(begins) if begins.count() <= MOST_SENT else begins
    ranked = table.join(side, ["part", "length"]).withColumn("at", placed("length", F.col("begin") + F.col("place")))
    return ranked.select("doc_id", "piece", "start", "length", "ids", "at.sequence_id", "at.offset"), packing


def sequences(packed: DataFrame) -> DataFrame:
    """A row per sequence: ``sequence_id``, ``n_tokens``, ``ids`` (its pieces' ids end to end) and ``pieces`` (document and
    piece, start in the sequence and length of each)."""
    one = F.struct("offset", "length", "doc_id", "piece", "ids")
    grouped = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(one)).alias("x"), F.sum("length").alias("n_tokens"))
    # concat takes a fixed number of binaries; as hexadecimal text any number can be joined.
    ids = F.unhex(F.array_join(F.transform("x", lambda p: F.hex(p["ids"])), ""))
    listed = F.transform("x", lambda p: F.struct(p["doc_id"].alias("doc_id"), p["piece"].alias("piece"), p["offset"].alias("offset"), p["length"].alias("length")))
    return grouped.select("sequence_id", "n_tokens", ids.alias("ids"), listed.alias("pieces"))
