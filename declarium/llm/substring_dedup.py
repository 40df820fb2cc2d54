"""Substring dedup by level-wise doubling.

A window is a run of consecutive words of one document. Removed is every word that a window of
``length`` words covers whose word sequence also starts in a document with a smaller id.

Levels. The first level are windows of half the length, taken at content-defined places only: for each
full window the one half window in it whose hash is smallest. Equal full windows hold equal half
windows, so a full window is a candidate only if its half window occurs in two documents. The second
level are all candidate windows of the full length; they decide what is removed. From there on only
what repeats is extended: of a stretch of repeated words, windows of twice the length are looked up at
content-defined places, and only stretches with a repeated window go on to the next length, until no
candidate survives. The last length that repeats is reported as ``longest`` (a stretch of one and a half times
a level's length is always seen at that level; what is removed does not depend on it).

How a level is looked up. Documents lie in blocks of bounded size (a bucketed table, so each pass reads
its blocks without moving text). A block sends each of its hashes once, with the smallest document of
the block that has it, to the part of the hash space it belongs to; a part answers with two bits for
each hash: is it repeated, and is the block's smallest document the smallest of all. A passage in a
third of all documents is one entry per block there, so no part grows with the frequency of a passage.

Defined cases: null and empty texts have no words and keep the empty text; texts shorter than a window
keep all; rows that repeat an id are separate rows that never remove from each other; a row with a null
id neither removes nor loses anything; an empty table gives an empty result; columns beside id and text
are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from declarium.llm import store
from declarium.llm.words import long_of, not_space, texts_of, whole, windows, words_of

#: Text of a block of documents, and hashes of a part, that one task holds at a time.
BLOCK_BYTES = 6_000_000
PART_HASHES = 2_000_000

_REQUEST = "part int, block long, n long, hashes binary, more binary, docs binary, several binary, kind int"
_ANSWER = "block long, part int, repeated binary, mine binary, kind int"
NO_DOC = np.iinfo(np.int64).max


def _planes(x: np.ndarray) -> bytes:
    """Bytes of the numbers, all first bytes first: the shuffle's compression then finds equal ones."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes()


def _unplaned(b: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(size, -1).T).view(kind).ravel()


def _grouped(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """An order in which rows with equal keys stand together, in their old order, and where a new key
    begins in it."""
    order = np.argsort(keys[0], kind="stable")
    new = np.ones(len(order), bool)
    first = keys[0][order]
    new[1:] = first[1:] != first[:-1]
    if len(keys) > 1:
        second = keys[1][order]
        if (second[1:] != second[:-1])[~new[1:]].any():
            order = np.lexsort((keys[1], keys[0]))
            first, second = keys[0][order], keys[1][order]
            new[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
    return order, new


class _Block:
    """Words of the documents of one block, in order of their ids, and what is asked about them."""

    def __init__(self, table: pa.Table, length: int):
        self.table = table.take(pc.sort_indices(table, sort_keys=[("doc_id", "ascending")]))
        ids = self.table.column("doc_id")
        self.ids = ids.fill_null(NO_DOC).to_numpy()
        self.texts = texts_of(self.table.column("text"))
        self.words = words_of(self.texts, not_space())
        self.length, self.half = length, (length + 1) // 2
        lies = whole(self.words, length)
        self.places = np.flatnonzero(lies)
        self.places = self.places[self.ids[self.words.text[self.places]] != NO_DOC]
        half = windows(self.words.hash, self.half)
        least = half[: max(0, len(self.words.hash) - length + 1)].copy()
        for i in range(1, length - self.half + 1):
            np.minimum(least, half[i : i + len(least)], out=least)
        self.halves = least[self.places]

    def docs_at(self, places: np.ndarray) -> np.ndarray:
        return self.ids[self.words.text[places]]

    def first(self, bits: int) -> Requests:
        """The half windows; 32 bits beside the part are enough, as they only choose candidates."""
        return Requests([self.halves >> np.uint64(32 - bits)], 32 + bits, self.docs_at(self.places), bits)

    def second(self, first: Requests, repeated: np.ndarray, bits: int) -> tuple[np.ndarray, Requests]:
        """Places of candidate windows, and the requests for them."""
        places = self.places[repeated[first.number]]
        one = windows(self.words.hash, self.length)[places]
        two = windows(self.words.hash, self.length, 2)[places].astype(np.uint32)
        return places, Requests([one, two], 64, self.docs_at(places), bits)

    def removed(self, places: np.ndarray, second: Requests, repeated: np.ndarray, mine: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of windows that occur in another document; words covered by one that a smaller
        document has."""
        again = repeated[second.number]
        later = again & (~mine[second.number] | (self.docs_at(places) != second.least[second.number]))
        return places[again], self.covered(places[later])

    def covered(self, places: np.ndarray) -> np.ndarray:
        step = np.zeros(len(self.words.hash) + 1, np.int64)
        np.add.at(step, places, 1)
        np.add.at(step, places + self.length, -1)
        return np.cumsum(step[:-1]) > 0


class Requests:
    """Hashes of a block, each once, by the part they belong to. ``keys[0]`` begins with the bits of
    the part; places are in order of their documents' ids."""

    def __init__(self, keys: list[np.ndarray], width: int, docs: np.ndarray, bits: int):
        self.bits = bits
        # Neighbouring places often have one half window: they are one entry from the start.
        differ = np.ones(len(docs), bool)
        differ[1:] = docs[1:] != docs[:-1]
        for k in keys:
            differ[1:] |= k[1:] != k[:-1]
        run = np.cumsum(differ) - 1
        keys, docs = [k[differ] for k in keys], docs[differ]
        order, new = _grouped(keys)
        at = np.flatnonzero(new)
        self.keys = [k[order[at]] for k in keys]
        self.least = docs[order[at]]
        self.greatest = docs[order[np.append(at[1:], len(order)) - 1]] if len(at) else self.least
        number = np.empty(len(order), np.int64)
        number[order] = np.cumsum(new) - 1
        self.number = number[run]
        self.parts = (self.keys[0] >> np.uint64(width - bits)).astype(np.int64) if bits else np.zeros(len(at), np.int64)

    def rows(self, block: int, kind: int) -> Iterator[dict]:
        cuts = np.searchsorted(self.parts, np.arange((1 << self.bits) + 1))
        for p in np.unique(self.parts).tolist():
            lo, hi = cuts[p], cuts[p + 1]
            yield {
                "part": p, "block": block, "n": int(hi - lo), "kind": kind,
                "hashes": _planes(self.keys[0][lo:hi]) if kind else self.keys[0][lo:hi].astype(np.uint32).tobytes(),
                "more": _planes(self.keys[1][lo:hi]) if kind else b"",
                "docs": _planes(self.least[lo:hi]),
                "several": np.packbits(self.greatest[lo:hi] != self.least[lo:hi]).tobytes(),
            }

    def answers(self, rows: list[dict], name: str) -> np.ndarray:
        """The bits of all parts, in the order of the requests."""
        out = np.zeros(len(self.least), bool)
        for r in rows:
            lo, hi = np.searchsorted(self.parts, [r["part"], r["part"] + 1])
            out[lo:hi] = np.unpackbits(np.frombuffer(r[name], np.uint8), count=hi - lo)
        return out


def _table(rows: list[dict], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_pylist(rows, schema=schema)


_REQUEST_ARROW = pa.schema([("part", pa.int32()), ("block", pa.int64()), ("n", pa.int64()), ("hashes", pa.binary()), ("more", pa.binary()), ("docs", pa.binary()), ("several", pa.binary()), ("kind", pa.int32())])
_ANSWER_ARROW = pa.schema([("block", pa.int64()), ("part", pa.int32()), ("repeated", pa.binary()), ("mine", pa.binary()), ("kind", pa.int32())])


def _match(table: pa.Table) -> pa.Table:
    """One part: which hashes occur in two documents, and which block has the smallest of them."""
    rows = table.to_pylist()
    kind = rows[0]["kind"]
    counts = [r["n"] for r in rows]
    one = np.concatenate([_unplaned(r["hashes"], np.uint64) if kind else np.frombuffer(r["hashes"], np.uint32) for r in rows])
    keys = [one] + ([np.concatenate([_unplaned(r["more"], np.uint32) for r in rows])] if kind else [])
    docs = np.concatenate([_unplaned(r["docs"], np.int64) for r in rows])
    some = np.concatenate([np.unpackbits(np.frombuffer(r["several"], np.uint8), count=r["n"]) for r in rows]).astype(bool)
    order, new = _grouped(keys)
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    at = np.flatnonzero(new)
    least, greatest = np.minimum.reduceat(docs[order], at), np.maximum.reduceat(docs[order], at)
    several = greatest != least
    several[number[some]] = True
    repeated, mine = several[number], docs == least[number]
    out, at = [], 0
    for r, c in zip(rows, counts):
        out.append({
            "block": r["block"], "part": r["part"], "kind": kind,
            "repeated": np.packbits(repeated[at : at + c]).tobytes(), "mine": np.packbits(mine[at : at + c]).tobytes(),
        })
        at += c
    return _table(out, _ANSWER_ARROW)


def _by_kind(table: pa.Table, kind: int) -> list[dict]:
    return [r for r in table.to_pylist() if r["kind"] == kind]


def _found(left: pa.Table, right: pa.Table, length: int, bits: tuple[int, int]):
    """A block after both levels: the block, places of repeated windows, removed words."""
    block = _Block(left, length)
    first = block.first(bits[0])
    rows = _by_kind(right, 0)
    places, second = block.second(first, first.answers(rows, "repeated"), bits[1])
    rows = _by_kind(right, 1)
    again, gone = block.removed(places, second, second.answers(rows, "repeated"), second.answers(rows, "mine"))
    return block, again, gone


def _runs(flags: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches of set flags; none reaches over the end of a text."""
    before = np.zeros(len(flags), bool)
    before[1:] = flags[:-1] & (text[1:] == text[:-1])
    after = np.zeros(len(flags), bool)
    after[:-1] = flags[1:] & (text[1:] == text[:-1])
    return np.flatnonzero(flags & ~before), np.flatnonzero(flags & ~after) + 1


def _sliding_min(x: np.ndarray, span: int) -> np.ndarray:
    """Least of each ``span`` neighbours, by doubling."""
    width = 1
    while width < span:
        step = min(width, span - width)
        x = np.minimum(x[:-step], x[step:])
        width += step
    return x


def _level_windows(block: _Block, again: np.ndarray) -> list[tuple]:
    """Windows of twice, four times ... the length inside stretches of repeated words, at places whose
    hash is the smallest among as many as half the window: (level, hash, document, stretch)."""
    out, hash_ = [], block.words.hash
    repeated = block.covered(again)
    start, end = _runs(repeated, block.words.text)
    base = windows(hash_, block.length)
    level, length = 1, 2 * block.length
    keep = end - start >= length
    while keep.any():
        start, end = start[keep], end[keep]
        full = windows(hash_, length)
        for s, e in zip(start, end):
            last = e - length
            marks = base[s : last + 1]
            at = s + np.flatnonzero(np.isin(marks, _sliding_min(marks, min(length // 2, len(marks)))))
            out.append((level, long_of(full[at]), int(block.ids[block.words.text[s]]), int(s)))
        level, length = level + 1, 2 * length
        keep = end - start >= length
    return out


def remove_repeated(docs: DataFrame, length: int = 13, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``n_words``, ``n_removed``, ``kept`` (the words kept, joined by
    one space), ``spans`` (start and end, in words, of what was removed) and ``longest`` (words of the
    longest level at which a window repeats; 0 if none does)."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count(F.lit(1))).first()
    blocks = max(1, -(-size[0] // BLOCK_BYTES), -(-size[1] // 100_000))
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-blocks // 8))
    # At most one in two places starts a half window, about one in seven words with this length.
    bits = tuple(max(0, int(np.ceil(np.log2(max(1, size[0] / per / PART_HASHES))))) for per in (20, 12))
    block = F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(0)), F.lit("block")), F.lit(blocks))
    name = store.bucketed(docs.withColumn("block", block), "block", buckets)
    table = spark.table(name)

    def half_windows(t: pa.Table) -> pa.Table:
        return _table(list(_Block(t, length).first(bits[0]).rows(t.column("block")[0].as_py(), 0)), _REQUEST_ARROW)

    def full_windows(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _table([], _REQUEST_ARROW)
        b = _Block(left, length)
        first = b.first(bits[0])
        _, second = b.second(first, first.answers(right.to_pylist(), "repeated"), bits[1])
        return _table(list(second.rows(left.column("block")[0].as_py(), 1)), _REQUEST_ARROW)

    level_arrow = pa.schema([("level", pa.int32()), ("hash", pa.int64()), ("doc_id", pa.int64()), ("stretch", pa.int64()), ("block", pa.int64())])

    def longer_windows(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _table([], level_arrow)
        b, again, _ = _found(left, right, length, bits)
        found = _level_windows(b, again)
        sizes = [len(f[1]) for f in found]
        whole_ = lambda i, kind: pa.array(np.repeat(np.array([f[i] for f in found], kind), sizes))
        hash_ = pa.array(np.concatenate([f[1] for f in found]) if found else np.zeros(0, np.int64))
        return pa.Table.from_arrays(
            [whole_(0, np.int32), hash_, whole_(2, np.int64), whole_(3, np.int64), pa.array(np.full(len(hash_), left.column("block")[0].as_py()))], schema=level_arrow)

    out_arrow = pa.schema([
        ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string()),
        ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("longest", pa.int64()),
    ])

    def result(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _table([], out_arrow)
        b, again, gone = _found(left, right, length, bits)
        longest = np.zeros(len(b.texts), np.int64)
        longest[b.words.text[again]] = length
        level = {}
        for r in _by_kind(right, 2):
            level[int.from_bytes(r["repeated"], "big", signed=True)] = length << r["part"]
        return _rows(b, gone, longest, level, out_arrow)

    first, folder_1 = store.parked(table.groupBy("block").applyInArrow(half_windows, _REQUEST).groupBy("part").applyInArrow(_match, _ANSWER))
    second, folder_2 = store.parked(
        table.groupBy("block").cogroup(first.groupBy("block")).applyInArrow(full_windows, _REQUEST).groupBy("part").applyInArrow(_match, _ANSWER)
    )
    answers = first.unionByName(second)
    longer, folder_3 = store.parked(
        table.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(longer_windows, "level int, hash long, doc_id long, stretch long, block long")
    )
    survivors, folders = _levels(longer)
    longest = survivors.select(
        "block", F.col("level").alias("part"), F.unhex(F.lpad(F.hex("doc_id"), 16, "0")).alias("repeated"), F.lit(None).cast("binary").alias("mine"), F.lit(2).alias("kind"))
    final, _ = store.parked(
        table.groupBy("block").cogroup(answers.unionByName(longest).groupBy("block")).applyInArrow(
            result, "doc_id long, n_words long, n_removed long, kept string, spans array<struct<start:long,end:long>>, longest long"))
    store.drop(spark, name)
    store.remove(spark, folder_1, folder_2, folder_3, *folders)
    return final


def _levels(longer: DataFrame) -> tuple[DataFrame, list[str]]:
    """The last level at which each document has a repeated window. A level looks up only stretches
    that have a repeated window at the level before."""
    folders, levels, alive = [], [], None
    level = 1
    while True:
        at = longer.where(F.col("level") == level)
        if alive is not None:
            at = at.join(alive.select("block", "doc_id", "stretch").distinct(), ["block", "doc_id", "stretch"], "left_semi")
        # Written before the join, so that Spark can split a hash that very many documents have.
        again, folder = store.parked(at.groupBy("hash").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("hash"))
        folders.append(folder)
        alive, folder = store.parked(at.join(again, "hash", "left_semi").select("block", "doc_id", "stretch").distinct())
        folders.append(folder)
        levels.append(alive.withColumn("level", F.lit(level)))
        if alive.isEmpty():
            break
        level += 1
    all_ = levels[0]
    for x in levels[1:]:
        all_ = all_.unionByName(x)
    return all_.groupBy("block", "doc_id").agg(F.max("level").alias("level")), folders


def _rows(b: _Block, gone: np.ndarray, longest: np.ndarray, level: dict, schema: pa.Schema) -> pa.Table:
    """A row per document: what is kept of it."""
    start, end = _runs(gone, b.words.text)
    first = b.words.first
    spans_of = np.searchsorted(start, first)
    kept, spans, n_removed = [], [], np.zeros(len(b.texts), np.int64)
    data = b.texts.data.tobytes()
    total = np.concatenate([[0], np.cumsum(gone)])
    n_removed = total[first[1:]] - total[first[:-1]]
    for t in range(len(b.texts)):
        lo, hi = int(b.texts.offsets[t]), int(b.texts.offsets[t + 1])
        own = range(spans_of[t], spans_of[t + 1])
        if len(own):
            parts, at = [], lo
            for i in own:
                parts.append(data[at : b.words.start[start[i]]])
                at = int(b.words.end[end[i] - 1])
            parts.append(data[at:hi])
            kept.append(b" ".join(b" ".join(p.split()) for p in parts if p.strip()).decode())
        else:
            kept.append(b" ".join(data[lo:hi].split()).decode())
        spans.append([{"start": int(start[i] - first[t]), "end": int(end[i] - first[t])} for i in own])
    ids = b.table.column("doc_id")
    long_ = [max(int(x), level.get(i, 0)) for x, i in zip(longest, ids.to_pylist())]
    return pa.Table.from_arrays(
        [ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids, pa.array(b.words.counts().astype(np.int64)), pa.array(n_removed),
         pa.array(kept), pa.array(spans, schema.field("spans").type), pa.array(long_, pa.int64())], schema=schema)
