"""Phrases of two and three words that stand together more often than their parts let expect.

Texts go in lower case (A-Z), are cut at ``. , ; : ! ?`` and line ends, and the pieces into words at blanks and
tabs; a phrase never reaches over a cut. All counts are per language (null: ``und``), and exact. A phrase
of ``a >= least`` occurrences scores ``floor(1000000 * a * a / (l * r))`` at a cut into parts with ``l`` and ``r``
occurrences; the cut of the lowest score counts, of equal ones the first. A phrase goes if a longer one
that holds it occurs in at least ``share`` percent of its occurrences. The first ``most`` of a language are kept.

Counting goes by weighted acyclic automata (``transducers``). A task turns the sorted phrases of each shard of
bounded text into count transducers, one for each prefix range of the order of phrases; the transducers of a
range are united and their weights added up, and the union keeps what occurs ``least`` times. Ranges are
as many as the text asks for. Their bounds come from a bounded sample of the phrases, as those of a range
partitioning do, so a word or pair that begins a third of all phrases is cut into several ranges by the
words behind it; the sample decides only how even the ranges are. A range beyond ``MOST_RANGES`` of them is
dealt further by a hash of the phrase. Parts are looked up by composing the sorted list of distinct parts of a range with its
transducer.

A word is a 64-bit hash of its bytes and its language. Should two words of one hash meet, in a shard (seen by
a second hash) or in a union (where the words themselves are compared), the job fails; no count is wrong
unnoticed.

Defined cases: null and empty texts have no words; a text without cuts is one piece; a very long text is
counted in parts that overlap by a phrase; rows that repeat an id all count; ids and other columns are not
looked at; a language without phrases has no rows; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from declarium.llm import store
from declarium.llm.transducers import BITS, LAYERS, Phrases, build, counted, keys, looked_up, packed, paths, united, unpacked
from declarium.llm.words import hashes, long_of, mix, pieces, texts_of, words_of
from declarium.operators.top import top_per_group

#: Text of a shard, words counted at once, and text of a range, in bytes and words.
SHARD_BYTES = 4 << 20
SHARD_WORDS = 700_000
RANGE_BYTES = 4 << 20
MOST_RANGES = 1 << 16
#: Text and phrases of the sample from which the bounds of ranges come.
SAMPLE_BYTES = 4 << 20
SAMPLE_PHRASES = 50_000
#: The characters that end a piece, and those between words.
CUTS, BLANKS = b".,;:!?\x0a\x0b\x0c\x0d", b"\x20\x09"
NO_LANGUAGE = "und"

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_INSIDE = np.ones(256, np.uint8)
_INSIDE[list(CUTS + BLANKS)] = 0
_CUT = np.zeros(256, bool)
_CUT[list(CUTS)] = True

_PART = "s1 long, s2 long"


class _Shard:
    """Sorted phrases of some text with their counts, and their words."""

    def __init__(self, symbols: np.ndarray, words: list[tuple[str, bytes]], phrases: Phrases):
        self.symbols, self.words, self.phrases, self.keys = symbols, words, phrases, keys(phrases.words)

    def place(self, bound: tuple[int, int, int]) -> int:
        """Phrases before ``bound``, three hashes."""
        key, exact = 0, True
        for b in bound:
            at = int(np.searchsorted(self.symbols, np.uint64(b))) if exact and b else -1
            key = key << BITS | (at + 1)
            exact = exact and 0 <= at < len(self.symbols) and int(self.symbols[at]) == b
        return int(np.searchsorted(self.keys, np.uint64(key)))

    def hashed(self, at: slice | np.ndarray) -> list[np.ndarray]:
        """The phrases as hashes, 0 where they have ended."""
        names = np.concatenate([np.zeros(1, np.uint64), self.symbols])
        return [names[w[at]] for w in self.phrases.words]


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[_Shard]:
    for batch in pieces(batches, most=SHARD_BYTES):
        texts = texts_of(batch.column("text"))
        words = words_of(texts, _INSIDE, hashed=False)
        if not len(words.start):
            continue
        lower = _LOWER[texts.data]
        langs = pc.fill_null(batch.column("lang").cast(pa.string()), NO_LANGUAGE).dictionary_encode()
        names = langs.dictionary.to_pylist()
        seeds = np.array([int.from_bytes(hashlib.blake2b(n.encode(), digest_size=8).digest()) for n in names], np.uint64)
        lang = langs.indices.to_numpy(zero_copy_only=False)[words.text]
        symbol = mix(hashes(lower, words.start, words.end) ^ seeds[lang])
        symbol[symbol == 0] = 1
        # Another table of letters makes another hash.
        second = hashes(~lower, words.start, words.end) ^ seeds[lang]
        piece = words.text + np.searchsorted(np.flatnonzero(_CUT[texts.data]), words.start)
        for low in range(0, len(symbol), SHARD_WORDS):
            high = min(low + SHARD_WORDS, len(symbol))
            own, near = symbol[low : high + LAYERS - 1], piece[low : high + LAYERS - 1]
            symbols, first, number = np.unique(own, return_index=True, return_inverse=True)
            check = second[low : high + LAYERS - 1]
            if (check[first][number] != check).any():
                raise ValueError("two words of one hash")
            number = (number + 1).astype(np.int32)
            listed: list[list[np.ndarray]] = [[] for _ in range(LAYERS)]
            for n in range(1, LAYERS + 1):
                at = np.arange(min(high - low, len(own) - n + 1))
                at = at[near[at] == near[at + n - 1]]
                for k in range(LAYERS):
                    listed[k].append(number[at + k] if k < n else np.zeros(len(at), np.int32))
            phrases = counted([np.concatenate(x) for x in listed], None, len(symbols))
            data = lower.data
            spelled = [(names[lang[low + i]], bytes(data[words.start[low + i] : words.end[low + i]])) for i in first.tolist()]
            yield _Shard(symbols, spelled, phrases)


def _words_column(words: list[tuple[str, bytes]], symbols: np.ndarray) -> list[dict]:
    return [{"symbol": s, "lang": lang, "word": word} for s, (lang, word) in zip(long_of(symbols).tolist(), words)]


_WORD_TYPE = pa.list_(pa.struct([("symbol", pa.int64()), ("lang", pa.string()), ("word", pa.binary())]))
_WORDS = "array<struct<symbol:long,lang:string,word:binary>>"
_TOTAL_TYPE = pa.list_(pa.struct([("lang", pa.string()), ("n", pa.int64())]))
_TOTALS = "array<struct<lang:string,n:long>>"


def _dealt(hashed: list[np.ndarray], folds: int) -> np.ndarray:
    """Which of the ``folds`` of its range a phrase belongs to."""
    if folds == 1:
        return np.zeros(len(hashed[0]), np.int64)
    h = hashed[0]
    for x in hashed[1:]:
        h = mix(h) + x
    return (mix(h) % np.uint64(folds)).astype(np.int64)


def _range_of(bounds: np.ndarray, hashed: list[np.ndarray]) -> np.ndarray:
    """Number of bounds at or before each phrase; bounds are sorted rows of three hashes."""
    if not len(bounds):
        return np.zeros(len(hashed[0]), np.int64)
    all_ = [np.concatenate([bounds[:, k], hashed[k]]) for k in range(LAYERS)]
    is_bound = np.arange(len(all_[0])) < len(bounds)
    order = np.lexsort((~is_bound, *all_[::-1]))
    before = np.cumsum(is_bound[order])
    out = np.empty(len(order), np.int64)
    out[order] = before
    return out[len(bounds) :]


def _bounds(docs: DataFrame, size: int, ranges: int) -> np.ndarray:
    """Bounds of ``ranges`` ranges of about as many phrases, as rows of three hashes."""
    if ranges == 1:
        return np.zeros((0, LAYERS), np.uint64)
    some = docs.where(F.pmod(F.xxhash64("text", "lang"), F.lit(1 << 30)) < int(min(1.0, SAMPLE_BYTES / size) * (1 << 30)))
    every = max(1, SAMPLE_BYTES // 2 // SAMPLE_PHRASES)

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in _shards(batches):
            yield pa.RecordBatch.from_arrays([pa.array(long_of(x)) for x in s.hashed(np.arange(every // 2, len(s.phrases.count), every))], ["s1", "s2", "s3"])

    rows = some.mapInArrow(sampled, _PART + ", s3 long").limit(4 * SAMPLE_PHRASES).collect()
    found = np.array([tuple(r) for r in rows], np.int64).reshape(-1, LAYERS).view(np.uint64)
    if len(found) < ranges:
        # Too few to tell: words are hashes, so equal steps do.
        even = np.array([k * (1 << 64) // ranges for k in range(1, ranges)], np.uint64)
        return np.stack([even, np.zeros_like(even), np.zeros_like(even)], axis=1)
    found = found[np.lexsort(found.T[::-1])]
    return np.unique(found[np.arange(1, ranges) * len(found) // ranges], axis=0)


def count_phrases(docs: DataFrame, least: int, text_column: str = "text", lang_column: str = "lang") -> tuple[DataFrame, np.ndarray, int]:
    """A row per range: ``part``, ``transducer`` (of the phrases that occur ``least`` times), ``words`` (those
    among them, spelled) and ``totals`` (occurrences of all words by language); the bounds and folds of ranges."""
    docs = docs.select(F.col(lang_column).cast("string").alias("lang"), F.col(text_column).alias("text"))
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    wanted = max(1, -(-size // RANGE_BYTES))
    folds = -(-wanted // MOST_RANGES)
    bounds = _bounds(docs, max(1, size), -(-wanted // folds))

    def sharded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in _shards(batches):
            cuts = [0, *(s.place(tuple(b)) for b in bounds.tolist()), len(s.phrases.count)]
            rows = []
            for k, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
                fold = _dealt(s.hashed(slice(lo, hi)), folds) if folds > 1 else None
                for f in range(folds if hi > lo else 0):
                    at = slice(lo, hi) if fold is None else lo + np.flatnonzero(fold == f)
                    own = Phrases([w[at] for w in s.phrases.words], s.phrases.count[at])
                    single = own.words[0][own.words[1] == 0] - 1
                    spelled = _words_column([s.words[i] for i in single.tolist()], s.symbols[single])
                    rows.append((k * folds + f, packed(build(s.symbols, own)), spelled))
                    if len(rows) == 16:
                        yield _shard_rows(rows)
                        rows = []
            if rows:
                yield _shard_rows(rows)

    def union(table: pa.Table) -> pa.Table:
        known: dict[int, tuple[str, bytes]] = {}
        for own in table.column("words").to_pylist():
            for w in own:
                spelled = (w["lang"], w["word"])
                if known.setdefault(w["symbol"], spelled) != spelled:
                    raise ValueError(f"two words of one hash: {spelled} and {known[w['symbol']]}")
        symbols, phrases = united(table.column("transducer").to_pylist())
        single = phrases.words[1] == 0
        totals: dict[str, int] = {}
        named = long_of(symbols)[phrases.words[0][single] - 1].tolist()
        for s, n in zip(named, phrases.count[single].tolist()):
            totals[known[s][0]] = totals.get(known[s][0], 0) + n
        often = phrases.count >= least
        kept = Phrases([w[often] for w in phrases.words], phrases.count[often])
        words = [{"symbol": s, "lang": known[s][0], "word": known[s][1]} for s in long_of(symbols)[kept.words[0][kept.words[1] == 0] - 1].tolist()]
        return pa.Table.from_arrays(
            [pa.array([table.column("part")[0].as_py()], pa.int64()), pa.array([packed(build(symbols, kept))], pa.binary()), pa.array([words], _WORD_TYPE),
             pa.array([[{"lang": k, "n": n} for k, n in totals.items()]], _TOTAL_TYPE)], ["part", "transducer", "words", "totals"])

    shards = docs.mapInArrow(sharded, f"part long, transducer binary, words {_WORDS}")
    return shards.groupBy("part").applyInArrow(union, f"part long, transducer binary, words {_WORDS}, totals {_TOTALS}"), bounds, folds


def _shard_rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], _WORD_TYPE)],
        ["part", "transducer", "words"])


def _cuts(merged: DataFrame, bounds: np.ndarray, folds: int) -> DataFrame:
    """A row per cut of each phrase of two or three words: the phrase, its count, the words before the cut,
    and both parts with the ranges they are in."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = lambda n: np.zeros(n, np.uint64)
        for batch in batches:
            for blob in batch.column("transducer").to_pylist():
                t = unpacked(blob)
                found = paths(t)
                names = np.concatenate([none(1), t.symbols])
                words = [names[w] for w in found.words]
                for k in (1, 2):
                    at = np.flatnonzero(words[k] > 0)
                    s1, s2, s3 = (w[at] for w in words)
                    left, right = ((s1, none(len(at))), (s2, s3)) if k == 1 else ((s1, s2), (s3, none(len(at))))
                    columns = {"w1": s1, "w2": s2, "w3": s3, "l1": left[0], "l2": left[1], "r1": right[0], "r2": right[1]}
                    arrays = [pa.array(long_of(x)) for x in columns.values()]
                    ends = none(len(at))
                    parts = [_range_of(bounds, [*p, ends]) * folds + _dealt([*p, ends], folds) for p in (left, right)]
                    arrays += [pa.array(x) for x in (found.count[at], np.full(len(at), k), *parts)]
                    yield pa.RecordBatch.from_arrays(arrays, [*columns, "a", "cut", "l_part", "r_part"])

    kinds = ", ".join(f"{c} long" for c in ("w1", "w2", "w3", "l1", "l2", "r1", "r2", "a", "cut", "l_part", "r_part"))
    return merged.select("transducer").mapInArrow(listed, kinds)


def _compose(parts: DataFrame, merged: DataFrame) -> DataFrame:
    """``s1, s2, n``: how often each of the distinct parts ``part, s1, s2`` occurs."""

    def composed(left: pa.Table, right: pa.Table) -> pa.Table:
        s = [left.column(c).to_numpy().view(np.uint64) for c in ("s1", "s2")] if left.num_rows else [np.zeros(0, np.uint64)] * 2
        n = np.zeros(len(s[0]), np.int64)
        for blob in right.column("transducer").to_pylist() if len(n) else []:
            n = looked_up(unpacked(blob), [*s, np.zeros(len(n), np.uint64)])
        return pa.Table.from_arrays([pa.array(long_of(s[0])), pa.array(long_of(s[1])), pa.array(n)], ["s1", "s2", "n"])

    return parts.groupBy("part").cogroup(merged.select("part", "transducer").groupBy("part")).applyInArrow(composed, _PART + ", n long")


def _score(a: str, l: str, r: str) -> Column:  # noqa: E741
    # Counts of up to 15 digits: products of 31 and 38.
    exact = lambda c: f"CAST({c} AS DECIMAL(15, 0))"
    return F.expr(f"CAST(CAST(1000000 AS DECIMAL(7, 0)) * ({exact(a)} * {exact(a)}) AS DECIMAL(38, 0)) div ({exact(l)} * {exact(r)})")


def collocations(docs: DataFrame, least: int = 10, share: int = 50, most: int = 2000, text_column: str = "text", lang_column: str = "lang") -> DataFrame:
    """``lang``, ``rank`` (from 1), ``phrase`` (words joined by one space), ``a``, ``l``, ``r`` (occurrences of the phrase and its parts),
    ``n`` (of all words of the language) and ``score``."""
    spark = docs.sparkSession
    merged, bounds, folds = count_phrases(docs, least, text_column, lang_column)
    merged, folder = store.parked(merged)
    cuts, folder_2 = store.parked(_cuts(merged, bounds, folds))
    sides = [cuts.select(F.col(f"{x}_part").alias("part"), F.col(f"{x}1").alias("s1"), F.col(f"{x}2").alias("s2")) for x in "lr"]
    counts, folder_3 = store.parked(_compose(sides[0].unionByName(sides[1]).distinct(), merged))
    scored = cuts
    for x in "lr":
        scored = scored.join(counts.select(F.col("s1").alias(f"{x}1"), F.col("s2").alias(f"{x}2"), F.col("n").alias(x)), [f"{x}1", f"{x}2"])
    scored = scored.withColumn("score", _score("a", "l", "r"))
    phrase = ["w1", "w2", "w3"]
    lowest = scored.groupBy(*phrase).agg(F.min(F.struct("score", "cut", "l", "r", "a")).alias("x")).select(*phrase, "x.a", "x.l", "x.r", "x.score")
    # Pairs inside phrases of three words.
    three = cuts.where("cut = 2")
    inside = [three.select(F.col(x).alias("w1"), F.col(y).alias("w2"), F.col("a").alias("longer")) for x, y in (("w1", "w2"), ("w2", "w3"))]
    covered = inside[0].unionByName(inside[1]).groupBy("w1", "w2").agg(F.max("longer").alias("longer")).withColumn("w3", F.lit(0).cast("long"))
    kept = lowest.join(covered, phrase, "left").where(F.col("longer").isNull() | (100 * F.col("longer") < F.lit(share) * F.col("a"))).drop("longer")
    words = merged.select(F.explode("words").alias("w")).select("w.symbol", "w.lang", F.col("w.word").cast("string").alias("word"))
    kept = kept.join(words.select(F.col("symbol").alias("w1"), "lang", F.col("word").alias("word_1")), "w1")
    for k in (2, 3):
        kept = kept.join(words.select(F.col("symbol").alias(f"w{k}"), F.col("word").alias(f"word_{k}")), f"w{k}", "left")
    kept = kept.select("lang", F.concat_ws(" ", "word_1", "word_2", "word_3").alias("phrase"), "a", "l", "r", "score")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    ranked = top_per_group(kept, ["lang"], order, most, rank="rank").withColumn("rank", F.col("rank").cast("long"))
    totals = merged.select(F.explode("totals").alias("t")).groupBy("t.lang").agg(F.sum("t.n").alias("n"))
    out, _ = store.parked(ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score"))
    store.remove(spark, folder, folder_2, folder_3)
    return out
