"""Periodic runs of words: stretches in which a block of words repeats three times or more.

A run is a stretch of consecutive words of one document with smallest period ``q`` (words ``q`` apart are
equal), at least ``max(least_words, least_exponent * q)`` words long, that no neighbouring word extends
with the same period. Collapsing keeps the first ``q`` words of each run.

Seeds. A run of period ``q`` and length ``n`` matches itself along the diagonal of lag ``q`` over ``n - q``
words. Lags go in octaves; ``k`` is the least such overlap of the octave's lags (16 words for lags to 16,
then 34 for lags to 32, 66 for lags to 64, ...). Each octave indexes the ``k``-grams of a document and
enumerates pairs of an occurrence and the next one whose distance is a lag of the octave. The next one
is enough, as ``k`` is never less than the lag: a gram that came back earlier within a run would hold a whole
block equal to its own rotation, and the period would not be the smallest. So every place of a run from
which a gram fits the overlap is a seed of its lag, and pairs grow with the text, never with the square of
how often a gram occurs.

Extension. Seeds go by lag and place, and the furthest word a lag has covered tells whether the next seed of
that lag lies on the stretch at hand, which it extends, or starts another. By the above the stretch of a run
is covered from its first word to its last, so a stretch that is long enough is a run and maximal; all
others are dropped.

A document is worked on by itself, with a sort for each octave its length allows, in batches of bounded
text. Nothing is shuffled.

Defined cases: null texts, empty texts and texts without words have no words and no runs, and collapse to the
empty text; a very long text is a batch of its own; rows that repeat an id are worked on each; ids are not
looked at; an empty table gives an empty result; the row's own columns are carried in ``row``, whatever
their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from declarium.llm.words import hashes, mix, not_space, pieces, texts_of, windows, words_of

_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


class Runs(NamedTuple):
    """Runs of a batch by text and start: the text's number, and the run in words of that text."""

    text: np.ndarray
    start: np.ndarray
    length: np.ndarray
    period: np.ndarray


def octaves(least_words: int, least_exponent: int) -> Iterator[tuple[int, int, int]]:
    """Without end: lags above the first number up to the second, and the least overlap of their runs."""
    low, high = 0, min(max(least_words, least_exponent * q) - q for q in range(1, least_words + 1))
    k = high
    while True:
        yield low, high, k
        low, high = high, 2 * high
        k = (least_exponent - 1) * (low + 1)


def _seeds(hash_: np.ndarray, text: np.ndarray, k: int, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Places whose ``k`` words occur next at a distance above ``low`` up to ``high``, and that distance."""
    grams = windows(hash_, k)
    at = np.flatnonzero(text[: len(grams)] == text[k - 1 :]) if len(grams) else np.zeros(0, np.int64)
    key = mix(grams[at] ^ mix(text[at].astype(np.uint64) + np.uint64(1)))
    order = np.argsort(key, kind="stable")
    same = np.flatnonzero(key[order[1:]] == key[order[:-1]])
    place = at[order[same]]
    lag = at[order[same + 1]] - place
    keep = (lag > low) & (lag <= high)
    return place[keep], lag[keep]


def find_runs(hash_: np.ndarray, first: np.ndarray, least_words: int = 24, least_exponent: int = 3) -> Runs:
    """All runs of texts given as word hashes end to end; ``first`` holds the words before each text."""
    n = np.diff(first)
    text = np.repeat(np.arange(len(n)), n)
    found = []
    for low, high, k in octaves(least_words, least_exponent):
        enough = n >= max(least_words, least_exponent * (low + 1))
        if not enough.any():
            break
        own = np.flatnonzero(enough[text])
        place, lag = _seeds(hash_[own], text[own], k, low, high)
        order = np.lexsort((place, lag))
        place, lag = place[order], lag[order]
        if not len(place):
            continue
        # The furthest word that the lag has covered so far is the last seed's end.
        fresh = np.ones(len(place), bool)
        fresh[1:] = (lag[1:] != lag[:-1]) | (place[1:] > place[:-1] + k)
        begin = np.flatnonzero(fresh)
        end = np.append(begin[1:], len(place)) - 1
        q = lag[begin]
        length = place[end] + k - place[begin] + q
        keep = length >= np.maximum(least_words, least_exponent * q)
        start = own[place[begin[keep]]]
        found.append((text[start], start - first[text[start]], length[keep], q[keep]))
    if not found:
        none = np.zeros(0, np.int64)
        return Runs(none, none, none, none)
    every = [np.concatenate(x) for x in zip(*found, strict=True)]
    order = np.lexsort((every[3], every[1], every[0]))
    return Runs(*(x[order] for x in every))


def _repeats(runs: Runs, first: np.ndarray) -> np.ndarray:
    """Whether a word lies in a run behind its first block."""
    edge = np.zeros(int(first[-1]) + 1, np.int64)
    at = first[runs.text] + runs.start
    np.add.at(edge, at + runs.period, 1)
    np.add.at(edge, at + runs.length, -1)
    return np.cumsum(edge)[:-1] > 0


def periodic_runs(docs: DataFrame, least_words: int = 24, least_exponent: int = 3, text_column: str = "text") -> DataFrame:
    """Per row of ``docs``: ``row`` (its columns as a struct), ``n_words``, ``runs`` (start in words, length
    and period, by start and period) and ``kept`` (the words outside the repeats, joined by one space)."""
    if least_exponent < 3 or least_words < 3:
        raise ValueError("a run holds at least three blocks and three words")
    out = docs.select(F.struct("*").alias("row"), F.col(text_column).alias("text"))
    row = out.schema["row"].dataType.simpleString()

    def worked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            texts = texts_of(batch.column("text"))
            words = words_of(texts, not_space(), hashed=False)
            runs = find_runs(hashes(texts.data, words.start, words.end), words.first, least_words, least_exponent)
            gone = _repeats(runs, words.first)
            has = np.searchsorted(runs.text, np.arange(len(texts) + 1))
            data, kept = texts.data.tobytes(), []
            for t in range(len(texts)):
                own = data[texts.offsets[t] : texts.offsets[t + 1]].split()
                if has[t] < has[t + 1]:
                    stays = ~gone[words.first[t] : words.first[t + 1]]
                    own = [own[i] for i in np.flatnonzero(stays).tolist()]
                kept.append(b" ".join(own).decode())
            listed = pa.StructArray.from_arrays([pa.array(x) for x in (runs.start, runs.length, runs.period)], fields=list(_RUNS.value_type))
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(words.counts().astype(np.int64)), pa.ListArray.from_arrays(pa.array(has.astype(np.int32)), listed), pa.array(kept, pa.string())],
                ["row", "n_words", "runs", "kept"])

    return out.mapInArrow(worked, f"row {row}, n_words long, runs array<struct<start:long,length:long,period:long>>, kept string")


def collapsed(docs: DataFrame, least_words: int = 24, least_exponent: int = 3) -> DataFrame:
    """The rows of ``docs``; a text that holds runs is replaced by its words without the repeats.
    ``n_chars``, where it exists, follows the text."""
    found = periodic_runs(docs, least_words, least_exponent)
    some = F.size("runs") > 0
    columns = {"text": F.when(some, F.col("kept")).otherwise(F.col("row.text"))}
    if "n_chars" in docs.columns:
        columns["n_chars"] = F.when(some, F.length("kept").cast("long")).otherwise(F.col("row.n_chars"))
    return found.select(*[columns.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
