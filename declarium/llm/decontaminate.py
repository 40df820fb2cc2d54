"""Benchmark decontamination with a generalised suffix automaton of the test items.

Texts are read as lower-case words (digits, letters, all non-ASCII characters). A window is ``window``
consecutive words of an item; an item of fewer words, but not none, is one window. Documents stream
through the automaton of the items word by word; at each word it holds the longest match that ends
there, so every window occurrence is seen, with the items it belongs to. Only stretches whose
neighbouring words are neighbours in some item too are streamed; no other place can hold a window.

Items come in blocks of bounded text: each block is one automaton, sent to the tasks, and documents
pass through one after another. Documents are never shuffled.

Defined cases: null and empty texts have no words and no hits; items with null or empty texts match
nothing; items without an id mark words but are not listed; an id listed twice counts once; with no
items nothing is hit; an empty table gives an empty result; other columns are carried, whatever their
names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from declarium.llm import store
from declarium.llm.words import Words, lower_alnum, pieces, texts_of, words_of

#: Bytes of item text in one automaton: about 100 MB of automaton at the most.
BLOCK_BYTES = 1_000_000


class Automaton:
    """Suffix automaton of the word sequences of many items."""

    def __init__(self, ids: list[int | None], items: list[list[int]], window: int):
        self.window = window
        self.length, self.link, step = [0], [-1], [{}]
        for item in items:
            last = 0
            for word in item:
                last = self._extend(step, last, word)
        self.step = step
        #: By state: items with the window that the state stands for; short items that end there.
        self.full: dict[int, set] = {}
        self.short: dict[int, list] = {}
        for number, item in zip(ids, items):
            self._mark(number, item)
        self.near = self._nearest_short()
        self._window_of: dict[int, int] = {}

    def _new(self, step: list, length: int, link: int, moves: dict) -> int:
        self.length.append(length)
        self.link.append(link)
        step.append(moves)
        return len(step) - 1

    def _split(self, step: list, state: int, word: int, target: int) -> int:
        """The state of the shorter strings of ``target`` that end in ``word`` after ``state``."""
        if self.length[target] == self.length[state] + 1:
            return target
        copy = self._new(step, self.length[state] + 1, self.link[target], dict(step[target]))
        self.link[target] = copy
        while state != -1 and step[state].get(word) == target:
            step[state][word] = copy
            state = self.link[state]
        return copy

    def _extend(self, step: list, last: int, word: int) -> int:
        known = step[last].get(word)
        if known is not None:
            return self._split(step, last, word, known)
        added = self._new(step, self.length[last] + 1, 0, {})
        at = last
        while at != -1 and word not in step[at]:
            step[at][word] = added
            at = self.link[at]
        if at != -1:
            self.link[added] = self._split(step, at, word, step[at][word])
        return added

    def _mark(self, number: int | None, item: list[int]) -> None:
        state = 0
        for i, word in enumerate(item):
            state = self.step[state][word]
            while self.length[self.link[state]] >= self.window:
                state = self.link[state]
            if i + 1 >= self.window:
                self.full.setdefault(state, set()).add(number)
        if 0 < len(item) < self.window:
            self.short.setdefault(state, []).append((len(item), number))

    def _nearest_short(self) -> list[int]:
        """By state: the nearest state on its chain of suffixes, itself included, where a short item
        ends; -1 if there is none."""
        near = [-1] * len(self.link)
        for state in sorted(range(1, len(self.link)), key=self.length.__getitem__):
            near[state] = state if state in self.short else near[self.link[state]]
        return near

    def window_state(self, state: int) -> int:
        """The state of the last ``window`` words of a match in ``state``."""
        found = self._window_of.get(state)
        if found is None:
            found = state
            while self.length[self.link[found]] >= self.window:
                found = self.link[found]
            self._window_of[state] = found
        return found

    def stream(self, words: list[int]) -> tuple[list[tuple[int, int]], set, int]:
        """Hit spans, items, and the longest match of a stretch of words."""
        step, link, length, window = self.step, self.link, self.length, self.window
        state = matched = longest = 0
        spans, items = [], set()
        for i, word in enumerate(words):
            while state and word not in step[state]:
                state = link[state]
                matched = length[state]
            follow = step[state].get(word)
            if follow is None:
                continue
            state, matched = follow, matched + 1
            longest = max(longest, matched)
            hit = 0
            if matched >= window:
                hit = window
                items |= self.full.get(self.window_state(state), set())
            short = self.near[state]
            while short != -1:
                for n, number in self.short[short]:
                    if n <= matched:
                        hit = max(hit, n)
                        items.add(number)
                short = self.near[link[short]] if link[short] > 0 else -1
            if hit:
                spans.append((i + 1 - hit, i + 1))
        return spans, items, longest


class Items:
    """One block of items, ready to be sent to the tasks."""

    def __init__(self, ids: list[int | None], texts: list[str | None], window: int):
        words = words_of(texts_of(pa.array(texts, pa.string())), lower_alnum())
        self.vocabulary, numbers = np.unique(words.hash, return_inverse=True)
        cuts = words.first
        items = [numbers[cuts[i] : cuts[i + 1]].tolist() for i in range(len(texts))]
        self.automaton = Automaton(ids, items, window)
        pairs = [numbers[:-1][same] * len(self.vocabulary) + numbers[1:][same] for same in [words.text[1:] == words.text[:-1]]]
        self.pairs = np.unique(pairs[0]) if len(numbers) else np.zeros(0, np.int64)
        sizes = [min(len(i), window) for i in items if i]
        self.alone = np.array(sorted({i[0] for i in items if len(i) == 1}), np.int64)
        self.least = min([s for s in sizes if s > 1], default=window)
        self.quick = np.zeros(1 << 16, bool)
        self.quick[(self.vocabulary & np.uint64(0xFFFF)).astype(np.int64)] = True

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Number of each word, -1 for words of no item."""
        out = np.full(len(hashes), -1, np.int64)
        maybe = np.flatnonzero(self.quick[(hashes & np.uint64(0xFFFF)).astype(np.int64)])
        at = np.searchsorted(self.vocabulary, hashes[maybe])
        at[at == len(self.vocabulary)] = 0
        right = self.vocabulary[at] == hashes[maybe] if len(self.vocabulary) else np.zeros(0, bool)
        out[maybe[right]] = at[right]
        return out

    def stretches(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Word numbers, and starts and ends of the stretches that can hold a window."""
        numbers = self.numbers(words.hash)
        n = len(numbers)
        joined = np.zeros(n + 1, bool)  # whether word i - 1 and word i are neighbours in an item
        if n > 1 and len(self.pairs):
            pair = numbers[:-1] * len(self.vocabulary) + numbers[1:]
            maybe = np.flatnonzero((numbers[:-1] >= 0) & (numbers[1:] >= 0) & (words.text[1:] == words.text[:-1]))
            at = np.searchsorted(self.pairs, pair[maybe])
            at[at == len(self.pairs)] = 0
            joined[1 + maybe[self.pairs[at] == pair[maybe]]] = True
        start = np.flatnonzero(~joined[:-1] & joined[1:])
        end = np.flatnonzero(joined[:-1] & ~joined[1:]) + 1
        enough = end - start >= self.least
        start, end = start[enough], end[enough]
        if len(self.alone):
            lone = np.flatnonzero(np.isin(numbers, self.alone))
            inside = np.searchsorted(start, lone, "right") - 1
            free = lone[(inside < 0) | (lone >= np.append(end, 0)[inside])]
            start, end = np.concatenate([start, free]), np.concatenate([end, free + 1])
            order = np.argsort(start)
            start, end = start[order], end[order]
        return numbers, start, end


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def _hits(block: Items, words: Words, before: list | None) -> list[dict]:
    """Per text: spans, items and longest match, with those of earlier blocks."""
    numbers, start, end = block.stretches(words)
    found = [([(x["start"], x["end"]) for x in b["spans"]], set(b["items"]), b["longest"]) for b in before] if before else [
        ([], set(), 0) for _ in range(len(words.first) - 1)]
    for s, e in zip(start.tolist(), end.tolist()):
        text = int(words.text[s])
        base = s - int(words.first[text])
        spans, items, longest = block.automaton.stream(numbers[s:e].tolist())
        own = found[text]
        found[text] = (own[0] + [(base + a, base + b) for a, b in spans], own[1] | items, max(own[2], longest))
    return [{"spans": [{"start": s, "end": e} for s, e in _merged(spans)], "items": sorted(i for i in items if i is not None), "longest": longest}
            for spans, items, longest in found]


_HITS = pa.struct([
    ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("items", pa.list_(pa.int64())), ("longest", pa.int64())])


def _without(text: bytes, start: np.ndarray, end: np.ndarray, spans: list[dict]) -> str:
    """The text without the spans; what is left is joined by one space."""
    parts, at = [], 0
    for s in spans:
        parts.append(text[at : start[s["start"]]].rstrip())
        at = int(end[s["end"] - 1])
    parts.append(text[at:].lstrip())
    return b" ".join(p for p in parts if p).decode()


def find_items(docs: DataFrame, items: DataFrame, window: int = 10, text_column: str = "text", cut: int | None = None) -> DataFrame:
    """Per row of ``docs``: ``row`` (its columns as a struct), ``n_words``, ``n_hit``, ``hits`` (spans
    in words, ids of the items, longest match) and, with ``cut``, ``clean`` (the text without the spans
    of ``cut`` or more words; null if there are none)."""
    spark = docs.sparkSession
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").alias("text"))
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-size // BLOCK_BYTES))
    out = docs.select(F.struct("*").alias("row"), F.col(text_column).alias("text"))
    row = out.schema["row"].dataType.simpleString()
    for k in range(blocks):
        own = items.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == k).collect()
        sent = store.sent(spark, Items([i.item_id for i in own], [i.text for i in own], window))
        last = cut is not None and k == blocks - 1

        def through(batches: Iterator[pa.RecordBatch], sent=sent, last=last) -> Iterator[pa.RecordBatch]:
            table = lower_alnum()
            for batch in pieces(batches):
                texts = texts_of(batch.column("text"))
                words = words_of(texts, table)
                before = batch.column("hits").to_pylist() if "hits" in batch.schema.names else None
                hits = _hits(sent(), words, before)
                columns = [batch.column("row"), batch.column("text"), pa.array(words.counts().astype(np.int64)), pa.array(hits, _HITS)]
                names = ["row", "text", "n_words", "hits"]
                if last:
                    cleaned = []
                    for t, h in enumerate(hits):
                        lo, hi, first, stop = texts.offsets[t], texts.offsets[t + 1], words.first[t], words.first[t + 1]
                        spans = [s for s in h["spans"] if s["end"] - s["start"] >= cut]
                        cleaned.append(_without(texts.data[lo:hi].tobytes(), words.start[first:stop] - lo, words.end[first:stop] - lo, spans) if spans else None)
                    columns, names = [*columns, pa.array(cleaned, pa.string())], [*names, "clean"]
                yield pa.RecordBatch.from_arrays(columns, names)

        out = out.mapInArrow(through, f"row {row}, text string, n_words long, hits struct<spans:array<struct<start:long,end:long>>,items:array<long>,longest:long>" + ", clean string" * last)
    hit = F.aggregate("hits.spans", F.lit(0).cast("long"), lambda a, s: a + s.end - s.start)
    return out.select("row", "n_words", hit.alias("n_hit"), "hits", *["clean"] * (cut is not None))


def decontaminated(docs: DataFrame, items: DataFrame, window: int = 10, least_words: int = 2, most_coverage: float = 0.5) -> DataFrame:
    """The rows of ``docs`` without contaminated text: spans of ``least_words`` or more words that
    windows of the items cover are cut out, and a row goes if more than ``most_coverage`` of its words
    are hit. An item of fewer than ``window`` words is cut where it occurs whole; an item of one word
    (fewer than ``least_words``) stays, or a common word would be lost from every text. ``n_chars``,
    where it exists, follows the text."""
    found = find_items(docs, items, window, cut=least_words)
    cut = F.col("clean").isNotNull()
    columns = {"text": F.when(cut, F.col("clean")).otherwise(F.col("row.text"))}
    if "n_chars" in docs.columns:
        columns["n_chars"] = F.when(cut, F.length("clean").cast("long")).otherwise(F.col("row.n_chars"))
    return found.where(F.col("n_hit") <= most_coverage * F.col("n_words")).select(
        *[columns.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
