"""Token ids of texts by a public byte-pair vocabulary, with a cache of pieces per Python worker.

A text is cut before each space that a visible character follows. The pattern of these vocabularies
always begins a new token there, so encoding piece by piece gives the same ids as encoding the text,
and a piece that was met before costs one look-up.
"""

from __future__ import annotations

import base64
import json
import re
import sys
import types
from array import array
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from declarium.llm import store
from declarium.llm.words import hashes, pieces, texts_of

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the splitting pattern of the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
MOST_CACHED = 400_000
#: Text whose characters no version of Unicode puts in another class.
SETTLED = re.compile("[\x00-\x7f\xa1-\u052f]*")

#: Bytes a visible character may begin with: not white space, and no byte that begins a wide space.
_VISIBLE = np.ones(256, bool)
_VISIBLE[[*range(0x09, 0x0E), 0x20, 0xC2, 0xE1, 0xE2, 0xE3]] = False


def _of_worker(name: str) -> dict:
    """A dictionary that lives as long as the Python worker; functions come anew with each task."""
    return vars(sys.modules.setdefault("declarium_worker", types.ModuleType("declarium_worker"))).setdefault(name, {})


class Vocabulary:
    """The file's bytes, read once by the driver; each worker builds its encoder from them."""

    def __init__(self, path: str = VOCABULARY):
        self.data = Path(path).read_bytes()
        self.size = sum(1 for line in self.data.splitlines() if line.strip()) + 1
        #: The first id that no token has ends each document and fills up short sequences.
        self.end = self.size - 1
        self.kind = np.uint16 if self.size <= 1 << 16 else np.uint32

    def encoder(self):
        import tiktoken

        known = _of_worker("encoders")
        key = hash(self.data)
        if key not in known:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in self.data.splitlines() if line.strip())}
            known[key] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        return known[key]

    def piece_encoder(self, raw: bytes):
        """A function from the bytes of a piece of ``raw`` to those of its ids."""
        encode, kind = self.encoder().encode_ordinary, self.kind
        return lambda piece: np.array(encode(piece.decode()), kind).tobytes()

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts end to end, and where each text's ids begin."""
        texts = texts_of(column)
        data, edges = texts.data, texts.offsets
        cut = np.zeros(len(data) + 1, bool)
        if len(data) > 1:
            cut[:-2] = (data[:-1] == 0x20) & _VISIBLE[data[1:]]
        cut[edges] = True
        cut[-1] = False
        start = np.flatnonzero(cut)
        end = np.append(start[1:], len(data))[: len(start)]
        h = hashes(data, start, end)
        values, first, number = np.unique(h, return_index=True, return_inverse=True)
        cache = _of_worker(f"pieces-{hash(self.data)}")
        if len(cache) + len(values) > MOST_CACHED:
            cache.clear()
        raw = data.tobytes()
        encode = self.piece_encoder(raw)
        own = []
        for v, at in zip(values.tolist(), first.tolist()):
            ids = cache.get(v)
            if ids is None:
                ids = cache[v] = encode(raw[start[at] : end[at]])
            own.append(ids)
        flat = np.frombuffer(b"".join(own), self.kind)
        sizes = np.array([len(x) for x in own], np.int64) // np.dtype(self.kind).itemsize
        at = np.concatenate([[0], np.cumsum(sizes)])
        n = sizes[number] if len(number) else np.zeros(0, np.int64)
        total = np.concatenate([[0], np.cumsum(n)])
        ids = flat[np.repeat(at[:-1][number] - total[:-1], n) + np.arange(total[-1])] if len(number) else flat
        return ids, total[np.searchsorted(start, edges)]


class JsonVocabulary(Vocabulary):
    """A byte-level vocabulary of the ``tokenizers`` library, as a JSON file. Strings of special tokens in a text
    are these tokens, as the library has it.

    If a token's id is the rank of its merge, the vocabulary is a table of ranks as well. Pieces of Latin, Greek and
    Cyrillic letters in a batch without special tokens are then encoded from that, which is faster; the ids are the
    same."""

    def __init__(self, path: str, end: int):
        self.data = Path(path).read_bytes()
        listed = json.loads(self.data)
        vocab, merges = listed["model"]["vocab"], listed["model"]["merges"]
        self.special = [t["content"].encode() for t in listed["added_tokens"]]
        self.size = 1 + max([*vocab.values(), *(t["id"] for t in listed["added_tokens"])])
        self.end = end
        self.kind = np.uint16 if self.size <= 1 << 16 else np.uint32
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        plain = listed["normalizer"] is None and listed["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
        self.ranked = plain and len(vocab) == 256 + len(pairs) and all(vocab.get("".join(p)) == 256 + k for k, p in enumerate(pairs))

    def _known(self, kind: str, build):
        known, key = _of_worker("encoders"), (kind, hash(self.data))
        if key not in known:
            known[key] = build()
        return known[key]

    def _ranks(self):
        import tiktoken

        # Fixed value: the library writes a byte as the character of its code, or, where that is no visible one,
        # as the next free character from code 256 on.
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
        vocab = json.loads(self.data)["model"]["vocab"]
        return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks={bytes(byte[c] for c in t): i for t, i in vocab.items()}, special_tokens={})

    def encoder(self):
        from tokenizers import Tokenizer

        own = self._known("whole", lambda: Tokenizer.from_str(self.data.decode()))
        return types.SimpleNamespace(encode_ordinary=lambda text: own.encode(text, add_special_tokens=False).ids)

    def piece_encoder(self, raw: bytes):
        letter, whole = "H" if self.kind == np.uint16 else "I", self.encoder().encode_ordinary
        if not self.ranked or any(s in raw for s in self.special):
            return lambda piece: array(letter, whole(piece.decode())).tobytes()
        ranks = self._known("ranks", self._ranks).encode_ordinary

        def encode(piece: bytes) -> bytes:
            text = piece.decode()
            return array(letter, (ranks if SETTLED.fullmatch(text) else whole)(text)).tobytes()

        return encode


def with_lengths(docs: DataFrame, path: str = VOCABULARY, text_column: str = "text") -> DataFrame:
    """One row ``length`` per row of ``docs``: ids of its text, 0 for null."""
    sent = store.sent(docs.sparkSession, Vocabulary(path))

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = sent()
        for batch in pieces(batches, most=2 << 20):
            _, at = vocabulary.encode(batch.column("text"))
            yield pa.RecordBatch.from_arrays([pa.array(np.diff(at))], ["length"])

    return docs.select(F.col(text_column).alias("text")).mapInArrow(measured, "length long")
