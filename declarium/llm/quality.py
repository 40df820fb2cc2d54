"""Document quality by a regularised quadratic discriminant.

Each text becomes a vector of transformed statistics: how long it is, what its characters are, how
its words and word pairs repeat, how far symbols stick to words. Per class, mean and covariance come
from sums that Spark adds up; a covariance is shrunk towards the pooled one and that towards a
multiple of the identity, and factored once (Cholesky). The score is the posterior of the better
class from the difference of the two Mahalanobis log densities.

Defined cases: null and empty texts have the statistics of a text without words and get a score like
any other; labels without a document, null labels and documents without a label do not train; rows
that repeat an id are separate rows, each trained on and scored; if a class has no training row, its
prior alone decides; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from declarium.llm import store
from declarium.llm.words import lower_alnum, not_space, pieces, texts_of, windows, words_of

STATISTICS = (
    "words letters upper digits symbols exclamations bars sentence_ends commas other_ascii non_ascii lines line_length "
    "word_length word_spread short_words repeats distinct_words distinct_pairs distinct_runs symbol_words upper_words"
).split()

_CLASSES = np.full(256, 8, np.uint8)  # other ASCII
for _number, _bytes in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#$%&*", b"!", b"|", b".?;:", b",", b"", b"", b"\n", b" \t\r\v\f")):
    _CLASSES[list(_bytes)] = _number
_CLASSES[128:] = 9


def _distinct(hashes: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Different hashes of each text."""
    order = np.lexsort((hashes, owner))
    h, o = hashes[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    return np.bincount(o[new], minlength=n)


def statistics(column: pa.Array) -> np.ndarray:
    """One row of transformed statistics per text."""
    texts = texts_of(column)
    n = len(texts)
    kind = _CLASSES[texts.data]
    sizes = np.diff(texts.offsets)
    counts = np.zeros((n, 12))
    edges = texts.offsets
    for k in range(12):
        total = np.concatenate([[0], np.cumsum(kind == k, dtype=np.int64)])
        counts[:, k] = total[edges[1:]] - total[edges[:-1]]
    visible = np.maximum(1, sizes - counts[:, 10] - counts[:, 11])
    words = words_of(texts, lower_alnum())
    tokens = words_of(texts, not_space())
    owner, n_words = words.text, np.maximum(1, words.counts())
    length = (words.end - words.start).astype(float)
    add = lambda x, o: np.bincount(o, weights=x, minlength=n)
    mean = add(length, owner) / n_words
    spread = np.sqrt(np.maximum(0, add(length**2, owner) / n_words - mean**2))
    same = (owner[1:] == owner[:-1]) & (words.hash[1:] == words.hash[:-1])

    def different(size: int) -> np.ndarray:
        if len(words.hash) < size:
            return np.ones(n)
        lies = owner[: len(owner) - size + 1] == owner[size - 1 :]
        grams = windows(words.hash, size)[lies] if size > 1 else words.hash[lies]
        own = owner[: len(lies)][lies]
        return (_distinct(grams, own, n) + 1) / (np.bincount(own, minlength=n) + 1)

    last = kind[tokens.end - 1] if len(tokens.end) else np.zeros(0, np.uint8)
    ends_odd = (last >= 3) & (last <= 5)
    first_two = np.minimum(tokens.start + 1, len(kind) - 1) if len(kind) else tokens.start
    loud = (kind[tokens.start] == 1) & (kind[first_two] == 1) & (tokens.end - tokens.start > 1) if len(kind) else np.zeros(0, bool)
    n_tokens = np.maximum(1, tokens.counts())
    share = lambda k: np.log(counts[:, k] / visible + 1e-3)
    lines = counts[:, 10] + 1
    columns = [
        np.log1p(words.counts()), (counts[:, 0] + counts[:, 1] + counts[:, 9]) / visible, share(1), share(2), share(3), share(4), share(5), share(6), share(7),
        share(8), np.sqrt(counts[:, 9] / visible), np.log(lines / n_words + 1e-3), np.log1p(sizes / lines), np.log1p(mean), np.log1p(spread),
        np.sqrt(add((length <= 3).astype(float), owner) / n_words), np.log(add(same.astype(float), owner[1:]) / n_words + 1e-3),
        np.log(different(1)), np.log(different(2)), np.log(different(5)), np.log(add(ends_odd.astype(float), tokens.text) / n_tokens + 1e-3),
        np.log(add(loud.astype(float), tokens.text) / n_tokens + 1e-3),
    ]
    return np.stack(columns, 1)


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training: crc32 of its id as text is a multiple of 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


class Discriminant:
    """Two Gaussian classes with shrunk covariances; the Cholesky factors are computed once."""

    def __init__(self, n: np.ndarray, sums: np.ndarray, squares: np.ndarray, shrink: float, ridge: float):
        d = sums.shape[1]
        self.prior = np.log((n + 0.5) / (n.sum() + 1))
        self.known = bool((n > 1).all())
        if not self.known:
            return
        self.mean = sums / n[:, None]
        scatter = squares - n[:, None, None] * self.mean[:, :, None] * self.mean[:, None, :]
        pooled = scatter.sum(0) / max(1, n.sum() - 2)
        scale = np.sqrt(np.maximum(np.diag(pooled), 1e-12))
        self.scale = scale
        to_unit = lambda m: m / scale[:, None] / scale[None, :]
        pooled = (1 - ridge) * to_unit(pooled) + ridge * np.eye(d)
        self.factor, self.log_det = [], []
        for k in (0, 1):
            own = (1 - shrink) * to_unit(scatter[k] / max(1, n[k] - 1)) + shrink * pooled
            own = (1 - ridge) * own + ridge * np.eye(d)
            factor = np.linalg.cholesky(own)
            self.factor.append(np.linalg.inv(factor))
            self.log_det.append(2 * np.log(np.diag(factor)).sum())

    def score(self, x: np.ndarray) -> np.ndarray:
        """Posterior of class 1."""
        density = np.tile(self.prior, (len(x), 1))
        if self.known:
            for k in (0, 1):
                z = (x - self.mean[k]) / self.scale @ self.factor[k].T
                density[:, k] -= 0.5 * ((z * z).sum(1) + self.log_det[k])
        return 1 / (1 + np.exp(np.clip(density[:, 0] - density[:, 1], -700, 700)))


def fit(measured: DataFrame, labels: DataFrame, label: str, shrink: float, ridge: float) -> Discriminant:
    """From the rows of ``measured`` (``doc_id``, ``x``) that have a label and are not held out."""
    d = len(STATISTICS)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where("y in (0, 1)").distinct()
    rows = measured.join(known, "doc_id").where(~held_out(F.col("doc_id"))).select("y", "x")

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, squares = np.zeros(2), np.zeros((2, d)), np.zeros((2, d, d))
        for batch in batches:
            y = batch.column("y").to_numpy()
            x = batch.column("x").flatten().to_numpy().reshape(len(y), d)
            for k in (0, 1):
                own = x[y == k]
                n[k] += len(own)
                sums[k] += own.sum(0)
                squares[k] += own.T @ own
        packed = np.concatenate([n, sums.ravel(), squares.ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(packed))), pa.array(packed)], ["at", "v"])

    total = rows.mapInArrow(summed, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).orderBy("at").collect()
    v = np.array([r.v for r in total]) if total else np.zeros(2 + 2 * d + 2 * d * d)
    return Discriminant(v[:2], v[2 : 2 + 2 * d].reshape(2, d), v[2 + 2 * d :].reshape(2, d, d), shrink, ridge)


def quality_scores(docs: DataFrame, labels: DataFrame, label: str = "quality", shrink: float = 0.5, ridge: float = 0.001, threshold: float = 0.3) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``held_out``, ``score``, ``predicted`` and the statistics ``x``."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            x = statistics(batch.column("text"))
            x = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), x], ["doc_id", "x"])

    measured, _ = store.parked(texts.mapInArrow(measure, "doc_id long, x array<double>"))
    sent = store.sent(docs.sparkSession, fit(measured, labels, label, shrink, ridge))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x").flatten().to_numpy().reshape(batch.num_rows, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sent().score(x)), batch.column("x")], ["doc_id", "score", "x"])

    scored = measured.mapInArrow(score, "doc_id long, score double, x array<double>")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "x")
