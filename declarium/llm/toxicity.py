"""Toxicity by weak supervision.

Voters are many weak signs of toxicity: a fixed lexicon, and words and word beginnings (patterns of 3
to 8 bytes) found in labelled training documents by how often they stand in either class. A voter
votes where its sign occurs. A generative label model of a hidden class and the votes is fitted by
expectation maximisation: voters that fire together beyond what the class explains are joined to one
source, so that correlated voters do not count many times; each source has its accuracy, a rate of
votes in either class. Its posterior labels then train a linear classifier on the votes and how often
they were cast, which scores all documents.

Training takes a sample bounded by ``most_rows`` labelled documents of each class (those whose hashed
id is smallest); held-out documents are never in it. Everything else covers all documents.

Defined cases: null and empty texts have no votes and get the score of a text without any; null labels
and labels without a document do not train; without training rows the lexicon votes alone; rows that
repeat an id are scored each; an empty table gives an empty result; other columns are carried.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from declarium.llm import store
from declarium.llm.quality import held_out
from declarium.llm.words import hashes, long_of, lower_alnum, mix, pieces, texts_of, words_of

#: The lexicon, words of insult and abuse.
LEXICON = (
    "bastard clown creep crap disgusting dumb fool freak garbage hate idiot imbecile jerk kill loser moron pathetic pig scum "
    "stupid trash ugly vermin worthless"
).split()
BEGINNINGS = range(3, 9)


def _terms(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Text numbers and hashes of all words, then of their beginnings of each length."""
    texts = texts_of(column)
    table = lower_alnum()
    words = words_of(texts, table)
    yield words.text, words.hash
    norm = table[texts.data]
    for n in BEGINNINGS:
        long_ = words.end - words.start > n
        start = words.start[long_]
        yield words.text[long_], mix(hashes(norm, start, start + n) + np.uint64(n))


def lexicon_terms() -> np.ndarray:
    return next(iter(_terms(pa.array(LEXICON))))[1]


def _votes(column: pa.Array, terms: np.ndarray) -> np.ndarray:
    """How often each of the sorted terms occurs in each text."""
    quick = np.zeros(1 << 16, bool)
    quick[(terms & np.uint64(0xFFFF)).astype(np.int64)] = True
    out = np.zeros(len(column) * len(terms), np.int64)
    for owner, h in _terms(column):
        maybe = np.flatnonzero(quick[(h & np.uint64(0xFFFF)).astype(np.int64)])
        at = np.minimum(np.searchsorted(terms, h[maybe]), len(terms) - 1)
        right = terms[at] == h[maybe]
        out += np.bincount(owner[maybe[right]] * len(terms) + at[right], minlength=len(out))
    return out.reshape(len(column), len(terms))


class LabelModel(NamedTuple):
    """Sources (groups of voters), the rate at which each votes in either class, the rate of rows
    without any vote, and the class prior."""

    source: np.ndarray
    rate: np.ndarray
    silent: np.ndarray
    prior: float
    correlation: np.ndarray

    def odds(self, votes: np.ndarray) -> np.ndarray:
        """Log odds of the toxic class, given the votes. A source that does not vote abstains and says
        nothing (its signs may be of another language); that none votes is an observation of its own."""
        fires = _by_source(votes > 0, self.source)
        silent = ~fires.any(1)
        return np.log(self.prior / (1 - self.prior)) + fires @ np.log(self.rate[1] / self.rate[0]) + silent * np.log(self.silent[1] / self.silent[0])


def _by_source(fires: np.ndarray, source: np.ndarray) -> np.ndarray:
    out = np.zeros((len(fires), int(source.max()) + 1), bool)
    for j, s in enumerate(source):
        out[:, s] |= fires[:, j]
    return out


def _correlation(fires: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Correlation of each two voters within the classes, the posterior q taken as known."""
    total, weight = 0.0, max(1, len(fires))
    for part in (q, 1 - q):
        mean = part @ fires / max(1e-9, part.sum())
        centred = fires - mean
        total = total + (centred * part[:, None]).T @ centred
    var = np.sqrt(np.maximum(np.diag(total), 1e-12 * weight))
    return total / var[:, None] / var[None, :]


def fit_label_model(votes: np.ndarray, label: np.ndarray, joined: float = 0.5, trust: float = 0.95, rounds: int = 25) -> tuple[LabelModel, np.ndarray]:
    """Expectation maximisation, and the posterior of each row. The given label is one more voter,
    whose accuracy ``trust`` is fixed: it keeps the hidden class from turning into something else
    that many voters share, such as a language."""
    start = trust * label + (1 - trust) * (1 - label)
    given, prior = np.log(start / (1 - start)), float(label.mean())
    fires = (votes > 0).astype(float)
    correlation = _correlation(fires, start)
    source = np.arange(votes.shape[1])
    for i, j in zip(*np.nonzero(np.triu(correlation, 1) > joined)):
        source[source == source[j]] = source[i]
    source = np.unique(source, return_inverse=True)[1]
    own = _by_source(votes > 0, source).astype(float)
    q = start
    for _ in range(rounds):
        # Half a vote added on each side; a source is never less likely to vote in the toxic class.
        rate = np.array([(part @ own + 0.5) / (part.sum() + 50) for part in (1 - q, q)])
        rate = np.clip(rate, 1e-6, 1 - 1e-6)
        rate[1] = np.maximum(rate[0], rate[1])
        silent = np.array([(part @ (own.sum(1) == 0) + 0.5) / (part.sum() + 50) for part in (1 - q, q)])
        model = LabelModel(source, rate, silent, float(np.clip((q.sum() + prior * 50) / (len(q) + 50), 1e-4, 0.9)), correlation)
        q = 1 / (1 + np.exp(-np.clip(model.odds(votes) + given, -500, 500)))
    return model, q


def _features(votes: np.ndarray) -> np.ndarray:
    """Whether each voter votes, how often in all, and a constant."""
    fires = votes > 0
    return np.concatenate([fires, np.log1p(votes.sum(1, keepdims=True)), np.log1p(fires.sum(1, keepdims=True)), np.ones((len(votes), 1))], 1).astype(float)


def fit_linear(x: np.ndarray, q: np.ndarray, weight: np.ndarray, penalty: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Logistic regression on soft labels by Newton's method."""
    w = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], penalty)
    ridge[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        gradient = x.T @ (weight * (p - q)) + ridge * w
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(ridge + 1e-9)
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


class Model(NamedTuple):
    terms: np.ndarray
    weights: np.ndarray
    label_model: LabelModel | None

    def score(self, column: pa.Array) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(_features(_votes(column, self.terms)) @ self.weights, -500, 500)))


def _mined(sample: DataFrame, most_terms: int, least: float) -> np.ndarray:
    """Words and beginnings that stand in toxic documents far more often than in others: at least
    ``least`` of the documents with them are toxic, with allowance for small numbers."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            y = batch.column("y").to_numpy()
            for owner, h in _terms(batch.column("text")):
                if not len(h):
                    continue
                order = np.lexsort((owner, h))
                h, owner = h[order], owner[order]
                first = np.ones(len(h), bool)
                first[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
                h, bad = h[first], y[owner[first]]
                new = np.ones(len(h), bool)
                new[1:] = h[1:] != h[:-1]
                at = np.flatnonzero(new)
                df, toxic = np.diff(np.append(at, len(h))), np.add.reduceat(bad, at)
                yield pa.RecordBatch.from_arrays([pa.array(long_of(h[at])), pa.array(toxic.astype(np.int64)), pa.array(df)], ["term", "toxic", "df"])

    counts = sample.mapInArrow(counted, "term long, toxic long, df long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("df").alias("df"))
    # The sample is bounded, so all its terms are counted exactly, however it is partitioned.
    rate = (F.col("toxic") - F.sqrt("toxic")) / F.col("df")
    chosen = counts.where((F.col("toxic") >= 4) & (rate >= least)).orderBy(F.desc("toxic"), "df", "term").limit(most_terms).collect()
    return np.array([r.term for r in chosen], np.int64).view(np.uint64)


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", most_rows: int = 6000, most_terms: int = 300, least: float = 0.5, trust: float = 0.999, penalty: float = 1.0) -> Model:
    """The classifier, from the documents with a label that are not held out."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where("y in (0, 1)")
    known = known.where(~held_out(F.col("doc_id"))).distinct()
    order = [F.xxhash64("doc_id"), "doc_id"]
    chosen = known.where("y = 1").orderBy(*order).limit(most_rows).unionByName(known.where("y = 0").orderBy(*order).limit(most_rows))
    share = known.agg(F.coalesce(F.avg("y"), F.lit(0.1))).first()[0]
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    sample = texts.join(F.broadcast(chosen), "doc_id").select("y", "text")
    mined = _mined(sample, most_terms, least)
    terms = np.unique(np.concatenate([lexicon_terms(), mined]))
    sent = docs.sparkSession.sparkContext.broadcast(terms)

    def cast(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            votes = np.minimum(_votes(batch.column("text"), sent.value), 255).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array([v.tobytes() for v in votes], pa.binary())], ["y", "votes"])

    rows = sample.mapInArrow(cast, "y int, votes binary").toArrow()
    votes = np.frombuffer(b"".join(rows.column("votes").to_pylist()), np.uint8).reshape(rows.num_rows, len(terms)).astype(np.int64)
    if not rows.num_rows:
        # The lexicon alone: any vote is more likely toxic than not.
        return Model(terms, np.concatenate([np.zeros(len(terms)), [4.0, 0.0, -2.0]]), None)
    y = rows.column("y").to_numpy().astype(float)
    # The sample holds the classes in other shares than the corpus; weights put that right.
    weight = np.where(y == 1, share / max(y.mean(), 1e-9), (1 - share) / max(1 - y.mean(), 1e-9))
    model, q = fit_label_model(votes, y, trust=trust)
    return Model(terms, fit_linear(_features(votes), q, weight, penalty), model)


def toxicity_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **options) -> DataFrame:
    """Per row of ``docs``: ``row`` (its columns as a struct), ``held_out``, ``score``, ``predicted``."""
    sent = store.sent(docs.sparkSession, train(docs, labels, **options))
    rows = docs.select(F.struct("*").alias("row"), F.col("text").alias("text"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, most=4 << 20):
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(sent().score(batch.column("text")))], ["row", "score"])

    scored = rows.mapInArrow(score, f"row {rows.schema['row'].dataType.simpleString()}, score double")
    return scored.select("row", held_out(F.col("row.doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that are not predicted to be toxic."""
    return toxicity_scores(docs, labels, **options).where("predicted = 0").select("row.*")
