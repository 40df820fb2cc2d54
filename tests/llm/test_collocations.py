"""Count transducers against plain counters, phrases against all of them counted, and the registered query."""

import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from declarium.llm import collocations, transducers
from declarium.llm.words import mix
from tests.compare import compare, connect
from tests.llm import brute

PHRASES = st.lists(st.lists(st.integers(1, 5), min_size=1, max_size=3), min_size=0, max_size=60)
NAMES = np.sort(mix(np.arange(1, 6).astype(np.uint64)))


def transducer(phrases):
    rows = [np.array([p[k] if k < len(p) else 0 for p in phrases], np.int64) for k in range(3)]
    return transducers.build(NAMES, transducers.counted(rows, None, len(NAMES)))


def weights(symbols, phrases):
    at = {int(s): i for i, s in enumerate(NAMES.tolist(), 1)}
    number = [0, *(at[s] for s in symbols.tolist())]
    rows = zip(*(w.tolist() for w in phrases.words), phrases.count.tolist())
    return {tuple(number[x] for x in r[:3] if x): r[3] for r in rows}


@settings(max_examples=120, deadline=None)
@given(st.lists(PHRASES, max_size=4), PHRASES)
def test_union_and_composition(shards, asked):
    blobs = [transducers.packed(transducer(s)) for s in shards]
    symbols, found = transducers.united(blobs)
    want = Counter(tuple(p) for s in shards for p in s)
    assert weights(symbols, found) == want
    t = transducers.unpacked(transducers.packed(transducers.build(symbols, found)))
    assert weights(t.symbols, transducers.paths(t)) == want
    rows = [np.array([NAMES[p[k] - 1] if k < len(p) else 0 for p in asked], np.uint64) for k in range(3)]
    assert transducers.looked_up(t, rows).tolist() == [want[tuple(p)] for p in asked]


def test_equal_states_are_one():
    t = transducer([[a, b, 1] for a in range(1, 6) for b in range(1, 6)])
    assert [len(layer.first) - 1 for layer in t.layers] == [1, 1, 1] and [len(layer.symbol) for layer in t.layers] == [5, 5, 1]


def test_phrases_too_many_to_pack(monkeypatch):
    draw = random.Random(3)
    words = [np.array([draw.randrange(1, 4) for _ in range(200)]), np.array([draw.randrange(3) for _ in range(200)]), np.zeros(200, np.int64)]
    counts = np.arange(200)
    packed = [transducers.counted(words, c, 3) for c in (None, counts)]
    monkeypatch.setattr(transducers, "MOST_PACKED", 2)
    for a, b in zip(packed, [transducers.counted(words, c, 3) for c in (None, counts)]):
        assert all((x == y).all() for x, y in zip([*a.words, a.count], [*b.words, b.count]))


def texts(seed, n=250):
    draw = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(30)] + ["Größe", "ÉTÉ", "É", "The", "a\x00b", "a\x01b"]
    out = [("en", None), (None, ""), ("fr", " \t "), ("en", ". , ;\n\x0b\x0c\r"), ("xx", "only two"), (None, "no lang here " * 12), ("und", "no lang here. " * 9)]
    for i in range(n):
        w = [draw.choice(vocabulary[: draw.choice((4, 36))]) + draw.choice(["", "", "", "", ".", ", ", "\n", "?!"]) for _ in range(draw.randrange(60))]
        out.append((draw.choice(["en", "en", "en", "de", None]), draw.choice([" ", "\t", "  "]).join(w)))
    return out + [("en", "Hot Pair " + " x".join(map(str, range(3000))))] + [("de", "the same text of copies")] * 40


def rows_of(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("ranges, words, most_ranges, sample", [(1 << 40, 1 << 20, 9, 1), (2000, 1 << 20, 1 << 16, 1 << 20), (2000, 7, 1 << 16, 1 << 20), (3000, 50, 3, 1 << 20), (2000, 50, 1 << 16, 1)])
def test_phrases(spark, monkeypatch, ranges, words, most_ranges, sample):
    for name, value in (("RANGE_BYTES", ranges), ("SHARD_WORDS", words), ("MOST_RANGES", most_ranges), ("SAMPLE_BYTES", sample)):
        monkeypatch.setattr(collocations, name, value)
    rows = texts(words, 120 if words == 7 else 250)
    docs = spark.createDataFrame([(lang, t, 1, "x", 2) for lang, t in rows], "lang string, text string, n long, word string, w1 long").repartition(3)
    got = collocations.collocations(docs)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    want = brute.collocations(rows)
    assert rows_of(got) == sorted(want) and len(want) > 20
    assert rows_of(collocations.collocations(docs, least=3, share=80, most=7)) == sorted(brute.collocations(rows, 3, 80, 7))


def test_empty(spark):
    assert collocations.collocations(spark.createDataFrame([], "lang string, text string")).count() == 0
    assert collocations.collocations(spark.createDataFrame([("en", None), (None, "")], "lang string, text string")).count() == 0


@pytest.mark.parametrize("partitions", [1, 2])
def test_words_of_one_hash_are_not_mixed_up(spark, monkeypatch, partitions):
    monkeypatch.setattr(collocations, "mix", lambda h: h & np.uint64(0))
    rows = [("en", "ab"), ("en", "cd")]
    docs = spark.createDataFrame(rows[:1], "lang string, text string").coalesce(1).unionByName(spark.createDataFrame(rows[1:], "lang string, text string").coalesce(1))
    with pytest.raises(Exception, match="two words of one hash"):
        collocations.collocations(docs.coalesce(partitions))


def test_scores_of_large_counts(spark):
    a, left, right = 9 * 10**12 + 7, 10**13 + 9, 9 * 10**12 + 8
    row = spark.createDataFrame([(a, left, right)], "a long, l long, r long").select(collocations._score("a", "l", "r").alias("s")).first()
    assert row.s == 10**6 * a * a // (left * right)


def test_query(spark):
    from declarium.llm.queries import ORACLE, op13_collocations

    sf = "/root/testdata/sf0.001"
    assert compare(op13_collocations(spark, sf), connect(sf), ORACLE["op13_collocations"]) == []
