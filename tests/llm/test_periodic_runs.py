"""Periodic runs against every lag and place tried, and the registered query on a table."""

import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from declarium.llm import periodic_runs
from declarium.llm.queries import op12_periodic_runs
from declarium.llm.words import mix
from tests.llm import brute


def found(texts, **limits):
    first = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    symbols = np.array([s for t in texts for s in t], np.uint64)
    got = periodic_runs.find_runs(mix(symbols + np.uint64(77)), first, **limits)
    out = [[] for _ in texts]
    for t, *run in zip(*(x.tolist() for x in got)):
        out[t].append(tuple(run))
    return out


BLOCKS = st.lists(st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=9), st.integers(1, 14)), max_size=6)


@settings(max_examples=150, deadline=None)
@given(st.lists(BLOCKS, min_size=1, max_size=4))
def test_runs_of_repeated_blocks(texts):
    texts = [[s for block, times in t for s in block * times] for t in texts]
    assert found(texts) == [brute.runs(t) for t in texts]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 1), max_size=120), st.integers(3, 12), st.integers(3, 5))
def test_runs_of_two_symbols_with_other_limits(text, least_words, least_exponent):
    assert found([text], least_words=least_words, least_exponent=least_exponent) == [brute.runs(text, least_words, least_exponent)]


@pytest.mark.parametrize("period", [1, 7, 8, 9, 16, 17, 18, 32, 33, 64, 65, 100])
def test_runs_at_the_edges_of_octaves(period):
    draw = random.Random(period)
    least = max(24, 3 * period)
    for length, n in ((least - 1, 0), (least, 1), (least + 5, 1)):
        # The block is itself made of two repeating halves where it can be, but for one word.
        half = [draw.randrange(5) for _ in range(period // 2)]
        block = (half * 2 + [9] * period)[:period]
        block[-1] = 8
        text = [50, 51] + (block * 40)[:length] + [60, 61]
        got = found([text])[0]
        assert got == brute.runs(text) and sum(r[2] == period for r in got) == n


def test_a_word_a_hundred_thousand_times():
    assert found([[3] * 100_000, [], [1, 2] * 30_000]) == [[(0, 100_000, 1)], [], [(0, 60_000, 2)]]


TEXTS = [
    (1, None), (2, ""), (3, " \t\n\x0b "), (4, "a " * 23), (5, "a " * 24), (6, "b c\n" * 40 + "x " + "c\td " * 40), (6, "b c\n" * 40), (None, "z " * 30),
    (7, "a\x00b a\x01b " * 30), (8, "Größe  Maß " * 50 + "ende"), (9, " ".join(f"w{i % 700}" for i in range(5000))),
]
TEXTS += [(i, " ".join(f"w{(i * j * j) % 97}" for j in range(40 + i))) for i in range(20, 120)]


def test_rows(spark):
    schema = "doc_id long, text string, row string, runs int, kept string, n_chars long"
    docs = spark.createDataFrame([(i, t, "r", 1, "k", 5) for i, t in TEXTS], schema).repartition(3)
    got = periodic_runs.periodic_runs(docs).select("row.doc_id", "row.row", "n_words", "runs", "kept").collect()
    want = []
    for i, t in TEXTS:
        words = brute.TOKEN.findall(t or "")
        runs = brute.runs(words)
        want.append((i, "r", len(words), runs, brute.collapsed(words, runs)))
    assert sorted(((*r[:3], [tuple(x) for x in r.runs], r.kept) for r in got), key=str) == sorted(want, key=str)
    clean = periodic_runs.collapsed(docs)
    assert clean.schema == docs.schema
    kept = {r.doc_id: (r.text, r.n_chars) for r in clean.collect()}
    assert kept[5] == ("a", 1) and kept[4] == ("a " * 23, 5) and kept[1] == (None, 5)
    assert periodic_runs.periodic_runs(docs.limit(0)).count() == 0


def test_query(spark, tmp_path):
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in TEXTS) > 5
    spark.createDataFrame(TEXTS, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = op12_periodic_runs(spark, str(tmp_path))
    assert got.columns[1:] == ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert [k for _, k in got.dtypes] == ["bigint"] * 6 + ["string"] * 2
    assert sorted(map(tuple, got.collect()), key=str) == sorted((brute.runs_row(i, brute.with_block(i, t)) for i, t in TEXTS), key=str)


def test_query_on_the_small_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/documents.parquet").where(F.length("text") < 4000).select("doc_id", "text").collect()
    got = {r.doc_id: tuple(r) for r in op12_periodic_runs(spark, sf).collect()}
    assert rows and all(got[r.doc_id] == brute.runs_row(r.doc_id, brute.with_block(r.doc_id, r.text)) for r in rows)
