"""Packing: the solver against bounds and best fit, the pieces against the tokenizer itself."""

import bisect
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from declarium.llm import packing
from declarium.llm.queries import op11_best_fit_packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


def held(solved, capacity):
    out = {}
    for c, times in solved.configurations:
        assert times > 0 and sum(n * a for n, a in c) <= capacity
        for n, a in c:
            out[n] = out.get(n, 0) + times * a
    return out


def best_fit(histogram, capacity):
    free, bins = [], 0
    for n in sorted((n for n, c in histogram.items() for _ in range(c)), reverse=True):
        at = bisect.bisect_left(free, n)
        bins += at == len(free)
        bisect.insort(free, (free.pop(at) if at < len(free) else capacity) - n)
    return bins


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 40).flatmap(lambda c: st.tuples(st.just(c), st.dictionaries(st.integers(1, c), st.integers(1, 200), max_size=12))))
def test_solver(given_):
    capacity, histogram = given_
    solved = packing.solve(histogram, capacity)
    assert held(solved, capacity) == histogram
    assert -(-sum(n * c for n, c in histogram.items()) // capacity) <= solved.lower_bound <= solved.sequences
    assert solved.sequences <= 1.02 * best_fit(histogram, capacity) + 1


@pytest.mark.parametrize("low, high, n", [(250, 600, 8000), (300, 420, 8000), (1, 1024, 5000), (330, 350, 3000), (1, 200, 9000)])
def test_solver_beside_best_fit(low, high, n):
    sizes, counts = np.unique(np.random.default_rng(low).integers(low, high, n), return_counts=True)
    histogram = dict(zip(sizes.tolist(), counts.tolist()))
    solved = packing.solve(histogram, 1024)
    assert held(solved, 1024) == histogram and solved.sequences <= best_fit(histogram, 1024) + 1


def test_more_pieces_take_no_more_turns():
    histogram = {n: 10**12 + n for n in range(40, 1000, 7)}
    solved = packing.solve(histogram, 1024)
    assert held(solved, 1024) == histogram and solved.sequences <= 1.02 * solved.lower_bound
    assert len(solved.configurations) < 40_000


def test_knapsack_is_exact():
    rng = np.random.default_rng(2)
    for _ in range(30):
        lengths = np.unique(rng.integers(1, 40, 6))
        left = rng.integers(0, 4, len(lengths))
        sums = {0}
        for n, c in zip(lengths.tolist(), left.tolist()):
            sums = {s + k * n for s in sums for k in range(c + 1)}
        for room in (1, 17, 60):
            got = packing._fullest(lengths, left, room)
            assert sum(lengths[k] * a for k, a in got) == max(s for s in sums if s <= room)
            assert all(0 < a <= left[k] for k, a in got)


TEXTS = [(1, None), (2, ""), (3, " "), (4, "one two  three\n\n four's"), (5, "Größe ÉTÉ 　 naïve \U0001f600"), (6, "<|endoftext|> a <|endoftext|>b"), (6, "again 6")]
TEXTS += [(None, "no id"), (7, "word " * 9000), (8, "x" * 3000), (9, "a b c " * 341 + "d"), (10, "a b c " * 341), (11, "a b " * 255)] + [(i, "some words of it " * (i % 37)) for i in range(20, 300)]


def expected(capacity):
    tokenizer = Tokenizer.from_file(PATH)
    out = []
    for number, text in TEXTS:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        first = len(ids) % capacity or capacity
        cuts = [0, *range(first, len(ids) + 1, capacity)]
        out += [(number, k, a, b - a, np.array(ids[a:b], "<u4").tobytes()) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    return sorted(out, key=str)


def check_places(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in by.values():
        own.sort()
        assert [o for o, _ in own] == np.cumsum([0] + [n for _, n in own])[:-1].tolist() and sum(n for _, n in own) <= capacity
    return len(by)


@pytest.mark.parametrize("capacity, sent", [(1024, 300_000), (1024, 0), (16, 300_000), (1, 300_000)])
def test_pieces(spark, monkeypatch, capacity, sent):
    monkeypatch.setattr(packing, "MOST_SENT", sent)
    docs = spark.createDataFrame([(i, t, 1, 2, b"x") for i, t in TEXTS], "doc_id long, text string, part long, piece int, ids binary").repartition(4)
    got, solved = packing.pack(docs, PATH, capacity=capacity)
    rows = got.collect()
    assert sorted(((r.doc_id, r.piece, r.start, r.length, bytes(r.ids)) for r in rows), key=str) == expected(capacity)
    assert check_places(rows, capacity) == solved.sequences and solved.sequences <= 1.05 * solved.lower_bound + 1
    whole = {r.sequence_id: r for r in packing.sequences(got).collect()}
    assert sum(len(r.pieces) for r in whole.values()) == len(rows)
    for r in rows:
        own = whole[r.sequence_id]
        assert bytes(own.ids)[4 * r.offset : 4 * (r.offset + r.length)] == bytes(r.ids) and own.n_tokens * 4 == len(own.ids)


def test_empty(spark):
    got, solved = packing.pack(spark.createDataFrame([], "doc_id long, text string"), PATH)
    assert got.count() == 0 and solved.sequences == 0 and solved.lower_bound == 0


def test_query(spark, tmp_path):
    spark.createDataFrame(TEXTS, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = op11_best_fit_packing(spark, str(tmp_path))
    assert got.dtypes == [("doc_id", "bigint"), ("piece", "int"), ("start", "bigint"), ("length", "bigint"), ("ids_crc32", "bigint"), ("sequence_id", "bigint"), ("offset", "bigint")]
    rows = got.collect()
    want = sorted((n, k, a, size, zlib.crc32(ids)) for n, k, a, size, ids in expected(1024) if n is not None)
    assert sorted(tuple(r)[:5] for r in rows if r.doc_id is not None) == want
    check_places(rows, 1024)


def test_small_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got, solved = packing.pack(docs, PATH)
    assert got.agg(F.count_distinct("sequence_id")).first()[0] == solved.sequences <= solved.lower_bound + 1
