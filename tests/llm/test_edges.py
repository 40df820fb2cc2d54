"""Every operator on nulls, empty and long texts, ties, repeated rows, empty tables, clashing names."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from declarium.llm import components, decontaminate, embedding_dedup, license_scan, mixing, near_dedup, quality, substring_dedup, token_counts, toxicity, training_order
from declarium.llm.tokens import Vocabulary
from tests.llm import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, hits string, block int, node long, label string"
random.seed(7)
VOCABULARY = [f"w{i}" for i in range(400)]


def prose(n):
    return " ".join(random.choice(VOCABULARY) for _ in range(n))


PASSAGE, LONG = prose(60), prose(9000)
TEXTS = [
    (1, PASSAGE + " " + prose(40)), (2, prose(30) + "\n" + PASSAGE), (3, None), (4, ""), (5, "one two"), (6, "one two"), (7, LONG),
    (8, LONG + " end"), (9, prose(12)), (10, " \t\n "), (11, "Größe ÉTÉ naïve " + prose(20)), (12, LONG.replace("w1 ", "x1 ", 3)),
    (12, prose(50)), (13, PASSAGE.upper()), (13, PASSAGE.upper()), (None, PASSAGE), (14, "the idiot is stupid " + prose(15)), (15, "the idiot is stupid " + prose(15)),
    (16, "!!! ??? ..."), (17, "Licensed under CC BY-NC 4.0.\n" + prose(10)), (18, "a\x00b \x01 c " * 20),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", ["a", "a", "b", None, ""][k % 5], len(t or ""), "r", "h", 1, 2, "l") for k, (i, t) in enumerate(TEXTS)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).persist()


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(1, 1, 0), (2, 1, 0), (3, 0, 0), (7, 1, 0), (9, 0, None), (14, 0, 1), (15, None, 1), (99, 1, 1), (None, 1, 1), (11, 1, 0)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def test_substring_dedup(docs, empty):
    got = substring_dedup.remove_repeated(docs).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256))
    assert rows_of(got, "*") == sorted(brute.without_repeats(TEXTS), key=str)
    assert substring_dedup.remove_repeated(empty).count() == 0


def test_substring_levels_reach_the_whole_repeat(spark):
    shared = prose(300)
    df = spark.createDataFrame([(1, shared), (2, prose(5) + " " + shared), (3, prose(200))], "doc_id long, text string")
    got = {r.doc_id: (r.longest, [tuple(s) for s in r.spans]) for r in substring_dedup.remove_repeated(df).collect()}
    assert got == {1: (208, []), 2: (208, [(5, 305)]), 3: (0, [])}


def test_decontamination(spark, docs, empty):
    items = [(1, PASSAGE), (2, "two"), (3, None), (4, ""), (5, "naïve " + TEXTS[10][1].split(" ", 3)[3]), (None, LONG[:200]), (1, PASSAGE), (10, "no such words at all")]
    table = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.find_items(docs, table)
    digest = F.sha2(F.concat_ws(",", F.array_sort(F.transform("hits.items", lambda i: i.cast("string")))).cast("binary"), 256)
    assert rows_of(got, "row.doc_id", "n_words", "n_hit", F.size("hits.items"), digest, F.col("n_hit") > 0) == sorted(brute.contaminated(TEXTS, items), key=str)
    cleaned = decontaminate.decontaminated(docs, table)
    assert cleaned.columns == docs.columns and cleaned.schema == docs.schema
    kept = {(r.doc_id, r.text) for r in cleaned.collect()}
    assert (2, TEXTS[1][1]) not in kept and (9, TEXTS[8][1]) in kept and all(PASSAGE not in (t or "") for _, t in kept)
    assert decontaminate.find_items(empty, table).count() == 0
    assert decontaminate.find_items(docs, table.limit(0)).where("n_hit > 0").count() == 0


def test_short_items_are_cut_whole(spark):
    texts = [(1, "One two THREE four, five six. " + "clean words follow here " * 3), (2, "two three"), (3, "two three? no: three four stays, one word"), (4, None), (5, ""),
             (6, "a b c d e f g h i and many other words that no item has, then a b c d e f g h once more in part")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    items = spark.createDataFrame([(1, "two three"), (2, "a b c d e f g h i"), (3, "word"), (4, "")], "item_id long, text string")
    got = {r.doc_id: r.text for r in decontaminate.decontaminated(docs, items).collect()}
    assert got == {1: "One four, five six. " + "clean words follow here " * 3, 3: "? no: three four stays, one word", 4: None, 5: "",
                   6: "and many other words that no item has, then a b c d e f g h once more in part"}


def test_decontamination_in_several_blocks(spark, docs, monkeypatch):
    items = [(k, t) for k, (_, t) in enumerate(TEXTS) if k in (0, 6, 9, 10)]
    table = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 20_000)
    got = rows_of(decontaminate.find_items(docs, table), "row.doc_id", "n_words", "n_hit", F.size("hits.items"))
    assert got == sorted((r[:4] for r in brute.contaminated(TEXTS, items)), key=str)


def test_near_dedup(docs, empty):
    got = near_dedup.near_groups(docs)
    want = brute.near_classes(TEXTS)
    assert all(r.class_id == want.get(r.doc_id) for r in got.select("row.doc_id", "class_id").collect())
    assert got.count() == len(TEXTS)
    left = near_dedup.without_near_copies(docs)
    assert left.schema == docs.schema and sorted(r.doc_id or 0 for r in left.collect()) == sorted((i or 0) for i, _ in TEXTS if want.get(i, i) == i)
    assert near_dedup.near_groups(empty).count() == 0


def test_near_dedup_of_crowded_buckets(spark):
    base = [random.choice(VOCABULARY) + str(i) for i in range(200)]
    texts = []
    for i in range(150):
        w = list(base)
        for _ in range(i % 9):
            w[random.randrange(200)] = f"new{i}"
        texts.append((i, " ".join(w)))
    got = near_dedup.near_groups(spark.createDataFrame(texts, "doc_id long, text string"), split=16)
    want = brute.near_classes(texts)
    assert {r.doc_id: r.class_id for r in got.select("row.doc_id", "class_id").collect()} == want


def test_quality_and_toxicity_scores(docs, empty, labels):
    for got in (quality.quality_scores(docs, labels), toxicity.toxicity_scores(docs, labels).select("row.doc_id", "held_out", "score", "predicted")):
        rows = got.select("doc_id", "held_out", "score", "predicted").collect()
        assert len(rows) == len(TEXTS) and all(0 <= r.score <= 1 for r in rows)
        assert all(r.held_out == (r.doc_id is not None and brute.held_out(r.doc_id)) for r in rows)
    assert quality.quality_scores(empty, labels).count() == 0 and toxicity.toxicity_scores(empty, labels).count() == 0
    without = labels.limit(0)
    assert quality.quality_scores(docs, without).select("score").distinct().count() == 1
    kept = toxicity.without_toxic(docs, without)
    assert kept.schema == docs.schema and {14, 15}.isdisjoint({r.doc_id for r in kept.collect()}) and kept.count() == len(TEXTS) - 2


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    for got, label, least in ((quality.quality_scores(docs, labels), "quality", 0.98), (toxicity.toxicity_scores(docs, labels).select("row.doc_id", "held_out", "predicted"), "toxic", 0.95)):
        right = got.where("held_out").join(labels, "doc_id").agg(F.avg((F.col("predicted") == F.col(label)).cast("int"))).first()[0]
        assert right >= least


def test_embeddings(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((40, 64))
    x = np.concatenate([base, base[:20] + 0.15 * rng.standard_normal((20, 64)), base[:5], base[:3] * 2]).astype(np.float32)
    rows = [(i, v.tolist(), i % 2 if i < 60 else int(i % 5 % 2)) for i, v in enumerate(x)]
    odd = [(100, None, 0), (101, [], 0), (102, [0.0] * 64, 0), (103, [float("nan")] * 64, 0), (104, [None] + [1.0] * 63, 0), (105, [1.0] * 64, None), (None, [1.0] * 64, 0),
           (106, [1.0] * 8, 0), (107, [1.0] * 8, 0), (107, [1.0] * 8, 0)]
    table = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.link_vectors(table).collect()}
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    links = [(i, j) for i in range(len(x)) for j in range(i) if rows[i][2] == rows[j][2] and unit[i] @ unit[j] >= 0.93]
    belongs, count = brute.components(range(len(x)), links), {i: sum(i in p for p in links) for i in range(len(x))}
    assert {i: got[i] for i in range(len(x))} == {i: (count[i], belongs[i]) for i in range(len(x))} and links
    assert all(got[i] == (0, i) for i in (100, 101, 102, 103, 104, 105, None)) and got[106] == (2, 106) and got[107] == (2, 106)
    assert embedding_dedup.link_vectors(table.limit(0)).count() == 0


def test_embedding_boxes_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "HOMES", 16)
    monkeypatch.setattr(embedding_dedup, "VISITORS", 20)
    rng = np.random.default_rng(4)
    centre = rng.standard_normal(16)
    x = (centre + 0.25 * rng.standard_normal((300, 16))).astype(np.float32)
    table = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: r.n_links for r in embedding_dedup.link_vectors(table).collect()}
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    assert got == {i: int(n) - 1 for i, n in enumerate((unit @ unit.T >= 0.93).sum(0))}


def test_mixing(docs, empty):
    got = mixing.mixed(docs, repetition=3.0).select("row.doc_id", "row.source", "n_tokens", "weight", "epochs", "copies").toPandas()
    assert len(got) == len(TEXTS)
    assert got.copies.between(1, 3).all() and abs(got.groupby("source", dropna=False).weight.first().sum() - 1) < 1e-9
    for _, own in got.groupby("source", dropna=False):
        total = own.n_tokens.sum()
        assert own.epochs.nunique() == 1 and (own.n_tokens * own.copies).sum() <= own.epochs.iloc[0] * total + 1e-6
    assert mixing.mixture(docs, repetition=3.0).schema == docs.schema and mixing.mixture(docs, repetition=3.0).count() == got.copies.sum()
    assert mixing.mixed(empty).count() == 0


def test_mixing_meets_its_targets(spark):
    rows = [(i, prose(20), "big" if i % 10 else f"s{i % 30}") for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    by = mixing.mixed(df, entropy=0.9, repetition=100.0).groupBy("row.source").agg(F.first("weight").alias("w"), F.sum("n_tokens").alias("t"), F.sum(F.col("n_tokens") * F.col("copies")).alias("u")).toPandas()
    entropy = -(by.w * np.log(by.w)).sum() / np.log(len(by))
    assert abs(entropy - 0.9) < 1e-6 and np.allclose(by.u / by.u.sum(), by.w, atol=0.01)
    limited = mixing.mixed(df, repetition=2.0).agg(F.max("epochs"), F.max("copies")).first()
    assert 1.99 < limited[0] <= 2.0 and limited[1] == 2
    few = mixing.mixed(df, repetition=4.0, budget=3000.0).agg(F.sum(F.col("n_tokens") * F.col("copies"))).first()[0]
    assert 2700 < few <= 3000


def test_tokens(docs, empty):
    vocabulary = Vocabulary()
    encode = lambda t: vocabulary.encoder().encode_ordinary(t or "")
    sizes = pd.Series([len(encode(t)) for _, t in TEXTS])
    limits = token_counts.context_limits(token_counts.length_histogram(docs))
    for r in limits.collect():
        assert (r.n_docs, r.docs_longer, r.truncated_tokens) == ((sizes == r.context_limit).sum(), (sizes > r.context_limit).sum(), sizes.clip(upper=r.context_limit).sum())
    assert token_counts.quantile(limits, 0.5).first()[0] == sizes.sort_values().iloc[(len(sizes) + 1) // 2 - 1]
    assert token_counts.context_limits(token_counts.length_histogram(empty)).count() == 0


@pytest.mark.parametrize("sequence", [7, 1024])
def test_training_order(spark, docs, empty, sequence):
    vocabulary = Vocabulary()
    rows, folder = training_order.materialise(docs, sequence=sequence, shard=64)
    got = rows.orderBy("slot").collect()
    assert [r.slot for r in got] == list(range(len(got))) and all(r.shard == r.slot // 64 and len(r.tokens) == 2 * sequence for r in got)
    parts = sorted((str(r.doc_id), r.seq_no, np.frombuffer(r.tokens, np.uint16)[: r.n_tokens].tolist()) for r in got)
    want = []
    for i, t in TEXTS:
        ids = vocabulary.encoder().encode_ordinary(t or "")
        ids = ids + [vocabulary.end] if ids else []
        want += [(str(i), k, ids[lo : lo + sequence]) for k, lo in enumerate(range(0, len(ids), sequence))]
    assert parts == sorted(want)
    assert [r.slot for r in training_order.read_from(spark, folder, 3, 10).collect()] == list(range(3, 13))
    assert training_order.materialise(empty)[0].count() == 0


def test_feistel_is_a_permutation():
    for n in (1, 2, 3, 5, 64, 1000, 4097):
        assert sorted(training_order.feistel(np.arange(n), n, 11).tolist()) == list(range(n))


def test_license_scan(spark, docs, empty):
    files = [("/a/LICENSE", "Released under the MIT License."), ("/a/b/x.c", "int x;"), ("/a/b/COPYING", "This work is licensed under the GNU General Public License, version 3."),
             ("/a/b/c/y.c", None), ("/a/z.c", "// Licensed under the Apache License, Version 2.0.\nint a(int b, int c, int d);\nint e(int f, int g, int h);"), ("/q.c", ""), (None, "Released under the MIT License."), ("/a/w.c", "no licence at all")]
    table = spark.createDataFrame(files, "path string, text string")
    got = {r.path: (r.own_license, r.license, r.inherited_from) for r in license_scan.scan(table, F.col("path")).collect()}
    assert got == {
        "/a/LICENSE": ("MIT", "MIT", None), "/a/b/x.c": (None, "GPL-3.0", "/a/b"), "/a/b/COPYING": ("GPL-3.0", "GPL-3.0", None), "/a/b/c/y.c": (None, "GPL-3.0", "/a/b"),
        "/a/z.c": ("Apache-2.0", "Apache-2.0", None), "/q.c": (None, None, None), None: ("MIT", "MIT", None), "/a/w.c": (None, "MIT", "/a"),
    }
    assert license_scan.scan(docs, F.col("source")).count() == len(TEXTS) and license_scan.scan(empty, F.col("source")).count() == 0


@pytest.mark.parametrize("most_sent", [0, 500_000])
def test_components(spark, monkeypatch, most_sent):
    monkeypatch.setattr(components, "MOST_SENT", most_sent)
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(random.randrange(200, 300), random.randrange(200, 300)) for _ in range(60)] + [(7, 7)]
    got, _ = components.components(spark.createDataFrame(links, "a long, b long"))
    want = brute.components({n for p in links for n in p}, links)
    rows = {r.node: r.component for r in got.collect()}
    assert rows == {n: want[n] for n in rows} and set(rows) >= {n for a, b in links if a != b for n in (a, b)}


def test_near_dedup_misses_no_pair_of_crowded_buckets(spark):
    # Each pair has a similarity of 89 / 111; with split=1 every bucket it shares is crowded.
    draw, texts = random.Random(5), []
    for i in range(2500):
        w = [f"{draw.randrange(1 << 30):x}" for _ in range(115)]
        texts += [(2 * i, " ".join(w[:104])), (2 * i + 1, " ".join(w[:93] + w[104:]))]
    got = near_dedup.near_groups(spark.createDataFrame(texts, "doc_id long, text string"), split=1)
    assert got.where("class_id <> row.doc_id - row.doc_id % 2").count() == 0


@pytest.mark.parametrize("samples, matches", [(lambda: 24, lambda: near_dedup.LEAST_MATCHES), (lambda: near_dedup.LONG, lambda: near_dedup.LONG_MATCHES)])
def test_near_dedup_sketches_pass_what_is_meant(samples, matches):
    p = 0.8 + 0.2 / 256
    assert sum(math.comb(samples(), k) * p**k * (1 - p) ** (samples() - k) for k in range(matches())) < 1e-6


GRANT = (
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software '
    "without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, "
    "and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
)


def test_license_headers_and_notices(spark):
    texts = {
        "SPDX-License-Identifier: MIT": "MIT", "// SPDX-License-Identifier: Apache-2.0\nint x;": "Apache-2.0", "# SPDX-License-Identifier: BSD-3-Clause": "BSD-3-Clause",
        "/* SPDX-License-Identifier: GPL-2.0-only */": "GPL-2.0", "/* SPDX-License-Identifier: (LGPL-2.1+ OR MIT) */": "LGPL-2.1", "SPDX-License-Identifier: Zlib": "Zlib",
        "Distributed under the MIT license, see LICENSE for details.": "MIT", "All of this is licensed under the GNU GPL v3.": "GPL-3.0",
        " * it under the terms of the GNU General Public License as published by": "GPL", GRANT: "MIT",
        "int a;\n// This program is free software: you can redistribute it and/or modify\n// it under the terms of the GNU General Public License as published by\n"
        "// the Free Software Foundation, either version 3 of the License, or\n// (at your option) any later version.\nint b;": "GPL-3.0",
        "the library is free; you can use it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License": "LGPL-2.1",
        "You need a licence to drive, and permission of the owner.": None, "no such words": None, "Copyright 2020 by nobody. All rights reserved.": None,
    }
    table = spark.createDataFrame([(f"/x{k}/f", t) for k, t in enumerate(texts)], "path string, text string")
    got = {r.path: (r.own_license, r.own_score) for r in license_scan.scan(table, F.col("path")).collect()}
    assert {t: got[f"/x{k}/f"][0] for k, t in enumerate(texts)} == texts


def test_license_file_of_several_units(spark):
    mit = "MIT License\n\nCopyright (c) 2020 Some One\n\n" + GRANT + "\n\n" + (
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.")
    lines = "Released under the MIT License.\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software.\n" + prose(6)
    files = [("/a/17", mit), ("/a/b/18", "int x;"), ("/c/19", lines), ("/c/20", "int y;"), ("/d/21", "Released under the MIT License.\n" + prose(40)), ("/d/22", "int z;")]
    got = {r.path: r.license for r in license_scan.scan(spark.createDataFrame(files, "path string, text string"), F.col("path")).collect()}
    assert got == {"/a/17": "MIT", "/a/b/18": "MIT", "/c/19": "MIT", "/c/20": "MIT", "/d/21": "MIT", "/d/22": None}


@pytest.mark.parametrize("split", [2, 64])
def test_near_dedup_finds_exactly_what_samples_miss(spark, monkeypatch, split):
    # No two sketches agree in so many samples, so all links are left to the exact way.
    monkeypatch.setattr(near_dedup, "LIKELY_MATCHES", 25)
    monkeypatch.setattr(near_dedup, "LEAST_MATCHES", 25)
    draw = random.Random(8)
    passage = [f"p{k}" for k in range(40)]
    texts = []
    for i in range(40):
        w = [f"{draw.randrange(1 << 30):x}" for _ in range(draw.randrange(20, 130))]
        # Around the limit of the similarity; every third text holds a passage that many have, some twice.
        w = w + passage * (1 + i % 2) if i % 3 == 0 else w
        texts += [(4 * i + k, " ".join(w[: len(w) - k * (len(w) * (i % 7) // 24)] + [f"x{i}{k}"] * (k % 2))) for k in range(4)]
    texts += [(500, "a b"), (501, "A, b"), (502, ""), (503, None), (None, texts[0][1])]
    got = near_dedup.near_groups(spark.createDataFrame(texts, "doc_id long, text string"), split=split)
    want = brute.near_classes(texts)
    assert len(set(want.values())) > 40 and any(want[4 * i] != want[4 * i + 3] for i in range(40))
    assert {r.doc_id: r.class_id for r in got.where("row.doc_id is not null").select("row.doc_id", "class_id").collect()} == want


def test_near_dedup_compares_no_texts_that_share_too_little_of_their_prefixes(spark, monkeypatch):
    # Documents 4i and 4i+1 share a passage, far too short for the similarity; 4i+3 is nearly 4i+2.
    draw, compared, verified = random.Random(11), [], near_dedup._verified

    def counted(texts, pairs, *rest):
        compared.extend((r.a, r.b) for r in pairs.collect())
        return verified(texts, pairs, *rest)

    monkeypatch.setattr(near_dedup, "_verified", counted)
    monkeypatch.setattr(near_dedup, "LIKELY_MATCHES", 25)
    texts = []
    for i in range(60):
        a, b, c = ([f"{draw.randrange(1 << 30):x}" for _ in range(110)] for _ in range(3))
        texts += [(4 * i, " ".join(a)), (4 * i + 1, " ".join(b[:90] + a[:20])), (4 * i + 2, " ".join(c)), (4 * i + 3, " ".join(c[:108] + b[:2]))]
    got = near_dedup.near_groups(spark.createDataFrame(texts, "doc_id long, text string"))
    assert {r.doc_id: r.class_id for r in got.select("row.doc_id", "class_id").collect()} == brute.near_classes(texts)
    assert sorted(compared) == [(4 * i + 2, 4 * i + 3) for i in range(60)]


def test_near_dedup_joins_all_texts_of_one_id(spark):
    # Document 9 has the text of 3 and, in another row, that of 7, which 8 nearly has.
    draw = random.Random(13)
    a, b, c = (" ".join(f"{draw.randrange(1 << 30):x}" for _ in range(60)) for _ in range(3))
    texts = [(3, a), (9, a), (9, b), (7, b), (8, b + " end"), (10, c), (10, "one two"), (11, "one two")]
    got = near_dedup.near_groups(spark.createDataFrame(texts, "doc_id long, text string"))
    want = brute.near_classes(texts)
    assert want[8] == 3 and {r.doc_id: r.class_id for r in got.select("row.doc_id", "class_id").collect()} == want


def test_near_dedup_does_not_compare_all_pairs_of_a_group(spark, monkeypatch):
    # Copies of one text, each changed at three places: near to the text itself, which has the last id, but not to each other.
    draw, compared, verified = random.Random(17), [], near_dedup._verified

    def counted(texts, pairs, *rest):
        compared.append(pairs.count())
        return verified(texts, pairs, *rest)

    monkeypatch.setattr(near_dedup, "_verified", counted)
    monkeypatch.setattr(near_dedup, "LIKELY_MATCHES", 25)
    base = [f"{draw.randrange(1 << 30):x}" for _ in range(200)]
    texts = []
    for i in range(120):
        w = list(base)
        for k in range(3):
            w[draw.randrange(200)] = f"new{i}x{k}"
        texts.append((i, " ".join(w)))
    texts.append((120, " ".join(base)))
    got = near_dedup.near_groups(spark.createDataFrame(texts, "doc_id long, text string"), split=16)
    assert {r.doc_id: r.class_id for r in got.select("row.doc_id", "class_id").collect()} == brute.near_classes(texts)
    assert sum(compared) < 4 * len(texts)
