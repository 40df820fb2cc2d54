"""The pipeline's stages, each on what the one before it left, against brute force."""

import numpy as np
import pytest

import corpus_pipeline
from declarium.llm import toxicity
from declarium.llm.store import parked
from declarium.llm.tokens import Vocabulary
from tests.llm import brute

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(parked(stage(spark, out[-1], SF))[0])
    return out


def by_id(df):
    return sorted((r.doc_id, r.text) for r in df.select("doc_id", "text").collect())


def test_stages_keep_the_columns(steps):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "decontamination", "mixing", "token_ids"]
    assert all(df.columns == steps[0].columns for df in steps[:5])


def test_each_stage(spark, steps):
    docs, clean, single, decontaminated, mixed, tokens = steps
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    toxic = {r.doc_id for r in toxicity.toxicity_scores(docs, labels).where("predicted = 1").select("row.doc_id").collect()}
    assert by_id(clean) == [r for r in by_id(docs) if r[0] not in toxic]

    classes = brute.near_classes(by_id(clean))
    assert by_id(single) == [r for r in by_id(clean) if classes[r[0]] == r[0]]

    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    hit = {r[0]: r for r in brute.contaminated(by_id(single), items)}
    want = {i: t for i, t in by_id(single) if 2 * hit[i][2] <= hit[i][1]}
    got = dict(by_id(decontaminated))
    assert got.keys() == want.keys() and all(got[i] == t for i, t in want.items() if not hit[i][2])
    assert not any(r[5] for r in brute.contaminated([r for r in got.items() if hit[r[0]][2]], items))

    copies = [r[0] for r in by_id(mixed)]
    assert set(copies) == set(got) and all(1 <= copies.count(i) <= 2 for i in got)

    rows = tokens.collect()
    assert sorted(r.slot for r in rows) == list(range(len(rows)))
    vocabulary = Vocabulary()
    want = sorted((i, vocabulary.encoder().encode_ordinary(t) + [vocabulary.end]) for i, t in by_id(mixed))
    parts = {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.seq_no)):
        parts.setdefault((r.doc_id, r.seq_no), []).append(np.frombuffer(r.tokens, np.uint16)[: r.n_tokens].tolist())
    ids = {i for i, _ in want}
    whole = [(i, [x for k in range(sum(d == i for d, _ in parts)) for x in parts[i, k][n]]) for i in ids for n in range(copies.count(i))]
    assert sorted(whole) == want


def test_run_is_all_stages(spark, steps):
    assert corpus_pipeline.run(spark, SF).count() == steps[-1].count()
