"""The corpus pipeline: stages over ``documents``, each written and read again by the next.

1. ``toxicity``: documents predicted to be toxic go.
2. ``near_dedup``: of each class of near duplicates the document with the least id stays.
3. ``decontamination``: passages shared with the benchmark (10 words, or a whole item of 2 to 9) are cut
   out; a document goes if more than half of its words are such.
4. ``mixing``: sources get tempered weights; the largest is read once, the others up to 1.25 times.
5. ``token_ids``: sequences of token ids at their global slots; the shards lie in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from declarium.llm.decontaminate import decontaminated
from declarium.llm.mixing import mixture
from declarium.llm.near_dedup import without_near_copies
from declarium.llm.store import parked, remove
from declarium.llm.toxicity import without_toxic
from declarium.llm.training_order import materialise


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_near_copies(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixture(docs, entropy=0.97, repetition=1.25)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows, _ = materialise(docs)
    return rows


STAGES = [
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("token_ids", token_ids),
]

#: A trained classifier and a tokenizer are not for SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table of documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for _, stage in STAGES:
        docs, folder = parked(stage(spark, docs, sf_dir))
        if before:
            remove(spark, before)
        before = folder
    return docs
