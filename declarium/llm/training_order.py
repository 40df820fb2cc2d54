"""Training-order materialisation of token ids.

Each document's ids and an end mark are cut into sequences of at most ``sequence`` ids. The table of
sequences is written once; the place of a sequence in it is its rank. A keyed Feistel network on the
ranks, walked in cycles until it lands inside the table, is a permutation that needs no state: it
gives every sequence its global slot in training order. Sequences are then dealt by slot into shards of
``shard`` slots; a sequence is padded to a fixed stride, so slot ``s`` is row ``s % shard`` of shard
``s // shard``, and reading can begin at any slot.

Files, in one folder: ``sequences`` (shard by shard, rows in order of their slots) and ``manifest``
(one row: number of sequences, sequence length, shard size, key, bytes of an id, end mark).

Defined cases: null and empty texts have no ids and give no sequence; repeated rows and repeated ids
give sequences each; an empty table gives no sequences; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from declarium.llm import store
from declarium.llm.tokens import VOCABULARY, Vocabulary
from declarium.llm.words import mix, pieces
from declarium.plans.shared import fresh_folder


def feistel(ranks: np.ndarray, size: int, key: int, rounds: int = 6) -> np.ndarray:
    """A permutation of ``range(size)``, evaluated at the ranks."""
    half = max(1, (max(1, size - 1).bit_length() + 1) // 2)
    low = np.uint64((1 << half) - 1)
    keys = mix(np.arange(1, rounds + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(key & 0xFFFFFFFFFFFFFFFF))

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(half), x & low
        for k in keys:
            left, right = right, left ^ (mix(right + k) & low)
        return left << np.uint64(half) | right

    out = once(ranks.astype(np.uint64))
    outside = np.flatnonzero(out >= np.uint64(size))
    while len(outside):
        out[outside] = once(out[outside])
        outside = outside[out[outside] >= np.uint64(size)]
    return out.astype(np.int64)


def sequences(docs: DataFrame, vocabulary: Vocabulary, sequence: int) -> DataFrame:
    """``part`` and ``place`` (the task and the row within it), ``doc_id``, ``seq_no``, ``n_tokens``,
    ``tokens`` (ids as little-endian bytes)."""
    sent = store.sent(docs.sparkSession, vocabulary)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = sent()
        width, part, done = np.dtype(v.kind).itemsize, TaskContext.get().partitionId(), 0
        for batch in pieces(batches, most=2 << 20):
            ids, at = v.encode(batch.column("text"))
            sizes = np.diff(at)
            has = np.flatnonzero(sizes)
            if not len(has):
                continue
            # With the end marks put in, document i takes sizes[i] + 1 ids from at[i] + (marks before).
            marked = np.insert(ids, at[has + 1], v.end)
            begin = at[has] + np.arange(len(has))
            pieces_of = -(-(sizes[has] + 1) // sequence)
            owner = np.repeat(np.arange(len(has)), pieces_of)
            number = np.arange(len(owner)) - np.repeat(np.cumsum(pieces_of) - pieces_of, pieces_of)
            start = begin[owner] + number * sequence
            stop = np.minimum(start + sequence, (begin + sizes[has] + 1)[owner])
            offsets = np.append(start, stop[-1]) * width
            tokens = pa.Array.from_buffers(pa.binary(), len(owner), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(marked.tobytes())])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(owner), part, np.int32)), pa.array(done + np.arange(len(owner))), batch.column("doc_id").take(pa.array(has[owner])),
                 pa.array(number.astype(np.int32)), pa.array((stop - start).astype(np.int32)), tokens],
                ["part", "place", "doc_id", "seq_no", "n_tokens", "tokens"])
            done += len(owner)

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    return texts.mapInArrow(cut, "part int, place long, doc_id long, seq_no int, n_tokens int, tokens binary")


def materialise(docs: DataFrame, path: str = VOCABULARY, key: int = 20240229, sequence: int = 1024, shard: int = 16384) -> tuple[DataFrame, str]:
    """Write the shards; returns their rows (``slot``, ``shard``, ``doc_id``, ``seq_no``, ``n_tokens``,
    ``tokens``) and the folder."""
    spark = docs.sparkSession
    vocabulary = Vocabulary(path)
    stride = sequence * np.dtype(vocabulary.kind).itemsize
    table, table_folder = store.parked(sequences(docs, vocabulary, sequence))
    # A row for each task of the scan: small, and in order the ranks at which the tasks' rows begin.
    counts = table.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    begins = counts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("begin"))
    begins, begins_folder = store.parked(begins)
    size = table.count()

    @F.pandas_udf("long")
    def slot_of(rank: pd.Series) -> pd.Series:
        return pd.Series(feistel(rank.to_numpy(), size, key))

    fill = vocabulary.end.to_bytes(np.dtype(vocabulary.kind).itemsize, "little") * sequence
    ranked = table.join(F.broadcast(begins), "part").withColumn("slot", slot_of(F.col("begin") + F.col("place")))
    placed = ranked.select(
        "slot", F.floor(F.col("slot") / shard).cast("int").alias("shard"), "doc_id", "seq_no", "n_tokens", "tokens")
    shards = max(1, -(-size // shard))
    partitions = min(shards, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-shards // 8)))
    folder = fresh_folder(spark)
    padded = F.substring(F.concat("tokens", F.lit(bytearray(fill))), 1, stride)
    placed.repartition(partitions, "shard").sortWithinPartitions("shard", "slot").withColumn("tokens", padded).write.option("compression", "zstd").partitionBy(
        "shard").parquet(f"{folder}/sequences")
    manifest = spark.range(1).select(
        F.lit(size).alias("n_sequences"), F.lit(sequence).alias("sequence"), F.lit(shard).alias("shard"), F.lit(key).alias("key"),
        F.lit(stride // sequence).alias("id_bytes"), F.lit(vocabulary.end).alias("end_id"))
    manifest.write.parquet(f"{folder}/manifest")
    store.remove(spark, table_folder, begins_folder)
    return rows_of(spark, folder), folder


def rows_of(spark: SparkSession, folder: str) -> DataFrame:
    schema = "slot long, doc_id long, seq_no int, n_tokens int, tokens binary, shard int"
    return spark.read.schema(schema).parquet(f"{folder}/sequences").select("slot", "shard", "doc_id", "seq_no", "n_tokens", "tokens")


def read_from(spark: SparkSession, folder: str, slot: int, count: int) -> DataFrame:
    """``count`` sequences from ``slot`` on, in training order; only the shards they are in are read."""
    size = spark.read.parquet(f"{folder}/manifest").first().shard
    rows = rows_of(spark, folder).where(F.col("shard").between(slot // size, (slot + count - 1) // size))
    return rows.where((F.col("slot") >= slot) & (F.col("slot") < slot + count)).orderBy("slot")
