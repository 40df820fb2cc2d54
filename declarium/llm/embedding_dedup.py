"""Near duplicates among embeddings by a subspace pigeonhole join.

Unit vectors are rotated by one random orthogonal matrix and split into blocks of ``width``
dimensions. Two vectors of cosine c are at squared distance 2 - 2 c; if that is within the limit, at
least one block is within its share of it, in proportion to its dimensions. So each block is a range
join of low dimension, and the union over the blocks misses nothing. Candidates are verified by the
cosine of the vectors as they are, in double precision.

The range join: a tree of median splits, made from a bounded sample, cuts each block's space into
boxes. A vector is at home in one box and visits the boxes of higher number within reach. A box of
more rows than a task should hold is dealt in chunks of homes and slices of visitors, each chunk meets
each slice. Pairs are counted and joined inside the tasks, never listed: a task returns for each vector
its links and the least vector it is joined with there. A pair counts in the first block it is near in.

Equal vectors of a label are one node with a count. Defined cases: a null label or id, and vectors that
are null, empty, zero, or hold null or non-finite components, link with nothing; vectors of different
dimension do not link; rows that repeat an id are vectors each; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from declarium.llm import store
from declarium.llm.components import components

#: Homes in a box, visitors in a slice, and vectors of the sample the boxes are made from.
HOMES, VISITORS, SAMPLE = 1024, 4096, 20_000
SLACK = 1e-9


class Boxes:
    """Boxes of each block, and the rotation, for vectors of one dimension."""

    def __init__(self, sample: np.ndarray, width: int, leaves: int, limit: float):
        d = sample.shape[1]
        self.rotation = np.linalg.qr(np.random.default_rng(d).standard_normal((d, d)))[0]
        self.cuts = [(lo, min(d, lo + width)) for lo in range(0, d, width)]
        self.budget = [limit * (hi - lo) / d + SLACK for lo, hi in self.cuts]
        x = self.turned(sample)
        depth = max(0, int(np.ceil(np.log2(max(1, leaves)))))
        depth = min(depth, max(0, len(sample) // 16).bit_length())
        self.low, self.high = [], []
        for lo, hi in self.cuts:
            boxes = [(np.arange(len(x)), np.full(hi - lo, -np.inf), np.full(hi - lo, np.inf))]
            for _ in range(depth):
                parts = []
                for rows, low, high in boxes:
                    own = x[rows, lo:hi]
                    axis = int(own.var(0).argmax()) if len(rows) else 0
                    at = float(np.median(own[:, axis])) if len(rows) else (0.0)
                    left, right = high.copy(), low.copy()
                    left[axis] = right[axis] = at
                    parts += [(rows[own[:, axis] < at], low, left), (rows[own[:, axis] >= at], right, high)]
                boxes = parts
            self.low.append(np.array([b[1] for b in boxes]))
            self.high.append(np.array([b[2] for b in boxes]))

    def turned(self, units: np.ndarray) -> np.ndarray:
        return units @ self.rotation

    def of(self, x: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Home box of each rotated vector; pairs of vector number and box that it visits."""
        lo, hi = self.cuts[block]
        own = x[:, None, lo:hi]
        low, high = self.low[block][None], self.high[block][None]
        home = ((own >= low) & (own < high)).all(2).argmax(1)
        gap = np.maximum(0, np.maximum(low - own, own - high))
        near = (gap * gap).sum(2) <= self.budget[block]
        near &= np.arange(near.shape[1])[None] > home[:, None]
        return home, *np.nonzero(near)

    def near(self, a: np.ndarray, b: np.ndarray, block: int) -> np.ndarray:
        lo, hi = self.cuts[block]
        a, b = a[:, lo:hi], b[:, lo:hi]
        return (a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T <= self.budget[block]


def _units(column: pa.Array, d: int) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), d)
    return x / np.sqrt((x * x).sum(1))[:, None]


def _joined(links: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least node that each left and right node is connected with through the links."""
    left, right = left.copy(), right.copy()
    top = np.iinfo(np.int64).max
    while True:
        l2 = np.minimum(left, np.where(links, right[None], top).min(1, initial=top))
        r2 = np.minimum(right, np.where(links, l2[:, None], top).min(0, initial=top))
        if (l2 == left).all() and (r2 == right).all():
            return left, right
        left, right = l2, r2


def _meeting(sent, d: int, cosine: float):
    """The work on one chunk and slice of a box: links of its vectors, and whom they are joined with."""

    def linked(table: pa.Table) -> pa.Table:
        boxes, block, first = sent(), table.column("block")[0].as_py(), table.column("slice")[0].as_py() == 0
        home = table.column("home").to_numpy()
        u = _units(table.column("v").combine_chunks(), d)
        x, node, n = boxes.turned(u), table.column("node").to_numpy(), table.column("n").to_numpy()
        out = [[], [], []]

        def meet(a: np.ndarray, b: np.ndarray, upper: bool) -> None:
            near = boxes.near(x[a], x[b], block)
            if upper:
                near &= np.arange(len(a))[:, None] < np.arange(len(b))[None]
            if not near.any():
                return
            near &= u[a] @ u[b].T >= cosine
            for earlier in range(block if near.any() else 0):
                near &= ~boxes.near(x[a], x[b], earlier)
            least_a, least_b = _joined(near, node[a], node[b])
            for rows_, links, least in ((a, near @ n[b], least_a), (b, n[a] @ near, least_b)):
                some = links > 0
                out[0].append(node[rows_][some])
                out[1].append(links[some])
                out[2].append(least[some])

        homes, visitors = np.flatnonzero(home), np.flatnonzero(~home)
        if first and len(homes):
            meet(homes, homes, True)
        for lo in range(0, len(visitors), VISITORS):
            meet(visitors[lo : lo + VISITORS], homes, False)
        return pa.table({c: np.concatenate(v).astype(np.int64) if v else np.zeros(0, np.int64) for c, v in zip(("node", "links", "least"), out)})

    return linked


def link_vectors(vectors: DataFrame, cosine: float = 0.93, width: int = 8, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label") -> DataFrame:
    """Per row of ``vectors``: ``vec_id``, ``n_links`` (other vectors of its label within the cosine),
    ``component_id`` (least id it is connected with) and ``kept`` (whether it is that vector)."""
    spark = vectors.sparkSession
    folders: list[str] = []

    def parked(df: DataFrame) -> DataFrame:
        df, folder = store.parked(df)
        folders.append(folder)
        return df

    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(label_column).alias("label"), F.col(vector_column).alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    sound = F.coalesce(F.col("label").isNotNull() & F.col("vec_id").isNotNull() & (F.size("v") > 0) & finite & (square > 0) & (square < float("inf")), F.lit(False))
    rows = rows.withColumn("sound", sound)
    nodes = parked(rows.where("sound").groupBy("label", "v").agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("n")).withColumn("d", F.size("v")))

    found = None
    sizes = nodes.groupBy("d", "label").agg(F.count(F.lit(1)).alias("n")).groupBy("d").agg(F.max("n").alias("n"), F.sum("n").alias("all"))
    for size in sizes.collect():  # a row for each dimension that occurs
        d, own = size.d, nodes.where(F.col("d") == size.d)
        sample = own.orderBy(F.xxhash64("node"), "node").limit(SAMPLE).select("v").toArrow().column("v")
        sent = store.sent(spark, Boxes(_units(sample.combine_chunks(), d), width, -(-size.n // HOMES), 2 - 2 * cosine))

        def placed(batches: Iterator[pa.RecordBatch], d=d, sent=sent) -> Iterator[pa.RecordBatch]:
            boxes = sent()
            for whole in batches:
                for lo in range(0, whole.num_rows, 1000):
                    batch = whole.slice(lo, 1000)
                    x = boxes.turned(_units(batch.column("v"), d))
                    for block in range(len(boxes.cuts)):
                        home, who, where = boxes.of(x, block)
                        pick = np.concatenate([np.arange(len(x)), who])
                        yield pa.RecordBatch.from_arrays(
                            [batch.column("label").take(pa.array(pick)), pa.array(np.full(len(pick), block, np.int32)), pa.array(np.concatenate([home, where]).astype(np.int32)),
                             pa.array(np.arange(len(pick)) < len(x)), *[batch.column(c).take(pa.array(pick)) for c in ("node", "n", "v")]],
                            ["label", "block", "box", "home", "node", "n", "v"])

        label = own.schema["label"].dataType.simpleString()
        vector = own.schema["v"].dataType.simpleString()
        box = parked(own.mapInArrow(placed, f"label {label}, block int, box int, home boolean, node long, n long, v {vector}"))
        key = ["label", "block", "box"]
        counts = parked(box.groupBy(*key).agg(F.count_if("home").alias("homes"), F.count_if(~F.col("home")).alias("visitors")).select(
            *key, F.ceil(F.col("homes") / HOMES).cast("int").alias("chunks"), F.greatest(F.lit(1), F.ceil(F.col("visitors") / VISITORS)).cast("int").alias("slices")).where("chunks > 0"))
        pick = lambda n, seed: F.pmod(F.xxhash64(F.lit(seed), "node"), F.col(n)).cast("int")
        dealt = box.join(counts, key).withColumn("own", pick("chunks", 1)).withColumn("slice", pick("slices", 2))
        # A home sits in its chunk, once for each slice; as a visitor it meets the later chunks of its box.
        sits = dealt.where("home").select(*key, F.col("own").alias("chunk"), F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), F.lit(True).alias("home"), "node", "n", "v")
        later = dealt.where("home and own < chunks - 1").select(*key, F.explode(F.sequence(F.col("own") + 1, F.col("chunks") - 1)).alias("chunk"), "slice", F.lit(False).alias("home"), "node", "n", "v")
        visits = dealt.where("not home").select(*key, F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), "slice", F.lit(False).alias("home"), "node", "n", "v")

        part = sits.unionByName(later).unionByName(visits).groupBy(*key, "chunk", "slice").applyInArrow(_meeting(sent, d, cosine), "node long, links long, least long")
        part = parked(part)
        found = part if found is None else found.unionByName(part)

    out = rows.join(nodes.select("label", "v", "node", F.col("n").alias("copies")).withColumn("sound", F.lit(True)), ["label", "v", "sound"], "left")
    if found is not None:
        totals = parked(found.groupBy("node").agg(F.sum("links").alias("links")))
        belongs, own_folders = components(found.select(F.col("node").alias("a"), F.col("least").alias("b")))
        folders += own_folders
        of_node = parked(totals.join(belongs, "node", "left"))
        out = out.join(of_node, "node", "left")
    else:
        out = out.withColumn("links", F.lit(None).cast("long")).withColumn("component", F.lit(None).cast("long"))
    out = out.select(
        "vec_id", (F.coalesce(F.col("copies") - 1, F.lit(0)) + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "node", "vec_id").alias("component_id"))
    out, _ = store.parked(out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True))))
    store.remove(spark, *folders)
    return out
