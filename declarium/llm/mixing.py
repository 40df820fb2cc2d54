"""Mixing sources to target weights by temperature, with DataFrame operations only.

The share of each source in all tokens is raised to an exponent between 0 (all sources alike) and 1
(as they are) and normalised. The exponent is bisected, eight halvings a pass, over sums that a pass
takes of the table of sources: the greatest exponent whose entropy reaches a target, or the least one
at which no source is repeated beyond a limit, whichever is greater. A source's weight times the token
budget is what it may give: whole epochs of its documents, and of one more epoch the documents that
come first in a keyed permutation while they fit. The permutation goes by blocks: a source of n
documents has about sqrt(n) blocks, whose order is permuted, and the documents in a block are, so
running sums are taken over blocks and within blocks and never over a source.

Defined cases: a null source is a source of its own; null and empty texts have no tokens and are
taken as often as their source's whole epochs; rows that are equal in id, source and text are taken
equally often; with one source, or without tokens, each document is taken once per whole epoch; an
empty table gives an empty result; other columns are carried, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from declarium.llm import store

HALVINGS = 8


def count_tokens(text: Column) -> Column:
    """Words between white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("long")


def _statistics(sources: DataFrame, low: float, step: float, n: int) -> list[tuple[float, float, float]]:
    """For each exponent ``low + step * i``, i from 1 to n: the normaliser, the entropy, and how often
    the most repeated source is read while the least repeated one is read once."""
    grid = sources.where("share > 0").select("share", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("i"))
    exponent = F.lit(low) + F.lit(step) * F.col("i")
    scored = grid.select("i", F.pow("share", exponent).alias("w"), F.pow("share", exponent - 1).alias("e"))
    sums = scored.groupBy("i").agg(F.sum("w").alias("z"), F.sum(F.col("w") * F.log("w")).alias("wl"), F.max("e").alias("most"), F.min("e").alias("least"))
    return [(r.z, math.log(r.z) - r.wl / r.z, r.most / r.least) for r in sums.orderBy("i").collect()]


def _bisect(sources: DataFrame, passes: int, fits) -> float:
    """The exponent in [0, 1] at which ``fits`` turns from false to true, as far as bisection goes."""
    low, high = 0.0, 1.0
    for _ in range(passes):
        n = (1 << HALVINGS) - 1
        step = (high - low) / (n + 1)
        grid = [low + step * i for i in range(1, n + 1)]
        good = [fits(*s, a) for a, s in zip(grid, _statistics(sources, low, step, n))]
        first = good.index(True) if True in good else n
        low, high = grid[first - 1] if first else low, grid[first] if first < n else high
    return high


def choose_exponent(sources: DataFrame, entropy: float | None, repetition: float, budget: float | None, total: float, passes: int = 6) -> float:
    """``entropy`` is a share of the greatest possible one; ``repetition`` bounds the epochs of a
    source, for a budget in tokens or, without one, where the least repeated source is read once."""
    n = sources.where("share > 0").count()
    if n < 2:
        return 1.0

    least_share = sources.where("share > 0").agg(F.min("share")).first()[0]

    def repeats(z: float, h: float, ratio: float, a: float) -> bool:
        # Epochs of a source are budget / total * share**(a - 1) / z: the smallest has most.
        return (ratio if budget is None else least_share ** (a - 1) * budget / total / z) <= repetition

    exponent = _bisect(sources, passes, repeats)
    if entropy is not None:
        # Entropy falls as the exponent grows: the greatest exponent that still reaches the target.
        exponent = max(exponent, _bisect(sources, passes, lambda z, h, r, a: h <= entropy * math.log(n)))
    return exponent


def mixed(docs: DataFrame, entropy: float | None = None, repetition: float = 2.0, budget: float | None = None, key: int = 17) -> DataFrame:
    """Per row of ``docs``: ``row`` (its columns as a struct), ``n_tokens``, ``weight`` (of its source
    in the mixture), ``epochs`` (of its source) and ``copies`` (how often it is taken)."""
    name = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("-"))
    mark = [F.xxhash64(F.lit(i), "doc_id", "text", "source") for i in (1, 2)]
    whole = docs.select(F.struct("*").alias("row"), mark[0].alias("m1"), mark[1].alias("m2"))
    rows, folder = store.parked(
        docs.select(name.alias("name"), mark[0].alias("m1"), mark[1].alias("m2"), count_tokens(F.col("text")).alias("n_tokens"))
        .groupBy("name", "m1", "m2").agg(F.first("n_tokens").alias("n_tokens"), F.count(F.lit(1)).alias("n")))
    sources = rows.groupBy("name").agg(F.sum(F.col("n_tokens") * F.col("n")).alias("tokens"), F.count(F.lit(1)).alias("docs"))
    sources, sources_folder = store.parked(sources)
    total = sources.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    shares = sources.withColumn("share", F.col("tokens") / F.lit(float(max(1, total))))
    exponent = choose_exponent(shares, entropy, repetition, budget, float(max(1, total)))
    z = shares.agg(F.sum(F.when(F.col("share") > 0, F.pow("share", F.lit(exponent)))).alias("z"), F.min(F.when(F.col("share") > 0, F.pow("share", F.lit(exponent - 1)))).alias("e")).first()
    scale = (1 / z.e if budget is None else budget / total / z.z) if z.z else 1.0
    weights = shares.select(
        "name", "tokens", F.greatest(F.lit(1.0), F.round(F.sqrt("docs"))).alias("blocks"),
        F.when(F.col("share") > 0, F.pow("share", F.lit(exponent)) / F.lit(z.z or 1.0)).otherwise(0.0).alias("weight"),
        F.when(F.col("share") > 0, F.least(F.lit(repetition), F.lit(scale) * F.pow("share", F.lit(exponent - 1)))).otherwise(1.0).alias("epochs"))
    # Rounding must not turn an epoch that is whole into a little less than one.
    epochs = F.when(F.abs(F.col("epochs") - F.round("epochs")) < 1e-9, F.round("epochs")).otherwise(F.col("epochs"))
    weights, weights_folder = store.parked(weights.withColumn("epochs", epochs))
    turn = F.xxhash64(F.lit(key), "m1", "m2")
    block = F.floor((F.shiftrightunsigned(turn, 11) / F.lit(float(1 << 53))) * F.col("blocks")).cast("long")
    dealt = rows.join(weights, "name").select("name", "m1", "m2", "n_tokens", "weight", "epochs", "tokens", (F.col("n_tokens") * F.col("n")).alias("size"), turn.alias("turn"), block.alias("block"))
    dealt, dealt_folder = store.parked(dealt)
    sums = dealt.groupBy("name", "block").agg(F.sum("size").alias("size"))
    order = Window.partitionBy("name").orderBy(F.xxhash64(F.lit(key), "block"), "block").rowsBetween(Window.unboundedPreceding, -1)
    begins, begins_folder = store.parked(sums.select("name", "block", F.coalesce(F.sum("size").over(order), F.lit(0)).alias("begin")))
    inside = Window.partitionBy("name", "block").orderBy("turn", "m1", "m2").rowsBetween(Window.unboundedPreceding, 0)
    end = F.col("begin") + F.sum("size").over(inside)
    rest = (F.col("epochs") - F.floor("epochs")) * F.col("tokens")
    taken = dealt.join(begins, ["name", "block"]).select(
        "m1", "m2", "n_tokens", "weight", "epochs",
        (F.floor("epochs") + ((end <= rest) & (F.col("size") > 0)).cast("long")).cast("int").alias("copies"))
    taken, _ = store.parked(taken)
    store.remove(docs.sparkSession, folder, sources_folder, weights_folder, dealt_folder, begins_folder)
    return whole.join(taken, ["m1", "m2"]).select("row", "n_tokens", "weight", "epochs", "copies")


def mixture(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, each as often as the mixture takes it."""
    taken = mixed(docs, **options).where("copies > 0")
    return taken.select(F.explode(F.array_repeat("row", F.col("copies"))).alias("row")).select("row.*")
