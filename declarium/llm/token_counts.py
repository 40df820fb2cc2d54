"""Token counts from an exact length histogram.

Documents are counted by encoded length, which is all that leaves the scan. Suffix sums over the
lengths then answer, for every context limit: documents and tokens beyond it, tokens that remain if
each document is cut there, and the share of documents that fit (so any quantile). The sums go by
chunks of lengths, so no task sees all lengths.

Defined cases: null and empty texts have length 0 and count as documents; repeated rows count each;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from declarium.llm import store
from declarium.llm.tokens import VOCABULARY, with_lengths

CHUNK = 4096


def length_histogram(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """``length`` and ``n_docs``, a row for each length that occurs."""
    return with_lengths(docs, path).groupBy("length").agg(F.count(F.lit(1)).alias("n_docs"))


def context_limits(histogram: DataFrame) -> DataFrame:
    """For each length that occurs, taken as a context limit: documents of that length, documents and
    tokens at most that long, documents and tokens longer, tokens left after truncation, totals, and
    ``fit_share``, the share of documents that fit."""
    rows = histogram.select("length", "n_docs", (F.col("length") * F.col("n_docs")).alias("tokens"), F.floor(F.col("length") / CHUNK).alias("chunk"))
    rows, _ = store.parked(rows)
    chunks = rows.groupBy("chunk").agg(F.sum("n_docs").alias("docs"), F.sum("tokens").alias("toks"))
    # One row for each 4,096 lengths; the longest text bounds their number.
    later = Window.orderBy(F.desc("chunk")).rowsBetween(Window.unboundedPreceding, -1)
    chunks = chunks.select(
        "chunk", *[F.coalesce(F.sum(c).over(later), F.lit(0)).alias(f"{c}_after") for c in ("docs", "toks")],
        *[F.sum(c).over(Window.partitionBy()).alias(f"{c}_all") for c in ("docs", "toks")])
    own = Window.partitionBy("chunk").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, -1)
    longer = lambda c, after: F.coalesce(F.sum(c).over(own), F.lit(0)) + F.col(after)
    rows = rows.join(chunks, "chunk").select(
        "length", "n_docs", longer("n_docs", "docs_after").alias("docs_longer"), longer("tokens", "toks_after").alias("tokens_longer"), "docs_all", "toks_all")
    return rows.select(
        F.col("length").alias("context_limit"), "n_docs", (F.col("docs_all") - F.col("docs_longer")).alias("docs_fit"), "docs_longer", "tokens_longer",
        (F.col("toks_all") - F.col("tokens_longer") + F.col("length") * F.col("docs_longer")).alias("truncated_tokens"),
        F.col("docs_all").alias("total_docs"), F.col("toks_all").alias("total_tokens"),
        ((F.col("docs_all") - F.col("docs_longer")) / F.col("docs_all")).alias("fit_share"))


def quantile(limits: DataFrame, share: float) -> DataFrame:
    """The least context limit that at least ``share`` of all documents fit."""
    return limits.where(F.col("fit_share") >= share).agg(F.min("context_limit").alias("context_limit"))
