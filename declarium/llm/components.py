"""Connected components of a table of links, by Spark joins on shrinking tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from declarium.llm import store

#: Links up to which the nodes' least neighbours are sent to all tasks (16 bytes each).
MOST_SENT = 500_000


def components(links: DataFrame) -> tuple[DataFrame, list[str]]:
    """``node`` and ``component`` (least node it is joined with) of every node in the links ``a, b``.

    Each round first points every node at the least node beside it (large star), then every node and
    its smaller neighbours at the least of those (small star), until every node points at its least
    one. What each node points at is sent to all tasks while there are few links; beyond that it is
    written first and joined, so that Spark can split a node with very many links. Also returns the
    folders that hold the result."""
    folders = []

    def parked(df: DataFrame) -> DataFrame:
        df, folder = store.parked(df)
        folders.append(folder)
        return df

    def both(df: DataFrame) -> DataFrame:
        return df.unionByName(df.select(F.col("b").alias("a"), F.col("a").alias("b")))

    spark = links.sparkSession
    links = parked(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:
        # Done when each node points at one other, and none of those points on.
        n, points = links.agg(F.count(F.lit(1)), F.count_distinct("a")).first()
        few = n <= MOST_SENT
        side = F.broadcast if few else parked
        if n == points and links.join(side(links.select(F.col("b").alias("a")).distinct()), "a", "left_semi").isEmpty():
            break
        least = side(both(links).groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        large = both(links).where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = large if few else parked(large)
        smallest = side(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(smallest, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x"))
        links = parked(small.select("x.*").where("a <> b").distinct())
        store.remove(spark, *folders[:-1])
        del folders[:-1]
    nodes = links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.unionByName(nodes.select(F.col("component").alias("node"), "component").distinct()), folders
