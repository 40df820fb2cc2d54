"""First rows per group, safe for groups that hold most of the table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPREAD = 64
# Up to here what the input partitions keep of one group is little enough for one task.
ONE_STEP = 32


def top_per_group(
    df: DataFrame, keys: list[str], order: list[Column], n: int, rank: str | None = None
) -> DataFrame:
    """First ``n`` rows per ``keys`` by ``order``; ``rank`` names the position column, if wanted.

    Spark cuts every group within each input partition before the shuffle (for ``n`` up to
    ``spark.sql.optimizer.windowGroupLimitThreshold``, 1000 by default), so a large group sends
    ``n`` rows per partition and not all of its rows. For a large ``n`` the group is cut once more
    in up to ``SPREAD`` slices by input partition, so that the last step sees at most
    ``SPREAD * n`` rows of it.
    """
    position = rank or "_position"
    if n > ONE_STEP:
        df = df.withColumn("_slice", F.pmod(F.spark_partition_id(), F.lit(SPREAD)))
        local = Window.partitionBy(*keys, "_slice").orderBy(*order)
        df = df.withColumn("_local", F.row_number().over(local)).where(F.col("_local") <= n).drop("_local", "_slice")
    final = Window.partitionBy(*keys).orderBy(*order)
    kept = df.withColumn(position, F.row_number().over(final)).where(F.col(position) <= n)
    return kept if rank else kept.drop(position)
