"""Which files need parsing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NEW, CHANGED, SKIPPED = "new", "changed", "skipped"


def detect_changes(observed: DataFrame, known: DataFrame | None) -> DataFrame:
    """``path, mtime, size, status``: skipped exactly where both time and size are as stored; a null is
    as stored where the stored value is null."""
    seen = observed.select("path", "mtime", "size")
    if known is None:
        return seen.withColumn("status", F.lit(NEW))
    stored = known.select("path", F.col("mtime").alias("_mtime"), F.col("size").alias("_size"), F.lit(True).alias("_known"))
    same = F.col("mtime").eqNullSafe(F.col("_mtime")) & F.col("size").eqNullSafe(F.col("_size"))
    status = F.when(F.col("_known").isNull(), NEW).when(same, SKIPPED).otherwise(CHANGED)
    return seen.join(stored, "path", "left").select("path", "mtime", "size", status.alias("status"))
