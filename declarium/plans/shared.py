"""Tables written between two steps of a job, in the folder all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="declarium-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def fresh_folder(spark: SparkSession) -> str:
    """A new, unused folder name in the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/declarium/{uuid.uuid4().hex}"


def spread(df: DataFrame) -> DataFrame:
    """Deal out a scan that has fewer splits than the cluster has cores, before work that is heavy
    per row; a scan with enough splits is returned as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def written(df: DataFrame, *parts: str) -> DataFrame:
    """Write ``df``, in folders by ``parts`` if given, and read it back: computed once, and not lost with an
    executor."""
    spark = df.sparkSession
    folder = fresh_folder(spark)
    writer = df.write.partitionBy(*parts) if parts else df.write
    writer.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)
