"""Tables between two steps: written to the shared folder, read back, removed when used up."""

from __future__ import annotations

import pickle
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

from declarium.plans.shared import fresh_folder


def parked(df: DataFrame, compression: str = "zstd") -> tuple[DataFrame, str]:
    """``df`` written to a new folder in the shared folder and read back, and that folder."""
    spark = df.sparkSession
    folder = fresh_folder(spark)
    df.write.option("compression", compression).parquet(folder)
    return spark.read.schema(df.schema).parquet(folder), folder


def remove(spark: SparkSession, *folders: str) -> None:
    """Delete folders that nothing will read again, through the file system they are on."""
    for folder in folders:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def bucketed(df: DataFrame, key: str, buckets: int) -> str:
    """Name of a new warehouse table with the rows of ``df`` in ``buckets`` files by ``key``: joins and
    groups on it need no further exchange of these rows."""
    name = f"declarium_{uuid.uuid4().hex}"
    df.repartition(buckets, key).write.option("compression", "zstd").bucketBy(buckets, key).saveAsTable(name)
    return name


def drop(spark: SparkSession, name: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {name}")


def sent(spark: SparkSession, value):
    """A function that gives ``value`` in the tasks. It travels as bytes with the classes it needs, so workers
    without this package can read it, and is made from them once a task."""
    data, made = spark.sparkContext.broadcast(cloudpickle.dumps(value)), []

    def value_of():
        if not made:
            made.append(pickle.loads(data.value))
        return made[0]

    return value_of
