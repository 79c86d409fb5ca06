"""Intermediate tables that survive lost executors.

Lineage is cut by writing Parquet under the folder in ``spark.checkpoint.dir``, which every node of a cluster shares.
Only where that setting is absent (tests, a laptop) does a folder under the system's temporary folder take its place.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def root(spark: SparkSession) -> str:
    """The shared folder's URI."""
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not conf.get("spark.master", "local").split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all nodes share")
        found = "file://" + tempfile.gettempdir() + "/corpusloom-scratch"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def folder(spark: SparkSession, name: str) -> str:
    """A new path for one table or set of files of one run."""
    return f"{own(spark)}/{name}-{uuid.uuid4().hex}"


def own(spark: SparkSession) -> str:
    """The part of the shared folder that only this application writes to."""
    return f"{root(spark)}/corpusloom/{spark.sparkContext.applicationId}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back; later steps read columns of it instead of computing it again."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession) -> None:
    """Delete what this application has written to the shared folder by this module; call it when no lazy result of it is still to be
    read. Other applications' tables stay."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(own(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def smallest(df: DataFrame, total: int, n: int, key: str, *ties: str) -> DataFrame:
    """The ``n`` rows of smallest ``key``, a 64-bit hash, of ``total`` rows: a sample that does not depend on partitions.

    Rows whose hash cannot be among them, but for chance, are left out first: else every task would send ``n`` rows on.
    """
    share = min(1.0, (2 * n + 1000) / max(total, 1))
    below = int(-(1 << 63) + share * ((1 << 64) - 1))
    some = df.where(F.col(key) <= F.lit(min(below, (1 << 63) - 1))) if share < 1 else df
    return some.orderBy(key, *ties).limit(n)
