"""The folder that all nodes share, for what outlives a query."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def root(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; only where that is unset and the master local, one under the system's temporary
    folder."""
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if conf.get("spark.master", "local").split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all nodes share")
        found = "file://" + tempfile.gettempdir() + "/corpusloom-shared"
    return found.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back, which cuts its lineage and survives lost executors."""
    path = f"{root(df.sparkSession)}/corpusloom-tables/{df.sparkSession.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stamp(tables: list[DataFrame], *more: object) -> str:
    """A name for the present files of tables, by path, length and time."""
    told = [repr(more)]
    for df in tables:
        spark = df.sparkSession
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        for name in sorted(df.inputFiles()):
            path = jvm.org.apache.hadoop.fs.Path(name)
            status = path.getFileSystem(conf).getFileStatus(path)
            told.append(f"{name} {status.getLen()} {status.getModificationTime()}")
    return hashlib.sha256("\n".join(told).encode()).hexdigest()[:24]


def built(spark: SparkSession, name: str, build: Callable[[str], None]) -> str:
    """The folder ``name``; ``build`` writes it where it is not there yet. It is written beside and renamed, so a reader sees all
    of it or nothing; of two builders one is kept."""
    jvm = spark.sparkContext._jvm
    as_path = jvm.org.apache.hadoop.fs.Path
    folder = f"{root(spark)}/corpusloom-built/{name}"
    fs = as_path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(as_path(folder)):
        part = f"{folder}-part-{uuid.uuid4().hex}"
        build(part)
        if fs.exists(as_path(folder)) or not fs.rename(as_path(part), as_path(folder)):
            fs.delete(as_path(part), True)
    return folder
