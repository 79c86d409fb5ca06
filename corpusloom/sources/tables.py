"""Reading the named tables of a data folder; works on any path that Spark's readers open."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` (a Parquet file or folder) under ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def register(spark: SparkSession, sf_dir: str, names: list[str] | None = None) -> None:
    """Temp views of the tables, for SQL."""
    for name in names or TABLES:
        table(spark, sf_dir, name).createOrReplaceTempView(name)


def spread(scan: DataFrame) -> DataFrame:
    """A file scan, dealt out over the cores if it has fewer partitions than there are: a small file of one row group would
    otherwise keep a single core busy. Large tables have more partitions than cores and are left as they are."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan
