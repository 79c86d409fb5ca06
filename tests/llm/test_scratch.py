import pytest
from pyspark.sql import functions as F

from corpusloom.llm import scratch


@pytest.mark.parametrize(("total", "n"), [(0, 5), (3, 5), (20_000, 7), (20_000, 3000)])
def test_smallest_is_a_sample_of_the_whole(spark, total, n):
    df = spark.range(total).select("id", F.xxhash64("id").alias("h"))
    want = [r["id"] for r in df.orderBy("h").limit(n).collect()]
    assert [r["id"] for r in scratch.smallest(df, total, n, "h").collect()] == want


def test_stored_tables_are_read_back_and_removed(spark):
    import os

    df = scratch.stored(spark.range(5).withColumn("x", F.lit(None).cast("string")), "test")
    assert df.count() == 5 and df.columns == ["id", "x"]
    other = scratch.root(spark).removeprefix("file://") + "/corpusloom/of-another-application"
    os.makedirs(other, exist_ok=True)
    scratch.remove(spark)
    assert not os.path.exists(scratch.own(spark).removeprefix("file://")) and os.path.exists(other)


def test_a_cluster_must_name_its_folder(spark, monkeypatch):
    class Conf:
        def get(self, key, default=None):
            return "spark://host" if key == "spark.master" else None

    class Session:
        class sparkContext:  # noqa: N801
            getConf = staticmethod(lambda: Conf())

        conf = Conf()

    with pytest.raises(ValueError):
        scratch.root(Session())
