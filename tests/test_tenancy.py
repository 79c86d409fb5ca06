from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import alerts, tenancy
from corpusloom.streaming import state


def test_cursors_round_trip_and_refuse_junk(spark):
    at = datetime(2025, 5, 6, 4, 30)
    assert tenancy.opened(tenancy.cursor(at, 12), datetime, int) == (at, 12)
    assert tenancy.opened(None, int) is None and tenancy.opened("", int) is None
    for bad in ("???", "e30", tenancy.cursor(1), tenancy.cursor(at, 1)[:-3]):
        with pytest.raises(ValueError):
            tenancy.opened(bad, datetime, int)
    row = spark.range(1).select(tenancy.encoded(F.lit('ä"b'), F.lit(7))).first()[0]
    assert tenancy.opened(row, str, int) == ('ä"b', 7)


@pytest.mark.parametrize("size", [1, 2, 3, 7, 50])
def test_pages_join_up_to_the_listing(spark, size):
    """Queries within one second, some at the same microsecond."""
    at = datetime(2025, 1, 1, 12)
    rows = [(k, at + timedelta(microseconds=[0, 7, 7, 500_000, 999_999, 1_000_000, 7][k % 7]), "click") for k in range(20)]
    queries = spark.createDataFrame(rows, "query_id long, created_at timestamp, kind string")
    feedback = spark.createDataFrame([(3, 1)], "query_id long, rating int")
    got, after = [], None
    while True:
        page, limit = tenancy.logged(queries, feedback, after, size, kind="click")
        found = page.collect()
        got += [r["query_id"] for r in found[:limit]]
        if len(found) <= limit:
            break
        after = found[limit - 1]["next"]
    assert got == [r[0] for r in sorted(rows, key=lambda r: (r[1], r[0]), reverse=True)]


def test_answers_over_sources_of_text_ids(spark):
    from corpusloom.operators import search

    asked = spark.createDataFrame([(1, "so [2]", None, True, False), (2, None, "down", True, False), (3, "x", None, False, False), (4, "[1]", None, True, False)], "query long, answer string, error string, grounded boolean, streamed boolean")
    sources = spark.createDataFrame([(1, "v/0", 1), (1, "v/1", 2), (2, "w/0", 1)], "query long, chunk_id string, r int")
    got = {r["query"]: (r["outcome"], r["citations"]) for r in search.answered(asked, sources).collect()}
    assert got == {1: ("answered", ["v/1"]), 2: ("degraded", ["w/0"]), 3: ("refused", []), 4: ("answered", [])}


def test_a_grace_that_is_not_positive_is_the_default(spark):
    now = datetime(2025, 1, 1)
    rows = spark.createDataFrame([(1, "active"), (2, "deleted")], "tenant_id long, status string").withColumn("delete_after", F.lit(None).cast("timestamp"))
    got = tenancy.scheduled(rows, F.lit(True), now, timedelta(days=-3))
    assert {r["tenant_id"]: r["status"] for r in got.collect()} == {1: "deleting", 2: "deleted"}
    assert tenancy.deletable(got, now + timedelta(days=6)).count() == 0 and tenancy.deletable(got, now + timedelta(days=7)).count() == 1


def test_runs_over_several_days(spark):
    """One series over five days: a run across midnight, a day where nothing holds, a day without samples."""
    first = datetime(2025, 1, 1)
    held = [*range(20, 30), *range(31, 33), *range(50, 52), *range(110, 120)]
    hours = [h for h in range(120) if not 72 <= h < 96]
    rows = spark.createDataFrame([(first + timedelta(hours=h), h in held) for h in hours], "at timestamp, h boolean")
    got = sorted((r["since"], r["until"]) for r in alerts.sustained(rows, "at", F.col("h"), 60).collect())
    t = lambda h: first + timedelta(hours=h)
    assert got == [(t(20), t(29)), (t(31), t(32)), (t(50), t(51)), (t(110), t(119))]
    every = alerts.sustained(rows, "at", F.lit(True), 60).collect()
    assert [(r["since"], r["until"]) for r in every] == [(t(0), t(119))]


def test_a_slow_bucket_is_kept_until_it_is_full(spark):
    """Three tokens at one an hour take three hours: the state may not go after one."""
    assert state.idle_for(1 / 3600, 3, 3_600_000) == 3 * 3_600_000
    assert state.idle_for(10, 5, 3_600_000) == 3_600_000
    assert state.idle_for(0, 5, 3_600_000) is None and state.idle_for(1, 5, None) is None
