"""Fetch schedules against a plain count, and embedding requests in flight against a slow, failing provider."""

import random
import threading
import time

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import ingest
from corpusloom.sources import web


@pytest.mark.parametrize("most", [None, 40])
def test_schedules_against_a_plain_count(spark, most):
    draw = random.Random(0)
    rows = [(f"u{k:05d}", draw.choice(["big", "big", "big", "small", None, f"h{k % 9}"]), k) for k in range(600)]
    draw.shuffle(rows)
    frontier = spark.createDataFrame(rows, "url string, host string, lane_of long")
    delays = spark.createDataFrame([("small", 50), ("big", 5), ("absent", 1)], "host string, delay_ms int")
    got = sorted((r["at_ms"], r["host"] or "", r["url"], r["turn"]) for r in web.scheduled(frontier, delays, 20, most=most).collect())
    seen, want = {}, []
    for url, host, _ in sorted(rows):
        turn = seen[host] = seen.get(host, -1) + 1
        want.append((turn * {"small": 50, "big": 5}.get(host, 20), host or "", url, turn))
    assert got == sorted(want)[:most]


def test_a_host_of_any_size_is_many_tasks(spark):
    frontier = spark.range(20_000).select(F.format_string("u%06d", "id").alias("url"), F.lit("one").alias("host"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = web.scheduled(frontier, delay_ms=3)
        assert rows.agg(F.max("turn"), F.max("at_ms"), F.countDistinct("turn"), F.countDistinct("lane")).first() == (19_999, 59_997, 20_000, 1)
        parts = [n for n in rows.select("turn").rdd.glom().map(len).collect() if n]
        assert len(parts) > 1 and max(parts) < 15_000
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert web.scheduled(frontier.limit(0)).count() == 0


class Busy(Exception):
    retryable = True


def test_answers_keep_their_order_and_few_are_in_flight():
    now, most, lock = [0], [0], threading.Lock()
    taken = []

    def given():
        for k in range(30):
            taken.append(k)
            yield k

    def ask(k):
        with lock:
            now[0] += 1
            most[0] = max(most[0], now[0])
        time.sleep(0.03 if k % 4 == 0 else 0.005)
        with lock:
            now[0] -= 1
        return k * 2

    answers = ingest.in_order(ask, given(), 4)
    assert next(answers) == 0 and len(taken) <= 4
    assert list(answers) == [k * 2 for k in range(1, 30)] and 1 < most[0] <= 4
    assert list(ingest.in_order(ask, range(3), 1)) == [0, 2, 4]


def test_waits_between_tries():
    retry = ingest.Retry(times=3, first=1.0, most=3.0)
    assert [retry.wait(Busy(), k, lambda: 0.0) for k in (1, 2, 3, 4)] == [1.0, 2.0, 3.0, None]
    assert retry.wait(Busy(), 1, lambda: 1.0) == 0.5 and retry.wait(ValueError(), 1) is None and retry.wait(TimeoutError(), 1) > 0
    told = Busy()
    told.retry_after = 9
    assert retry.wait(told, 1) == 3.0
    slept, calls = [], []

    def ask(texts):
        calls.append(texts)
        if len(calls) < 3:
            raise Busy
        return texts

    assert retry(ask, ["a"], slept.append) == ["a"] and len(slept) == 2
    with pytest.raises(ValueError):
        retry(lambda t: (_ for _ in ()).throw(ValueError("no")), ["a"], slept.append)


def test_a_slow_failing_provider(spark):
    def embed(texts):
        from tests import test_politeness as own

        time.sleep(0.01)
        if any("bad" in t for t in texts):
            raise ValueError("never")
        if random.random() < 0.4:
            raise own.Busy("later")
        return [[float(len(t))] for t in texts]

    rows = [(f"h{k}", "bad text" if k == 777 else "w " * (k % 50 + 1)) for k in range(2000)]
    missing = spark.createDataFrame(rows, "chunk_hash string, embed_text string").coalesce(1)
    start = time.monotonic()
    got = {r["chunk_hash"]: (r["embedding"], r["error"]) for r in ingest.embedded(missing, embed, "m", failsafe=True, retry=ingest.Retry(30, 0.001, 0.01)).collect()}
    assert time.monotonic() - start < 60
    lost = {h for h, (_, e) in got.items() if e}
    assert "h777" in lost and 1 <= len(lost) <= ingest.BATCH_TEXTS and all(got[h][1] == "never" for h in lost)
    assert all(got[h][0] == [float(len(t))] for h, t in rows if h not in lost)
