"""Structured Streaming forms of the roll-ups and of the folds by key."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState

from corpusloom.operators.operations import Breaker, TokenBucket
from corpusloom.sources.tablestore import TableStore


def usage_daily(stream: DataFrame, tenant: str, at: str, late: str = "1 day", **sums: Column) -> DataFrame:
    """Sums by tenant and UTC day; a day closes when the watermark has passed it."""
    days = stream.withWatermark(at, late).groupBy(F.window(at, "1 day").alias("w"), F.col(tenant))
    return days.agg(*[F.sum(c).alias(k) for k, c in sums.items()]).select(tenant, F.to_date("w.start").alias("day"), *sums)


def sliding_count(stream: DataFrame, at: str, width: str, slide: str, late: str, *by: str) -> DataFrame:
    """Events in sliding windows: start, keys, n."""
    rows = stream.withWatermark(at, late).groupBy(F.window(at, width, slide).alias("w"), *by).agg(F.count("*").alias("n"))
    return rows.select(F.col("w.start").alias("start"), *by, "n")


def unique_jobs(stream: DataFrame, key: list[str], at: str, within: str) -> DataFrame:
    """The first of jobs with equal arguments within a time."""
    return stream.withWatermark(at, within).dropDuplicatesWithinWatermark(key)


def rate_limited(stream: DataFrame, rate: float, burst: float, key: str, at: str, idle_ms: int | None = 3_600_000) -> DataFrame:
    """``key``, ``at``, allowed and retry_after of each request under its key's token bucket, a micro-batch's requests in order of
    time. The state of a key is two numbers, dropped after ``idle_ms`` without a request, but never before the bucket is full
    again (burst / rate seconds); None, or a rate of 0, keeps it. Only the times of a key's requests in a micro-batch are held."""
    idle_ms = idle_for(rate, burst, idle_ms)
    schema = T.StructType([stream.schema[key], stream.schema[at], T.StructField("allowed", T.BooleanType()), T.StructField("retry_after", T.DoubleType())])

    def step(name: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        bucket = TokenBucket(rate, burst, *(state.get if state.exists else ()))
        times = pd.concat([f[at] for f in frames]).sort_values()
        out = [bucket.take(pd.Timestamp(t).timestamp()) for t in times]
        state.update((bucket.tokens, bucket.at))
        if idle_ms:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame({key: name[0], at: times.to_numpy(), "allowed": [o[0] for o in out], "retry_after": [o[1] for o in out]})

    return stream.select(key, at).groupBy(key).applyInPandasWithState(step, schema, "tokens double, at double", "append", _timeout(idle_ms))


def idle_for(rate: float, burst: float, idle_ms: int | None) -> int | None:
    """The time after which a bucket's state may go: at least what an empty one takes to fill."""
    return max(idle_ms, math.ceil(burst / rate * 1000)) if idle_ms and rate > 0 else None


def broken(stream: DataFrame, key: str, at: str, ok: str, failures: int = 5, cooldown: float = 30.0, idle_ms: int | None = 86_400_000) -> DataFrame:
    """``key``, ``at`` and result of each call under its key's circuit breaker."""
    schema = T.StructType([stream.schema[key], stream.schema[at], T.StructField("result", T.StringType())])

    def step(name: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        count, opened = state.get if state.exists else (0, None)
        breaker = Breaker(failures, cooldown, count, opened)
        calls = pd.concat(list(frames)).sort_values(at, kind="stable")
        results = [breaker.call(pd.Timestamp(t).timestamp(), bool(x)) for t, x in zip(calls[at], calls[ok], strict=True)]
        state.update((breaker.count, breaker.opened))
        if idle_ms:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame({key: name[0], at: calls[at].to_numpy(), "result": results})

    return stream.select(key, at, ok).groupBy(key).applyInPandasWithState(step, schema, "count int, opened double", "append", _timeout(idle_ms))


def _timeout(idle_ms: int | None) -> str:
    # with timeouts a query also runs batches without data, and so has no end of its own
    return "ProcessingTimeTimeout" if idle_ms else "NoTimeout"


def job_states(stream: DataFrame, job: str = "job_id", at: str = "at", state: str = "state") -> DataFrame:
    """The state of each job, updated with each event: in update mode a row for each job that changed."""
    order = F.struct(at, state)
    return stream.groupBy(job).agg(F.when(F.bool_or(F.col(state) == "cancelled"), F.lit("cancelled")).otherwise(F.max_by(state, order)).alias(state))


def committing(store: TableStore, query: str, change: Callable[[DataFrame, int], dict[str, DataFrame]]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that applies each batch once, across restarts too: the tables that ``change`` makes of a batch and the
    number of that batch are committed to the store as one."""

    def sink(batch: DataFrame, number: int) -> None:
        base = store.snapshot()
        kind = "query string, number long"
        known = base.read("applied") if "applied" in base.tables else store.spark.createDataFrame([], kind)
        last = known.where(F.col("query") == query).agg(F.max("number")).first()[0]
        if last is None or number > last:
            mark = store.spark.createDataFrame([(query, number)], kind)
            # made from the snapshot taken before ``change`` reads: what others commit meanwhile makes it fail, not get lost
            store.commit(base, replace=change(batch, number), upsert={"applied": (mark, ["query"])})

    return sink


def upserting(write: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that passes over a batch that this process has applied, for writes that do no harm when repeated after a
    restart; ``committing`` holds across restarts."""
    done: set[int] = set()

    def sink(batch: DataFrame, number: int) -> None:
        if number not in done:
            write(batch, number)
            done.add(number)

    return sink
