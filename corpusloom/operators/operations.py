"""Operating the platform: job states, schedules, limits, keys and roles, as predicates and folds over tables."""

from __future__ import annotations

from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.functions.times import utc
from corpusloom.operators.folds import carried

TERMINAL = ("succeeded", "failed", "cancelled")


def keyset(df: DataFrame, order: list[str], cursor: tuple | None, limit: int) -> DataFrame:
    """A page after a cursor, newest first, with one row more than ``limit`` to tell whether another follows."""
    if cursor is not None:
        after, equal = F.lit(False), F.lit(True)
        for c, v in zip(order, cursor, strict=True):
            value = utc(v) if isinstance(v, datetime) else F.lit(v)
            after |= equal & (F.col(c) < value)
            equal &= F.col(c) == value
        df = df.where(after)
    return df.orderBy(*[F.col(c).desc() for c in order]).limit(limit + 1)


def page_size(asked: int | None, default: int = 50, most: int = 200) -> int:
    return default if not asked or asked < 1 else min(asked, most)


def page_range(df: DataFrame, order: list[Column], page: int, size: int = 20) -> DataFrame:
    """Page ``page`` (from 0) by offset; a page out of range is the nearest one there is. Only the rows up to the page's end are
    ordered in one place; for deep pages use ``keyset``."""
    last = max(0, -(-df.count() // size) - 1)
    at = min(max(page, 0), last)
    rows = df.orderBy(*order).limit((at + 1) * size).withColumn("_n", F.row_number().over(Window.orderBy(*order)))
    return rows.where(F.col("_n") > at * size).drop("_n")


def job_states(events: DataFrame, job: str = "job_id", at: str = "at", state: str = "state", seq: str = "seq") -> DataFrame:
    """Each job's state after its events: the last one, but a cancelled job stays so whatever is reported later."""
    order = F.struct(at, seq)
    return events.groupBy(job).agg(
        F.when(F.bool_or(F.col(state) == "cancelled"), F.lit("cancelled")).otherwise(F.max_by(state, order)).alias(state),
        F.min(F.when(F.col(state) == "running", F.col(at))).alias("started_at"),
        F.when(F.bool_or(F.col(state) == "cancelled"), F.min(F.when(F.col(state) == "cancelled", F.col(at)))).otherwise(F.max(F.when(F.col(state).isin(*TERMINAL), F.col(at)))).alias("finished_at"),
    )


def outcome_state(ok: Column, attempt: Column, most: Column, snoozed: Column, cancelled: Column) -> Column:
    """A job's state after an attempt."""
    return F.when(cancelled, "cancelled").when(ok, "succeeded").when(snoozed, "queued").when(attempt >= most, "failed").otherwise("queued")


def duration_ms(started: Column, finished: Column) -> Column:
    """Milliseconds if both ends are there."""
    return F.timestamp_diff("MILLISECOND", started, finished)


def reconciled_jobs(mirror: DataFrame, queue: DataFrame, now: datetime, job: str = "job_id") -> DataFrame:
    """The mirror with the queue's terminal states where it still shows an open one."""
    ended = queue.where(F.col("state").isin(*TERMINAL)).select(job, F.col("state").alias("_s"), F.col("finished_at").alias("_f"))
    drifted = F.col("_s").isNotNull() & ~F.col("state").isin(*TERMINAL)
    return mirror.join(ended, job, "left").withColumns({"finished_at": F.when(drifted, F.coalesce("_f", utc(now))).otherwise(F.col("finished_at")), "state": F.when(drifted, F.col("_s")).otherwise(F.col("state"))}).drop("_s", "_f")


def cancellable(state: Column) -> Column:
    """What a request to cancel does: at once, at the next checkpoint, or nothing."""
    return F.when(state.isin("queued", "scheduled"), "cancel").when(state == "running", "request").otherwise("refuse")


def due(sources: DataFrame, now: datetime, every_full: int = 7) -> DataFrame:
    """Active scheduled sources whose time has come, with mode full for each ``every_full``-th run, the first included."""
    ready = (F.col("status") == "active") & F.col("schedule").isNotNull() & (F.col("next_run_at") <= utc(now))
    return sources.where(ready).withColumn("mode", F.when(F.col("run_count") % every_full == 0, "full").otherwise("incremental"))


_RANGES = ((0, 59), (0, 23), (1, 31), (1, 12), (0, 7))


def _field(text: str, low: int, high: int) -> set[int]:
    out: set[int] = set()
    for part in text.split(","):
        span, _, step = part.partition("/")
        a, dash, b = span.partition("-")
        first, last = (low, high) if span == "*" else (int(a), int(b) if dash else high if step else int(a))
        if not low <= first <= last <= high or step and int(step) < 1:
            raise ValueError(f"{part!r} is out of range")
        out.update(range(first, last + 1, int(step or 1)))
    return out


def next_run(schedule: str, after: datetime) -> datetime:
    """The next minute a five-field cron line names, in UTC; a line that is not one parks the source for a day."""
    try:
        minutes, hours, days, months, weekdays = (_field(f, *r) for f, r in zip(schedule.split(), _RANGES, strict=True))
    except ValueError:
        return after + timedelta(days=1)
    weekdays = {d % 7 for d in weekdays}
    parts = schedule.split()
    t = after.replace(second=0, microsecond=0) + timedelta(minutes=1)
    for _ in range(366 * 5):
        on_day, on_weekday = t.day in days, (t.weekday() + 1) % 7 in weekdays
        fits = (on_day or on_weekday) if parts[2] != "*" and parts[4] != "*" else (on_day and on_weekday)
        if t.month in months and fits:
            for hour in sorted(h for h in hours if h >= t.hour):
                for minute in sorted(minutes):
                    if (hour, minute) >= (t.hour, t.minute):
                        return t.replace(hour=hour, minute=minute)
        t = (t + timedelta(days=1)).replace(hour=0, minute=0)
    return after + timedelta(days=1)


@F.pandas_udf(T.TimestampType())
def next_run_udf(schedule: pd.Series, after: pd.Series) -> pd.Series:
    return pd.Series([None if s is None or pd.isna(t) else next_run(s, t) for s, t in zip(schedule, after, strict=True)], dtype="datetime64[ns]")


def gc_due(tenants: DataFrame, jobs: DataFrame, now: datetime) -> DataFrame:
    """Active tenants without a garbage collection in the last day."""
    recent = jobs.where((F.col("kind") == "gc") & (F.col("created_at") > utc(now - timedelta(days=1)))).select("tenant_id").distinct()
    return tenants.where("status = 'active'").join(recent, "tenant_id", "left_anti")


def admitted(queued: DataFrame, running: DataFrame, cap: int = 2) -> DataFrame:
    """The oldest queued jobs of each tenant that its free places take."""
    busy = running.groupBy("tenant_id").agg(F.count("*").alias("_busy"))
    place = F.row_number().over(Window.partitionBy("tenant_id").orderBy("created_at", "job_id"))
    # the plain limit comes first: it lets Spark keep the first rows of a tenant on the map side
    return queued.withColumn("_n", place).where(F.col("_n") <= cap).join(busy, "tenant_id", "left").where(F.col("_n") + F.coalesce("_busy", F.lit(0)) <= cap).drop("_n", "_busy")


class TokenBucket:
    """Tokens at a rate up to a burst; ``take`` answers (allowed, seconds until one is there)."""

    def __init__(self, rate: float, burst: float, tokens: float | None = None, at: float | None = None) -> None:
        self.rate, self.burst, self.tokens, self.at = rate, burst, burst if tokens is None else tokens, at

    def take(self, now: float) -> tuple[bool, float]:
        if self.at is not None:
            self.tokens = min(self.burst, self.tokens + max(0.0, now - self.at) * self.rate)
        self.at = now if self.at is None else max(now, self.at)
        if self.tokens >= 1:
            self.tokens -= 1
            return True, 0.0
        return False, (1 - self.tokens) / self.rate if self.rate > 0 else float("inf")


class Breaker:
    """A circuit breaker: opens at ``failures`` failures in a row, lets one call try after ``cooldown`` seconds."""

    def __init__(self, failures: int = 5, cooldown: float = 30.0, count: int = 0, opened: float | None = None) -> None:
        self.failures, self.cooldown, self.count, self.opened = failures, cooldown, count, opened

    def state(self, now: float) -> str:
        return "closed" if self.opened is None else "half-open" if now - self.opened >= self.cooldown else "open"

    def call(self, now: float, ok: bool) -> str:
        """What a call at ``now`` that would end so meets: refused, or tried, and with which end."""
        was = self.state(now)
        if was == "open":
            return "refused"
        if ok:
            self.count, self.opened = 0, None
            return "ok"
        self.count += 1
        if was == "half-open" or self.count >= self.failures:
            self.opened = now
        return "failed"


def rate_limited(requests: DataFrame, rate: float, burst: float, key: str = "key", at: str = "at", seq: str = "seq") -> DataFrame:
    """``requests`` with allowed and retry_after, each key's in order of time."""
    adds = T.StructType([T.StructField("allowed", T.BooleanType()), T.StructField("retry_after", T.DoubleType())])
    return carried(requests, key, [at, seq], lambda: TokenBucket(rate, burst), TokenBucket.take, [at], adds)


def broken(calls: DataFrame, key: str = "key", at: str = "at", seq: str = "seq", ok: str = "ok", failures: int = 5, cooldown: float = 30.0) -> DataFrame:
    """``calls`` with result: refused, ok or failed, under each key's circuit breaker."""
    adds = T.StructType([T.StructField("result", T.StringType())])
    return carried(calls, key, [at, seq], lambda: Breaker(failures, cooldown), lambda breaker, t, good: (breaker.call(t, bool(good)),), [at, ok], adds)


def usable_keys(keys: DataFrame, now: datetime, scope: str | None = None) -> DataFrame:
    """API keys neither revoked nor expired, and with a scope if one is asked for."""
    ok = F.col("revoked_at").isNull() & (F.col("expires_at").isNull() | (utc(now) < F.col("expires_at")))
    return keys.where(ok & F.array_contains("scopes", scope) if scope else ok)


def usable_sessions(sessions: DataFrame, now: datetime, idle: timedelta) -> DataFrame:
    """Sessions within their absolute end and their sliding idle time."""
    return sessions.where((utc(now) < F.col("expires_at")) & (F.col("last_seen_at") > utc(now - idle)))


def locked_out(failures: DataFrame, now: datetime, most: int = 10, minutes: int = 15, key: str = "email") -> DataFrame:
    """Accounts, by address in lower case, with at least ``most`` failures in the last minutes."""
    recent = failures.where((F.col("at") > utc(now - timedelta(minutes=minutes))) & (F.col("at") <= utc(now)))
    return recent.groupBy(F.lower(key).alias(key)).agg(F.count("*").alias("failures")).where(F.col("failures") >= most)


def last_owner(members: DataFrame, tenant: str = "tenant_id") -> DataFrame:
    """``members`` with removable: false for a tenant's only owner."""
    owners = F.count_if(F.col("role") == "owner").over(Window.partitionBy(tenant))
    return members.withColumn("removable", ~((F.col("role") == "owner") & (owners <= 1)))


#: Roles from the least to the most, each with the permissions it adds: fixed values.
ROLES = {
    "viewer": ("query",),
    "editor": ("upload_documents",),
    "admin": ("manage_sources", "manage_members", "change_settings"),
    "owner": ("delete_tenant",),
}


def role_matrix() -> list[tuple[str, str]]:
    """(role, permission): each role has those below it too."""
    out, held = [], []
    for role, own in ROLES.items():
        held += own
        out += [(role, p) for p in held]
    return out


#: Allowed moves of a tenant's life: fixed values.
LIFECYCLE = (
    ("active", "suspended"),
    ("active", "deleting"),
    ("suspended", "active"),
    ("suspended", "deleting"),
    ("deleting", "active"),
    ("deleting", "suspended"),
    ("deleting", "deleted"),
)
GRACE_DAYS = 7


def permitted_move(before: Column, after: Column) -> Column:
    out = F.lit(False)
    for a, b in LIFECYCLE:
        out |= (before == a) & (after == b)
    return out


def access(status: Column, write: Column, schema_ok: Column) -> Column:
    """What a tenant's state lets a request do: suspended ones only read, and the schema must match."""
    return F.when(~status.isin("active", "suspended"), "refused").when(~schema_ok, "unavailable").when((status == "suspended") & write, "read-only").otherwise("allowed")
