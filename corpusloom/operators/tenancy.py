"""Tenants: who a user is in one, what the registry knows of it, whose schema is behind, keys, deletion and chained limits."""

from __future__ import annotations

import base64
import json
from datetime import datetime, timedelta
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.times import utc
from corpusloom.operators import operations

#: Seconds between two updates of a key's last use.
THROTTLE = 60


def principals(requests: DataFrame, users: DataFrame, members: DataFrame) -> DataFrame:
    """``requests`` (tenant_id, user_id) with is_platform_admin, role and member. Unknown users are left out; a user who is no
    member of the tenant has no role, whatever they are elsewhere."""
    of = members.select("tenant_id", "user_id", "role")
    known = requests.join(users.select("user_id", "is_platform_admin"), "user_id")
    return known.join(of, ["tenant_id", "user_id"], "left").withColumn("member", F.col("role").isNotNull())


def registry(tenants: DataFrame, databases: DataFrame) -> DataFrame:
    """Each tenant with its database's connection, or defaults where it has none yet."""
    defaults: dict[str, Any] = {"host": "", "port": 0, "database_name": "", "ssl_mode": "require", "schema_version": 0, "max_conns": 5}
    rows = tenants.select("tenant_id", "status").join(databases, "tenant_id", "left")
    return rows.select("tenant_id", "status", *[F.coalesce(c, F.lit(v)).alias(c) for c, v in defaults.items()])


def behind(tenants: DataFrame, databases: DataFrame, expected: int) -> DataFrame:
    """Active tenants whose database has an older schema than expected; those without a database are not counted."""
    active = tenants.where("status = 'active'").select("tenant_id")
    return active.join(databases, "tenant_id").where(F.coalesce("schema_version", F.lit(0)) < expected)


def verified(presented: DataFrame, keys: DataFrame, at: str = "at") -> DataFrame:
    """``presented`` (key, ``at``, ...) with key_id, tenant_id, scopes and result: ok, expired or invalid, and touch: whether this
    use is to be noted, as the last one noted is a minute old or more. Keys are known by prefix and SHA-256 only."""
    prefix = F.regexp_extract("key", r"^([a-z]+_[A-Za-z0-9]+)_.+$", 1)
    own = keys.where("revoked_at is null").select("key_prefix", "key_hash", "key_id", "tenant_id", "scopes", "expires_at", "last_used_at")
    asked = presented.withColumns({"key_prefix": prefix, "key_hash": F.sha2("key", 256)})
    rows = asked.join(own, ["key_prefix", "key_hash"], "left")
    ended = F.col("expires_at").isNotNull() & (F.col(at) >= F.col("expires_at"))
    result = F.when(F.col("key_id").isNull(), "invalid").when(ended, "expired").otherwise("ok")
    idle = F.col("last_used_at").isNull() | (F.timestamp_diff("SECOND", F.col("last_used_at"), F.col(at)) >= THROTTLE)
    return rows.withColumn("result", result).withColumn("touch", (F.col("result") == "ok") & idle).drop("key_prefix", "key_hash", "expires_at", "last_used_at")


def scheduled(tenants: DataFrame, which: Column, now: datetime, grace: timedelta = timedelta(days=operations.GRACE_DAYS)) -> DataFrame:
    """``tenants`` with those that may be deleted set to deleting and delete_after at the end of the grace time; a grace that is
    not positive is the default one."""
    grace = grace if grace > timedelta(0) else timedelta(days=operations.GRACE_DAYS)
    hit = which & operations.permitted_move(F.col("status"), F.lit("deleting"))
    return tenants.withColumns({"delete_after": F.when(hit, utc(now + grace)).otherwise(F.col("delete_after")), "status": F.when(hit, F.lit("deleting")).otherwise(F.col("status"))})


def deletable(tenants: DataFrame, now: datetime) -> DataFrame:
    """Tenants whose grace time is over."""
    return tenants.where((F.col("status") == "deleting") & (F.col("delete_after") <= utc(now)))


def to_migrate(tenants: DataFrame, slug: str | None = None) -> DataFrame:
    """Tenants that a fleet migration takes, by slug: those whose database is in use, or the one asked for if it is such."""
    rows = tenants.where(F.col("status").isin("active", "suspended", "deleting"))
    return (rows.where(F.col("slug") == slug) if slug else rows).orderBy("slug")


def chained_limits(requests: DataFrame, rate: float, burst: float, key_burst: float, tenant: str = "tenant_id", key: str = "key_id", at: str = "at", seq: str = "seq") -> DataFrame:
    """``requests`` with limited_by (tenant, key or null) and retry_after: first the tenant's bucket, then, for what that lets
    through and has a key, the key's. What the key's bucket refuses has taken the tenant's token."""
    first = operations.rate_limited(requests, rate, burst, tenant, at, seq)
    through = F.col("allowed") & F.col(key).isNotNull()
    stopped = first.where(~through).select(*requests.columns, F.when(~F.col("allowed"), "tenant").alias("limited_by"), "retry_after")
    second = operations.rate_limited(first.where(through).select(*requests.columns), rate, key_burst, key, at, seq)
    return stopped.unionByName(second.select(*requests.columns, F.when(~F.col("allowed"), "key").alias("limited_by"), "retry_after"))


def cursor(*values: Any) -> str:
    """An opaque cursor of a listing: JSON in unpadded base64url."""
    told = json.dumps([v.isoformat() if isinstance(v, datetime) else v for v in values], separators=(",", ":"))
    return base64.urlsafe_b64encode(told.encode()).decode().rstrip("=")


def opened(text: str | None, *kinds: type) -> tuple | None:
    """The values of a cursor, None for none; a malformed one is a ValueError."""
    if not text:
        return None
    try:
        values = json.loads(base64.b64decode(text + "=" * (-len(text) % 4), altchars=b"-_", validate=True))
        if not isinstance(values, list) or len(values) != len(kinds):
            raise ValueError("another listing's")
        return tuple(datetime.fromisoformat(v) if k is datetime else k(v) for v, k in zip(values, kinds, strict=True))
    except (ValueError, TypeError) as e:
        raise ValueError(f"not a cursor: {text!r}") from e


def encoded(*columns: Column) -> Column:
    """``cursor`` of a row of numbers and strings, as a JVM expression."""
    told = F.concat(F.lit("["), F.array_join(F.array(*[F.when(F.typeof(c) == "string", F.to_json(F.array(c.cast("string"))).substr(F.lit(2), F.length(F.to_json(F.array(c.cast("string")))) - 2)).otherwise(c.cast("string")) for c in columns]), ","), F.lit("]"))
    return F.regexp_replace(F.translate(F.regexp_replace(F.base64(told.cast("binary")), r"\s", ""), "+/", "-_"), "=+$", "")


def logged(queries: DataFrame, feedback: DataFrame, after: str | None, limit: int, **equal: Any) -> tuple[DataFrame, int]:
    """A page of logged queries, newest first, with their feedback and next, each row's cursor: ``limit`` + 1 rows, so that one more
    tells of another page. Filters that are None do not apply."""
    for c, v in equal.items():
        if v is not None:
            queries = queries.where(F.col(c) == v)
    page = operations.keyset(queries, ["created_at", "query_id"], opened(after, datetime, int), limit)
    at = F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return page.join(feedback, "query_id", "left").withColumn("next", encoded(at, F.col("query_id"))).orderBy(F.desc("created_at"), F.desc("query_id")), limit
