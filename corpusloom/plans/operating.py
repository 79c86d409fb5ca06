"""Usage, jobs, schedules, limits, roles and alerts over the test tables."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from corpusloom.functions.times import utc
from corpusloom.operators import alerts, operations
from corpusloom.plans.base import DataFrame, SparkSession, query, table

NOW = datetime(2024, 1, 20)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


def told(c: str, name: str | None = None):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(name or c)


@query("""select user_id, strftime(ts, '%Y-%m-%d') as day, count(*) as queries, round(sum(value), 4) as tokens from events group by 1, 2""")
def usage_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = alerts.usage_daily(events(spark, sf_dir), "user_id", "ts", queries=F.lit(1), tokens=F.col("value"))
    return rows.select("user_id", F.date_format("day", "yyyy-MM-dd").alias("day"), "queries", F.round("tokens", 4).alias("tokens"))


@query("""select user_id, strftime(ts, '%Y-%m-%d') as day, count(*) as queries from events where cast(ts as date) between date '2024-01-05' and date '2024-01-09' group by 1, 2""")
def usage_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = alerts.usage_daily(events(spark, sf_dir), "user_id", "ts", queries=F.lit(1))
    return alerts.usage_window(rows, "2024-01-05", "2024-01-09").select("user_id", F.date_format("day", "yyyy-MM-dd").alias("day"), "queries")


@query("""select event_type as queue, count(*) as n from events where ts <= timestamp '2024-01-20 00:00:00' group by 1""")
def queue_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).where(F.col("ts") <= utc(NOW)).groupBy(F.col("event_type").alias("queue")).agg(F.count("*").alias("n"))


@query("""select count(*) filter (where n_regionkey <> 1) as mismatched, count(*) as tenants from nation""")
def schema_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").agg(F.count_if(F.col("n_regionkey") != 1).alias("mismatched"), F.count("*").alias("tenants"))


_STATES = "case event_type when 'signup' then 'cancelled' when 'view' then 'running' when 'click' then 'queued' when 'error' then 'failed' else 'succeeded' end"
_JOBS = f"e as (select event_id % 3000 as job_id, ts as done_at, event_id as seq, {_STATES} as state from events)"
_FOLDED = """select job_id, case when bool_or(state = 'cancelled') then 'cancelled' else arg_max(state, (done_at, seq)) end as state, min(done_at) filter (where state = 'running') as started,
 case when bool_or(state = 'cancelled') then min(done_at) filter (where state = 'cancelled') else max(done_at) filter (where state in ('succeeded', 'failed', 'cancelled')) end as finished from e group by 1"""


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    state = F.when(kind == "signup", "cancelled").when(kind == "view", "running").when(kind == "click", "queued").when(kind == "error", "failed").otherwise("succeeded")
    rows = events(spark, sf_dir).select((F.col("event_id") % 3000).alias("job_id"), F.col("ts").alias("at"), F.col("event_id").alias("seq"), state.alias("state"))
    return operations.job_states(rows)


@query(f"""with {_JOBS}, f as ({_FOLDED}) select job_id, state, strftime(started, '%Y-%m-%d %H:%M:%S') as started_at, date_sub('millisecond', started, finished) as duration_ms from f""")
def job_state_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs(spark, sf_dir).select("job_id", "state", told("started_at"), operations.duration_ms(F.col("started_at"), F.col("finished_at")).alias("duration_ms"))


@query("""select o_orderkey as job_id, case when o_orderkey % 3 = 0 and o_orderstatus not in ('F') then 'cancelled' when o_orderstatus = 'F' then 'succeeded' when o_orderstatus = 'P' then 'running' else 'queued' end as state from orders""")
def reconcile_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    state = F.when(F.col("o_orderstatus") == "F", "succeeded").when(F.col("o_orderstatus") == "P", "running").otherwise("queued")
    mirror = o.select(F.col("o_orderkey").alias("job_id"), state.alias("state"), F.lit(None).cast("timestamp_ntz").alias("finished_at"))
    queue = o.where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("job_id"), F.lit("cancelled").alias("state"), F.col("o_orderdate").cast("timestamp_ntz").alias("finished_at"))
    return operations.reconciled_jobs(mirror, queue, NOW).select("job_id", "state")


@query("""select c_custkey as source_id, case when c_custkey % 10 % 7 = 0 then 'full' else 'incremental' end as mode from customer where c_custkey % 4 <> 0 and c_custkey % 5 <> 0 and c_custkey % 40 >= 5""")
def scheduler_due_full7(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("c_custkey")
    at = F.timestamp_add("DAY", 5 - i % 40, utc(NOW))
    sources = table(spark, sf_dir, "customer").select(i.alias("source_id"), F.when(i % 4 != 0, "active").otherwise("paused").alias("status"), F.when(i % 5 != 0, "0 * * * *").alias("schedule"), at.alias("next_run_at"), (i % 10).alias("run_count"))
    return operations.due(sources, NOW).select("source_id", "mode")


@query("""with c as (select event_id, ts, unnest(list_transform(range(0, 16), lambda k: date_trunc('day', ts) + to_days(cast(k // 4 as integer)) + interval 3 hour + to_minutes(15 * (k % 4)))) as due from events where event_id % 2 = 0)
select event_id, strftime(min(due), '%Y-%m-%d %H:%M:%S') as next_run_at from c where isodow(due) <= 5 and due > date_trunc('minute', ts) group by event_id
union all select event_id, strftime(ts + interval 1 day, '%Y-%m-%d %H:%M:%S') from events where event_id % 2 = 1""")
def scheduler_next_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).select("event_id", F.col("ts").cast("timestamp").alias("at"), F.when(F.col("event_id") % 2 == 0, "*/15 3 * * 1-5").otherwise("bad line").alias("schedule"))
    return rows.select("event_id", F.date_format(operations.next_run_udf("schedule", "at"), "yyyy-MM-dd HH:mm:ss").alias("next_run_at"))


@query("""select n_nationkey as tenant_id from nation n where n_regionkey <> 0 and not exists (select 1 from events e where e.user_id % 60 = n.n_nationkey and e.event_type = 'error' and e.event_id % 9 = 0 and e.ts > timestamp '2024-01-19 00:00:00')""")
def gc_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    tenants = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("tenant_id"), F.when(F.col("n_regionkey") != 0, "active").otherwise("suspended").alias("status"))
    ran = events(spark, sf_dir).select((F.col("user_id") % 60).alias("tenant_id"), F.when((F.col("event_type") == "error") & (F.col("event_id") % 9 == 0), "gc").otherwise("sync").alias("kind"), F.col("ts").alias("created_at"))
    return operations.gc_due(tenants, ran, NOW).select("tenant_id")


@query("""select o_orderkey as job_id from (select o_orderkey, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as n, o_custkey % 3 as busy from orders where o_orderstatus = 'O') where n + busy <= 2""")
def tenant_cap_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    queued = o.where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("job_id"), F.col("o_custkey").alias("tenant_id"), F.col("o_orderdate").alias("created_at"))
    running = o.select(F.col("o_custkey").alias("tenant_id")).distinct().select("tenant_id", F.explode(F.array_repeat(F.lit(1), (F.col("tenant_id") % 3).cast("int"))).alias("j"))
    return operations.admitted(queued, running, 2).select("job_id")


@query("""with s as (select unnest(generate_series(date_trunc('minute', ts) - interval 4 minute, date_trunc('minute', ts), interval 1 minute)) as start, event_type from events)
select strftime(start, '%Y-%m-%d %H:%M:%S') as start, event_type, count(*) as n, round(count(*) / 300.0::double, 6) as rate from s group by start, event_type""")
def rate_sliding_5m(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = alerts.sliding_rate(events(spark, sf_dir), "ts", 5, "1 minute", "event_type")
    return rows.select(told("start"), "event_type", "n", F.round("rate", 6).alias("rate"))


@query("""with s as (select unnest(generate_series(time_bucket(interval 5 minute, ts) - interval 10 minute, time_bucket(interval 5 minute, ts), interval 5 minute)) as start, event_type from events where event_type = 'error')
select strftime(start, '%Y-%m-%d %H:%M:%S') as start, event_type, count(*) as n from s group by start, event_type having count(*) > 1""")
def failures_15m(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = alerts.sliding(events(spark, sf_dir).where("event_type = 'error'"), "ts", "15 minutes", "5 minutes", "event_type")
    return rows.where("n > 1").select(told("start"), "event_type", "n")


@query("""select event_type, round(quantile_cont(value, 0.95), 6) as p95 from events group by 1""")
def latency_p95(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alerts.quantile(events(spark, sf_dir), "value", 0.95, "event_type").select("event_type", F.round("quantile", 6).alias("p95"))


_BUCKETS = """b as (select event_type, le, (select count(*) from events e where e.event_type = t.event_type and e.value <= l.le) as c from (select distinct event_type from events) t, (values (1.0::double), (5.0), (20.0), (100.0), ('inf'::double)) l(le)),
w as (select *, coalesce(lag(le) over o, 0.0) as low, coalesce(lag(c) over o, 0) as before, max(c) over (partition by event_type) as total from b window o as (partition by event_type order by le)),
h as (select * from w where c >= 0.95 * total qualify row_number() over (partition by event_type order by le) = 1)"""


@query(f"""with {_BUCKETS} select event_type, round(case when le = 'inf'::double then low else low + (le - low) * (0.95::double * total - before) / (c - before) end, 6) as p95 from h""")
def latency_p95_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounds = F.array(*[F.lit(float(b)) for b in (1, 5, 20, 100, "inf")])
    rows = events(spark, sf_dir).select("event_type", "value", F.explode(bounds).alias("le"))
    buckets = rows.groupBy("event_type", "le").agg(F.count_if(F.col("value") <= F.col("le")).alias("count"))
    return alerts.bucket_quantile(buckets, 0.95, ["event_type"]).select("event_type", F.round("quantile", 6).alias("p95"))


@query("""with d as (select cast(ts as date) as day, avg((event_type <> 'error')::int) as share from events group by 1), b as (select *, lag(day) over (order by day) as pd, lag(share) over (order by day) as ps from d)
select strftime(day, '%Y-%m-%d') as day, round(share, 6) as share, round(case when pd = day - 1 then ps - share end, 6) as drop from b""")
def grounded_drop_dod(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = alerts.share_daily(events(spark, sf_dir), "ts", F.col("event_type") != "error")
    return rows.select(F.date_format("day", "yyyy-MM-dd").alias("day"), F.round("share", 6).alias("share"), F.round("drop", 6).alias("drop"))


@query("""select strftime(time_bucket(interval 5 minute, ts), '%Y-%m-%d %H:%M:%S') as start, count(*) filter (where event_type = 'error') as failed, count(*) as n, round(count(*) filter (where event_type = 'error') / cast(count(*) as double), 6) as ratio
from events group by time_bucket(interval 5 minute, ts)""")
def error_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = alerts.error_ratio(events(spark, sf_dir), "ts", 5, F.col("event_type") == "error")
    return rows.select(told("start"), "failed", "n", F.round("ratio", 6).alias("ratio"))


@query("""with s as (select user_id, ts, value > 3 as h, sum(case when value > 3 then 0 else 1 end) over (partition by user_id order by ts, event_id) as run from events),
r as (select user_id, min(ts) as since, max(ts) as until from s where h group by user_id, run)
select user_id, strftime(since, '%Y-%m-%d %H:%M:%S') as since, strftime(until, '%Y-%m-%d %H:%M:%S') as until, date_sub('minute', since, until) as minutes from r where date_sub('minute', since, until) >= 30""")
def sustained_queue_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = alerts.sustained(events(spark, sf_dir), "ts", F.col("value") > 3, 30, ["user_id"])
    return rows.select("user_id", told("since"), told("until"), "minutes")


@query("""select l_returnflag as run, round(sum(l_quantity) / sum(l_quantity + l_linenumber), 6) as ratio from lineitem group by 1""")
def chunk_reuse_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("run"), F.col("l_quantity").alias("reused"), F.col("l_linenumber").alias("written"))
    return alerts.reuse_ratio(rows, "run").select("run", F.round("ratio", 6).alias("ratio"))


@query("""with r(role, permission) as (values ('viewer', 'query'), ('editor', 'query'), ('editor', 'upload_documents'), ('admin', 'query'), ('admin', 'upload_documents'), ('admin', 'manage_sources'), ('admin', 'manage_members'), ('admin', 'change_settings'),
('owner', 'query'), ('owner', 'upload_documents'), ('owner', 'manage_sources'), ('owner', 'manage_members'), ('owner', 'change_settings'), ('owner', 'delete_tenant')),
m as (select c_custkey, ['viewer', 'editor', 'admin', 'owner'][c_custkey % 4 + 1] as role from customer)
select permission, count(*) as members from m join r using (role) group by 1""")
def role_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = table(spark, sf_dir, "customer").select(F.element_at(F.array(*[F.lit(r) for r in operations.ROLES]), (F.col("c_custkey") % 4 + 1).cast("int")).alias("role"))
    grants = spark.createDataFrame(operations.role_matrix(), "role string, permission string")
    return members.join(F.broadcast(grants), "role").groupBy("permission").agg(F.count("*").alias("members"))


@query("""with s as (select c_custkey, ['active', 'suspended', 'deleting', 'deleted'][c_custkey % 4 + 1] as a, ['active', 'suspended', 'deleting', 'deleted'][c_custkey // 4 % 4 + 1] as b from customer)
select c_custkey, (a || '>' || b) in ('active>suspended', 'active>deleting', 'suspended>active', 'suspended>deleting', 'deleting>active', 'deleting>suspended', 'deleting>deleted') as permitted from s""")
def lifecycle_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = F.array(*[F.lit(s) for s in ("active", "suspended", "deleting", "deleted")])
    pick = lambda k: F.element_at(states, (k % 4 + 1).cast("int"))
    i = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select("c_custkey", operations.permitted_move(pick(i), pick(F.floor(i / 4))).alias("permitted"))


@query("""select c_custkey, case when c_custkey % 3 = 2 then 'refused' when c_custkey % 5 = 0 then 'unavailable' when c_custkey % 3 = 1 and c_custkey % 2 = 0 then 'read-only' else 'allowed' end as access from customer""")
def tenant_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("c_custkey")
    status = F.when(i % 3 == 2, "deleting").when(i % 3 == 1, "suspended").otherwise("active")
    return table(spark, sf_dir, "customer").select("c_custkey", operations.access(status, i % 2 == 0, i % 5 != 0).alias("access"))


@query("""with m as (select c_nationkey as tenant_id, c_custkey, case when c_custkey % 40 = 0 then 'owner' else 'editor' end as role from customer)
select tenant_id, count(*) filter (where not (role = 'owner' and owners <= 1)) as removable from (select *, count(*) filter (where role = 'owner') over (partition by tenant_id) as owners from m) group by 1""")
def last_owner_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("tenant_id"), F.when(F.col("c_custkey") % 40 == 0, "owner").otherwise("editor").alias("role"))
    return operations.last_owner(members).groupBy("tenant_id").agg(F.count_if("removable").alias("removable"))


@query("""select user_id as email, count(*) as failures from events where event_type = 'error' and ts > timestamp '2024-01-19 00:00:00' and ts <= timestamp '2024-01-20 00:00:00' group by 1 having count(*) >= 2""")
def account_lockout(spark: SparkSession, sf_dir: str) -> DataFrame:
    failures = events(spark, sf_dir).where("event_type = 'error'").select(F.col("user_id").cast("string").alias("email"), F.col("ts").alias("at"))
    return operations.locked_out(failures, NOW, 2, 24 * 60).select(F.col("email").cast("long").alias("email"), "failures")


@query("""select s_suppkey as key_id from supplier where s_suppkey % 3 <> 0 and (s_suppkey % 4 = 0 or s_suppkey % 30 > 15) and s_suppkey % 2 = 0""")
def api_key_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("s_suppkey")
    at = F.timestamp_add("DAY", i % 30 - 15, utc(NOW))
    keys = table(spark, sf_dir, "supplier").select(i.alias("key_id"), F.when(i % 3 == 0, at).alias("revoked_at"), F.when(i % 4 != 0, at).alias("expires_at"), F.when(i % 2 == 0, F.array(F.lit("query"))).otherwise(F.array(F.lit("ingest"))).alias("scopes"))
    return operations.usable_keys(keys, NOW, "query").select("key_id")


@query("""select event_id as session_id from events where ts > timestamp '2024-01-18 00:00:00' and event_id % 3 <> 0""")
def session_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = F.when(F.col("event_id") % 3 == 0, utc(NOW)).otherwise(utc(datetime(2024, 3, 1)))
    rows = events(spark, sf_dir).select(F.col("event_id").alias("session_id"), ends.alias("expires_at"), F.col("ts").alias("last_seen_at"))
    return operations.usable_sessions(rows, NOW, timedelta(days=2)).select("session_id")


@query("""select event_id from events where event_id < 9000 order by event_id desc limit 201""")
def audit_keyset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return operations.keyset(events(spark, sf_dir).select("event_id"), ["event_id"], (9000,), operations.page_size(900))


@query("""select o_orderkey, case when o_orderstatus = 'F' then 'refuse' when o_orderstatus = 'P' then 'request' else 'cancel' end as cancel from orders""")
def cancel_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("o_orderstatus")
    state = F.when(s == "F", "succeeded").when(s == "P", "running").otherwise("queued")
    return table(spark, sf_dir, "orders").select("o_orderkey", operations.cancellable(state).alias("cancel"))


@query("""select l_orderkey, l_linenumber, case when l_linenumber % 5 = 0 then 'cancelled' when l_returnflag = 'A' then 'succeeded' when l_linenumber % 7 = 0 then 'queued' when l_linenumber >= 4 then 'failed' else 'queued' end as state from lineitem""")
def attempt_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("l_linenumber")
    state = operations.outcome_state(F.col("l_returnflag") == "A", n, F.lit(4), n % 7 == 0, n % 5 == 0)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", state.alias("state"))


_SECONDS = "epoch_us(ts) / 1000000.0::double"


@query(f"""with recursive q as (select 'tenant:' || user_id as key, event_id as seq, {_SECONDS} as t, row_number() over (partition by user_id order by ts, event_id) as n from events),
f as (select key, seq, n, t, 3.0::double as held from q where n = 1
 union all select q.key, q.seq, q.n, q.t, least(3.0::double, (case when f.held >= 1 then f.held - 1 else f.held end) + (q.t - f.t) * (1 / 3600.0::double)) from f join q on q.key = f.key and q.n = f.n + 1)
select key, seq, held >= 1 as allowed, round(case when held >= 1 then 0.0::double else (1 - held) / (1 / 3600.0::double) end, 3) as retry_after from f""")
def token_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).select(F.concat(F.lit("tenant:"), "user_id").alias("key"), F.col("ts").alias("at"), F.col("event_id").alias("seq"))
    return operations.rate_limited(rows, 1 / 3600, 3).select("key", "seq", "allowed", F.round("retry_after", 3).alias("retry_after"))


@query(f"""with recursive q as (select event_type as key, event_id as seq, {_SECONDS} as t, value < 10 as ok, row_number() over (partition by event_type order by ts, event_id) as n from events),
r as (select *, case when ok then 'ok' else 'failed' end as result, case when ok then 0 else 1 end as fails, cast(null as double) as opened from q where n = 1
 union all select q.key, q.seq, q.t, q.ok, q.n,
  case when r.opened is not null and q.t - r.opened < 3600 then 'refused' when q.ok then 'ok' else 'failed' end,
  case when r.opened is not null and q.t - r.opened < 3600 then r.fails when q.ok then 0 else r.fails + 1 end,
  case when r.opened is not null and q.t - r.opened < 3600 then r.opened when q.ok then null when r.opened is not null or r.fails + 1 >= 3 then q.t else null end
 from r join q on q.key = r.key and q.n = r.n + 1)
select key, seq, result from r""")
def circuit_breaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).select(F.col("event_type").alias("key"), F.col("ts").alias("at"), F.col("event_id").alias("seq"), (F.col("value") < 10).alias("ok"))
    return operations.broken(rows, failures=3, cooldown=3600.0).select("key", "seq", "result")
