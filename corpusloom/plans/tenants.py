"""Tenants over the test tables: nations are tenants, customers users, orders requests."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from corpusloom.functions import jsondoc
from corpusloom.functions.times import utc
from corpusloom.operators import alerts, tenancy
from corpusloom.plans.base import DataFrame, SparkSession, query, table

NOW = datetime(2024, 6, 1)


def tenants(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_nationkey")
    status = F.when(n % 5 == 0, "suspended").when(n % 7 == 3, "deleting").otherwise("active")
    return table(spark, sf_dir, "nation").select(n.alias("tenant_id"), status.alias("status"))


def databases(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").where(n % 4 != 0).select(
        n.alias("tenant_id"), F.concat(F.lit("db"), n).alias("host"), F.lit(5432).alias("port"), F.col("n_name").alias("database_name"), F.when(n % 2 == 0, "disable").alias("ssl_mode"),
        F.when(n % 3 != 0, n % 6).cast("int").alias("schema_version"), F.when(n % 5 == 1, 9).alias("max_conns"),
    )


_TENANTS = "t as (select n_nationkey as tenant_id, case when n_nationkey % 5 = 0 then 'suspended' when n_nationkey % 7 = 3 then 'deleting' else 'active' end as status from nation)"
_DATABASES = """d as (select n_nationkey as tenant_id, 'db' || n_nationkey as host, 5432 as port, n_name as database_name, case when n_nationkey % 2 = 0 then 'disable' end as ssl_mode,
case when n_nationkey % 3 <> 0 then n_nationkey % 6 end as schema_version, case when n_nationkey % 5 = 1 then 9 end as max_conns from nation where n_nationkey % 4 <> 0)"""


@query("""with u as (select c_custkey as user_id, c_custkey % 50 = 0 as is_platform_admin from customer), m as (select c_nationkey as tenant_id, c_custkey as user_id, ['viewer', 'editor', 'admin', 'owner'][1 + c_custkey % 4] as role from customer where c_custkey % 3 <> 0)
select o_orderkey, is_platform_admin, role, role is not null as member from orders join u on user_id = o_custkey left join m on m.user_id = u.user_id and m.tenant_id = o_orderkey % 5""")
def principal_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("c_custkey")
    customer = table(spark, sf_dir, "customer")
    users = customer.select(c.alias("user_id"), (c % 50 == 0).alias("is_platform_admin"))
    role = F.element_at(F.array(*map(F.lit, ("viewer", "editor", "admin", "owner"))), (c % 4 + 1).cast("int")).alias("role")
    members = customer.where(c % 3 != 0).select(F.col("c_nationkey").alias("tenant_id"), c.alias("user_id"), role)
    asked = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 5).alias("tenant_id"), F.col("o_custkey").alias("user_id"))
    return tenancy.principals(asked, users, members).select("o_orderkey", "is_platform_admin", "role", "member")


@query(f"""with {_TENANTS}, {_DATABASES} select tenant_id, status, coalesce(host, '') as host, coalesce(port, 0) as port, coalesce(database_name, '') as database_name, coalesce(ssl_mode, 'require') as ssl_mode,
cast(coalesce(schema_version, 0) as integer) as schema_version, coalesce(max_conns, 5) as max_conns from t left join d using (tenant_id)""")
def tenant_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tenancy.registry(tenants(spark, sf_dir), databases(spark, sf_dir))


@query(f"""with {_TENANTS}, {_DATABASES} select tenant_id from t join d using (tenant_id) where status = 'active' and coalesce(schema_version, 0) < 3""")
def tenants_behind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tenancy.behind(tenants(spark, sf_dir), databases(spark, sf_dir), 3).select("tenant_id")


@query("""with m as (select cast(floor(epoch(ts) / 60) as bigint) as minute, avg((user_id % 7 <> 0)::int) > 0.8 as behind from events group by 1),
s as (select minute, behind, sum(case when behind then 0 else 1 end) over (order by minute) as run from m), r as (select min(minute) as since, max(minute) as until from s where behind group by run)
select since, until from r where until - since >= 15""")
def schema_mismatch_15m(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times in which samples of tenants behind stay high for fifteen minutes; a sample is a minute."""
    samples = table(spark, sf_dir, "events").groupBy(F.window("ts", "1 minute")["start"].alias("at")).agg(F.avg((F.col("user_id") % 7 != 0).cast("int")).alias("share"))
    runs = alerts.sustained(samples, "at", F.col("share") > 0.8, 15)
    minute = lambda c: F.timestamp_diff("MINUTE", utc(datetime(1970, 1, 1)), F.col(c))
    return runs.select(minute("since").alias("since"), minute("until").alias("until"))


@query("""with k as (select c_custkey as key_id, c_nationkey as tenant_id, 'ck_' || c_custkey as key_prefix, sha256('ck_' || c_custkey || '_' || c_name) as key_hash, c_custkey % 9 = 0 as revoked,
 case when c_custkey % 4 = 0 then timestamp '2024-06-01 00:00:00' - to_days(cast(c_custkey % 20 - 10 as integer)) end as expires_at, case when c_custkey % 5 <> 0 then timestamp '2024-06-01 00:00:00' - to_seconds(cast(c_custkey % 120 as integer)) end as last_used_at from customer),
p as (select o_orderkey, 'ck_' || o_custkey || '_' || case when o_orderkey % 10 = 0 then 'guess' else c_name end as key from orders join customer on c_custkey = o_custkey)
select o_orderkey, k.key_id, k.tenant_id, case when k.key_id is null then 'invalid' when expires_at <= timestamp '2024-06-01 00:00:00' then 'expired' else 'ok' end as result,
k.key_id is not null and coalesce(expires_at > timestamp '2024-06-01 00:00:00', true) and (last_used_at is null or date_diff('second', last_used_at, timestamp '2024-06-01 00:00:00') >= 60) as touch
from p left join k on not revoked and key_hash = sha256(key) and key_prefix = regexp_extract(key, '^(ck_[0-9]+)_', 1)""")
def api_key_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = table(spark, sf_dir, "customer")
    c = F.col("c_custkey")
    text = lambda secret: F.concat(F.lit("ck_"), c, F.lit("_"), secret)
    ago = lambda unit, n: F.timestamp_add(unit, -n, utc(NOW))
    keys = customer.select(
        c.alias("key_id"), F.col("c_nationkey").alias("tenant_id"), F.concat(F.lit("ck_"), c).alias("key_prefix"), F.sha2(text(F.col("c_name")), 256).alias("key_hash"), F.array(F.lit("query")).alias("scopes"),
        F.when(c % 9 == 0, utc(NOW)).alias("revoked_at"), F.when(c % 4 == 0, ago("DAY", c % 20 - 10)).alias("expires_at"), F.when(c % 5 != 0, ago("SECOND", c % 120)).alias("last_used_at"),
    )
    orders = table(spark, sf_dir, "orders").join(customer, F.col("o_custkey") == c)
    asked = orders.select("o_orderkey", text(F.when(F.col("o_orderkey") % 10 == 0, F.lit("guess")).otherwise(F.col("c_name"))).alias("key"), utc(NOW).alias("at"))
    return tenancy.verified(asked, keys).select("o_orderkey", "key_id", "tenant_id", "result", "touch")


@query(f"""with {_TENANTS} select tenant_id, case when status <> 'deleting' and tenant_id % 2 = 0 then 'deleting' else status end as status, (tenant_id % 2 = 0 and status <> 'deleting') or (status = 'deleting' and tenant_id > 5) as due from t""")
def tenant_deletion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even tenants are scheduled; seven days later they are due, as are those of over 5 that were scheduled a day before."""
    before = F.when(F.col("status") == "deleting", F.when(F.col("tenant_id") > 5, utc(NOW + timedelta(days=6))).otherwise(utc(NOW + timedelta(days=8))))
    rows = tenancy.scheduled(tenants(spark, sf_dir).withColumn("delete_after", before), F.col("tenant_id") % 2 == 0, NOW, timedelta(0))
    due = tenancy.deletable(rows, NOW + timedelta(days=7)).select("tenant_id", F.lit(True).alias("due"))
    return rows.join(due, "tenant_id", "left").select("tenant_id", "status", F.coalesce("due", F.lit(False)).alias("due"))


_SECONDS = "epoch_us(ts) / 1000000.0::double"


def _bucket(name: str, rows: str, key: str, burst: float) -> str:
    rate = "(1 / 3600.0::double)"
    return f"""{name}_q as (select {key} as key, seq, t, row_number() over (partition by {key} order by t, seq) as n from {rows}),
{name} as (select key, seq, n, t, {burst}::double as held from {name}_q where n = 1 union all select q.key, q.seq, q.n, q.t, least({burst}::double, (case when f.held >= 1 then f.held - 1 else f.held end) + (q.t - f.t) * {rate}) from {name} f join {name}_q q on q.key = f.key and q.n = f.n + 1)"""


@query(f"""with recursive e as (select event_id as seq, {_SECONDS} as t, user_id % 20 as tenant_id, case when event_id % 4 <> 0 then user_id end as key_id from events), {_bucket('a', 'e', 'tenant_id', 6.0)},
passed as (select e.* from e join a on a.seq = e.seq where a.held >= 1 and e.key_id is not null), {_bucket('b', 'passed', 'key_id', 2.0)}
select e.seq as event_id, case when a.held < 1 then 'tenant' when b.held < 1 then 'key' end as limited_by from e join a on a.seq = e.seq left join b on b.seq = e.seq""")
def rate_limit_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", F.col("ts").alias("at"), (F.col("user_id") % 20).alias("tenant_id"), F.when(F.col("event_id") % 4 != 0, F.col("user_id")).alias("key_id"))
    return tenancy.chained_limits(rows, 1 / 3600, 6, 2, seq="event_id").select("event_id", "limited_by")


@query("""with p as (select event_id, ts, event_type from events where event_type = 'click' and ts < timestamp '2024-01-20 00:00:00' order by ts desc, event_id desc limit 21)
select event_id, quality as rating, replace(replace(rtrim(base64(encode('["' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '",' || event_id || ']')), '='), '+', '-'), '/', '_') as next from p left join labels on doc_id = event_id""")
def querylog_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    logged = table(spark, sf_dir, "events").select(F.col("event_id").alias("query_id"), F.col("ts").alias("created_at"), "event_type")
    feedback = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("query_id"), F.col("quality").alias("rating"))
    page, _ = tenancy.logged(logged, feedback, tenancy.cursor(datetime(2024, 1, 20), 0), 20, event_type="click", source=None)
    return page.select(F.col("query_id").alias("event_id"), "rating", "next")


@query(f"""with {_TENANTS} select tenant_id from t""")
def fleet_migration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tenancy.to_migrate(tenants(spark, sf_dir).withColumn("slug", F.concat(F.lit("t"), "tenant_id"))).select("tenant_id")


@query("""with d as (select event_id, event_type, json_merge_patch(json_object('limits', json_object('qps', 10, 'burst', user_id), 'llm', json_object('model', event_type)),
 json_object('limits', cast(props as json), 'flags', json_object('value', value))) as j from events)
select event_id, cast(j->>'$.limits.qps' as bigint) as qps, cast(j->>'$.limits.burst' as bigint) as burst, cast(j->>'$.limits.k' as bigint) as k, cast(j->>'$.flags.value' as double) as value,
 case when event_id % 5 <> 0 then case when event_id % 3 = 0 then 'none' else j->>'$.llm.model' end end as model, case when event_id % 7 = 0 then event_type end as before,
 case when event_id % 7 = 0 then 'before,' else '' end || 'flags,limits' || case when event_id % 5 <> 0 then ',llm' else '' end as names from d""")
def settings_patched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A settings document for each event: its patch merged in, members set and removed."""
    i, doc = F.col("event_id"), lambda c: F.parse_json(F.to_json(c))
    stored = doc(F.struct(F.struct(F.lit(10).alias("qps"), F.col("user_id").alias("burst")).alias("limits"), F.struct(F.col("event_type").alias("model")).alias("llm")))
    patch = doc(F.struct(F.from_json("props", "map<string,long>").alias("limits"), F.struct("value").alias("flags")))
    rows = table(spark, sf_dir, "events").select(i, jsondoc.merged(stored, patch).alias("d"), F.to_variant_object(F.array("event_type")).alias("t"))
    text = F.variant_get("t", "$[0]", "variant")
    rows = rows.select(i, F.when(i % 3 == 0, jsondoc.with_member(F.col("d"), ["llm", "model"], F.parse_json(F.lit('"none"')))).otherwise(F.col("d")).alias("d"), F.when(i % 7 == 0, text).alias("t"))
    rows = rows.select(i, jsondoc.with_member(F.col("d"), ["before"], F.col("t")).alias("d"))
    rows = rows.select(i, F.when(i % 5 == 0, jsondoc.without(F.col("d"), "llm")).otherwise(F.col("d")).alias("d"))
    get = lambda path, kind: F.try_variant_get("d", path, kind)
    return rows.select(i, get("$.limits.qps", "long").alias("qps"), get("$.limits.burst", "long").alias("burst"), get("$.limits.k", "long").alias("k"), get("$.flags.value", "double").alias("value"), get("$.llm.model", "string").alias("model"), get("$.before", "string").alias("before"), F.array_join(jsondoc.names(F.col("d")), ",").alias("names"))
