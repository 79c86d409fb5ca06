"""Ingest, versions, reuse, retention and reindexing over the test tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.functions.times import utc
from corpusloom.operators import ingest
from corpusloom.operators.folds import carried
from corpusloom.plans.base import DataFrame, SparkSession, query, table

NOW = datetime(2024, 6, 1)
_T = "timestamp '2024-06-01 00:00:00'"


def _days_ago(n: Column) -> Column:
    """A time whole days before NOW, without a zone."""
    return F.timestamp_add("DAY", -n, utc(NOW))


@query("""with v as (select source || '/' || lang as document_id, doc_id as version_id from documents), c as (select document_id, max(version_id) as current from v group by 1)
select document_id, version_id from v where version_id not in (select current from c)""")
def noncurrent_versions_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "documents").select(F.concat_ws("/", "source", "lang").alias("document_id"), F.col("doc_id").alias("version_id"))
    current = v.groupBy("document_id").agg(F.max("version_id").alias("version_id")).select("version_id")
    return v.join(current, "version_id", "left_anti").select("document_id", "version_id")


@query("""select min(doc_id) as chunk_id, sha256(text) as chunk_hash from documents where doc_id % 2 = 1 and sha256(text) not in (select sha256(text) from documents where doc_id % 2 = 0) group by sha256(text)""")
def embed_reuse_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("chunk_hash"), F.col("text").alias("embed_text"))
    known = docs.where("doc_id % 2 = 0").select(F.col("doc_id").alias("chunk_id"), "chunk_hash", F.lit("m").alias("model"), F.array(F.lit(1.0)).alias("embedding"))
    fresh = docs.where("doc_id % 2 = 1")
    _, missing = ingest.reuse(fresh, known, "m")
    return fresh.join(missing.select("chunk_hash"), "chunk_hash").groupBy("chunk_hash").agg(F.min("doc_id").alias("chunk_id")).select("chunk_id", "chunk_hash")


@query("""with b as (select sha256(text) as chunk_hash, min(doc_id) as least from documents where doc_id % 2 = 0 group by 1)
select d.doc_id, b.least as reused_from from documents d join b on sha256(d.text) = b.chunk_hash where d.doc_id % 2 = 1""")
def embed_reuse_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("chunk_hash"), F.col("text").alias("embed_text"))
    known = docs.where("doc_id % 2 = 0").select(F.col("doc_id").alias("chunk_id"), "chunk_hash", F.lit("m").alias("model"), F.col("doc_id").alias("embedding"))
    found, _ = ingest.reuse(docs.where("doc_id % 2 = 1"), known, "m")
    return found.select("doc_id", F.col("embedding").alias("reused_from"))


_FOLD = """with recursive t as (select source, doc_id, cast(ceil(strlen(text) / 4.0) as bigint) as tokens, row_number() over (partition by source order by doc_id) as k from documents),
f as (select source, doc_id, k, tokens as held, 1 as size, cast(0 as bigint) as batch from t where k = 1
 union all select t.source, t.doc_id, t.k, case when f.size = 16 or f.held + t.tokens > 8000 then t.tokens else f.held + t.tokens end, case when f.size = 16 or f.held + t.tokens > 8000 then 1 else f.size + 1 end,
 case when f.size = 16 or f.held + t.tokens > 8000 then f.batch + 1 else f.batch end from f join t on t.source = f.source and t.k = f.k + 1)
select source, doc_id, batch from f"""


@query(_FOLD)
def embed_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("source", "doc_id", F.ceil(F.octet_length("text") / 4).cast("long").alias("tokens"))

    adds = T.StructType([T.StructField("batch", T.LongType())])
    return carried(rows, "source", ["doc_id"], lambda: ingest.Requests(16, 8000), lambda requests, tokens: (requests.take(tokens),), ["tokens"], adds).select("source", "doc_id", "batch")


def _catalog(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(stored documents, incoming ones): ids not divisible by 4 are stored, odd ones come in; every fifth text has changed."""
    docs = table(spark, sf_dir, "documents")
    h = F.sha2("text", 256)
    stored = docs.where("doc_id % 4 <> 0").select("doc_id", "source", h.alias("content_hash"), F.when(F.col("doc_id") % 7 == 0, "deleted").otherwise("active").alias("status"), _days_ago(F.col("doc_id") % 60).alias("last_seen_at"), F.when(F.col("doc_id") % 7 == 0, _days_ago(F.col("doc_id") % 50)).alias("deleted_at"))
    incoming = docs.where("doc_id % 2 = 1 or doc_id % 4 = 0").select("doc_id", F.when(F.col("doc_id") % 5 == 0, F.sha2(F.concat("text", F.lit("!")), 256)).otherwise(h).alias("content_hash"))
    return stored, incoming


_CHANGE = """case when doc_id % 4 = 0 then 'new' when doc_id % 5 = 0 then 'changed' when doc_id % 7 = 0 then 'revived' else 'unchanged' end"""


@query(f"select {_CHANGE} as change, count(*) as n from documents where doc_id % 2 = 1 or doc_id % 4 = 0 group by 1")
def ingest_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored, incoming = _catalog(spark, sf_dir)
    return ingest.changed(incoming, stored, ["doc_id"]).groupBy("change").agg(F.count("*").alias("n"))


@query("""select doc_id, case when doc_id % 2 = 1 or doc_id % 4 = 0 then 'active' when doc_id % 7 = 0 then 'deleted' else 'active' end as status,
 sha256(case when doc_id % 5 = 0 and (doc_id % 2 = 1 or doc_id % 4 = 0) then text || '!' else text end) as content_hash from documents""")
def versioned_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored, incoming = _catalog(spark, sf_dir)
    return ingest.upserted(stored, incoming, ["doc_id"], NOW).select("doc_id", "status", "content_hash")


@query(f"""select doc_id from documents where (doc_id % 2 = 1 or doc_id % 4 = 0) and {_CHANGE} in ('new', 'changed')""")
def new_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored, incoming = _catalog(spark, sf_dir)
    return ingest.versioned(stored, incoming, ["doc_id"]).select("doc_id")


@query(f"""select status, count(*) as n from (select case when doc_id % 7 = 0 then 'deleted' when source = 'src1' and {_T} - to_days(cast(doc_id % 60 as integer)) < {_T} - to_days(30) then 'deleted' else 'active' end as status
from documents where doc_id % 4 <> 0) group by 1""")
def delete_unseen(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored, _ = _catalog(spark, sf_dir)
    after = ingest.reconciled(stored, "src1", datetime(2024, 5, 2), complete=True, seen=5)
    return after.groupBy("status").agg(F.count("*").alias("n"))


def _retained(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    docs = table(spark, sf_dir, "documents")
    i = F.col("doc_id")
    versions = docs.select(F.concat_ws("/", "source", "lang").alias("document_id"), i.alias("version_id"), _days_ago(i % 70).alias("created_at"))
    documents = versions.groupBy("document_id").agg(F.max("version_id").alias("current_version"))
    gone = F.col("current_version") % 9 == 0
    documents = documents.withColumns({"status": F.when(gone, "deleted").otherwise("active"), "deleted_at": F.when(gone, _days_ago(F.col("current_version") % 70))})
    chunks = versions.select("version_id", F.explode(F.array(F.col("version_id") * 2, F.col("version_id") * 2 + 1)).alias("chunk_id"))
    queries = table(spark, sf_dir, "events").select(F.col("event_id").alias("query_id"), _days_ago(F.col("event_id") % 120).alias("created_at"))
    pages = table(spark, sf_dir, "pages").select("url", F.when(F.col("page_id") % 3 != 0, _days_ago(F.col("page_id") % 40)).alias("last_fetched_at"))
    return ingest.garbage(documents, versions, chunks, queries, pages, NOW, ingest.Retention(30, 30, 90, 21))


_GC = """with v as (select source || '/' || lang as document_id, doc_id as version_id, doc_id % 70 as age from documents), d as (select document_id, max(version_id) as cur from v group by 1),
gone as (select document_id from d where cur % 9 = 0 and cur % 70 > 30), stale as (select version_id from v where version_id not in (select cur from d) and age > 30),
lost as (select version_id from stale union select version_id from v where document_id in (select document_id from gone))
select 'old_versions' as class, (select count(*) from stale) as n union all select 'deleted_docs', (select count(*) from gone) union all select 'versions', (select count(*) from lost)
union all select 'chunks', 2 * (select count(*) from lost) union all select 'query_logs', (select count(*) from events where event_id % 120 > 90) union all select 'crawl_pages', (select count(*) from pages where page_id % 3 <> 0 and page_id % 40 > 21)"""


@query(_GC)
def gc_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for name, gone in _retained(spark, sf_dir).items():
        one = gone.agg(F.count("*").alias("n")).select(F.lit(name).alias("class"), "n")
        out = one if out is None else out.union(one)
    return out


@query("""select count(distinct source || '/' || lang) as live_docs, (select count(*) from (select source || '/' || lang as d from documents group by 1 having bool_or(doc_id % 10 = 0))) as covered_docs, count(*) as live_chunks,
(select count(*) from documents where doc_id % 10 = 0) as new_chunks from documents""")
def reindex_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    live = table(spark, sf_dir, "documents").select(F.concat_ws("/", "source", "lang").alias("document_id"), "doc_id")
    return ingest.coverage(live, live.where("doc_id % 10 = 0"))


@query("""select doc_id, source || case when lang = 'en' then '' else ' > ' || lang end || chr(10) || text as embed_text from documents""")
def reindex_reuse_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.array("source", F.when(F.col("lang") == "en", F.lit("")).otherwise(F.col("lang")))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("title"), path.alias("heading_path"), F.col("text").alias("content"))
    return ingest.reindex_texts(rows).select("doc_id", "embed_text")


@query("""select source, min(doc_id) as first_id from documents group by source""")
def distinct_on_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.latest_once(table(spark, sf_dir, "documents"), ["source"], F.col("doc_id")).select("source", F.col("doc_id").alias("first_id"))


@query("""select 'documents' as t, count(*) as n from documents where source <> 'src2' union all select 'chunks', count(*) from documents where source <> 'src2'""")
def delete_source_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), "source", F.col("doc_id").alias("version_id"))
    products = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("product_id"), F.lit("src2").alias("source"))
    left = ingest.source_deleted("src2", docs.select("document_id", "source"), docs.select("document_id", "version_id"), docs.select("version_id"), products)
    count = lambda name: left[name].agg(F.count("*").alias("n")).select(F.lit(name).alias("t"), "n")
    return count("documents").union(count("chunks"))


@query(f"""with i as (select doc_id, {_CHANGE} as change, case when doc_id % 50 = 1 then 'bad' end as error from documents where doc_id % 2 = 1 or doc_id % 4 = 0)
select count(*) as docs_seen, count(*) filter (where change = 'new') as docs_new, count(*) filter (where change = 'changed') as docs_changed, count(*) filter (where change = 'unchanged') as docs_unchanged, count(error) as docs_failed,
(select string_agg(e, ';' order by e) from (select cast(doc_id as varchar) || ': bad' as e from i where error is not null order by cast(doc_id as varchar) limit 5)) as errors from i""")
def sync_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored, incoming = _catalog(spark, sf_dir)
    rows = ingest.changed(incoming, stored, ["doc_id"]).select(F.col("doc_id").cast("string").alias("external_id"), "change", F.when(F.col("doc_id") % 50 == 1, "bad").alias("error"))
    return ingest.sync_stats(rows, 5).withColumn("errors", F.array_join("errors", ";"))


@query("""select page_id, case when page_id % 2 = 0 then 'new' || page_id else 'old' || page_id end as etag from pages""")
def page_state_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    old = pages.select("page_id", F.concat(F.lit("old"), "page_id").alias("etag"))
    new = pages.select("page_id", F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("new"), "page_id")).alias("etag"))
    return ingest.merged(old, new, ["page_id"], ["etag"])


@query("""select count(*) filter (where item_id % 3 <> 0) as created, count(*) filter (where item_id % 3 = 0) as updated from benchmark""")
def eval_import_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = table(spark, sf_dir, "benchmark").select(F.col("text").alias("question"), "item_id")
    return ingest.imported_counts(cases, cases.where("item_id % 3 = 0"))


@query("""select doc_id, max(doc_id) over (partition by source) as newest from documents""")
def newest_per_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.max("doc_id").over(Window.partitionBy("source")).alias("newest"))
