"""A whole sync and a whole reindex over the test tables, each in a store of its own."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import functions as F

from corpusloom.operators import sync
from corpusloom.plans.base import DataFrame, SparkSession, documents, query, table
from corpusloom.sources import shared
from corpusloom.sources.tablestore import TableStore

#: No text is cut at this size, so that a document is one chunk.
WHOLE = 10**9


def store(spark: SparkSession) -> TableStore:
    return TableStore(spark, f"{shared.root(spark)}/corpusloom-stores/{uuid.uuid4().hex}")


def lengths(texts: list[str]) -> list[list[float]]:
    """A stand-in for an embedding model."""
    return [[float(len(t)), 1.0] for t in texts]


_CANON = """array_to_string(list_filter(list_transform(string_split(replace(replace(t, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10) || chr(10)), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: x <> ''), chr(10) || chr(10))"""


@query(f"""with a as (select doc_id, text as t from documents where doc_id % 4 <> 0 and doc_id % 50 <> 1), b as (select doc_id, case when doc_id % 5 = 0 then text || '!' else text end as t from documents where doc_id % 3 <> 0),
stored as (select doc_id, {_CANON} as c from a), seen as (select doc_id, t, {_CANON} as c from b), good as (select * from seen where doc_id % 50 <> 1),
changed as (select g.* from good g left join stored s using (doc_id) where s.c is null or s.c <> g.c), missing as (select distinct c from changed where c <> '' and c not in (select c from stored))
select (select count(*) from seen) as docs_seen, (select count(*) from changed) as docs_changed, (select count(*) from good) - (select count(*) from changed) as docs_unchanged,
(select count(*) from stored where doc_id % 3 = 0) as docs_deleted, (select count(*) from seen where doc_id % 50 = 1) as docs_failed, (select count(*) from changed where c <> '') as chunks_written,
(select count(*) from changed where c in (select c from missing)) as chunks_embedded, (select count(*) from changed where c <> '' and c not in (select c from missing)) as chunks_reused,
(select cast(coalesce(sum(len(regexp_extract_all(c, '[\\p{{L}}\\p{{N}}]+|[^\\s\\p{{L}}\\p{{N}}]'))), 0) as bigint) from missing) as embed_tokens, (select cast(sum(strlen(t)) as bigint) from seen) as bytes_fetched,
(select string_agg(e, ';' order by e) from (select doc_id || ': unsupported mime type ''x/unknown''' as e from seen where doc_id % 50 = 1 order by cast(doc_id as varchar) limit 100)) as errors""")
def sync_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counters of a second full sync, with new, changed, unchanged, unreadable and vanished documents."""
    own = store(spark)
    out = shared.stored(_twice(spark, sf_dir, own).drop("duration_ms").withColumn("errors", F.array_join("errors", ";")), "sync-run")
    own.remove()
    return out


def _twice(spark: SparkSession, sf_dir: str, own: TableStore) -> DataFrame:
    """Two full syncs of the documents; the counters of the second."""
    docs = documents(spark, sf_dir)
    mime = F.when(F.col("doc_id") % 50 == 1, "x/unknown").otherwise("text/plain").alias("mime")
    first = docs.where("doc_id % 4 <> 0").select(F.col("doc_id").alias("external_id"), mime, F.col("text").alias("data"))
    text = F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")).alias("data")
    second = docs.where("doc_id % 3 <> 0").select(F.col("doc_id").alias("external_id"), mime, text)
    sync.synced(own, first, lengths, sync.Run("s", "m1", datetime(2024, 1, 1), target=WHOLE))
    return sync.synced(own, second, lengths, sync.Run("s", "m1", datetime(2024, 1, 2), target=WHOLE))


@query(f"""with a as (select doc_id, {_CANON} as c from (select doc_id, text as t from documents where doc_id % 4 <> 0 and doc_id % 50 <> 1)),
b as (select doc_id, {_CANON} as c from (select doc_id, case when doc_id % 5 = 0 then text || '!' else text end as t from documents where doc_id % 3 <> 0 and doc_id % 50 <> 1))
select cast(doc_id as varchar) as external_id, case when doc_id % 3 = 0 then 'deleted' else 'active' end as status, case when doc_id % 3 = 0 then 1 else 2 end as seen_on,
sha256(coalesce(b.c, a.c)) as markdown, cast(coalesce(b.c, a.c) <> '' as bigint) as chunks from a full join b using (doc_id)""")
def sync_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as the store has it after two syncs, read from the logs of parts: state, current version and its chunks."""
    own = store(spark)
    _twice(spark, sf_dir, own)
    now = sync.opened(own.snapshot())
    held = now["chunks"].groupBy("version_id").agg(F.count("*").alias("chunks"))
    rows = now["documents"].join(now["versions"].select(F.col("version_id").alias("current_version"), "markdown"), "current_version", "left").join(held.withColumnRenamed("version_id", "current_version"), "current_version", "left")
    out = rows.select("external_id", "status", F.dayofmonth("last_seen_at").alias("seen_on"), F.sha2("markdown", 256).alias("markdown"), F.coalesce("chunks", F.lit(0)).cast("long").alias("chunks"))
    out = shared.stored(out, "sync-state")
    own.remove()
    return out


@query("""with live as (select source || '/' || lang as d, max(doc_id) as v from documents where lang <> 'es' group by 1)
select doc_id, 'm2' as model, source || chr(10) || text as embed_text, cast(length(source || chr(10) || text) as double) as first from documents where doc_id in (select v from live)""")
def reindex_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live chunks after a reindex by another model, step by step, swapped in and the old ones dropped."""
    docs, own = table(spark, sf_dir, "documents"), store(spark)
    key, now = F.concat_ws("/", "source", "lang").alias("external_id"), F.lit(datetime(2024, 1, 1)).cast("timestamp")
    version = F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("version_id")
    top = docs.groupBy(key).agg(F.max(version).alias("current_version"))
    states = top.select("external_id", F.lit("s").alias("source"), F.lit("h").alias("content_hash"), "current_version", F.when(F.substring_index("external_id", "/", -1) == "es", "deleted").otherwise("active").alias("status"), F.lit(None).cast("timestamp").alias("deleted_at"), now.alias("last_seen_at"))
    versions = docs.select(version, key, F.lit("s").alias("source"), F.lit("h").alias("content_hash"), F.col("source").alias("title"), F.col("text").alias("markdown"), now.alias("created_at"))
    chunks = docs.select(version.alias("chunk_id"), version, F.lit(0).alias("position"), F.array().cast("array<string>").alias("heading_path"), F.col("text").alias("content"), F.col("text").alias("embed_text"), F.lit(1).alias("token_count"), F.sha2("text", 256).alias("chunk_hash"), F.lit("m1").alias("model"), F.array(F.lit(0.0)).cast("array<float>").alias("embedding"))
    own.commit(own.snapshot(), replace={"documents": states, "versions": versions, "chunks": chunks})
    work = sync.Reindex(own, lengths, "m2", batch=40)
    work.run()
    work.swap()
    work.drop_old()
    out = shared.stored(own.read("chunks").select(F.col("version_id").cast("long").alias("doc_id"), "model", "embed_text", F.col("embedding")[0].cast("double").alias("first")), "reindex-run")
    own.remove()
    return out
