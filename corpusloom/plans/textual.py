"""Parsing, chunking, text expressions, crawl sources."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusloom.functions import text, urls
from corpusloom.operators import blocks, chunks
from corpusloom.plans.base import DataFrame, SparkSession, documents, query, table
from corpusloom.sources import web

_ONE = r"trim(regexp_replace({}, '\s+', ' ', 'g'))"


@query(r"""select doc_id, cast(len(regexp_extract_all(text, '[\p{L}\p{N}]+|[^\s\p{L}\p{N}]')) as bigint) as tokens from documents""")
def approx_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", text.approx_tokens(F.col("text")).cast("long").alias("tokens"))


@query(f"""with p as (select doc_id, unnest(string_split(text, chr(10) || chr(10))) as para, generate_subscripts(string_split(text, chr(10) || chr(10)), 1) as k from documents),
c as (select doc_id, k, {_ONE.format('para')} as paragraph from p)
select doc_id, row_number() over (partition by doc_id order by k) - 1 as position, paragraph from c where paragraph <> ''""")
def text_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir).select("doc_id", F.posexplode(text.paragraphs(F.col("text"))).alias("position", "paragraph"))
    return rows.select("doc_id", F.col("position").cast("long").alias("position"), "paragraph")


@query(f"""select doc_id, case when length({_ONE.format('text')}) <= 240 then {_ONE.format('text')} else left({_ONE.format('text')}, 240) || '…' end as snippet from documents""")
def snippet_240(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", text.snippet(F.col("text")).alias("snippet"))


@query("""select sha256(text) as content_hash, count(*) as copies, min(doc_id) as first_id from documents group by 1 having count(*) > 1""")
def content_hash_dupes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").groupBy(text.content_hash(F.col("text")).alias("content_hash"))
    return rows.agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id")).where("copies > 1")


@query()
def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    parsed = blocks.documents_parsed(docs, "text/plain", "text")
    rows = chunks.exploded(parsed, "doc_id", 256, 32)
    return rows.select("doc_id", "position", "token_count", "chunk_hash", "content")


@query()
def html_to_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "html")
    parsed = blocks.documents_parsed(pages, "text/html", "html")
    return parsed.select("page_id", "title", F.size("blocks").alias("n_blocks"), "content_hash", "markdown")


@query()
def markdown_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = blocks.documents_parsed(table(spark, sf_dir, "pages").select("page_id", "html"), "text/html", "html").select("page_id", F.col("markdown").alias("body"))
    parsed = blocks.documents_parsed(pages, "text/markdown", "body")
    rows = parsed.select("page_id", F.posexplode("blocks").alias("position", "b"))
    return rows.select("page_id", "position", F.col("b.type").alias("type"), F.col("b.level").alias("level"), F.col("b.text").alias("text"))


@query("""select event_id, 'k: ' || json_extract_string(props, '$.k') as flattened from events""")
def json_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = blocks.parsed("application/json", F.col("props"))
    return table(spark, sf_dir, "events").select("event_id", parsed.alias("p")).select("event_id", F.col("p.blocks")[0]["text"].alias("flattened"))


@query(r"""with h as (select page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) as href from pages) select page_id, count(*) as links, count(distinct href) as distinct_links from h group by page_id""")
def html_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))).alias("href"))
    return rows.groupBy("page_id").agg(F.count("*").alias("links"), F.countDistinct("href").alias("distinct_links"))


@query(r"""with p as (select page_id, regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) as origin, trim(regexp_replace(replace(replace(replace(replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '\s+', ' ', 'g')) as title,
 list_transform(regexp_extract_all(html, '<a href="(/[^"]*)"', 1), lambda h: replace(replace(url_encode(h), '%2F', '/'), '%2C', ',')) as paths from pages),
h as (select page_id, origin, title, unnest(paths) as path, generate_subscripts(paths, 1) as n from p), f as (select page_id, title, origin || path as link, min(n) as n from h group by 1, 2, 3)
select page_id, title, cast(null as varchar) as canonical, cast(row_number() over (partition by page_id order by n) - 1 as integer) as place, link from f""")
def html_link_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").select("page_id", web.terminated_links_udf("url", "html").alias("l"))
    return rows.select("page_id", F.col("l.title").alias("title"), F.col("l.canonical").alias("canonical"), F.posexplode("l.links").alias("place", "link"))


_NORMAL = r"""with u as (select page_id, lower(regexp_extract(url, '^([A-Za-z]+)://', 1)) as scheme, lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]+)', 1)) as host,
  regexp_extract(url, '^[A-Za-z]+://[^/?#]+([^?#]*)', 1) as path, regexp_extract(url, '\?([^#]*)', 1) as q from pages),
k as (select *, list_sort(list_filter(string_split(q, '&'), lambda p: p <> '' and not starts_with(lower(p), 'utm_') and not list_contains(['gclid','fbclid','mc_cid','mc_eid','yclid','msclkid','igshid','_hsenc','_hsmi','ref_src'], lower(string_split(p, '=')[1])))) as kept from u)
select page_id, scheme || '://' || case scheme when 'http' then regexp_replace(host, ':80$', '') else regexp_replace(host, ':443$', '') end
  || case when path = '' then '/' else path end || case when len(kept) > 0 then '?' || array_to_string(kept, '&') else '' end as url from k"""


@query(_NORMAL)
def url_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", urls.plain_normalised(F.col("url")).alias("url"))


@query(_NORMAL)
def url_normalize_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", urls.normalise_udf("url").alias("url"))


@query(r"""select page_id from pages where (starts_with(url, 'https://m.') or starts_with(url, 'http://blog.')) and not contains(url, '/de/')""")
def crawl_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").where(urls.allowed(F.col("url"), ["https://m.", "http://blog."], ["/de/"])).select("page_id")


@query("""with recursive e as (select p_partkey as a, (p_partkey * 7 + 3) % (select count(*) from part) + 1 as b from part union all select p_partkey, p_partkey // 2 from part where p_partkey > 1),
l1 as (select distinct b as url from e where a = 1 and b <> 1), v1 as (select 1 as url union select url from l1),
l2 as (select distinct b as url from e where a in (select url from l1) and b not in (select url from v1)), v2 as (select * from v1 union select * from l2),
l3 as (select distinct b as url from e where a in (select url from l2) and b not in (select url from v2))
select cast(1 as bigint) as page, 0 as depth union all select url, 1 from l1 union all select url, 2 from l2 union all select url, 3 from l3""")
def crawl_bfs_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("url"))
    n = part.count()
    edges = part.select("url", ((F.col("url") * 7 + 3) % n + 1).alias("link")).union(part.where("url > 1").select("url", F.floor(F.col("url") / 2).cast("long")))
    found, _ = web.crawl(edges, spark.createDataFrame([(1,)], "url long"), 3, 10_000)
    return found.select(F.col("url").alias("page"), "depth")


@query(r"""with c as (select page_id, url, regexp_replace(url, '[?#].*$', '') as canonical from pages)
select page_id, canonical as external_id from c qualify row_number() over (partition by canonical order by length(url), url, page_id) = 1""")
def canonical_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.regexp_replace("url", "[?#].*$", "").alias("canonical"), F.char_length("url").alias("depth"))
    place = F.row_number().over(Window.partitionBy("canonical", "url").orderBy("page_id"))
    once = web.canonical_once(pages.withColumn("n", place).where("n = 1").drop("n"))
    return once.select("page_id", "external_id")


@query(r"""with p as (select page_id, lower(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)) as host, regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) as path from pages),
r(prefix, allow) as (values ('/de/', false), ('/de/1', true), ('/', true), ('/fr/', false))
select page_id, coalesce((select arg_max(allow, length(prefix)) from r where starts_with(path, prefix)), true) as allowed from p""")
def robots_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", urls.host(F.col("url")).alias("host"), F.regexp_extract("url", "^[a-z]+://[^/?#]+([^?#]*)", 1).alias("path"))
    parsed = web.robots("User-agent: *\nDisallow: /de/\nAllow: /de/1\nAllow: /\nDisallow: /fr/\n", "loom")
    one = spark.createDataFrame(parsed, "prefix string, allow boolean")
    # a table of rules has a row for each host; here all hosts share one file of four rules
    rules = pages.select("host").distinct().crossJoin(F.broadcast(one))
    return web.robots_allowed(pages, rules).select("page_id", "allowed")


@query("""select page_id, case when page_id % 5 = 0 then 'out of scope' when page_id % 7 = 0 then 'not modified since' when page_id % 11 = 0 then 'robots' when page_id % 13 = 0 then 'unchanged'
 when page_id % 17 = 0 then 'failed' when page_id % 2 = 0 then 'unchanged' else 'changed' end as decision from pages""")
def fetch_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("page_id")
    at = lambda s: F.lit(s).cast("timestamp_ntz")
    body = F.sha2("html", 256)
    state = table(spark, sf_dir, "pages").select(
        i, (i % 5 != 0).alias("in_scope"), (i % 11 != 0).alias("robots_ok"), F.when(i % 7 == 0, at("2024-01-01")).alias("lastmod"), at("2024-02-01").alias("last_fetched_at"),
        F.when(i % 13 == 0, 304).when(i % 17 == 0, 500).otherwise(200).alias("status"), body.alias("body_hash"), F.when(i % 2 == 0, body).alias("known_hash"),
    )
    return state.select("page_id", web.fetch_decision(True).alias("decision"))


@query(f"""with n as ({_NORMAL}), a as (select url, case when page_id % 3 = 0 then timestamp '2024-01-01 00:00:00' + to_days(cast(page_id % 300 as integer)) end as lastmod, page_id % 2 as deeper, page_id // 500 as file, page_id from n)
select url, arg_min(struct_pack(t := lastmod), (deeper, file, page_id)).t as lastmod from a group by url""")
def sitemap_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages by the sitemaps that list them, which are made from the table: an index for odd and a set for even ids of each 500."""
    i = F.col("page_id")
    pages = table(spark, sf_dir, "pages").select(i, (i % 2 == 1).alias("odd"), F.floor(i / 500).alias("k"), F.replace("url", F.lit("&"), F.lit("&amp;")).alias("loc"))
    day = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (i % 300).cast("int")), "yyyy-MM-dd")
    entry = F.concat(F.lit("<url><loc>"), "loc", F.lit("</loc>"), F.when(i % 3 == 0, F.concat(F.lit("<lastmod>"), day, F.lit("</lastmod>"))).otherwise(F.lit("")), F.lit("</url>"))
    name = F.format_string("https://maps.test/%s/%08d.xml", F.when(F.col("odd"), F.lit("odd")).otherwise(F.lit("even")), F.col("k").cast("long"))
    # 250 entries a file
    sets = pages.groupBy(name.alias("url"), "odd").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_id", entry.alias("e")))), lambda x: x["e"]), "").alias("x"))
    sets = sets.select("url", "odd", F.encode(F.concat(F.lit("<urlset>"), "x", F.lit("</urlset>")), "utf-8").alias("body"))
    # an index for each file of odd ids
    lead = F.replace("url", F.lit("/odd/"), F.lit("/index/"))
    tops = sets.where("odd").select(lead.alias("url"), F.encode(F.concat(F.lit("<sitemapindex><sitemap><loc>"), "url", F.lit("</loc></sitemap></sitemapindex>")), "utf-8").alias("body"))
    files = sets.select("url", "body").union(tops)
    roots = sets.where("not odd").select("url").union(tops.select("url"))
    found = web.sitemap_urls(roots, lambda wanted: wanted.join(files, "url"), files=None, urls=None)
    return found.pages.select("url", F.to_utc_timestamp("lastmod", F.current_timezone()).cast("timestamp_ntz").alias("lastmod"))


@query(r"""with p as (select page_id, url, lower(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)) as host from pages),
t as (select *, row_number() over (partition by host order by url, page_id) - 1 as turn from p)
select page_id, host, turn, turn * case when starts_with(host, 'm.') then 2500 else 700 end as at_ms from t order by at_ms, host, url, page_id limit (select count(*) // 2 from pages)""")
def crawl_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The earlier half of the fetches of all pages, each host's spaced by its own delay."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", urls.host(F.col("url")).alias("host"))
    delays = pages.where("host like 'm.%'").select("host").distinct().withColumn("delay_ms", F.lit(2500))
    rows = web.scheduled(pages, delays, 700, order=("url", "page_id"), most=pages.count() // 2)
    return rows.select("page_id", "host", "turn", "at_ms")


@query("""select page_id, case when page_id % 13 = 0 then 'unchanged' when strlen(coalesce(html, '')) > 1500 then 'too large' when page_id % 17 = 0 then 'failed' else 'changed' end as decision from pages""")
def fetch_size_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, none = F.col("page_id"), F.lit(None)
    state = table(spark, sf_dir, "pages").select(
        i, F.lit(True).alias("in_scope"), F.lit(True).alias("robots_ok"), none.cast("timestamp_ntz").alias("lastmod"), none.cast("timestamp_ntz").alias("last_fetched_at"),
        F.when(i % 13 == 0, 304).when(i % 17 == 0, 500).otherwise(200).alias("status"), F.sha2("html", 256).alias("body_hash"), none.cast("string").alias("known_hash"), F.coalesce(F.octet_length("html"), F.lit(0)).alias("bytes"),
    )
    return state.select("page_id", web.fetch_decision(True, 1500).alias("decision"))
