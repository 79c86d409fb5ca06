"""Retrieval over the test tables: a chunk is a document, its embedding the vector of the same id."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from corpusloom.functions.times import utc
from corpusloom.functions import textquery
from corpusloom.functions.vector import cosine_distance, literal
from corpusloom.operators import evaluate, operations, retrieve
from corpusloom.operators import index as indexes
from corpusloom.plans.base import DataFrame, SparkSession, documents, query, table
from corpusloom.sources import shared


def texts(spark: SparkSession, sf_dir: str, docs: DataFrame | None = None) -> DataFrame:
    """chunk_id, source, uri, metadata, created_at, content."""
    return (table(spark, sf_dir, "documents") if docs is None else docs).select(
        F.col("doc_id").alias("chunk_id"),
        "source",
        F.concat(F.lit("https://"), "source", F.lit(".example.com/"), "lang", F.lit("/"), "doc_id").alias("uri"),
        F.to_json(F.struct("lang")).alias("metadata"),
        F.timestamp_add("DAY", F.pmod("doc_id", F.lit(365)), utc(datetime(2024, 1, 1))).alias("created_at"),
        F.col("text").alias("content"),
    )


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts with an embedding (those without one cannot be in the vector list)."""
    return texts(spark, sf_dir).join(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding"), "chunk_id")


def probe(spark: SparkSession, sf_dir: str, vec_id: int = 0) -> list[float]:
    """The query vector: that of a given id."""
    return list(table(spark, sf_dir, "embeddings").where(F.col("vec_id") == vec_id).first()["embedding"])


_OPEN: dict[str, indexes.Index] = {}


def index(spark: SparkSession, sf_dir: str) -> indexes.Index:
    """The index of the documents' texts and vectors, built when it is first asked for and after the tables' files change."""
    docs, vectors = table(spark, sf_dir, "documents"), table(spark, sf_dir, "embeddings")
    name = "index-" + shared.stamp([docs, vectors], "sixth form", indexes.BUCKETS)
    if (known := _OPEN.get(name)) is None or known.spark is not spark:
        own = texts(spark, sf_dir, documents(spark, sf_dir))
        folder = shared.built(spark, name, lambda path: indexes.build(own, vectors.select(F.col("vec_id").alias("chunk_id"), "embedding"), path, attributes=("source", "uri", "metadata", "created_at")))
        _OPEN[name] = known = indexes.Index(spark, folder)
    return known


#: Queries of a batch that are compared in one scan.
BLOCK = 2048


def asked(spark: SparkSession, sf_dir: str):
    """Blocks of (vec_id, vector) of the query set, every vector whose id is divisible by 100."""
    block = []
    for r in table(spark, sf_dir, "embeddings").where("vec_id % 100 = 0").select("vec_id", "embedding").toLocalIterator():
        block.append((r["vec_id"], list(r["embedding"])))
        if len(block) == BLOCK:
            yield block
            block = []
    yield block


def of_blocks(spark: SparkSession, sf_dir: str, run) -> DataFrame:
    """The union of ``run`` over the blocks."""
    out = None
    for block in asked(spark, sf_dir):
        part = run(block)
        out = part if out is None else out.union(part)
    return out


WORD = "the"
#: Words that the batch's queries take in turn.
WORDS = ("the", "of", "and", "les")
_CHUNKS = """chunks as (
  select d.doc_id as chunk_id, source, 'https://' || source || '.example.com/' || lang || '/' || doc_id as uri, lang,
         date '2024-01-01' + cast(doc_id % 365 as integer) as created_on, text as content, embedding
  from documents d left join embeddings e on e.vec_id = d.doc_id)"""
_DISTANCE = """1 - list_sum(list_transform(list_zip(cast(embedding as double[]), (select cast(embedding as double[]) from embeddings where vec_id = 0)), lambda p: p[1] * p[2]))
  / (sqrt(list_sum(list_transform(cast(embedding as double[]), lambda x: x * x))) * sqrt(list_sum(list_transform((select cast(embedding as double[]) from embeddings where vec_id = 0), lambda x: x * x))))"""


def _words(text: str = "content") -> str:
    return f"regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}]+')"


def _lists(where: str = "true", word: str = WORD) -> str:
    return f"""with {_CHUNKS}, kept as (select * from chunks where {where}),
v as (select chunk_id, row_number() over (order by distance, chunk_id) as r from
  (select chunk_id, {_DISTANCE} as distance from kept where embedding is not null) order by distance, chunk_id limit 40),
t as (select chunk_id, row_number() over (order by score desc, chunk_id) as r from
  (select chunk_id, len(list_filter({_words()}, lambda w: w = '{word}')) * 0.1::double as score from kept) where score > 0 order by score desc, chunk_id limit 40),
fused as (select chunk_id, sum(1.0::double / (60 + r)) as score from (select * from v union all select * from t) group by chunk_id order by 2 desc, 1 limit 8)
select f.chunk_id, round(f.score, 6) as score, k.source, k.uri from fused f join kept k using (chunk_id)"""


def _told(best: DataFrame) -> DataFrame:
    return best.select("chunk_id", F.round("score", 6).alias("score"), "source", "uri")


@query(f"""select vec_id, round({_DISTANCE}, 6) + 0.0 as distance, row_number() over (order by {_DISTANCE}, vec_id) as r from embeddings
order by {_DISTANCE}, vec_id limit 40""")
def vec_topk_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = retrieve.top_vector(table(spark, sf_dir, "embeddings"), probe(spark, sf_dir), 40, id="vec_id")
    return best.select("vec_id", (F.round("distance", 6) + 0.0).alias("distance"), F.col("r").cast("long").alias("r"))


_ASKED = """q as (select vec_id as query, cast(embedding as double[]) as v from embeddings where vec_id % 100 = 0),
s as (select query, vec_id, 1 - list_dot_product(v, cast(e.embedding as double[])) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(cast(e.embedding as double[]), cast(e.embedding as double[])))) as distance from q, embeddings e)"""


@query(f"""with {_ASKED}
select query, vec_id, round(distance, 6) + 0.0 as distance from s qualify row_number() over (partition by query order by distance, vec_id) <= 5""")
def vec_topk_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = of_blocks(spark, sf_dir, lambda block: retrieve.top_vector_batch(table(spark, sf_dir, "embeddings"), block, 5, id="vec_id"))
    return best.select("query", "vec_id", (F.round("distance", 6) + 0.0).alias("distance"))


@query("""select count(*) as queries, true as enough from embeddings where vec_id % 100 = 0""")
def ivf_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of the exact ten nearest the inverted file finds, over the whole query set: at least nine in ten."""
    exact = of_blocks(spark, sf_dir, lambda block: retrieve.top_vector_batch(table(spark, sf_dir, "embeddings"), block, 10, id="vec_id"))
    own = index(spark, sf_dir)
    found = of_blocks(spark, sf_dir, lambda block: own.top_vector_batch(block, 10)).select("query", F.col("chunk_id").alias("vec_id"), F.lit(True).alias("hit"))
    rows = exact.join(found, ["query", "vec_id"], "left")
    return rows.agg(F.countDistinct("query").alias("queries"), (F.count("hit") >= 0.9 * F.count("*")).alias("enough"))


_BATCH = f"""{_ASKED}, w as (select query, ['the', 'of', 'and', 'les'][1 + (query // 100) % 4] as word from q),
v as (select query, vec_id as chunk_id, row_number() over (partition by query order by distance, vec_id) as r from s qualify r <= 40),
words as (select doc_id, {_words('text')} as ws from documents),
t as (select query, doc_id as chunk_id, row_number() over (partition by query order by len(list_filter(ws, lambda x: x = word)) desc, doc_id) as r from w join words on list_contains(ws, word) qualify r <= 40),
f as (select query, chunk_id, sum(1.0::double / (60 + r)) as score from (select * from v union all select * from t) group by 1, 2),
best as (select query, chunk_id, round(score, 6) as score, row_number() over (partition by query order by score desc, chunk_id) as r from f qualify r <= 8)"""


def batch(spark: SparkSession, sf_dir: str, blank: int = 0) -> DataFrame:
    """Hybrid retrieval for the query set; each ``blank``-th text is left blank."""
    own, vectors = index(spark, sf_dir), table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")

    def run(block: list) -> DataFrame:
        told = [(q, WORDS[q // 100 % 4], v) for q, v in block if not blank or q // 100 % blank]
        return indexes.hybrid_batch(own, told, vectors)

    return of_blocks(spark, sf_dir, run)


@query(f"with {_BATCH} select query, chunk_id, score, r from best")
def hybrid_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch(spark, sf_dir).select("query", "chunk_id", F.round("score", 6).alias("score"), F.col("r").cast("long").alias("r"))


@query(f"""with {_BATCH}, g as (select query, list(chunk_id order by r) as retrieved from best where (query // 100) % 5 <> 0 group by query),
cases as (select query as case_id, (query // 100) % 5 = 0 as blank, case when (query // 100) % 3 = 0 then [] else [query, query + 1] end as expected from q)
select case_id, case when blank or len(expected) = 0 then null else list_has_any(expected, retrieved) end as recall_hit, array_to_string(coalesce(retrieved, []), ',') as retrieved,
case when blank then 'the question is blank' end as error from cases left join g on query = case_id""")
def eval_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("vec_id")
    expected = F.when(F.floor(i / 100) % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(i, i + 1).cast("array<string>"))
    word = F.element_at(F.array(*map(F.lit, WORDS)), (F.floor(i / 100) % 4 + 1).cast("int"))
    question = F.when(F.floor(i / 100) % 5 == 0, F.lit(" ")).otherwise(word)
    cases = table(spark, sf_dir, "embeddings").where("vec_id % 100 = 0").select(i.alias("case_id"), question.alias("question"), expected.alias("expected"))
    found = batch(spark, sf_dir, 5).select(F.col("query").alias("case_id"), "r", F.col("chunk_id").cast("string").alias("document_id"))
    rows = evaluate.run(cases, found)
    return rows.select("case_id", "recall_hit", F.array_join("retrieved", ",").alias("retrieved"), "error")


@query(f"""select doc_id, round(score, 6) as score, row_number() over (order by score desc, doc_id) as r from
(select doc_id, len(list_filter({_words('text')}, lambda w: w = '{WORD}')) * 0.1::double as score from documents) where score > 0 order by score desc, doc_id limit 40""")
def text_topk_tf(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = index(spark, sf_dir).top_text(WORD, 40).withColumnRenamed("chunk_id", "doc_id")
    return best.select("doc_id", F.round("score", 6).alias("score"), F.col("r").cast("long").alias("r"))


@query(f"""with w as (select doc_id, ' ' || array_to_string({_words('text')}, ' ') || ' ' as s from documents)
select doc_id from w where (contains(s, ' the ') and contains(s, ' of the ') and not contains(s, ' with ')) or contains(s, ' les ')""")
def websearch_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = textquery.parse('the "of the" -with OR les')
    return documents(spark, sf_dir).where(q.matches(F.col("text"))).select("doc_id")


@query()
def text_cover_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = index(spark, sf_dir).top_text('the "of the" that OR les', 40).withColumnRenamed("chunk_id", "doc_id")
    return best.select("doc_id", F.round("score", 6).alias("score"), "r")


@query(f"""with w as (select doc_id, unnest({_words('text')}) as word, generate_subscripts({_words('text')}, 1) as place from documents),
e as (select doc_id, word, place, lag(word) over o as before, place - lag(place) over o as gap from w where word in ('the', 'of') window o as (partition by doc_id order by place)),
s as (select doc_id, sum(0.1::double / gap) as score from e where before <> word group by 1)
select doc_id, round(score, 6) as score, row_number() over (order by score desc, doc_id) as r from s order by score desc, doc_id limit 40""")
def text_cover_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cover density of two words: each neighbouring pair of different ones is a minimal cover."""
    best = index(spark, sf_dir).top_text("the of", 40)
    return best.select(F.col("chunk_id").alias("doc_id"), F.round("score", 6).alias("score"), F.col("r").cast("long").alias("r"))


FILTERS = retrieve.Filters(["src0", "src1", "src2", "src3"], "https://src", datetime(2024, 1, 5), datetime(2024, 11, 30), {"lang": "en"})


@query(_lists())
def hybrid_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _told(retrieve.hybrid(texts(spark, sf_dir), probe(spark, sf_dir), WORD, index=index(spark, sf_dir)))


@query(_lists("source in ('src0', 'src1', 'src2', 'src3') and lang = 'en' and starts_with(uri, 'https://src') and created_on >= date '2024-01-05' and created_on <= date '2024-11-30'"))
def hybrid_rrf_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _told(retrieve.hybrid(texts(spark, sf_dir), probe(spark, sf_dir), WORD, FILTERS, index=index(spark, sf_dir)))


@query()
def hybrid_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What searches with the share that the index proposes find of the exact ten nearest, over the whole query set, without filters
    and with: recall, and the part of the lists that a query reads."""
    own, out = index(spark, sf_dir), None
    asked = table(spark, sf_dir, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("vector"))
    total = int((own.sizes > 0).sum())
    for name, where in (("none", F.col("held")), ("all", F.col("held") & FILTERS.condition())):
        exact = own.search_batch(asked, 10, where)[0].select("query", "chunk_id")
        found, read = own.search_batch(asked, 10, where, own.share)
        hits = exact.join(found.select("query", "chunk_id", F.lit(True).alias("hit")), ["query", "chunk_id"], "left").agg(F.count("*").alias("wanted"), F.count("hit").alias("found"))
        row = hits.crossJoin(read.agg(F.countDistinct("query").alias("queries"), F.count("*").alias("lists")))  # frames of one row
        row = row.select(F.lit(name).alias("filters"), "queries", "wanted", "found", F.try_divide("found", "wanted").alias("recall"), F.try_divide("lists", F.col("queries") * total).alias("read"))
        out = row if out is None else out.union(row)
    return out


@query("""select vec_id, round(1.0::double / (60 + r), 6) as score from (select vec_id, row_number() over (order by vec_id) as r from embeddings) where r <= 10""")
def rrf_single_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    some = retrieve.ranked(table(spark, sf_dir, "embeddings").select("vec_id"), 10, F.col("vec_id"))
    return retrieve.fused([some], 10, "vec_id").select("vec_id", F.round("score", 6).alias("score"))


def versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(documents with their current version, versions): a document is a (source, lang), its versions its rows."""
    docs = table(spark, sf_dir, "documents")
    all_ = docs.select(F.concat_ws("/", "source", "lang").alias("document_id"), F.col("doc_id").alias("version_id"), "text")
    status = F.when(F.substring_index("document_id", "/", -1) == "es", "deleted").otherwise("active")
    return all_.groupBy("document_id").agg(F.max("version_id").alias("current_version")).withColumn("status", status), all_


@query("""with c as (select source || '/' || lang as document_id, max(doc_id) as v from documents where lang <> 'es' group by 1)
select d.doc_id as version_id, source || '/' || lang as document_id from documents d where doc_id in (select v from c)""")
def live_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, all_ = versions(spark, sf_dir)
    return retrieve.live(all_, documents).select("version_id", "document_id")


@query("""select doc_id from documents where starts_with('https://' || source || '.example.com/' || lang || '/' || doc_id, 'https://src1.example.com/en/')""")
def uri_prefix_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark, sf_dir).where(retrieve.Filters(uri_prefix="https://src1.example.com/en/").condition()).select(F.col("chunk_id").alias("doc_id"))


@query("""select event_id from events where json_extract_string(props, '$.k') = '3'""")
def json_tag_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").where(retrieve.Filters(tags={"k": "3"}).condition(metadata="props")).select("event_id")


@query("""select doc_id, source from documents where contains(lower(text), 'erthe') or contains(lower(source), 'src1')""")
def title_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    has = lambda c, q: F.contains(F.lower(c), F.lit(q))
    return docs.where(has(F.col("text"), "erthe") | has(F.col("source"), "src1")).select("doc_id", "source")


@query("""select source, doc_id from documents where source < 'src5' or (source = 'src5' and doc_id < 500) order by source desc, doc_id desc limit 21""")
def keyset_page_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return operations.keyset(table(spark, sf_dir, "documents").select("source", "doc_id"), ["source", "doc_id"], ("src5", 500), 20)


@query("""select event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') as at from events where ts < timestamp '2024-01-20 00:00:00' order by ts desc, event_id desc limit 51""")
def keyset_page_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("ts", "event_id")
    page = operations.keyset(rows, ["ts", "event_id"], (datetime(2024, 1, 20), 0), operations.page_size(None))
    return page.select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"))


@query("""select doc_id from (select doc_id, row_number() over (order by doc_id) as n from documents) where n > 40 and n <= 60""")
def offset_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return operations.page_range(table(spark, sf_dir, "documents").select("doc_id"), [F.col("doc_id")], 2)


@query("""with d as (select source || '/' || lang as document_id, max(doc_id) filter (where doc_id % 3 <> 0) as v from documents group by 1)
select d.document_id, d.v as current_version, cast(length(t.text) as bigint) as chars from d left join documents t on t.doc_id = d.v""")
def doc_version_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    own = docs.groupBy(F.concat_ws("/", "source", "lang").alias("document_id")).agg(F.max(F.when(F.col("doc_id") % 3 != 0, F.col("doc_id"))).alias("current_version"))
    texts = docs.select(F.col("doc_id").alias("current_version"), F.char_length("text").cast("long").alias("chars"))
    return own.join(texts, "current_version", "left").select("document_id", "current_version", "chars")


@query("""select d.doc_id as query_id, case l.quality when 1 then 1 when 0 then -1 end as rating from documents d left join labels l using (doc_id)
order by d.doc_id desc limit 51""")
def querylog_feedback_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    logged = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("query_id"))
    rating = F.when(F.col("quality") == 1, 1).when(F.col("quality") == 0, -1)
    feedback = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("query_id"), rating.alias("rating"))
    page = operations.keyset(logged, ["query_id"], None, 50)
    return page.join(feedback, "query_id", "left").select("query_id", "rating")


@query("""select source, max(doc_id) filter (where lang = 'fr') as latest from documents group by source having max(doc_id) filter (where lang = 'fr') is not null""")
def latest_by_json_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = texts(spark, sf_dir).where(F.get_json_object("metadata", "$.lang") == "fr")
    return rows.groupBy("source").agg(F.max("chunk_id").alias("latest"))


_RERANK = """with f as (select vec_id, row_number() over (order by distance, vec_id) as r from (select vec_id, {} as distance from embeddings) qualify r <= 60),
s as (select vec_id, cast((vec_id * 37) % 11 as double) as score from f where vec_id % 4 <> 0)
select vec_id, row_number() over (order by case when r > 20 then 2 when score is null then 1 else 0 end, case when r <= 20 then -score end nulls first, r) as new_r from f left join s using (vec_id)"""


@query(_RERANK.format(_DISTANCE))
def rerank_reorder(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = retrieve.top_vector(table(spark, sf_dir, "embeddings"), probe(spark, sf_dir), 60, id="vec_id")
    scores = first.where("vec_id % 4 <> 0").select("vec_id", ((F.col("vec_id") * 37) % 11).cast("double").alias("rerank_score"))
    return retrieve.reranked(first, scores, 20, "vec_id").select("vec_id", F.col("new_r").cast("long").alias("new_r"))


@query(f"""with q as (select list_distinct({_words("'the house of the rising sun'")}) as w)
select doc_id, round(len(list_intersect(list_distinct({_words('text')}), w)) / cast(len(w) as double), 6) as rerank_score from documents, q""")
def lexical_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = retrieve.lexical_scores(documents(spark, sf_dir), "the house of the rising sun", "doc_id", "text")
    return rows.select("doc_id", F.round("rerank_score", 6).alias("rerank_score"))


@query(f"""select count(*) as n, round(avg({_DISTANCE}), 6) as mean_distance from embeddings""")
def vector_distance_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(cosine_distance(F.col("embedding"), literal(probe(spark, sf_dir))).alias("d"))
    return rows.agg(F.count("*").alias("n"), F.round(F.avg("d"), 6).alias("mean_distance"))
