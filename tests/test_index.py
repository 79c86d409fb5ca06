"""Postings against texts, the inverted file against all vectors, batches against single queries."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.functions import textquery
from corpusloom.operators import index as indexes
from corpusloom.operators import evaluate, retrieve


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    draw = random.Random(0)
    texts = [" ".join(draw.choice(["Rye", "oat", "of", "the", "mill", "Flax"]) + draw.choice(["", "", ",", "."]) for _ in range(draw.randrange(25))) for _ in range(120)] + [None, "", "Été of the oat"]
    vectors = np.random.default_rng(0).normal(size=(len(texts), 8)) + np.repeat(np.eye(8) * 4, 16, 0)[: len(texts)]
    rows = [(k, t, [float(x) for x in v]) for k, (t, v) in enumerate(zip(texts, vectors, strict=True))] + [(900, "rye", None), (901, "rye", [0.0] * 8), (902, "rye", [1.0])]
    chunks = spark.createDataFrame(rows, "chunk_id long, content string, embedding array<float>").cache()
    folder = f"file://{tmp_path_factory.mktemp('index')}/one"
    indexes.build(chunks, chunks, folder)
    return chunks, indexes.Index(spark, folder)


@pytest.mark.parametrize("query", ["rye", "the oat", '"of the" -flax', 'mill OR "rye oat"', "absent", "x-200 OR été", "-rye"])
def test_postings_rank_as_texts_do(corpus, query):
    chunks, index = corpus
    key = lambda df: [(r["chunk_id"], round(r["score"], 9), r["r"]) for r in df.orderBy("r").collect()]
    if textquery.parse(query).empty:
        assert retrieve.top_text(chunks, query).count() == 0
    else:
        assert key(index.top_text(query)) == key(retrieve.top_text(chunks, query))


def test_postings_of_some_documents(corpus):
    chunks, index = corpus
    some = chunks.where("chunk_id % 3 = 0")
    assert [r["chunk_id"] for r in index.top_text("rye", 5, some).collect()] == [r["chunk_id"] for r in retrieve.top_text(some, "rye", 5).collect()]


def test_the_best_of_a_common_word_are_few_blocks(spark, tmp_path):
    """60,000 documents have the word, a few of them often; only the pages of the highest levels are read."""
    often = F.when(F.col("id") % 3000 == 7, 40 + F.col("id") % 5).otherwise(1 + F.col("id") % 3)
    docs = spark.range(60_000).select(F.col("id").alias("chunk_id"), F.concat(F.repeat(F.lit("rye "), often.cast("int")), F.lit("oat")).alias("content"), F.lit(None).cast("array<float>").alias("embedding"))
    indexes.build(docs, docs.select("chunk_id", "embedding"), f"file://{tmp_path}/i")
    index = indexes.Index(spark, f"file://{tmp_path}/i")
    want = sorted(((k, 40 + k % 5) for k in range(7, 60_000, 3000)), key=lambda x: (-x[1], x[0]))
    assert [(r["chunk_id"], round(r["score"] * 10)) for r in index.top_text("rye", 10).orderBy("r").collect()] == want[:10]
    (level, rows), *rest = index.levels("rye")
    assert (level, rows) == (5, 20) and sum(n for _, n in rest) == 59_980
    scan = index.of_levels("rye", level, level)
    assert scan.count() == 20
    few, every = (_scanned(index.of_levels("rye", low, 5)) for low in (5, 0))
    assert every == 60_000 and few <= 0.1 * every
    # where few pass the filter, lower levels follow
    within = docs.where("chunk_id % 3000 = 8 or chunk_id = 7")
    found = [r["chunk_id"] for r in index.top_text("rye", 5, within).orderBy("r").collect()]
    assert found == [r["chunk_id"] for r in retrieve.top_text(within, "rye", 5).orderBy("r").collect()] and len(found) == 5


def test_a_text_of_many_queries_is_ranked_once(corpus, monkeypatch):
    chunks, index = corpus
    asked = [(r["chunk_id"], ("rye", "oat")[r["chunk_id"] % 2], list(r["embedding"])) for r in chunks.where("chunk_id < 10").collect()]
    ranked = []
    real = indexes.Index.scores
    monkeypatch.setattr(indexes.Index, "scores", lambda self, queries: (ranked.append(sorted(queries.values())), real(self, queries))[1])
    got = {q: [r["chunk_id"] for r in rows] for q, rows in _by_query(indexes.hybrid_batch(index, asked, chunks)).items()}
    assert ranked == [["oat", "rye"]]
    one = {q: [r["chunk_id"] for r in rows] for own in asked[:2] for q, rows in _by_query(indexes.hybrid_batch(index, [own], chunks)).items()}
    assert one == {q: got[q] for q in one} and len(got) == 10


def _by_query(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query"], r["r"])):
        out.setdefault(r["query"], []).append(r)
    return out


def test_postings_of_long_documents_come_in_slices(spark):
    """A document of more words than a slice, and others after it: all postings, and batches of a slice at most."""
    rows = spark.range(6).selectExpr("id as chunk_id", "concat(repeat('oat rye ', 150000), 'w', id) as content").coalesce(1)
    got = {(r["lexeme"], r["chunk_id"]): r["n"] for r in indexes.postings(rows, "chunk_id", "content").selectExpr("lexeme", "chunk_id", "size(places) as n").collect()}
    assert got == {(w, k): n for k in range(6) for w, n in (("oat", 150000), ("rye", 150000), (f"w{k}", 1))}


def test_a_task_keeps_only_the_nearest(spark):
    """Of a partition of several slices, with equal vectors in different ones, a task gives k rows for each query."""
    rows = spark.range(3000).selectExpr("id", "array(cast(cos(id % 700) as float), cast(sin(id % 700) as float)) as v").coalesce(1)
    asked = [(q, [float(np.cos(q)), float(np.sin(q))]) for q in (5, 90)]
    found = retrieve.top_vector_batch(rows, asked, 3, "id", "v")
    assert {q: [r["id"] for r in x] for q, x in _by_query(found).items()} == {5: [5, 705, 1405], 90: [90, 790, 1490]}


def _scanned(df):
    """Rows that the scan of a query without exchanges gave."""
    plan = df._jdf.queryExecution().executedPlan()
    plan.executeCollect()
    while plan.children().nonEmpty():
        plan = plan.children().head()
    return plan.metrics().apply("numOutputRows").value()


def test_the_inverted_file(corpus):
    chunks, index = corpus
    asked = [(r["chunk_id"], list(r["embedding"])) for r in chunks.where("chunk_id < 40").collect()]
    exact = {(r["query"], r["chunk_id"]) for r in retrieve.top_vector_batch(chunks, asked, 10).collect()}
    found = {(r["query"], r["chunk_id"]) for r in index.top_vector_batch(asked, 10).collect()}
    assert len(exact & found) >= 0.9 * len(exact)
    every = {(r["query"], r["chunk_id"]) for r in index.top_vector_batch(asked, 10, probes=len(index.centres)).collect()}
    assert every == exact
    one = [r["chunk_id"] for r in index.top_vector(asked[0][1], 10, probes=len(index.centres)).orderBy("r").collect()]
    assert one == [r["chunk_id"] for r in retrieve.top_vector(chunks, asked[0][1], 10).orderBy("r").collect()]


def test_a_batch_is_many_single_queries(corpus):
    chunks, index = corpus
    vectors = {r["chunk_id"]: list(r["embedding"]) for r in chunks.where("chunk_id in (3, 50, 77)").collect()}
    asked = [(3, "rye", vectors[3]), (50, '"of the" OR mill', vectors[50]), (77, " ", vectors[77])]
    got = {}
    for r in indexes.hybrid_batch(index, asked, chunks).collect():
        got.setdefault(r["query"], {})[r["chunk_id"]] = pytest.approx(r["score"])
    for q, text, v in asked[:2]:
        assert {r["chunk_id"]: r["score"] for r in retrieve.hybrid(chunks, v, text).collect()} == got[q]
        assert {r["chunk_id"] for r in retrieve.hybrid(chunks, v, text, index=index).collect()} == set(got[q])
    assert len(got[77]) == 8  # no text: by vector alone


@pytest.fixture(scope="module")
def clustered(spark, tmp_path_factory):
    """Vectors in clusters of different width, with attributes; two of them have no document."""
    draw = np.random.default_rng(1)
    rows = []
    for k in range(1200):
        own = k % 12
        v = np.eye(16)[own] * 3 + draw.normal(size=16) * (0.1 + 0.01 * own)
        rows.append((k, "rye" if k % 3 else "oat", f"s{k % 7}", [float(x) for x in v]))
    table = spark.createDataFrame(rows, "chunk_id long, content string, source string, embedding array<float>").cache()
    folder = f"file://{tmp_path_factory.mktemp('index')}/two"
    indexes.build(table.where("chunk_id not in (12, 24)"), table, folder, attributes=("source",))
    return table, indexes.Index(spark, folder)


@pytest.mark.parametrize("where", [None, "source = 's3'", "source = 's3' and chunk_id % 12 = 5", "source = 'absent'", "held"])
def test_bounded_search_is_exact(clustered, where):
    table, index = clustered
    told = table.withColumn("held", ~F.col("chunk_id").isin(12, 24)).withColumn("source", F.when(F.col("held"), F.col("source")))
    asked = {r["chunk_id"]: list(r["embedding"]) for r in table.where("chunk_id in (0, 5, 500)").collect()} | {-1: [1.0] * 16}
    kept = told if where is None else told.where(where)
    want = {q: [(r["chunk_id"], r["r"]) for r in retrieve.top_vector(kept, v, 10).orderBy("r").collect()] for q, v in asked.items()}
    for q in (0, -1):
        found, read = index.search(asked[q], 10, F.expr(where) if where else None)
        assert [(r["chunk_id"], r["r"]) for r in found.orderBy("r").collect()] == want[q]
        assert len(read) == len(set(read))
        if q == 0 and where in (None, "held"):
            assert len(read) < (index.sizes > 0).sum() / 2
    table_of = table.sparkSession.createDataFrame([*asked.items(), (7, None), (8, [0.0] * 16), (9, [1.0])], "query long, vector array<float>")
    found, read = index.search_batch(table_of, 10, F.expr(where) if where else None)
    got = {}
    for r in found.orderBy("query", "r").collect():
        got.setdefault(r["query"], []).append((r["chunk_id"], r["r"]))
    assert got == {q: w for q, w in want.items() if w}
    assert read.count() == read.distinct().count()


def test_a_batch_in_blocks(clustered, monkeypatch):
    table, index = clustered
    queries = table.where("chunk_id % 20 = 0").select(F.col("chunk_id").alias("query"), F.col("embedding").alias("vector"))
    key = lambda found: sorted((r["query"], r["chunk_id"], r["r"]) for r in found[0].collect())
    whole = key(index.search_batch(queries, 5))
    monkeypatch.setattr(indexes, "TASK_ROWS", 20)
    monkeypatch.setattr(indexes, "TASK_QUERIES", 3)
    assert key(index.search_batch(queries, 5)) == whole and len(whole) == 300


def test_a_smaller_share_reads_fewer_lists(clustered):
    table, index = clustered
    queries = table.where("chunk_id % 20 = 0").select(F.col("chunk_id").alias("query"), F.col("embedding").alias("vector"))
    exact, read = index.search_batch(queries, 10)
    found, fewer = index.search_batch(queries, 10, share=index.share)
    hits = exact.join(found, ["query", "chunk_id"], "left_semi").count()
    assert hits >= 0.9 * exact.count() and fewer.count() <= read.count()


def test_only_the_lists_of_a_search_are_scanned(clustered, monkeypatch):
    table, index = clustered
    seen = []
    real = retrieve.top_vector
    monkeypatch.setattr(retrieve, "top_vector", lambda df, *a: (seen.append(df), real(df, *a))[1])
    index.search([1.0] + [0.0] * 15, 10, F.col("source") == "s1")
    for df in seen:
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [isnotnull(list" in plan or "PartitionFilters: [list" in plan
        assert "EqualTo(source,s1)" in plan


def test_hybrid_of_the_index_is_hybrid_of_the_chunks(clustered):
    table, index = clustered
    own = table.where("chunk_id not in (12, 24)")
    v = list(table.where("chunk_id = 14").first()["embedding"])
    for filters in (None, retrieve.Filters(sources=["s2", "s4"])):
        key = lambda df: [(r["chunk_id"], round(r["score"], 9)) for r in df.collect()]
        assert key(retrieve.hybrid(own, v, "oat", filters, index=index)) == key(retrieve.hybrid(own, v, "oat", filters))


def test_one_bad_case_never_stops_a_run(spark):
    cases = spark.createDataFrame([(1, "q", ["a"]), (2, " ", ["a"]), (3, None, None), (4, "q", []), (5, "q", ["z"])], "case_id long, question string, expected array<string>")
    found = spark.createDataFrame([(1, 2, "a"), (1, 1, "b"), (1, 3, "a"), (4, 1, "a")], "case_id long, r int, document_id string")
    got = {r["case_id"]: (r["retrieved"], r["recall_hit"], r["error"] is None) for r in evaluate.run(cases, found).collect()}
    assert got == {1: (["b", "a"], True, True), 2: ([], None, False), 3: ([], None, False), 4: (["a"], None, True), 5: ([], False, True)}


def test_empty_tables(spark, tmp_path):
    none = spark.createDataFrame([], "chunk_id long, content string, embedding array<float>")
    indexes.build(none, none, f"file://{tmp_path}/none")
    assert spark.read.text(f"file://{tmp_path}/none/meta").count() == 1
    assert indexes.centres(np.zeros((0, 1)), 4).shape == (0, 1) and F.lit(1) is not None
