from datetime import datetime

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import textquery
from corpusloom.functions.vector import cosine_distance, parse, render
from corpusloom.operators import retrieve

ROWS = [
    (1, "docs", "https://manual.loomworks.test/k7", '{"group":"weavers"}', "Ways to restart the K7 loom", [1.0] + [0.0] * 7),
    (2, "docs", "https://manual.loomworks.test/faults", '{"group":"smiths"}', "K7 list of fault lamps", [0.9, 0.1] + [0.0] * 6),
    (3, "shop", "https://store.loomworks.test/bread", '{"group":"bakers"}', "Rye bread baking plan", [0.0] * 7 + [1.0]),
]


@pytest.fixture(scope="module")
def chunks(spark):
    df = spark.createDataFrame(ROWS, "chunk_id long, source string, uri string, metadata string, content string, embedding array<float>")
    return df.withColumn("created_at", F.lit("2024-05-01").cast("timestamp_ntz")).cache()


def ids(chunks, **filters):
    got = retrieve.hybrid(chunks, [1.0] + [0.0] * 7, "K7 restart", retrieve.Filters(**filters)).collect()
    return [r["chunk_id"] for r in got], got


def test_golden_set(chunks):
    order, rows = ids(chunks)
    assert order[0] == 1 and rows[0]["score"] == pytest.approx(2 / 61)
    assert ids(chunks, sources=["shop"])[0] == [3]
    assert ids(chunks, sources=[])[0] == order
    assert sorted(ids(chunks, uri_prefix="https://manual.loomworks.test/")[0]) == [1, 2]
    assert ids(chunks, uri_prefix="https://manual.loomworks.test/%")[0] == []
    assert ids(chunks, tags={"group": "weavers"})[0] == [1]
    assert ids(chunks, tags={"group": ["weavers"]})[0] == [] and ids(chunks, tags={"group": "weavers", "n": 1})[0] == []
    assert ids(chunks, since=datetime(2030, 1, 1))[0] == []
    assert ids(chunks, since=datetime(2024, 5, 1), until=datetime(2024, 5, 1))[0] == order
    with pytest.raises(ValueError):
        retrieve.hybrid(chunks, [1.0], " ")


def test_deleted_documents_are_gone(spark, chunks):
    documents = spark.createDataFrame([(1, "deleted"), (2, "active"), (3, "active")], "current_version long, status string")
    assert 1 not in ids(retrieve.live(chunks.withColumn("version_id", F.col("chunk_id")), documents))[0]


def test_fusion(spark):
    lists = [spark.createDataFrame(rows, "chunk_id long, r int") for rows in ([(1, 1), (2, 2)], [(1, 5)])]
    got = {r["chunk_id"]: r["score"] for r in retrieve.fused(lists).collect()}
    assert got == {1: pytest.approx(1 / 61 + 1 / 65), 2: pytest.approx(1 / 62)}


def test_distances_of_odd_vectors(spark):
    rows = [([1.0, 0.0], [0.0, 2.0]), ([0.0, 0.0], [1.0, 0.0]), ([1.0], [1.0, 0.0]), (None, [1.0])]
    df = spark.createDataFrame(rows, "a array<float>, b array<float>")
    assert [r[0] for r in df.select(cosine_distance(F.col("a"), F.col("b"))).collect()] == [1.0, None, None, None]
    one = spark.createDataFrame([("[1, 2.5]",)], "s string").select(render(parse(F.col("s")))).first()[0]
    assert one == "[1.0,2.5]"


def test_batch_agrees_with_single_queries(spark):
    from corpusloom.sources.tables import table

    vectors = table(spark, "/root/testdata/sf0.001", "embeddings").repartition(3)
    asked = [(r["vec_id"], list(r["embedding"])) for r in vectors.where("vec_id < 4").collect()]
    batch = retrieve.top_vector_batch(vectors, asked, 5, id="vec_id").collect()
    for q, v in asked:
        single = {r["vec_id"]: r["r"] for r in retrieve.top_vector(vectors, v, 5, id="vec_id").collect()}
        assert {r["vec_id"]: r["r"] for r in batch if r["query"] == q} == single


@pytest.mark.parametrize(
    ("query", "text", "matches", "rank"),
    [
        ("cat", "Cat cat dog", True, 0.2),
        ("cat dog", "cat and dog", True, 0.1 / 2),
        ("cat dog", "cat dog x x dog cat", True, 0.2),
        ('"big cat"', "the big cat", True, 0.1),
        ('"big cat"', "cat big", False, 0.0),
        ("cat -dog", "cat dog", False, 0.0),
        ("cat OR dog", "a dog", True, 0.1),
        ("", "anything", False, 0.0),
        ("-cat", "dog", False, 0.0),
        ("x-200", "the X 200", True, 0.1),
    ],
)
def test_text_queries(spark, query, text, matches, rank):
    q = textquery.parse(query)
    df = spark.createDataFrame([(text,)], "t string")
    row = df.select(q.matches(F.col("t")).alias("m"), q.rank(F.col("t")).alias("r")).first()
    assert row["m"] is matches and row["r"] == pytest.approx(rank)


def test_covers_are_added_one_by_one():
    """Ten covers of 0.1 as a sum of doubles in SQL has them, not 1.0, so that near ties rank alike."""
    assert textquery.parse("the of").cover_density("the of " * 5 + "the") == 0.9999999999999999


def test_reranking(spark):
    rows = spark.createDataFrame([(k, k) for k in range(1, 7)], "chunk_id long, r int")
    scores = spark.createDataFrame([(1, 0.1), (3, 0.9), (3, 0.2), (6, 5.0), (99, 1.0)], "chunk_id long, rerank_score double")
    got = [r["chunk_id"] for r in retrieve.reranked(rows, scores, 4).orderBy("new_r").collect()]
    assert got == [3, 1, 2, 4, 5, 6]


def test_ranking_of_a_model():
    assert [k for k, _ in retrieve.ranking_scores("Sure: [3, 1, 3, 9, 0, true] done", 4)] == [2, 0]
    scores = [s for _, s in retrieve.ranking_scores('[{"id": 2, "score": 0.5}, {"id": 1, "score": 0.9}]', 2)]
    assert scores[0] > scores[1]
    assert retrieve.ranking_scores("none [1, 2", 3) == []


def test_json_containment():
    outer = {"a": 1, "b": [1, {"c": 2}], "d": {"e": [1, 2, 3]}}
    assert retrieve.contains_json(outer, {"b": [{"c": 2}], "d": {"e": [3, 1]}})
    assert not retrieve.contains_json(outer, {"a": 2}) and not retrieve.contains_json([1], {"a": 1})
    assert retrieve.contains_json([1, 2], 2)


def test_nested_tags(spark):
    rows = spark.createDataFrame([(1, '{"a":{"b":[1,2]},"n":3}'), (2, '{"a":{"b":[2]}}'), (3, "junk"), (4, None)], "id long, metadata string")
    got = lambda **tags: [r["id"] for r in rows.where(retrieve.Filters(tags=tags).condition()).orderBy("id").collect()]
    assert got(a={"b": [2]}) == [1, 2] and got(a={"b": [1]}, n=3) == [1]


def test_final_k():
    assert [retrieve.final_k(a, s) for a, s in ((None, None), (0, 5), (7, 5), (1000, 5), (-1, None))] == [8, 5, 7, 100, 8]
