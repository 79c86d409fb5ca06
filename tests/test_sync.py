"""Whole syncs and reindexes over a store: failures of single documents, deletions, restarts."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import sync
from corpusloom.sources.tablestore import TableStore
from corpusloom.streaming import state


def embed(texts):
    if any("poison" in t for t in texts):
        raise RuntimeError("the provider refuses")
    return [[float(len(t))] for t in texts]


def put(store, spark, rows, day, **more):
    frame = spark.createDataFrame([(i, m, t) for i, m, t in rows], "external_id string, mime string, data string").repartition(8, "external_id")
    return sync.synced(store, frame, embed, sync.Run("s", "m", datetime(2024, 1, day), **more)).first()


def told(store):
    docs = store.read("documents").collect()
    versions = {r["version_id"]: r["markdown"] for r in store.read("versions").collect()}
    return {r["external_id"]: (r["status"], versions.get(r["current_version"])) for r in docs}


def test_a_sync_survives_bad_documents(spark, tmp_path):
    store = TableStore(spark, f"file://{tmp_path}/store")
    text = "text/plain"
    first = put(store, spark, [("a", text, "one"), ("b", text, "two"), ("c", "x/y", "?"), ("d", "text/markdown", "# T\n\nrye")], 1)
    assert (first["docs_seen"], first["docs_changed"], first["docs_failed"], first["chunks_embedded"], first["docs_deleted"]) == (4, 3, 1, 3, 0)
    assert told(store) == {"a": ("active", "one"), "b": ("active", "two"), "d": ("active", "# T\n\nrye")}

    second = put(store, spark, [("a", text, "one"), ("b", text, "poison"), ("e", text, "two"), ("e", text, "two")], 2)
    # b fails and keeps its version, e has a text that is stored, d is gone
    assert (second["docs_unchanged"], second["docs_changed"], second["docs_failed"], second["chunks_reused"], second["chunks_embedded"], second["docs_deleted"]) == (1, 1, 1, 1, 0, 1)
    assert second["errors"] == ["b: the provider refuses"] and second["docs_seen"] == 3
    assert told(store) == {"a": ("active", "one"), "b": ("active", "two"), "d": ("deleted", "# T\n\nrye"), "e": ("active", "two")}

    third = put(store, spark, [("d", "text/markdown", "# T\n\nrye")], 3, full=False)
    assert (third["docs_unchanged"], third["docs_deleted"], third["chunks_written"]) == (1, 0, 0)
    assert told(store)["d"][0] == "active" and told(store)["a"][0] == "active"
    cut = put(store, spark, [("d", "text/markdown", "# T\n\nrye")], 4, truncated=True)
    assert cut["docs_deleted"] == 0
    assert store.read("chunks").groupBy("chunk_id").count().where("count > 1").isEmpty()


def test_a_reindex_resumes_verifies_and_swaps(spark, tmp_path):
    store = TableStore(spark, f"file://{tmp_path}/store")
    put(store, spark, [(f"d{k}", "text/plain", f"text {k}") for k in range(7)], 1)
    calls = []

    def other(texts):
        calls.extend(texts)
        return [[1.0, 2.0] for _ in texts]

    work = sync.Reindex(store, other, "m2", batch=3)
    with pytest.raises(sync.NotVerified):
        work.swap()
    cursor, over = work.step()
    assert not over and work.done().count() == 3
    # after a crash from an older cursor nothing is written twice
    work.run("")
    assert work.done().count() == 7 and work.done().select("version_id").distinct().count() == 7
    work.swap()
    assert {r["model"] for r in store.read("chunks").collect()} == {"m2"} and store.read("chunks_old").count() == 7
    work.drop_old()
    assert "chunks_old" not in store.names()


def test_batches_are_applied_once_across_restarts(spark, tmp_path):
    store = TableStore(spark, f"file://{tmp_path}/store")

    def change(batch, number):
        before = store.read("sums") if "sums" in store.names() else spark.createDataFrame([], "n long")
        return {"sums": before.union(batch.agg(F.sum("id")))}

    for number in (0, 1, 1, 0, 2):  # each call as after a restart
        state.committing(store, "q", change)(spark.range(number + 1), number)
    assert sorted(r["n"] for r in store.read("sums").collect()) == [0, 1, 3]


def test_a_sync_stores_each_text_once_beside_its_tables(spark, tmp_path):
    """A chunk that is embedded as it stands has its text once in what a run stages, its markdown and rows not at all; the tables have all."""

    own = TableStore(spark, f"file://{tmp_path}/store")
    docs = spark.createDataFrame([("a", "text/plain", "rye and oat"), ("b", "text/markdown", "# Mill\n\nflour")], "external_id string, mime string, data string")
    sync.synced(own, docs, lambda texts: [[float(len(t))] for t in texts], sync.Run("s", "m", datetime(2024, 1, 1)))
    chunk = {r["content"]: r["embed_text"] for r in own.read("chunks").collect()}
    assert chunk == {"rye and oat": "rye and oat", "flour": "Mill\nflour"} or set(chunk) >= {"rye and oat"} and all(chunk.values())
    assert {r["markdown"] for r in own.read("versions").collect()} == {"rye and oat", "# Mill\n\nflour"}
    staged = {p.name.rsplit("-", 5)[0]: spark.read.parquet(f"file://{p}") for p in (tmp_path / "store" / "_staged").iterdir()}
    assert "rows" not in staged and "markdown" not in staged["parsed"].columns
    assert staged["chunks"].where(F.col("embed_text") == F.col("content")).count() == 0
