"""Ingest, retention, answers, evaluation, operations and their streaming forms on hand-made cases."""

from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import alerts, answer, chunks, evaluate, ingest, operations
from corpusloom.streaming import state

NOW = datetime(2024, 6, 1)


def ago(days):
    return NOW - timedelta(days=days)


def ntz(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_retention(spark):
    documents = ntz(spark, [("A", 3, "active", None), ("B", 4, "deleted", ago(40)), ("C", 5, "deleted", ago(5))], "document_id string, current_version long, status string, deleted_at timestamp_ntz")
    versions = ntz(spark, [(1, "A", ago(40)), (2, "A", ago(35)), (3, "A", ago(1)), (4, "B", ago(50)), (5, "C", ago(50))], "version_id long, document_id string, created_at timestamp_ntz")
    parts = ntz(spark, [(10, 1), (11, 2), (12, 3), (13, 3), (14, 4), (15, 4)], "chunk_id long, version_id long")
    logs = ntz(spark, [(1, ago(100)), (2, ago(95)), (3, ago(5))], "query_id long, created_at timestamp_ntz")
    pages = ntz(spark, [("a", ago(40)), ("b", ago(5)), ("c", None)], "url string, last_fetched_at timestamp_ntz")
    policy = ingest.Retention(30, 30, 90, 21)
    gone = ingest.garbage(documents, versions, parts, logs, pages, NOW, policy)
    assert {k: v.count() for k, v in gone.items()} == {"old_versions": 2, "deleted_docs": 1, "versions": 3, "chunks": 4, "query_logs": 2, "crawl_pages": 1}
    again = ingest.garbage(*(ingest.without(t, gone[k]) for t, k in ((documents, "deleted_docs"), (versions, "versions"), (parts, "chunks"), (logs, "query_logs"), (pages, "crawl_pages"))), NOW, policy)
    assert all(v.count() == 0 for v in again.values())
    off = ingest.garbage(documents, versions, parts, logs, pages, NOW, ingest.Retention(pages=0))
    assert off["crawl_pages"].count() == 0


def test_upsert_revives_and_reconcile_guards(spark):
    schema = "key long, content_hash string, status string, deleted_at timestamp_ntz, last_seen_at timestamp_ntz, source string"
    stored = ntz(spark, [(1, "a", "active", None, ago(3), "s"), (2, "b", "deleted", ago(1), ago(3), "s"), (3, "c", "active", None, ago(3), "s")], schema)
    incoming = spark.createDataFrame([(1, "a"), (2, "b"), (4, "d"), (4, "d")], "key long, content_hash string")
    changes = {r["key"]: r["change"] for r in ingest.changed(incoming, stored, ["key"]).collect()}
    assert changes == {1: "unchanged", 2: "revived", 4: "new"}
    after = {r["key"]: r for r in ingest.upserted(stored, incoming, ["key"], NOW).collect()}
    assert after[2]["status"] == "active" and after[2]["deleted_at"] is None and after[4]["content_hash"] == "d"
    assert after[3]["last_seen_at"] == ago(3)
    for guard in ({"complete": False, "seen": 1}, {"complete": True, "seen": 0}, {"complete": True, "seen": 1, "truncated": True}):
        assert ingest.reconciled(stored, "s", NOW, **guard).where("status = 'deleted'").count() == 1
    assert ingest.reconciled(stored, "s", NOW, complete=True, seen=2).where("status = 'deleted'").count() == 3
    gone = ingest.soft_deleted(stored, F.col("key") <= 2, NOW)
    assert {r["key"]: r["deleted_at"] for r in gone.collect()} == {1: NOW, 2: ago(1), 3: None}


def test_reuse_embeds_changed_chunks_only(spark):
    doc = lambda text: [{"type": "paragraph", "level": 0, "text": t, "rows": None} for t in text.split("|")]
    rows = chunks.Splitter(4, 1).split("T", doc("one two three|four five six|seven eight nine"))
    assert len(rows) == 3
    df = spark.createDataFrame([(r["position"], r["embed_text"]) for r in rows], "position int, embed_text string").withColumn("chunk_hash", F.sha2("embed_text", 256))
    known = df.where("position < 2").select(F.col("position").alias("chunk_id"), "chunk_hash", F.lit("m").alias("model"), F.array(F.lit(1.0)).alias("embedding"))
    reused, missing = ingest.reuse(df, known, "m")
    assert reused.count() == 2 and missing.count() == 1
    calls = ingest.embedded(missing, lambda ts: [[float(len(t))] for t in ts], "m").collect()
    assert calls[0]["embedding"] == [float(len(rows[2]["embed_text"]))]
    assert ingest.reuse(df, known, "other")[1].count() == 3


def test_batches():
    assert ingest.batch_numbers(pd.Series([5, 5, 5, 20, 1]), 2, 10) == [0, 0, 1, 2, 3]


def test_invalid_documents(spark):
    good, bad = ingest.invalid(spark.createDataFrame([("a", "b"), ("", "b"), (None, None)], "x string, y string"), "x", "y")
    assert good.count() == 1 and sorted(r["reason"] for r in bad.collect()) == ["missing x", "missing x, y"]


def test_budget(spark):
    rows = [("q", 1, "a" * 400), ("q", 2, "b" * 400), ("q", 3, "c" * 4), ("z", 1, "é" * 999)]
    df = spark.createDataFrame(rows, "key string, r int, content string")
    kept = {(r["key"], r["r"]): r for r in answer.budget_prefix(df, 150, ["key"]).collect()}
    assert set(kept) == {("q", 1), ("z", 1)}  # it stops at the first that overflows
    assert kept["z", 1]["content"] == "é" * 300


def test_answers(spark):
    low = spark.createDataFrame([(1, 0.01), (2, 0.005)], "r int, score double")
    assert answer.grounded(low, reranked=True).count() == 0 and answer.grounded(low, reranked=False).count() == 2
    assert answer.refusal("Acme") == "I couldn't find information about that in Acme's content."
    sources = spark.createDataFrame([("q", k, f"text  {k}") for k in (1, 2, 3)], "key string, r int, content string")
    answers = spark.createDataFrame([("q", "As [3] and [1] say [3], not [0] or [7].")], "key string, answer string")
    got = answer.cited(answers, sources, "key").orderBy("r").collect()
    assert [(r["r"], r["snippet"]) for r in got] == [(1, "text 1"), (3, "text 3")]
    assert answer.messages("s", [("user", "a"), ("assistant", "b")], "ctx", "q", 1)[1] == ("assistant", "b")


def test_evaluation(spark):
    rows = [(True, True, None, 100, None), (False, True, None, 200, None), (None, False, True, 300, None), (True, False, False, 400, "boom")]
    s = evaluate.summary(spark.createDataFrame(rows, "recall_hit boolean, grounded boolean, correct boolean, latency_ms long, error string"))
    r = s.first()
    assert (r["cases"], r["errors"], r["recall_scored"], r["mean_latency_ms"], r["grounded_rate"]) == (4, 1, 3, 250, 0.5)
    assert r["recall"] == pytest.approx(2 / 3) and r["correctness"] == 0.5
    assert evaluate.gate(s, 0.7, 0.8).first()["failures"] == ["recall", "grounded_rate"]
    empty = evaluate.summary(spark.createDataFrame([], "recall_hit boolean, grounded boolean, correct boolean, latency_ms long, error string"))
    assert evaluate.gate(empty, 0.7).first()["skipped"]
    nothing = s.withColumn("recall", F.lit(None).cast("double"))
    assert evaluate.gate(nothing, recall=0.1).first()["failures"] == ["recall"]
    with pytest.raises(ValueError):
        evaluate.gate(s)
    assert evaluate.merged_settings({"a": {"b": 1, "c": 2}, "d": 1}, {"a": {"b": 9}, "d": [1]}) == {"a": {"b": 9, "c": 2}, "d": [1]}


def test_bucket_and_breaker():
    bucket = operations.TokenBucket(2, 2)
    assert [bucket.take(0.0)[0] for _ in range(3)] == [True, True, False]
    one = operations.TokenBucket(1, 1)
    assert one.take(0)[0] and one.take(0) == (False, 1.0) and one.take(1)[0]
    idle = operations.TokenBucket(1, 2)
    assert [idle.take(t)[0] for t in (0, 100, 100, 100)] == [True, True, True, False]
    breaker = operations.Breaker(2, 30)
    assert [breaker.call(t, ok) for t, ok in ((0, False), (1, False), (2, True), (31, False), (32, True), (61, True), (62, True))] == ["failed", "failed", "refused", "failed", "refused", "ok", "ok"]


@pytest.mark.parametrize(
    ("line", "want"),
    [("*/15 3 * * 1-5", datetime(2024, 6, 3, 3, 0)), ("0 0 1 * *", datetime(2024, 7, 1)), ("30 12 * * 0", datetime(2024, 6, 2, 12, 30)), ("0 0 29 2 *", datetime(2028, 2, 29)), ("bad", datetime(2024, 6, 2, 4, 5)), ("61 * * * *", datetime(2024, 6, 2, 4, 5))],
)
def test_cron(line, want):
    assert operations.next_run(line, datetime(2024, 6, 1, 4, 5)) == want


def test_job_states_and_reconcile(spark):
    rows = [(1, "queued", 0), (1, "running", 1), (1, "cancelled", 2), (1, "succeeded", 3), (2, "running", 1), (2, "queued", 2)]
    df = spark.createDataFrame([(j, s, ago(9) + timedelta(minutes=t), t) for j, s, t in rows], "job_id long, state string, at timestamp_ntz, seq long")
    got = {r["job_id"]: r for r in operations.job_states(df).collect()}
    assert got[1]["state"] == "cancelled" and got[1]["finished_at"] == ago(9) + timedelta(minutes=2)
    assert got[2]["state"] == "queued" and got[2]["finished_at"] is None
    mirror = ntz(spark, [(1, "running", None), (2, "succeeded", ago(1))], "job_id long, state string, finished_at timestamp_ntz")
    queue = ntz(spark, [(1, "cancelled", None), (2, "failed", ago(2))], "job_id long, state string, finished_at timestamp_ntz")
    done = {r["job_id"]: (r["state"], r["finished_at"]) for r in operations.reconciled_jobs(mirror, queue, NOW).collect()}
    assert done == {1: ("cancelled", NOW), 2: ("succeeded", ago(1))}


@pytest.mark.parametrize(("minutes", "runs"), [(29, 0), (30, 1), (31, 1), (301, 1)])
def test_sustained_depth(spark, minutes, runs):
    rows = [(ago(1) + timedelta(minutes=m), 501 if m <= minutes else 10) for m in range(0, 320)]
    df = spark.createDataFrame(rows, "at timestamp_ntz, depth long")
    assert alerts.sustained(df, "at", F.col("depth") > alerts.QUEUE_DEPTH).count() == runs
    assert alerts.sustained(df, "at", F.col("depth") > alerts.QUEUE_DEPTH, minutes=300).count() == (minutes >= 300)


def stream(spark, tmp_path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    return spark.readStream.schema(spark.read.parquet(f"{tmp_path}/in").schema).parquet(f"{tmp_path}/in")


def run(df, name, mode):
    # what is there now, then an end: a query with timeouts would go on with empty batches
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    try:
        assert q.awaitTermination(60)
    finally:
        q.stop()
    return df.sparkSession.table(name).collect()


def test_streams(spark, tmp_path):
    t = datetime(2024, 1, 1)
    rows = [("a", t + timedelta(seconds=s), True, s) for s in (0, 0, 1, 2, 100)] + [("b", t, False, 9)]
    df = stream(spark, tmp_path, rows, "key string, at timestamp, ok boolean, n long")
    limited = run(state.rate_limited(df, 1.0, 2.0, "key", "at", idle_ms=None), "limited", "append")
    assert sum(r["allowed"] for r in limited if r["key"] == "a") == 5 and len(limited) == 6
    assert {r["result"] for r in run(state.broken(df, "key", "at", "ok", idle_ms=None), "broken", "append")} == {"ok", "failed"}
    days = run(state.usage_daily(df, "key", "at", total=F.col("n")), "days", "complete")
    assert {(r["key"], r["total"]) for r in days} == {("a", 103), ("b", 9)}
    assert len(run(state.unique_jobs(df, ["key"], "at", "1 hour"), "unique", "append")) == 2
    assert run(state.sliding_count(df, "at", "5 minutes", "1 minute", "1 minute", "key"), "sliding", "complete")
    done = []
    sink = state.upserting(lambda batch, number: done.append(number))
    sink(None, 1)
    sink(None, 1)
    assert done == [1]
    folded = run(state.job_states(df.selectExpr("n as job_id", "at", "if(ok, 'running', 'cancelled') as state")), "folded", "update")
    assert {r["state"] for r in folded} == {"running", "cancelled"}


def test_folds_carry_their_state_over_batches(spark):
    from corpusloom.operators.folds import ordered_fold

    rows = [(k, n) for k in ("a", None, "b") for n in range(50)]
    df = spark.createDataFrame(rows, "key string, n long").repartition(5)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = ordered_fold(df, "key", ["n"], lambda: [0], lambda s, part: part.assign(total=[s.__setitem__(0, s[0] + n) or s[0] for n in part["n"]]), "key string, n long, total long").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert len(got) == 150
    assert all(r["total"] == r["n"] * (r["n"] + 1) // 2 for r in got)


def test_rows_of_short_keys_in_one_batch(spark):
    from pyspark.sql import types as T

    from corpusloom.operators.folds import carried

    rows = [(k, n, 7) for k in ("a", None, "b") for n in range(50)]
    df = spark.createDataFrame(rows, "key string, n long, total int").repartition(5)
    adds = T.StructType([T.StructField("total", T.LongType())])

    def add(state, n):
        state[0] += n
        return (state[0],)

    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    for size in ("7", "1000"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        try:
            got = carried(df, "key", ["n"], lambda: [0], add, ["n"], adds)
            assert got.columns == ["key", "n", "total"]
            assert sorted(((r["key"] or "", r["n"], r["total"]) for r in got.collect())) == sorted((k or "", n, n * (n + 1) // 2) for k, n, _ in rows)
            assert carried(df.limit(0), "key", ["n"], lambda: [0], add, ["n"], adds).count() == 0
        finally:
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
