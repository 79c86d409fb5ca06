"""A whole sync and a whole reindex, composed of the steps of ``ingest`` and committed to a table store as what they change.

A run never fails for one document: what cannot be parsed or embedded is counted with its error and keeps its former version.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import approx_tokens
from corpusloom.operators import blocks, chunks, ingest
from corpusloom.sources.tablestore import Snapshot, TableStore

Embed = Callable[[list[str]], list[list[float]]]
DOCUMENTS = "external_id string, source string, content_hash string, current_version string, status string, deleted_at timestamp, last_seen_at timestamp"
VERSIONS = "version_id string, external_id string, source string, content_hash string, title string, markdown string, created_at timestamp"
CHUNKS = "chunk_id string, version_id string, position int, heading_path array<string>, content string, embed_text string, token_count int, chunk_hash string, model string, embedding array<float>"
RUNS = "source string, started timestamp"


@dataclass(frozen=True)
class Run:
    """Settings of a sync."""

    source: str
    model: str
    started: datetime
    full: bool = True
    complete: bool = True
    truncated: bool = False
    target: int = chunks.TARGET
    overlap: int = chunks.OVERLAP


def opened(base: Snapshot) -> dict[str, DataFrame]:
    """The tables of a snapshot, empty ones where it has none yet. An active document has been seen by the last run of its source
    that ended with reconciling, as that deletes what it has not seen; so such a run writes no row for what it found unchanged."""
    now = {name: base.read(name) if name in base.tables else base.store.spark.createDataFrame([], kind) for name, kind in (("documents", DOCUMENTS), ("versions", VERSIONS), ("chunks", CHUNKS), ("runs", RUNS))}
    last = now["runs"].groupBy("source").agg(F.max("started").alias("_run"))
    seen = F.when(F.col("status") == "active", F.greatest("last_seen_at", "_run")).otherwise(F.col("last_seen_at"))
    documents = now["documents"].join(last, "source", "left").withColumn("last_seen_at", seen)
    return now | {"documents": documents.select(*[f.split()[0] for f in DOCUMENTS.split(", ")])}


def synced(store: TableStore, incoming: DataFrame, embed: Embed, run: Run, base: Snapshot | None = None, also: dict[str, tuple[DataFrame, list[str]]] | None = None) -> DataFrame:
    """Take ``incoming`` (external_id, mime, data) into the store; returns the run's twelve counters as one row.

    A document is read once, of repeated ids the one of the smallest hash. Parsed, it is compared by content hash; only new and changed ones
    are chunked, only chunk texts that no stored chunk has for the model are embedded. New versions, chunks and document
    states are committed together, and nothing else is written: the bytes of a run follow what has changed. After a full, complete and
    uncut run that saw something, unseen documents are deleted. Runs of several sources may commit at the same time; of two runs of
    one source, or a run and a reindex that swaps, the later to commit fails with Conflict and can be run again. ``base`` is the
    snapshot to work from if one has been taken; ``also``, rows by key of further tables for the same commit."""
    began = time.monotonic()
    base = base or store.snapshot()
    now = opened(base)
    docs = ingest.latest_once(incoming.withColumn("external_id", F.col("external_id").cast("string")), ["external_id"], F.xxhash64("mime", "data"))
    read = store.staged(blocks.documents_parsed(docs, F.col("mime"), "data").withColumn("bytes", F.octet_length("data").cast("long")).drop("data", "markdown"), "parsed")
    # the markdown follows from the blocks, so it is not stored beside them
    read = read.withColumn("markdown", blocks.canonical_column(F.col("blocks")))
    bad = read.where("error is not null").select("external_id", "error")
    own = now["documents"].where(F.col("source") == run.source)
    good = ingest.changed(read.where("error is null").drop("error"), own, ["external_id"])
    # what has the stored hash is only seen, also where it had been deleted
    fresh = good.where(F.col("change").isin("new", "changed")).withColumn("version_id", F.sha2(F.concat_ws("\n", F.lit(run.source), "external_id", "content_hash"), 256))
    # a chunk without a context line is embedded as it stands, so its text is stored once
    cut = store.staged(chunks.exploded(fresh, "version_id", run.target, run.overlap).withColumn("embed_text", F.when(F.col("embed_text") != F.col("content"), F.col("embed_text"))), "chunks")
    whole = F.coalesce("embed_text", "content").alias("embed_text")
    reused, missing = ingest.reuse(cut.select("version_id", "position", "chunk_hash", whole), now["chunks"].select("chunk_id", "chunk_hash", "model", "embedding"), run.model)
    made = store.staged(ingest.embedded(missing, embed, run.model, failsafe=True), "embedded")
    vectors = reused.select("version_id", "position", F.col("embedding")).unionByName(cut.join(made.where("error is null").select("chunk_hash", "embedding"), "chunk_hash").select("version_id", "position", "embedding"))
    failed = cut.join(made.where("error is not null").select("chunk_hash", "error"), "chunk_hash").groupBy("version_id").agg(F.min("error").alias("error"))
    lost = fresh.join(failed, "version_id").select("external_id", "error")
    errors = store.staged(bad.unionByName(lost), "errors")
    done = fresh.join(failed, "version_id", "left_anti")

    stamp = F.lit(run.started).cast("timestamp")
    versions = done.select("version_id", "external_id", F.lit(run.source).alias("source"), "content_hash", "title", "markdown", stamp.alias("created_at")).join(now["versions"].select("version_id"), "version_id", "left_anti")
    # what is to be written is settled on keys and vectors, and the texts are joined to it once
    wanted = vectors.join(done.select("version_id"), "version_id", "left_semi").join(now["chunks"].select("version_id").distinct(), "version_id", "left_anti")
    rows = cut.join(wanted, ["version_id", "position"]).select(F.concat_ws("/", "version_id", "position").alias("chunk_id"), "version_id", "position", "heading_path", "content", whole, "token_count", "chunk_hash", F.lit(run.model).alias("model"), F.col("embedding").cast("array<float>").alias("embedding"))
    count = read.count()
    reconciles = run.full and run.complete and not run.truncated and count > 0
    # a document that failed was seen all the same, so it is not taken for gone
    seen = own.join(read.select("external_id"), "external_id", "left_semi")
    settled = done.select("external_id", "content_hash", F.col("version_id").alias("current_version"))
    revived = good.where("change = 'revived'").select("external_id", "content_hash").join(own.select("external_id", "current_version"), "external_id")
    states = settled.unionByName(revived).select("external_id", F.lit(run.source).alias("source"), "content_hash", "current_version", F.lit("active").alias("status"), F.lit(None).cast("timestamp").alias("deleted_at"), stamp.alias("last_seen_at"))
    marked = seen.join(states.select("external_id"), "external_id", "left_anti").where(F.lit(not reconciles) | (F.col("status") != "active")).withColumn("last_seen_at", stamp)
    states = states.unionByName(marked.select(*states.columns))
    if reconciles:
        unseen = own.where((F.col("status") == "active") & (F.col("last_seen_at") < stamp)).join(read.select("external_id"), "external_id", "left_anti")
        states = states.unionByName(unseen.withColumns({"status": F.lit("deleted"), "deleted_at": stamp}).select(*states.columns))
    states = store.staged(states, "documents")
    gone = states.where("status = 'deleted'").join(own.where("status = 'active'").select("external_id"), "external_id", "left_semi").count()
    ended = {"runs": store.spark.createDataFrame([(run.source, run.started)], RUNS)} if reconciles else {}
    store.commit(base, upsert={"documents": (states, ["source", "external_id"]), **(also or {})}, append={"versions": versions, "chunks": rows, **ended}, scope=f"source {run.source}")

    of = cut.join(made.where("error is null").select("chunk_hash", F.lit(True).alias("made")), "chunk_hash", "left").agg(F.count("made").alias("chunks_embedded"), (F.count("*") - F.count("made")).alias("other"))
    broken = cut.join(made.where("error is not null").select("chunk_hash"), "chunk_hash", "left_semi").agg(F.count("*").alias("broken"))
    tokens = missing.join(made.where("error is null").select("chunk_hash"), "chunk_hash", "left_semi").agg(F.coalesce(F.sum(approx_tokens(F.col("embed_text"))), F.lit(0)).cast("long").alias("embed_tokens"))
    told = ingest.first_errors(errors)
    stats = read.agg(F.count("*").alias("docs_seen"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes_fetched"))
    for one in (done.agg(F.count("*").alias("docs_changed")), good.agg(F.count_if(F.col("change").isin("unchanged", "revived")).alias("docs_unchanged")), errors.agg(F.count("*").alias("docs_failed")), rows.agg(F.count("*").alias("chunks_written")), of, broken, tokens, told):
        stats = stats.crossJoin(one)  # frames of one row
    stats = stats.withColumns({"docs_deleted": F.lit(gone).cast("long"), "chunks_reused": F.col("other") - F.col("broken"), "duration_ms": F.lit(int((time.monotonic() - began) * 1000)).cast("long")})
    return store.staged(stats.select("docs_seen", "docs_changed", "docs_unchanged", "docs_deleted", "docs_failed", "chunks_written", "chunks_embedded", "chunks_reused", "embed_tokens", "bytes_fetched", "duration_ms", "errors"), "stats")


class NotVerified(Exception):
    """A reindexed table that does not cover every live version."""


class Reindex:
    """All live chunks embedded again by another model, beside the live table, and named in its place when they cover it.

    ``step`` takes the next documents after a cursor and adds their chunks, so a crash repeats one step at most and a version is
    written once; ``swap`` and ``drop_old`` write no rows. Each verifies the very snapshot that it changes: a sync that commits
    in between makes them fail.
    """

    def __init__(self, store: TableStore, embed: Embed, model: str, batch: int = 100_000) -> None:
        self.store, self.embed, self.model, self.batch = store, embed, model, batch

    def live(self, base: Snapshot) -> DataFrame:
        now = opened(base)
        current = now["documents"].where("status = 'active' and current_version is not null").select(F.col("current_version").alias("version_id"))
        return now["versions"].select("version_id", "external_id", "title").join(current, "version_id", "left_semi")

    def done(self, base: Snapshot | None = None) -> DataFrame:
        base = base or self.store.snapshot()
        return base.read("chunks_new") if "chunks_new" in base.tables else self.store.spark.createDataFrame([], CHUNKS)

    def step(self, cursor: str = "") -> tuple[str, bool]:
        """The advanced cursor, and whether nothing is left after it."""
        base = self.store.snapshot()
        live = self.live(base)
        left = live.select("version_id").where(F.col("version_id") > cursor).join(self.done(base).select("version_id").distinct(), "version_id", "left_anti")
        page = self.store.staged(left.orderBy("version_id").limit(self.batch), "page")
        last = page.agg(F.max("version_id"), F.count("*")).first()
        if not last[1]:
            return cursor, True
        rows = opened(base)["chunks"].join(page, "version_id", "left_semi").join(live.select("version_id", "title"), "version_id")
        rows = ingest.reindex_texts(rows).withColumn("chunk_hash", F.sha2("embed_text", 256)).drop("title", "model", "embedding")
        made = ingest.embedded(rows.groupBy("chunk_hash").agg(F.first("embed_text").alias("embed_text")), self.embed, self.model)
        fresh = rows.join(made, "chunk_hash").select(*[f.split()[0] for f in CHUNKS.split(", ")])
        self.store.commit(base, append={"chunks_new": fresh}, scope="reindex")
        return last[0], last[1] < self.batch

    def run(self, cursor: str = "") -> None:
        over = False
        while not over:
            cursor, over = self.step(cursor)

    def covered(self, base: Snapshot, name: str = "chunks_new") -> tuple[int, int]:
        """Live versions that have chunks, and those of them that the table has."""
        now = opened(base)
        wanted = self.live(base).join(now["chunks"].select("version_id").distinct(), "version_id", "left_semi").select("version_id")
        new = self.done(base) if name == "chunks_new" else now["chunks"].where(F.col("model") == self.model)
        row = wanted.join(new.select("version_id").distinct().withColumn("_h", F.lit(True)), "version_id", "left").agg(F.count("*"), F.count("_h")).first()
        return row[0], row[1]

    def _verified(self, name: str) -> Snapshot:
        base = self.store.snapshot()
        wanted, got = self.covered(base, name)
        if wanted != got:
            raise NotVerified(f"{got} of {wanted} live versions are covered")
        return base

    def swap(self) -> None:
        """The new chunks become the live ones, the old ones ``chunks_old``: three names change."""
        self.store.commit(self._verified("chunks_new"), rename={"chunks": "chunks_old", "chunks_new": "chunks"})

    def drop_old(self) -> None:
        """Forget the old chunks once the live table is seen to cover every live version."""
        self.store.commit(self._verified("chunks"), drop=("chunks_old", "chunks_new"))
