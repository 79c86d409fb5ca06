"""Ingest as a chain of frames: hash, split into changed and unchanged, reuse embeddings, version, reconcile, collect garbage.

States are tables in, tables out; ``sources.tablestore`` swaps the staged results in as one step.
"""

from __future__ import annotations

import random
import time
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import dataclass
from datetime import datetime, timedelta
from typing import TypeVar

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.functions.times import utc

#: Of one embedding request: texts and estimated tokens.
BATCH_TEXTS, BATCH_TOKENS = 96, 100_000
#: Requests of a task at the same time.
IN_FLIGHT = 4
R, S = TypeVar("R"), TypeVar("S")


def invalid(docs: DataFrame, *required: str) -> tuple[DataFrame, DataFrame]:
    """(valid, invalid with reason): required columns must be there and not blank."""
    missing = F.array_compact(F.array(*[F.when(F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == "", F.lit(c)) for c in required]))
    marked = docs.withColumn("_m", missing)
    return marked.where(F.size("_m") == 0).drop("_m"), marked.where(F.size("_m") > 0).withColumn("reason", F.concat(F.lit("missing "), F.array_join("_m", ", "))).drop("_m")


def latest_once(docs: DataFrame, key: list[str], *order: Column) -> DataFrame:
    """One row of each key: the first by ``order``, ascending; of rows equal in it one. Found by a minimum with sums on the map
    side, so a key may have any number of rows."""
    names = [c for c in docs.columns if c not in key]
    least = F.min_by(F.struct(*[F.col(f"`{c}`") for c in names]), F.struct(*order)).alias("_r")
    return docs.groupBy(*key).agg(least).select(*docs_order(docs.columns, key))


def docs_order(columns: list[str], key: list[str]) -> list[Column]:
    return [F.col(f"`{c}`") if c in key else F.col(f"_r.`{c}`").alias(c) for c in columns]


def changed(incoming: DataFrame, documents: DataFrame, key: list[str], hash: str = "content_hash") -> DataFrame:
    """``incoming`` with change: new, changed, unchanged or revived (unchanged, but it had been deleted)."""
    known = documents.select(*key, F.col(hash).alias("_h"), F.col("status").alias("_s"), F.lit(True).alias("_known"))
    kind = F.when(F.col("_known").isNull(), "new").when(~F.col(hash).eqNullSafe(F.col("_h")), "changed").when(F.col("_s") == "deleted", "revived").otherwise("unchanged")
    return incoming.join(known, key, "left").withColumn("change", kind).drop("_h", "_s", "_known")


def upserted(documents: DataFrame, incoming: DataFrame, key: list[str], now: datetime, hash: str = "content_hash") -> DataFrame:
    """The documents table (key, content_hash, status, deleted_at, last_seen_at) after a run has put ``incoming``: what it
    has is active with its hash and seen now, whether it changed, was deleted or is new."""
    seen = incoming.select(*key, F.col(hash).alias("_h")).dropDuplicates(key).withColumn("_seen", F.lit(True))
    out = documents.join(seen, key, "full_outer")
    hit = F.col("_seen").isNotNull()
    return out.select(
        *key,
        F.when(hit, F.col("_h")).otherwise(F.col(hash)).alias(hash),
        F.when(hit, F.lit("active")).otherwise(F.col("status")).alias("status"),
        F.when(~hit, F.col("deleted_at")).alias("deleted_at"),
        F.when(hit, utc(now)).otherwise(F.col("last_seen_at")).alias("last_seen_at"),
    )


def versioned(versions: DataFrame, incoming: DataFrame, key: list[str], hash: str = "content_hash") -> DataFrame:
    """Versions (key, content_hash) to be added: an older version with the same hash is used again."""
    return incoming.select(*key, hash).distinct().join(versions, [*key, hash], "left_anti")


def reconciled(documents: DataFrame, source: str, started: datetime, complete: bool, seen: int, truncated: bool = False) -> DataFrame:
    """After a full sync, active documents of the source that were not seen since it started are deleted. A run that failed,
    saw nothing or was cut short deletes nothing."""
    if not complete or truncated or not seen:
        return documents
    gone = (F.col("source") == source) & (F.col("status") == "active") & (F.col("last_seen_at") < utc(started))
    return documents.withColumns({"deleted_at": F.when(gone, utc(started)).otherwise(F.col("deleted_at")), "status": F.when(gone, F.lit("deleted")).otherwise(F.col("status"))})


def soft_deleted(documents: DataFrame, which: Column, now: datetime) -> DataFrame:
    """Marks documents deleted; those that are already keep their time."""
    hit = which & (F.col("status") == "active")
    return documents.withColumns({"deleted_at": F.when(hit, utc(now)).otherwise(F.col("deleted_at")), "status": F.when(hit, F.lit("deleted")).otherwise(F.col("status"))})


def first_by_hash(embedded: DataFrame, hash: str = "chunk_hash", model: str = "model", id: str = "chunk_id", vector: str = "embedding") -> DataFrame:
    """One embedding of each (hash, model): that of the smallest chunk id."""
    return embedded.where(F.col(vector).isNotNull()).groupBy(hash, model).agg(F.min_by(vector, id).alias(vector))


def reuse(chunks: DataFrame, embedded: DataFrame, model: str, hash: str = "chunk_hash") -> tuple[DataFrame, DataFrame]:
    """(chunks with an embedding of equal text by the same model, distinct texts still to embed). Deleted documents' chunks
    serve too."""
    known = first_by_hash(embedded.where(F.col("model") == model), hash).select(hash, "embedding")
    return chunks.join(known, hash), chunks.join(known, hash, "left_anti").groupBy(hash).agg(F.min("embed_text").alias("embed_text"))


class Requests:
    """The request that each text goes into, in order: a request is full at either bound; a text over the bound goes alone."""

    def __init__(self, texts: int = BATCH_TEXTS, limit: int = BATCH_TOKENS) -> None:
        self.texts, self.limit = texts, limit
        self.number = self.held = self.size = 0

    def take(self, tokens: int) -> int:
        if self.size and (self.size == self.texts or self.held + tokens > self.limit):
            self.number, self.held, self.size = self.number + 1, 0, 0
        self.held, self.size = self.held + tokens, self.size + 1
        return self.number


def batch_numbers(tokens: pd.Series, texts: int = BATCH_TEXTS, limit: int = BATCH_TOKENS) -> list[int]:
    requests = Requests(texts, limit)
    return [requests.take(int(t)) for t in tokens]


@dataclass(frozen=True)
class Retry:
    """Whether and when a request is made again: after a ``TimeoutError`` or ``ConnectionError``, or an exception with a true attribute
    ``retryable``; at most ``times`` times, after a wait that doubles from ``first`` seconds up to ``most`` and is spread by up to half,
    or what the exception's ``retry_after`` says, up to ``most`` too."""

    times: int = 5
    first: float = 0.5
    most: float = 30.0

    def wait(self, error: Exception, attempt: int, draw: Callable[[], float] = random.random) -> float | None:
        """Seconds before attempt ``attempt`` + 1 (from 1), None for giving up."""
        if attempt > self.times or not (isinstance(error, TimeoutError | ConnectionError) or getattr(error, "retryable", False)):
            return None
        if (told := getattr(error, "retry_after", None)) is not None:
            return min(float(told), self.most)
        return min(self.first * 2 ** (attempt - 1), self.most) * (1 - draw() / 2)

    def __call__(self, ask: Callable[[list[str]], list], texts: list[str], sleep: Callable[[float], None] = time.sleep) -> list:
        attempt = 1
        while True:
            try:
                return ask(texts)
            except Exception as e:  # whatever a provider's client raises
                if (seconds := self.wait(e, attempt)) is None:
                    raise
            sleep(seconds)
            attempt += 1


def in_order(ask: Callable[[R], S], given: Iterable[R], in_flight: int) -> Iterator[S]:
    """``ask`` of each, at most ``in_flight`` at the same time, the answers in the order of what was given; no more of it is taken than
    is in flight."""
    if in_flight <= 1:
        yield from map(ask, given)
        return
    with ThreadPoolExecutor(in_flight) as pool:
        waiting: deque[Future] = deque()
        for one in given:
            waiting.append(pool.submit(ask, one))
            if len(waiting) == in_flight:
                yield waiting.popleft().result()
        while waiting:
            yield waiting.popleft().result()


def embedded(missing: DataFrame, embed: Callable[[list[str]], list[list[float]]], model: str, tokens: Callable[[str], int] | None = None, hash: str = "chunk_hash", failsafe: bool = False, in_flight: int = IN_FLIGHT, retry: Retry = Retry()) -> DataFrame:
    """``hash``, model and embedding of texts, by requests of bounded size within a task, ``in_flight`` of them at a time (``embed`` is
    then called from several threads) and each made again as ``retry`` says; the order is kept. With ``failsafe`` a request that
    raises in the end or answers with another number of vectors gives its texts an error, and the other requests go on; without, it
    fails the task, which Spark tries again."""
    from corpusloom.operators.chunks import estimate

    count = tokens or estimate
    more = [T.StructField("error", T.StringType())] if failsafe else []
    schema = T.StructType([missing.schema[hash], T.StructField("model", T.StringType()), T.StructField("embedding", T.ArrayType(T.FloatType())), *more])

    def asked(texts: list[str]) -> tuple[list, str | None]:
        try:
            vectors = retry(embed, texts)
            if len(vectors) != len(texts):
                raise ValueError(f"{len(vectors)} vectors for {len(texts)} texts")
            return vectors, None
        except Exception as e:  # whatever a provider's client raises
            if not failsafe:
                raise
            return [None] * len(texts), str(e)[:200] or type(e).__name__

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            at = 0
            requests = (part["embed_text"].tolist() for _, part in frame.groupby(batch_numbers(frame["embed_text"].map(count)), sort=False))
            for own, error in in_order(asked, requests, in_flight):
                # the vectors of one request at a time
                yield pd.DataFrame({hash: frame[hash].iloc[at : at + len(own)].tolist(), "model": model, "embedding": own, **({"error": [error] * len(own)} if failsafe else {})})
                at += len(own)

    return missing.select(hash, "embed_text").mapInPandas(run, schema)


@dataclass(frozen=True)
class Retention:
    """Days that each class is kept; 0 keeps it for good."""

    versions: int = 30
    documents: int = 30
    queries: int = 90
    pages: int = 0


def garbage(documents: DataFrame, versions: DataFrame, chunks: DataFrame, queries: DataFrame, pages: DataFrame, now: datetime, policy: Retention = Retention()) -> dict[str, DataFrame]:
    """What retention removes, as ids by table: versions that are not current, deleted documents with all they have, logged
    queries and crawl pages, each strictly older than its days."""

    def old(column: str, days: int) -> Column:
        return F.col(column) < utc(now - timedelta(days=days)) if days else F.lit(False)

    gone = documents.where((F.col("status") == "deleted") & old("deleted_at", policy.documents)).select("document_id")
    current = documents.where("current_version is not null").select(F.col("current_version").alias("version_id"))
    stale = versions.join(current, "version_id", "left_anti").where(old("created_at", policy.versions)).select("version_id")
    cascaded = versions.join(gone, "document_id", "left_semi").select("version_id")
    lost = stale.union(cascaded).distinct()
    return {
        "old_versions": stale,
        "deleted_docs": gone,
        "versions": lost,
        "chunks": chunks.join(lost, "version_id", "left_semi").select("chunk_id"),
        "query_logs": queries.where(old("created_at", policy.queries)).select("query_id"),
        "crawl_pages": pages.where(F.col("last_fetched_at").isNotNull() & old("last_fetched_at", policy.pages)).select("url"),
    }


def without(table: DataFrame, gone: DataFrame) -> DataFrame:
    return table.join(gone, gone.columns, "left_anti")


def source_deleted(source: str, documents: DataFrame, versions: DataFrame, chunks: DataFrame, products: DataFrame) -> dict[str, DataFrame]:
    """The tables without a source's rows and all that hangs on them."""
    docs = documents.where(F.col("source") == source).select("document_id")
    own = versions.join(docs, "document_id", "left_semi").select("version_id")
    return {
        "documents": documents.where(~F.col("source").eqNullSafe(F.lit(source))),
        "versions": without(versions, own),
        "chunks": without(chunks, own),
        "products": products.where(~F.col("source").eqNullSafe(F.lit(source))),
    }


def coverage(live_chunks: DataFrame, new_chunks: DataFrame) -> DataFrame:
    """One row: live_docs, covered_docs, live_chunks, new_chunks. A reindex may be swapped in when all documents are covered."""
    left = live_chunks.agg(F.countDistinct("document_id").alias("live_docs"), F.count("*").alias("live_chunks"))
    hit = live_chunks.select("document_id").distinct().join(new_chunks.select("document_id").distinct(), "document_id", "left_semi").agg(F.count("*").alias("covered_docs"))
    # three one-row frames
    return left.crossJoin(hit).crossJoin(new_chunks.agg(F.count("*").alias("new_chunks")))


def reindex_texts(live_chunks: DataFrame, title: str = "title") -> DataFrame:
    """The reuse path: embed texts rebuilt from stored headings and contents, without parsing again."""
    parts = F.filter(F.concat(F.array(F.trim(F.coalesce(F.col(title), F.lit("")))), F.transform("heading_path", lambda p: F.trim(p))), lambda p: p != "")
    # a part equal to the one before it is left out
    once = F.filter(F.transform(parts, lambda p, i: F.when((i == 0) | (p != F.get(parts, i - 1)), p)), lambda p: p.isNotNull())
    line = F.array_join(once, " > ")
    return live_chunks.withColumn("embed_text", F.when(line == "", F.col("content")).otherwise(F.concat(line, F.lit("\n"), F.col("content"))))


def sync_stats(outcomes: DataFrame, errors: int = 100) -> DataFrame:
    """Totals of a run by outcome, and its first errors."""
    is_ = lambda k: F.count_if(F.col("change") == k)
    rows = outcomes.agg(
        F.count("*").alias("docs_seen"), is_("new").alias("docs_new"), is_("changed").alias("docs_changed"), is_("unchanged").alias("docs_unchanged"), F.count("error").alias("docs_failed"),
    )
    return rows.crossJoin(first_errors(outcomes, errors))


def first_errors(outcomes: DataFrame, most: int = 100) -> DataFrame:
    """One row: the first errors by id, as a list."""
    some = outcomes.where("error is not null").select("external_id", "error").orderBy("external_id", "error").limit(most)
    return some.agg(F.array_sort(F.collect_list(F.concat_ws(": ", "external_id", "error"))).alias("errors"))


def merged(before: DataFrame, after: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """Rows of either table by key: the newer value of each column where it is not null, else the older."""
    a, b = before.alias("a"), after.alias("b")
    on = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in key]
    return a.join(b, on, "full_outer").select(*[F.coalesce(f"b.{c}", f"a.{c}").alias(c) for c in [*key, *columns]])


def imported_counts(cases: DataFrame, stored: DataFrame, key: str = "question") -> DataFrame:
    """created and updated of an upsert of cases."""
    known = stored.select(key).distinct().withColumn("_k", F.lit(True))
    return cases.dropDuplicates([key]).join(known, key, "left").agg(F.count_if(F.col("_k").isNull()).alias("created"), F.count_if("_k").alias("updated"))
