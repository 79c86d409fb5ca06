"""HTTP API records as a stream: each micro-batch has the records that were updated since the one before.

An offset is a time. A batch is what lies between two of them: after the first, up to the second, so Spark's own offset log makes a
restart ask for the same records again, and no record of an unchanged update comes twice or is left out. What is updated again
meanwhile comes with its new time in a later batch. Endpoints are read in tasks, page by page; the driver knows times only.
"""

from __future__ import annotations

import importlib
import json
from collections.abc import Callable, Iterator
from dataclasses import replace
from datetime import UTC, datetime, timedelta
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSourceStreamReader, InputPartition

from corpusloom.operators import ingest, sync
from corpusloom.sources import api
from corpusloom.sources.tablestore import Snapshot, TableStore

SCHEMA = "external_id string, title string, uri string, body string, metadata map<string,string>, updated string, endpoint string, updated_at timestamp"


class _Window(InputPartition):
    def __init__(self, config: dict, start: str, end: str) -> None:
        self.config, self.start, self.end = config, start, end


def named(function: str) -> Callable:
    """The function of ``module:function``."""
    module, _, name = function.partition(":")
    return getattr(importlib.import_module(module), name)


def now(options: dict) -> datetime:
    return datetime.now(UTC)


class RecordStream(DataSourceStreamReader):
    """Reads the endpoints of ``ApiSource``'s options. Further ones: lag, the seconds that a record may show up after its time (0);
    since_parameter, a URL parameter that takes the start of a batch, to spare older records (they are left out in any case);
    clock, a ``module:function`` of the options in place of the system's time."""

    def __init__(self, options: dict) -> None:
        self.options = options
        self.endpoints = json.loads(options["endpoints"])
        self.last = ""

    def initialOffset(self) -> dict:
        return {"until": ""}

    def latestOffset(self) -> dict:
        at = named(self.options.get("clock") or f"{__name__}:now")(self.options) - timedelta(seconds=float(self.options.get("lag", 0)))
        self.last = max(self.last, at.astimezone(UTC).replace(tzinfo=None).isoformat(timespec="microseconds"))
        return {"until": self.last}

    def partitions(self, start: dict, end: dict) -> list[_Window]:
        self.last = max(self.last, end["until"])  # a clock set back asks for nothing twice
        return [_Window(e, start["until"], end["until"]) for e in self.endpoints]

    def read(self, partition: _Window) -> Iterator[tuple]:
        transport = named(self.options["transport"])
        auth, credentials = (json.loads(self.options.get(k) or "null") for k in ("auth", "credentials"))
        if auth:
            transport = api.authorised(transport, auth, credentials or {})
        e = partition.config
        mapping, number, url = api.Mapping(**e["mapping"]), 0, e["url"]
        if partition.start and (parameter := self.options.get("since_parameter")):
            url = api.with_parameters(url, **{parameter: partition.start})
        for items in api.pages(url, api.Paging(**e.get("paging", {})), e.get("items_path", "$"), transport):
            for item in items:
                number += 1
                d = api.document(item, number, mapping)
                at = api.when(d["updated"]) if d["updated"] else None
                if within(at, partition.start, partition.end):
                    yield d["external_id"], d["title"], d["uri"], d["body"], d["metadata"], d["updated"], mapping.endpoint, at

    def commit(self, end: dict) -> None:
        """Nothing is held for a batch; what it came to is in the sink's own commit (``syncing``)."""


def within(at: datetime | None, start: str, end: str) -> bool:
    """Whether a time lies after ``start`` and up to ``end``. A record without one belongs to the first batch only."""
    if at is None:
        return not start
    told = at.astimezone(UTC).replace(tzinfo=None).isoformat(timespec="microseconds")
    return start < told <= end


class RecordSource(api.ApiSource):
    """``ApiSource`` as a batch and, by ``readStream``, as a stream (format "records_stream"), with updated_at besides."""

    @classmethod
    def name(cls) -> str:
        return "records_stream"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema: Any) -> RecordStream:
        return RecordStream(dict(self.options))

    def reader(self, schema: Any) -> Any:
        stream = RecordStream(dict(self.options))
        return _Whole(stream)


class _Whole(api.DataSourceReader):
    def __init__(self, stream: RecordStream) -> None:
        self.stream = stream

    def partitions(self) -> list[_Window]:
        return self.stream.partitions(self.stream.initialOffset(), self.stream.latestOffset())

    def read(self, partition: _Window) -> Iterator[tuple]:
        return self.stream.read(partition)


def syncing(store: TableStore, embed: sync.Embed, run: sync.Run, query: str, mime: str = "text/plain", clock: Callable[[], datetime] = lambda: datetime.now(UTC).replace(tzinfo=None)) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that syncs each batch of records into the store, once across restarts: documents, chunks, the batch's
    number (table applied) and each endpoint's newest time as it is written (table connector_state: source, endpoint, cursor,
    updated_at) are one commit. A batch is a partial run: it deletes nothing."""

    def apply(base: Snapshot, batch: DataFrame, number: int) -> None:
        spark = store.spark
        kinds = {"applied": "query string, number long", "connector_state": "source string, endpoint string, cursor string, updated_at timestamp"}
        known = {name: base.read(name) if name in base.tables else spark.createDataFrame([], kind) for name, kind in kinds.items()}
        last = known["applied"].where(F.col("query") == query).agg(F.max("number")).first()[0]
        if last is not None and number <= last:
            return
        rows = ingest.latest_once(batch, ["external_id"], -F.coalesce(F.unix_micros("updated_at"), F.lit(0)), F.xxhash64("body"))
        told = batch.where("updated_at is not null").select("endpoint", F.col("updated").alias("cursor"), "updated_at")
        every = told.unionByName(known["connector_state"].where(F.col("source") == run.source).drop("source"))
        state = every.groupBy("endpoint").agg(F.max_by("cursor", "updated_at").alias("cursor"), F.max("updated_at").alias("updated_at"))
        state = state.select(F.lit(run.source).alias("source"), "endpoint", "cursor", "updated_at")
        mark = spark.createDataFrame([(query, number)], kinds["applied"])
        docs = rows.select("external_id", F.lit(mime).alias("mime"), F.col("body").alias("data"))
        sync.synced(store, docs, embed, replace(run, started=clock(), full=False), base, {"applied": (mark, ["query"]), "connector_state": (state, ["source", "endpoint"])})

    def sink(batch: DataFrame, number: int) -> None:
        # read once: a second look at the endpoints might show other records
        kept = store.staged(batch, "batch")
        store.retried(lambda base: apply(base, kept, number))

    return sink
