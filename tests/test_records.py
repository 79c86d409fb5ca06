"""The record stream: batches by time, restarts without loss or repeats, and the state that is committed with the documents."""

import json
from datetime import UTC, datetime, timedelta
from pathlib import Path
from urllib.parse import parse_qs, urlsplit

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import sync
from corpusloom.sources.tablestore import TableStore
from corpusloom.streaming import records


def transport(url):
    """Items of the file that the URL's path names, in pages."""
    parts = urlsplit(url)
    asked = {k: v[0] for k, v in parse_qs(parts.query).items()}
    items = [i for i in json.loads(Path(parts.path).read_text()) if "since" not in asked or not i.get("at") or i["at"] >= asked["since"][:19]]
    at = int(asked.get("offset", 0))
    return 200, {}, json.dumps(items[at : at + 3]).encode()


def clock(options):
    return datetime.fromisoformat(Path(options["at"]).read_text()).replace(tzinfo=UTC)


def lengths(texts):
    return [[float(len(t))] for t in texts]


class Service:
    """Two endpoints, a clock and a stream over them."""

    def __init__(self, spark, folder):
        self.spark, self.folder = spark, folder
        self.items = {"a": {}, "b": {}}
        self.at = datetime(2025, 1, 1)
        self.put()

    def put(self, name="a", seconds=0, **texts):
        for k, text in texts.items():
            self.items[name][k] = {"id": k, "text": text, "at": (self.at + timedelta(seconds=seconds)).isoformat(timespec="seconds")}
        for n, items in self.items.items():
            (self.folder / f"{n}.json").write_text(json.dumps(list(items.values())))
        (self.folder / "clock").write_text(self.at.isoformat())

    def wait(self, seconds):
        self.at += timedelta(seconds=seconds)
        self.put()

    def frame(self, reader):
        endpoints = [{"url": f"https://h{self.folder}/{n}.json", "paging": {"kind": "offset", "parameter": "offset", "size": 3}, "mapping": {"endpoint": n, "id_path": "$.id", "body": "{{.text}}", "updated_path": "$.at"}} for n in self.items]
        options = {"endpoints": json.dumps(endpoints), "transport": "tests.test_records:transport", "clock": "tests.test_records:clock", "at": str(self.folder / "clock"), "since_parameter": "since"}
        return reader.format("records_stream").options(**options).load()

    def run(self, sink):
        self.spark.dataSource.register(records.RecordSource)
        query = self.frame(self.spark.readStream).writeStream.foreachBatch(sink).option("checkpointLocation", f"file://{self.folder}/checkpoint").start()
        try:
            query.processAllAvailable()
        finally:
            query.stop()


@pytest.fixture
def service(spark, tmp_path):
    (tmp_path / "s").mkdir()
    return Service(spark, tmp_path / "s")


def test_batches_hold_what_was_updated_since(spark, service):
    got = []

    def sink(batch, number):
        got.append(sorted((r["external_id"], r["body"]) for r in batch.collect()))

    service.put(k1="one", k2="two", k3="three", k4="four")
    service.put("b", k1="other")
    service.run(sink)
    assert got == [[("a/k1", "one"), ("a/k2", "two"), ("a/k3", "three"), ("a/k4", "four"), ("b/k1", "other")]]
    got.clear()
    service.wait(60)
    service.put(seconds=-10, k2="newer")
    service.put("b", seconds=30, late="not yet")
    service.run(sink)
    assert [x for g in got for x in g] == [("a/k2", "newer")]
    got.clear()
    service.wait(60)
    service.run(sink)
    assert [x for g in got for x in g] == [("b/late", "not yet")]


def test_a_restart_loses_and_repeats_nothing(spark, service, tmp_path):
    store = TableStore(spark, f"file://{tmp_path}/store")
    sink = records.syncing(store, lengths, sync.Run("api", "m", datetime(2025, 1, 1)), "q", clock=lambda: service.at)
    service.put(k1="one", k2="two")
    service.run(sink)
    service.wait(60)
    service.put(k3="three", k1="one more")

    def dies(batch, number):
        if number:
            raise RuntimeError("before the commit")
        sink(batch, number)

    with pytest.raises(Exception, match="before the commit"):
        service.run(dies)
    service.wait(60)
    service.put(k4="four")
    service.run(sink)  # the batch that failed, by the offsets that were logged, then the new one

    def told():
        now = sync.opened(store.snapshot())
        rows = now["documents"].join(now["versions"].select(F.col("version_id").alias("current_version"), "markdown"), "current_version")
        return {r["external_id"]: (r["status"], r["markdown"]) for r in rows.collect()}

    want = {f"a/{k}": ("active", t) for k, t in {"k1": "one more", "k2": "two", "k3": "three", "k4": "four"}.items()}
    assert told() == want and store.read("versions").count() == 5
    state = {(r["source"], r["endpoint"]): r["cursor"] for r in store.read("connector_state").collect()}
    assert state == {("api", "a"): "2025-01-01T00:02:00"}
    before = store.snapshot().number
    # the same batch again, as after a crash between the sink's commit and Spark's
    last = store.read("applied").first()["number"]
    sink(service.frame(spark.read), last)
    assert store.snapshot().number == before and told() == want


def test_times_of_a_window():
    at = datetime(2025, 1, 1, 12, tzinfo=UTC)
    assert records.within(at, "", "2025-01-01T12:00:00.000000") and not records.within(at, "2025-01-01T12:00:00.000000", "2025-02-01T00:00:00.000000")
    assert records.within(None, "", "x") and not records.within(None, "2025-01-01T12:00:00.000000", "x")
    stream = records.RecordStream({"endpoints": "[]", "lag": "5"})
    first = stream.latestOffset()
    stream.partitions(stream.initialOffset(), {"until": "2999-01-01T00:00:00.000000"})
    assert first["until"] < stream.latestOffset()["until"] == "2999-01-01T00:00:00.000000"
