"""Indexes for retrieval, built once at ingest and pruned at query time.

Postings: a row for each (lexeme, document) with the lexeme's places, dealt over partitions by a hash of the lexeme. A text query
reads the partitions of its own words, with the words pushed down to the row groups, and never a text. A lexeme that most
documents hold is spread over ``parts`` files of its partition. Within a word the rows lie by level, the power of two of how often the
document has it, and the number of rows of each level is kept apart: the best documents of one word are in its highest levels, and
no row of a lower one can beat them, so the search reads these blocks and ends.

Vectors: an inverted file. Centres are fitted on a bounded sample, each vector lies in the partition of its nearest centre with the
columns that filters read. A search probes list by list, nearest centre first, until enough rows pass the filters and no list left
can hold a nearer one: by the triangle inequality on the sphere, a list is no nearer than its centre less its radius. So the result is
exact; with a ``share`` of each radius fewer lists are read. The index proposes the least share that finds ``RECALL`` of the exact
neighbours of a sample of queries, and for searches without bounds the least number of ``probes``; both are measured when it is
built.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.functions import textquery
from corpusloom.functions.text import lexemes
from corpusloom.operators import retrieve

#: Partitions of the postings, documents for each file of one, and vectors for each file of a list.
BUCKETS, PART_DOCS, PART_ROWS = 64, 100_000, 2_000_000
#: Of what a task has in Python at once: words of documents, rows compared with all centres, and probes of queries.
SLICE_WORDS, SLICE_ROWS, SLICE_PROBES = 200_000, 512, 20_000
#: Distances of a task at once.
CELLS = 1 << 22
#: Bytes of a row group of the postings, and rows of a page.
ROW_GROUP, PAGE_ROWS = 16 << 20, 1000
#: Vectors that centres are fitted on and rounds of fitting; queries that recall is measured by, their neighbours, the share of
#: these to be found.
SAMPLE, ROUNDS, ASKED, NEIGHBOURS, RECALL = 20_000, 10, 64, 10, 0.95
#: Waves of a batch; shares of a radius that are tried, in twentieths; how many times the rows of a wave those of the next are;
#: vectors and queries of one task of a batch; the slack of a bound in radians.
WAVES, SHARES, GROWTH = 3, range(21), 4
TASK_ROWS, TASK_QUERIES, SLACK = 200_000, 4096, 1e-6


def bucket_of(lexeme: Column, buckets: int = BUCKETS) -> Column:
    return (F.crc32(lexeme.cast("binary")) % buckets).cast("int")


def postings(docs: DataFrame, id: str, content: str) -> DataFrame:
    """lexeme, ``id`` and places (ascending) of each distinct word of each document; a null content has none. A task gives what it has
    after each ``SLICE_WORDS`` words, so its memory does not follow the documents that Spark hands it at once."""
    kind = docs.schema[id].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, rows, places, held = [], [], [], 0
            for k, found in enumerate(batch.column(1)):
                at: dict[str, list[int]] = {}
                for place, w in enumerate(found.as_py() or ()):
                    at.setdefault(w, []).append(place)
                    held += 1
                words.extend(at)
                rows.extend([k] * len(at))
                places.extend(at.values())
                if words and (held >= SLICE_WORDS or k + 1 == batch.num_rows):
                    yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), batch.column(0).take(pa.array(rows, pa.int64())), pa.array(places, pa.list_(pa.int32()))], names=["lexeme", id, "places"])
                    words, rows, places, held = [], [], [], 0

    schema = T.StructType([T.StructField("lexeme", T.StringType()), T.StructField(id, kind), T.StructField("places", T.ArrayType(T.IntegerType()))])
    return docs.select(F.col(id), lexemes(F.col(content)).alias("words")).mapInArrow(run, schema)


def _sampled(vectors: DataFrame, id: str, embedding: str, n: int) -> np.ndarray:
    """Unit vectors of the rows of smallest hash: a bounded sample that does not depend on partitions."""
    rows = vectors.where(F.size(embedding) > 0).select(F.xxhash64(F.col(id), F.lit("centre")).alias("h"), F.col(embedding).alias("v")).orderBy("h").limit(n).toPandas()
    if rows.empty:
        return np.zeros((0, 1))
    width = rows["v"].map(len).mode()[0]
    m = np.array([v for v in rows["v"] if len(v) == width and not any(x is None for x in v)], np.float64).reshape(-1, width)
    size = np.linalg.norm(m, axis=1)
    return m[size > 0] / size[size > 0, None]


def centres(unit: np.ndarray, lists: int, rounds: int = ROUNDS, seed: int = 0) -> np.ndarray:
    """Spherical k-means; an empty centre keeps its place."""
    if not len(unit):
        return unit
    c = unit[np.random.default_rng(seed).permutation(len(unit))[:lists]].copy()
    for _ in range(rounds):
        own = (unit @ c.T).argmax(1)
        sums = np.zeros_like(c)
        np.add.at(sums, own, unit)
        size = np.linalg.norm(sums, axis=1)
        c[size > 0] = sums[size > 0] / size[size > 0, None]
    return c


def probes_for(unit: np.ndarray, c: np.ndarray, recall: float = RECALL, asked: int = ASKED, k: int = NEIGHBOURS) -> int:
    """The least number of lists that holds ``recall`` of the nearest ``k`` of some of the sample's own vectors."""
    if len(c) < 2:
        return len(c)
    q = unit[:: max(1, len(unit) // asked)]
    near = np.argsort(-(q @ unit.T), axis=1, kind="stable")[:, :k]
    own = (unit @ c.T).argmax(1)
    order = np.argsort(-(q @ c.T), axis=1, kind="stable")
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(len(c))[None, :].repeat(len(q), 0), 1)
    needed = np.sort(np.take_along_axis(place, own[near], 1).ravel())
    return int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))))]) + 1


def lower_bounds(cosine: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """The least cosine distance that a member of each list can have to a query, from the cosine to the centre and the radius."""
    return 1 - np.cos(np.maximum(np.arccos(np.clip(cosine, -1, 1)) - radius - SLACK, 0))


def share_for(unit: np.ndarray, c: np.ndarray, recall: float = RECALL, asked: int = ASKED, k: int = NEIGHBOURS) -> float:
    """The least share of the radii with which a bounded search finds ``recall`` of the nearest ``k`` of some of the sample's own vectors."""
    if len(c) < 2:
        return 1.0
    own, cosine = (unit @ c.T).argmax(1), unit @ c.T
    off = np.arccos(np.clip(cosine[np.arange(len(unit)), own], -1, 1))
    queries = np.arange(0, len(unit), max(1, len(unit) // asked))
    radius = np.zeros(len(c))
    np.maximum.at(radius, own, off)
    for share in (x / 20 for x in SHARES[:-1]):
        found = wanted = 0
        for q in queries:
            distance = 1 - unit @ unit[q]
            near = np.argsort(distance, kind="stable")[:k]
            bounds, order = lower_bounds(cosine[q], share * radius), np.argsort(-cosine[q], kind="stable")
            probed: list[int] = []
            kth = np.inf
            for part in waves(order, np.bincount(own, minlength=len(c)), k):
                probed += [x for x in part if bounds[x] < kth]
                mine = np.sort(distance[np.isin(own, probed)])
                kth = mine[k - 1] if len(mine) >= k else np.inf
            found += np.isin(own[near], probed).sum()
            wanted += len(near)
        if found >= recall * wanted:
            return share
    return 1.0


def waves(order: np.ndarray, sizes: np.ndarray, k: int) -> list[list[int]]:
    """Lists with rows, in a query's order, cut into waves: the first of ten rows for each asked for, each next ``GROWTH`` times as
    many."""
    order = np.asarray(order)[sizes[order] > 0] if len(order) else np.zeros(0, np.int64)
    out, at, rows, sums = [], 0, 10 * k, np.cumsum(sizes[order])
    while at < len(order):
        stop = int(np.searchsorted(sums, (sums[at - 1] if at else 0) + rows)) + 1
        out.append(order[at:stop].tolist())
        at, rows = stop, rows * GROWTH
    return out


def sliced(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The rows of batches, so many at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def listed(vectors: DataFrame, c: np.ndarray, id: str, embedding: str) -> DataFrame:
    """The columns of ``vectors``, list (the nearest centre; -1 for vectors that cannot be compared) and off, the angle to it."""
    schema = T.StructType([*vectors.schema.fields, T.StructField("list", T.IntegerType()), T.StructField("off", T.DoubleType())])
    at = vectors.columns.index(embedding)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, SLICE_ROWS):
            own, off = np.full(batch.num_rows, -1, np.int32), np.zeros(batch.num_rows)
            rows = [(k, v) for k, v in enumerate(batch.column(at).to_pylist()) if v is not None and len(c) and len(v) == c.shape[1] and None not in v and any(v)]
            if rows:
                m, places = np.array([v for _, v in rows], np.float64), [k for k, _ in rows]
                cosine = m @ c.T / np.linalg.norm(m, axis=1, keepdims=True)
                own[places], off[places] = cosine.argmax(1), np.arccos(np.clip(cosine.max(1), -1, 1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own), pa.array(off)], names=schema.names)

    return vectors.mapInArrow(run, schema)


def build(docs: DataFrame, vectors: DataFrame, folder: str, id: str = "chunk_id", content: str = "content", embedding: str = "embedding", attributes: tuple[str, ...] = ()) -> None:
    """Write the postings of ``docs``, the lists of ``vectors`` with the ``attributes`` of their documents and held (whether there
    is one), and the attributes by themselves, under ``folder``. Ids are unique in both tables."""
    parts = max(1, -(-docs.count() // PART_DOCS))
    rows = postings(docs, id, content).withColumns({"bucket": bucket_of(F.col("lexeme")), "n": F.size("places"), "level": F.floor(F.log2(F.size("places"))).cast("int")})
    tasks = BUCKETS * parts if parts > 1 else min(BUCKETS, 2 * docs.sparkSession.sparkContext.defaultParallelism)
    rows = rows.repartition(tasks, "bucket", F.pmod(F.xxhash64(id), F.lit(parts)))
    # small row groups and pages, so that their bounds of (lexeme, level) leave most of them unread
    blocks = {"parquet.block.size": ROW_GROUP, "parquet.page.row.count.limit": PAGE_ROWS}
    rows.sortWithinPartitions("bucket", "lexeme", F.desc("level"), id).write.options(**blocks).partitionBy("bucket").parquet(f"{folder}/postings")
    levels = docs.sparkSession.read.schema(rows.schema).parquet(f"{folder}/postings").groupBy("bucket", "lexeme", "level").agg(F.count("*").alias("rows"))
    levels.repartition("bucket").sortWithinPartitions("bucket", "lexeme").write.partitionBy("bucket").parquet(f"{folder}/levels")
    docs.select(id, *attributes).write.parquet(f"{folder}/attributes")
    unit = _sampled(vectors, id, embedding, SAMPLE)
    total = vectors.count()
    c = centres(unit, max(1, min(round(total**0.5), 4096, len(unit))))
    told = docs.sparkSession.read.schema(docs.select(id, *attributes).schema).parquet(f"{folder}/attributes").withColumn("held", F.lit(True))
    wide = vectors.select(id, embedding).join(told, id, "left").withColumn("held", F.coalesce("held", F.lit(False)))
    rows = listed(wide, c, id, embedding)
    rows.repartition("list", F.pmod(F.xxhash64(id), F.lit(max(1, total // PART_ROWS)))).write.partitionBy("list").parquet(f"{folder}/vectors")
    lists = docs.sparkSession.read.parquet(f"{folder}/vectors").where("list >= 0").groupBy("list").agg(F.count("*").alias("n"), F.max("off").alias("radius")).collect() if total else []  # a row for each list
    sizes, radii = [0] * len(c), [0.0] * len(c)
    for r in lists:
        sizes[r["list"]], radii[r["list"]] = r["n"], r["radius"]
    meta = json.dumps({"centres": c.tolist(), "probes": probes_for(unit, c), "share": share_for(unit, c), "sizes": sizes, "radii": radii})
    docs.sparkSession.createDataFrame([(meta,)], "value string").coalesce(1).write.text(f"{folder}/meta")


@dataclass
class Index:
    """An index on disk."""

    spark: SparkSession
    folder: str
    id: str = "chunk_id"
    embedding: str = "embedding"

    def __post_init__(self) -> None:
        told = json.loads(self.spark.read.text(f"{self.folder}/meta").first()[0])
        self.centres, self.probes, self.share = np.array(told["centres"]), told["probes"], told["share"]
        self.sizes, self._radii = np.array(told["sizes"], np.int64), np.array(told["radii"], np.float64)
        self._postings, self._levels, self._vectors, self.attributes = (self.spark.read.parquet(f"{self.folder}/{x}") for x in ("postings", "levels", "vectors", "attributes"))

    def places(self, words: list[str]) -> DataFrame:
        """The postings of some words."""
        buckets = sorted({zlib.crc32(w.encode()) % BUCKETS for w in words})
        return self._postings.where(F.col("bucket").isin(buckets) & F.col("lexeme").isin(words))

    def scores(self, queries: dict[int, str]) -> DataFrame:
        """query, ``id`` and score of the documents that match each text query."""
        parsed = {k: textquery.parse(q) for k, q in queries.items()}
        single = {k: w for k, q in parsed.items() if (w := q.word)}
        words = {k: q.words for k, q in parsed.items() if q.words}
        rows = [(k, w, k in single) for k, ws in words.items() for w in sorted(ws)]
        asked = F.broadcast(self.spark.createDataFrame(rows, "query long, lexeme string, single boolean"))
        met = self.places(sorted({w for _, w, _ in rows})).join(asked, "lexeme")
        plain = met.where("single").select("query", self.id, (F.col("n") * F.lit(textquery.WEIGHT)).alias("score"))
        if len(single) == len(words):
            return plain
        schema = T.StructType([T.StructField("query", T.LongType()), self._postings.schema[self.id], T.StructField("score", T.DoubleType())])

        def density(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in sliced(batches, SLICE_ROWS):
                found = [parsed[q.as_py()].density({x["lexeme"]: x["places"] for x in at.as_py()}) for q, at in zip(batch.column(0), batch.column(2), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.float64())], names=schema.names)

        # a group holds the query's words of one document
        held = met.where("not single").groupBy("query", self.id).agg(F.collect_list(F.struct("lexeme", "places")).alias("at"))
        return plain.union(held.mapInArrow(density, schema).where("score > 0"))

    def top_text(self, query: str, k: int = retrieve.K_TEXT, within: DataFrame | None = None) -> DataFrame:
        """``id``, score and r of the k best documents, of those ``within`` if given; ties go by id."""
        if word := textquery.parse(query).word:
            return self._top_word(word, k, within)
        rows = self.scores({0: query})
        rows = rows.join(within.select(self.id), self.id, "left_semi") if within is not None else rows
        return retrieve.ranked(rows.select(self.id, "score"), k, F.col("score").desc(), F.col(self.id))

    def levels(self, word: str) -> list[tuple[int, int]]:
        """(level, rows) of a word's postings, the highest level first; some thirty at most."""
        bucket = zlib.crc32(word.encode()) % BUCKETS
        rows = self._levels.where((F.col("bucket") == bucket) & (F.col("lexeme") == word)).groupBy("level").agg(F.sum("rows").alias("rows")).collect()
        return sorted(((r["level"], r["rows"]) for r in rows), reverse=True)

    def of_levels(self, word: str, low: int, high: int) -> DataFrame:
        """``id`` and n of a word's postings from one level to another; the bounds reach the row groups and pages."""
        bucket = zlib.crc32(word.encode()) % BUCKETS
        return self._postings.where((F.col("bucket") == bucket) & (F.col("lexeme") == word) & F.col("level").between(low, high)).select(self.id, "n")

    def _top_word(self, word: str, k: int, within: DataFrame | None) -> DataFrame:
        """The best of one word, level by level from the highest, as many as have k rows and more each time, until k are found: what
        a lower level has is less."""
        best: list[tuple] = []
        left, wanted = self.levels(word), k
        while left and len(best) < k:
            held, stop = 0, 0
            while stop < len(left) and held < wanted:
                held, stop = held + left[stop][1], stop + 1
            rows = self.of_levels(word, left[stop - 1][0], left[0][0])
            rows = rows if within is None else rows.join(within.select(self.id), self.id, "left_semi")
            best += [tuple(r) for r in rows.orderBy(F.desc("n"), self.id).limit(k - len(best)).collect()]  # k rows
            left, wanted = left[stop:], wanted * GROWTH
        schema = T.StructType([self._postings.schema[self.id], T.StructField("score", T.DoubleType()), T.StructField("r", T.IntegerType())])
        return self.spark.createDataFrame([(i, n * textquery.WEIGHT, r) for r, (i, n) in enumerate(best, 1)], schema)

    def near(self, vector: list[float], probes: int | None = None) -> DataFrame:
        """The vectors of the lists nearest to one."""
        order = np.argsort(-(self.centres @ np.asarray(vector, np.float64)), kind="stable") if len(self.centres) else []
        return self._vectors.where(F.col("list").isin([int(x) for x in order[: probes or self.probes]]))

    def top_vector(self, vector: list[float], k: int = retrieve.K_VECTOR, probes: int | None = None) -> DataFrame:
        """``id``, distance and r of the nearest of the probed lists."""
        return retrieve.top_vector(self.near(vector, probes), vector, k, self.id, self.embedding)

    def _bounds(self, vector: np.ndarray, share: float) -> tuple[np.ndarray, np.ndarray]:
        """Lists in the order of their centres, and the bound of each list's distance."""
        cosine = self.centres @ (vector / np.linalg.norm(vector))
        bounds = lower_bounds(cosine, share * self._radii)
        bounds[self.sizes == 0] = np.inf
        return np.argsort(-cosine, kind="stable"), bounds

    def search(self, vector: list[float], k: int = retrieve.K_VECTOR, where: Column | None = None, share: float = 1.0) -> tuple[DataFrame, list[int]]:
        """``id``, distance and r of the nearest ``k`` that pass ``where`` (on ``id``, held and the attributes), and the lists that
        were read. Lists are read in growing waves, of which all while fewer than k rows pass, and then those whose bound is under the
        k-th distance so far. ``share`` is what counts of a list's radius; 1 is exact."""
        v = np.asarray(vector, np.float64)
        empty = self._vectors.select(self.id).limit(0).withColumns({"distance": F.lit(0.0), "r": F.lit(0)})
        if not len(self.centres) or len(v) != self.centres.shape[1] or not v.any():
            return empty, []
        order, bounds = self._bounds(v, share)
        best: list[tuple] = []
        read: list[int] = []
        for part in waves(order, self.sizes, k):
            now = [x for x in part if len(best) < k or bounds[x] < best[-1][1]]
            if not now:
                continue
            some = self._vectors.where(F.col("list").isin(now))
            near = retrieve.top_vector(some if where is None else some.where(where), vector, k, self.id, self.embedding)
            best = sorted([*best, *((r[0], r[1]) for r in near.select(self.id, "distance").collect())], key=lambda r: (r[1], r[0]))[:k]  # k rows
            read += now
        if not best:
            return empty, read
        found = self.spark.createDataFrame([(*row, n + 1) for n, row in enumerate(best)], T.StructType([self._vectors.schema[self.id], T.StructField("distance", T.DoubleType()), T.StructField("r", T.IntegerType())]))
        return found, read

    def search_batch(self, queries: DataFrame, k: int = retrieve.K_VECTOR, where: Column | None = None, share: float = 1.0) -> tuple[DataFrame, DataFrame]:
        """query, ``id``, distance and r for a table of queries (query, vector), and (query, list), what was read for each. Waves as in
        ``search``, of all queries at once, the third being the last; a task compares a block of a list's vectors with a block of its queries, and nothing
        of either passes the driver. Queries without a comparable vector find nothing."""
        from corpusloom.sources import shared

        kind = self._vectors.schema[self.id]
        asked = shared.stored(queries.select(F.col("query").cast("long").alias("query"), F.col("vector").cast("array<float>").alias("vector")), "asked")
        width = self.centres.shape[1] if len(self.centres) else 0
        # plain values for the tasks
        centres, sizes, radii = self.centres, self.sizes, share * self._radii

        def lists(number: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in sliced(batches, SLICE_ROWS):
                    out: list[tuple[int, int]] = []
                    for row, (v, kth) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                        if v is not None and len(v) == width and None not in v and any(v):
                            cosine = centres @ (np.asarray(v, np.float64) / np.linalg.norm(v))
                            parts = waves(np.argsort(-cosine, kind="stable"), sizes, k)
                            parts = parts[number : number + 1] if number + 1 < WAVES else parts[number:]
                            bounds = lower_bounds(cosine, radii)
                            out += [(row, x) for part in parts for x in part if kth is None or bounds[x] < kth]
                        if out and (len(out) >= SLICE_PROBES or row + 1 == batch.num_rows):
                            rows = pa.array([r for r, _ in out], pa.int64())
                            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array([x for _, x in out], pa.int32())], names=["query", "vector", "list"])
                            out = []

            return run

        def compared(left: pa.Table, right: pa.Table) -> pa.Table:
            names = ["query", own_id, "distance"]
            if not left.num_rows or not right.num_rows:
                return pa.table([pa.array([], pa.int64()), left.column(own_id).slice(0, 0), pa.array([], pa.float64())], names=names)
            m, q = (np.array(t.column(c).combine_chunks().flatten(), np.float64).reshape(-1, width) for t, c in ((left, embedding), (right, "vector")))
            m, q = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in (m, q))
            ids, asking, out, step = left.column(own_id).combine_chunks(), right.column("query").to_numpy(), [], max(1, CELLS // len(m))
            for at in range(0, len(q), step):
                distance = 1 - q[at : at + step] @ m.T
                # rows are in the order of ids, so of equal distances the smaller id is taken
                least = np.argsort(distance, axis=1, kind="stable")[:, :k]
                out.append(pa.table([pa.array(np.repeat(asking[at : at + step], least.shape[1])), ids.take(pa.array(least.ravel())), pa.array(np.take_along_axis(distance, least, 1).ravel())], names=names))
            return pa.concat_tables(out)

        own_id, embedding = self.id, self.embedding
        parts = max(1, -(-int(self.sizes.max(initial=0)) // TASK_ROWS))
        schema = T.StructType([T.StructField("query", T.LongType()), kind, T.StructField("distance", T.DoubleType())])

        def wave(rows: DataFrame, number: int) -> tuple[DataFrame, DataFrame]:
            told = shared.stored(rows.mapInArrow(lists(number), "query long, vector array<float>, list int"), "probes")
            n, busiest = told.groupBy("list").count().agg(F.count("*"), F.max("count")).first()
            probed = [r[0] for r in told.select("list").distinct().collect()] if n else []  # numbers of lists, 4,096 at most
            blocks = max(1, -(-(busiest or 0) // TASK_QUERIES))
            every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
            dealt = told.withColumn("part", every(parts)).withColumn("block", F.pmod(F.xxhash64("query"), F.lit(blocks)).cast("int"))
            some = self._vectors.where(F.col("list").isin(probed))
            some = (some if where is None else some.where(where)).select(self.id, self.embedding, "list", F.pmod(F.xxhash64(self.id), F.lit(parts)).cast("int").alias("part"), every(blocks).alias("block"))
            key = ["list", "part", "block"]
            near = some.groupBy(*key).cogroup(dealt.groupBy(*key)).applyInArrow(lambda a, b: compared(a.sort_by(own_id), b), schema)
            return near, told.select("query", "list")

        place = F.row_number().over(Window.partitionBy("query").orderBy("distance", self.id))
        found, read = wave(asked.withColumn("kth", F.lit(None).cast("double")), 0)
        for number in range(1, WAVES):
            found = shared.stored(found.withColumn("r", place).where(F.col("r") <= k), "near")
            kth = found.where(F.col("r") == k).select("query", F.col("distance").alias("kth"))
            more, others = wave(asked.join(kth, "query", "left"), number)
            found, read = found.drop("r").union(more), read.union(others)
        return found.withColumn("r", place).where(F.col("r") <= k), read

    def top_vector_batch(self, queries: list[tuple[int, list[float]]], k: int = retrieve.K_VECTOR, probes: int | None = None) -> DataFrame:
        """query, ``id``, distance and r for many queries: a task compares a list's vectors with the queries that probe it."""
        lists: dict[int, list[int]] = {}
        unit = np.array([v for _, v in queries], np.float64).reshape(len(queries), -1)
        order = np.argsort(-(unit @ self.centres.T), axis=1, kind="stable")[:, : probes or self.probes] if len(self.centres) and len(queries) else []
        for q, own in enumerate(order):
            for x in own:
                lists.setdefault(int(x), []).append(q)
        return retrieve.top_vector_batch(self._vectors, queries, k, self.id, self.embedding, lists)


def hybrid_batch(index: Index, queries: list[tuple[int, str, list[float]]], vectors: DataFrame | None = None, k_vector: int = retrieve.K_VECTOR, k_text: int = retrieve.K_TEXT, k: int = retrieve.FINAL_K) -> DataFrame:
    """query, ``id``, score and r (the place) of the best k of each of many (number, text, vector), fused by reciprocal rank. With
    ``vectors`` their exact nearest are taken, else those of the probed lists. Queries travel to the tasks: some thousands at
    a time."""
    by_text = Window.partitionBy("query").orderBy(F.desc("score"), index.id)
    # each text is ranked once, however many queries ask it
    texts: dict[str, int] = {}
    asking = [(q, texts.setdefault(t, len(texts))) for q, t, _ in queries if textquery.parse(t).words]
    asked = [(q, v) for q, _, v in queries]
    near = retrieve.top_vector_batch(vectors, asked, k_vector, index.id, index.embedding) if vectors is not None else index.top_vector_batch(asked, k_vector)
    both = near.select("query", index.id, "r")
    if texts:
        ranked = index.scores({n: t for t, n in texts.items()}).withColumn("r", F.row_number().over(by_text)).where(F.col("r") <= k_text).withColumnRenamed("query", "text")
        own = F.broadcast(index.spark.createDataFrame(asking, "query long, text long"))
        both = both.union(ranked.join(own, "text").select("query", index.id, "r"))
    score = F.sum(F.lit(1.0).cast("double") / (F.lit(retrieve.RRF) + F.col("r"))).alias("score")
    return both.groupBy("query", index.id).agg(score).withColumn("r", F.row_number().over(by_text)).where(F.col("r") <= k)
