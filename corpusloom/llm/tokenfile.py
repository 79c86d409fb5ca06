"""Token ids as Parquet shards that can be read in parts.

Format: a row holds a document's ids as a list of 32-bit integers, its length and its place; rows lie in ascending order of the
document's id over shards 0, 1, 2 ... Ids are dictionary-encoded (two bytes and less for each), numbers delta-encoded. Row groups
and pages have a bounded size, and pages an index, so that lengths and places are read without ids and a range of documents
without the others' pages. A manifest with a row for each shard has the number of ids before it; a row's own ``start`` counts
within the shard, so shards are written in one pass and at the same time.

Plan: one shuffle of the texts, by ranges of id; each task sorts its range, encodes it and writes it by Spark's own writer. What
equals in id and text is dealt over the ranges by its place, so one id with very many rows is no single task.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm import packing, scratch

#: Bytes of a row group and of a page, and rows of a page at most.
ROW_GROUP, PAGE, PAGE_ROWS = 32 << 20, 128 << 10, 1000
#: Rows and bytes of text that are taken together, by default and for ids.
ROWS, ID_ROWS, BYTES = 256, 10_000, 4_000_000
#: Entries of a worker's table of ids beyond which only the half that is used most stays (about 20 MB), and the longest chunk that it keeps.
KEPT, KEPT_CHARS = 400_000, 64
#: Marks that a chunk ends before, and one of them beside another character that is no letter, number or white space.
_MARKS = ".,"
_RUNS = f"[{_MARKS}][^{packing.WORD}]|[^{packing.WORD}][{_MARKS}]"


class ChunkIds:
    """Ids of texts by the library, as unsigned 32-bit integers.

    No pre-token holds white space, so a text's ids are those of its chunks between white space, and a chunk's those of its
    pre-tokens. A full stop or comma between letters, numbers and white space is a pre-token by itself, so a chunk ends before it and a
    word with a mark behind it is no chunk of its own. Arrow cuts a block of texts and looks its chunks up in the worker's table; only distinct ones that are not there are
    met by Python and encoded. Texts with special strings, or with characters on whose class Unicode versions differ, go to the
    library whole.
    """

    def __init__(self, tokenizer: str) -> None:
        self.words = packing.WordIds(tokenizer)
        #: The table: chunks, how many ids each has, the ids one after the other, how often each was met.
        self.chunks, self.sizes = pa.array([], pa.large_string()), np.zeros(0, np.int64)
        self.pool, self.met = np.zeros(0, "<u4"), np.zeros(0, np.int64)

    def block(self, texts: list[str | None]) -> list[bytes]:
        """Each text's ids in little-endian bytes."""
        ids, sizes = self.ids(texts)
        return [x.tobytes() for x in np.split(ids, np.cumsum(sizes)[:-1])] if texts else []

    def ids(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all the texts, one after the other, and how many each has."""
        lower = [(t or "").lower() for t in texts]
        data = pa.array(lower, pa.large_string())
        whole = _odd(data) | {k for k, t in enumerate(texts) if t and any(s in t for s in self.words.special)}
        # such a text is a chunk that no other text can hold
        apart = {f"\u0250{k}": self.words.block([texts[k]])[0] for k in whole}
        if apart:
            data = pa.array([f"\u0250{k}" if k in whole else t for k, t in enumerate(lower)], pa.large_string())
        cut = pc.utf8_split_whitespace(_marks_apart(data))
        chunks = cut.flatten()
        found = pc.index_in(chunks, value_set=self.chunks)
        number = pc.fill_null(found, -1).to_numpy().copy()
        fresh = chunks.filter(found.is_null()).dictionary_encode()
        coded = self._encoded(fresh.dictionary.to_pylist(), apart)
        number[number < 0] = fresh.indices.to_numpy() + len(self.chunks)
        sizes = np.concatenate([self.sizes, np.fromiter(map(len, coded), np.int64, len(coded)) // 4])
        pool = np.concatenate([self.pool, np.frombuffer(b"".join(coded), "<u4")])
        at, of = np.cumsum(sizes) - sizes, sizes[number]
        ends = np.concatenate([[0], np.cumsum(of)])
        where = np.repeat((at[number] - ends[:-1]).astype(np.int32), of)
        where += np.arange(ends[-1], dtype=np.int32)
        ids = pool[where]
        self._keep(fresh.dictionary, sizes, pool, np.bincount(number, minlength=len(sizes)), apart)
        return ids, np.diff(ends[cut.offsets.to_numpy()])

    def _encoded(self, new: list[str], apart: dict[str, bytes]) -> list[bytes]:
        """Ids in bytes of distinct chunks, or from ``apart``."""
        plain = set(new).difference(apart)
        # a chunk of letters is one pre-token
        parts = {c: packing.PRE.findall(c) for c in plain if not c.isalpha()}
        table = self.words.encoded(list(plain.difference(parts).union(*parts.values())))
        get = table.__getitem__
        table.update([(c, b"".join(map(get, p))) for c, p in parts.items()])
        table.update(apart)
        return list(map(get, new))

    def _keep(self, fresh: pa.Array, sizes: np.ndarray, pool: np.ndarray, met: np.ndarray, apart: dict[str, bytes]) -> None:
        """Put the new chunks into the table; of too many the ones met most stay."""
        met[: len(self.met)] += self.met
        stay = np.ones(len(sizes), bool)
        stay[len(self.met) :] = pc.less_equal(pc.utf8_length(fresh), KEPT_CHARS).to_numpy(zero_copy_only=False)
        if apart:
            stay[len(self.met) :] &= ~pc.starts_with(fresh, "\u0250").to_numpy(zero_copy_only=False)
        stay = busiest(stay, met, KEPT)
        self.chunks = pa.concat_arrays([self.chunks, fresh]).filter(pa.array(stay))
        self.pool, self.sizes, self.met = pool[np.repeat(stay, sizes)], sizes[stay], met[stay]


def busiest(stay: np.ndarray, met: np.ndarray, most: int) -> np.ndarray:
    """Which entries of a table stay: all of ``stay``, or of more than ``most`` the half of that which was met most."""
    if stay.sum() <= most:
        return stay
    top = np.zeros(len(stay), bool)
    top[np.argpartition(np.where(stay, met, 0), -(most // 2))[-(most // 2) :]] = True
    met //= 2  # what was met long ago counts less
    return stay & top


def _marks_apart(texts: pa.Array) -> pa.Array:
    """Lower-case texts with a space before each full stop and comma, but those where one stands beside another mark."""
    spaced = texts
    for mark in _MARKS:
        spaced = pc.replace_substring(spaced, mark, f" {mark}")
    return pc.if_else(pc.match_substring_regex(texts, _RUNS), texts, spaced)


def _odd(texts: pa.Array) -> set[int]:
    """The texts with a character from U+0250 on, or with one of the separators U+001C to U+001F."""
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[: len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[: offsets[-1]]
    odd = (data >= 0xCA) | (data - np.uint8(0x1C) < 4)
    at = np.flatnonzero(data[:-1] == 0xC9)
    odd[at] = data[at + 1] >= 0x90
    return set((np.searchsorted(offsets, np.flatnonzero(odd), "right") - 1).tolist())


_chunks: dict[str, ChunkIds] = {}


def chunk_ids(tokenizer: str) -> ChunkIds:
    if tokenizer not in _chunks:
        _chunks[tokenizer] = ChunkIds(tokenizer)
    return _chunks[tokenizer]


def slices(batch: pa.RecordBatch, column: int, rows: int = ROWS, most: int = BYTES) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """Parts of a batch of at most ``rows`` rows, and of one row beyond ``most`` bytes of a column at most, with the texts of that column."""
    before = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)])
    at = 0
    while at < batch.num_rows:
        stop = min(at + rows, int(np.searchsorted(before, before[at] + most)), batch.num_rows)
        part = batch.slice(at, stop - at)
        yield part, part.column(column).to_pylist()
        at = stop


def gathered(batches: Iterator[pa.RecordBatch], column: int, most: int) -> Iterator[pa.RecordBatch]:
    """Batches that follow one another put together, up to ``most`` bytes of a column."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        own = batch.column(column).nbytes
        if held and size + own > most:
            yield pa.concat_batches(held)
            held, size = [], 0
        held.append(batch)
        size += own
    if held:
        yield pa.concat_batches(held)


def write(docs: DataFrame, folder: str, text: str = "text", id: str = "doc_id", tokenizer: str = "word_bpe_49k.json", end_id: int = 1, shards: int | None = None) -> TokenFile:
    """Write the shards and the manifest of a table under ``folder``, which must not exist.

    A document's ids are those of its text (null: none) and ``end_id``. Every row is kept, null ids first; rows of one id lie in
    the order of their texts' hashes, so only equal rows are interchangeable. Other columns are not read. ``shards``: the
    session's shuffle partitions if not given. An empty table has shards without rows.
    """
    spark = docs.sparkSession
    kind = docs.schema[id].dataType
    n = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, shard, start = chunk_ids(tokenizer), TaskContext.get().partitionId(), 0
        for batch in gathered(batches, 1, BYTES):
            for part, texts in slices(batch, 1, ID_ROWS):
                ids, lengths = encoder.ids(texts)
                ids = np.insert(ids, np.cumsum(lengths), end_id).view(np.int32)
                lengths = lengths + 1
                ends = np.cumsum(lengths)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(start + ends - lengths), pa.array(lengths), lists, pa.array(np.full(len(lengths), shard, np.int32))], names=["id", "start", "n_tokens", "ids", "shard"])
                start += int(ends[-1])

    schema = T.StructType([T.StructField("id", kind), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("shard", T.IntegerType())])
    slim = docs.select(F.col(id).alias("id"), F.col(text).alias("text"), F.xxhash64(text).alias("h"), F.monotonically_increasing_id().alias("place"))
    ordered = slim.repartitionByRange(n, "id", "h", "place").sortWithinPartitions("id", "h", "place").select("id", "text")
    options = {
        "compression": "zstd", "parquet.block.size": ROW_GROUP, "parquet.page.size": PAGE, "parquet.page.row.count.limit": PAGE_ROWS, "parquet.writer.version": "v2",
        "parquet.enable.dictionary": "false", "parquet.enable.dictionary#ids.list.element": "true",
    }
    ordered.mapInArrow(run, schema).write.options(**options).parquet(f"{folder}/shards")
    told = spark.read.schema(schema).parquet(f"{folder}/shards").groupBy("shard").agg(F.sum("n_tokens").alias("n_tokens"), F.count("*").alias("n_rows"))
    # a row for each shard
    before = F.coalesce(F.sum("n_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    told.withColumn("base", before).coalesce(1).write.parquet(f"{folder}/manifest")
    return TokenFile(spark, folder)


class TokenFile:
    """Shards on disk. Nothing is read before a result is asked for, and of the columns only those that it needs."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder
        self._rows, self.manifest = spark.read.parquet(f"{folder}/shards"), spark.read.parquet(f"{folder}/manifest")

    def rows(self, where: Column | None = None) -> DataFrame:
        """id, start (over all shards), n_tokens and ids; ``where`` on id reaches the row groups and pages."""
        some = self._rows if where is None else self._rows.where(where)
        # the manifest has a row for each shard; Spark broadcasts it below its own threshold
        return some.join(self.manifest.select("shard", "base"), "shard").select("id", (F.col("base") + F.col("start")).alias("start"), "n_tokens", "ids")

    def lengths(self, where: Column | None = None) -> DataFrame:
        """id, start and n_tokens: no page of ids is read."""
        return self.rows(where).drop("ids")

    def span(self, first: int, last: int) -> DataFrame:
        """id, start, n_tokens and ids of the stream's positions from ``first`` up to ``last``, the first and the last row cut:
        of the other shards and pages nothing is read."""
        held = self.manifest.where((F.col("base") < last) & (F.col("base") + F.col("n_tokens") > first)).select("shard", "base")
        bounds = held.agg(F.min("shard"), F.max("shard"), F.min("base"), F.max("base")).first()
        low, high = (bounds[0], bounds[1]) if bounds[0] is not None else (0, -1)
        some = self._rows.where(F.col("shard").between(low, high))
        if low == high:
            some = some.where((F.col("start") < last - bounds[2]) & (F.col("start") + F.col("n_tokens") > first - bounds[2]))
        out = some.join(held, "shard").withColumn("at", F.col("base") + F.col("start")).where((F.col("at") < last) & (F.col("at") + F.col("n_tokens") > first))
        skip = F.greatest(F.lit(first) - F.col("at"), F.lit(0))
        stop = F.least(F.lit(last) - F.col("at"), F.col("n_tokens"))
        ids = F.slice("ids", (skip + 1).cast("int"), (stop - skip).cast("int"))
        return out.select("id", (F.col("at") + skip).alias("start"), (stop - skip).alias("n_tokens"), ids.alias("ids"))

    def digests(self, id: str = "id") -> DataFrame:
        """``id``, start, n_tokens and ids_crc32 (of the ids as little-endian unsigned 32-bit integers), from the ids themselves."""
        rows = self.rows().select(F.col("id").alias(id), "start", "ids")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                lists = batch.column(2)
                cuts, ids = lists.offsets.to_numpy(), lists.values.to_numpy().astype("<u4")
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.diff(cuts).astype(np.int64)), pa.array(crc, pa.int64())], names=[id, "start", "n_tokens", "ids_crc32"])

        return rows.mapInArrow(run, T.StructType([*rows.schema.fields[:2], T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())]))


def round_trip(docs: DataFrame, id: str = "doc_id", **how) -> DataFrame:
    """``id``, start, n_tokens and ids_crc32 of each row, as read back from files written to the shared folder."""
    return write(docs, scratch.folder(docs.sparkSession, "tokens"), id=id, **how).digests(id)
