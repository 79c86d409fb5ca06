"""Benchmark decontamination: documents that hold passages of test items, edited copies included.

Method: word pairs of each item are seeds. The documents' seeds are counted over the whole corpus, each item keeps the rare ones,
and the rare seeds join documents to items. Where a document has as many of an item's rare seeds as a passage that counts
must leave, the words around its seeds are aligned with the whole item by Smith-Waterman, and the score against a perfect match
decides.

No passage that counts is lost by the seeds. Of an item of n words, let m be matched, and b of its pairs of matched neighbours
have two or more words put between them. At half of a perfect score 2 m - (n - m) - 2 b >= n, and at least 2 m - n - 1 - b pairs
are left, which is n / 3 - 1 or more, found next to each other or with one word between; a part of ``PART_WORDS`` words at
``PART_SCORE`` leaves 16. An item drops its most frequent seeds up to half of the number that must be left, and asks for the
rest of them, so a passage that thousands of documents share is found like any other.

Plan: one scan of the documents puts out their seeds (a hash of the text, a hash of the pair), filtered by a bitmap of bounded
size; the number of scans does not depend on the benchmark. Seeds are joined and counted as narrow rows with sums on the map
side. Only texts that hold enough seeds are read again, by a broadcast of their hashes up to ``ASKED`` of them, else by a
shuffled join; equal texts are aligned once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm import scratch

#: Words below which an item only counts whole.
LEAST = 4
#: Share of the perfect alignment score from which a passage counts as the item's, and words that suffice for a part of one.
SCORE, PART_WORDS, PART_SCORE = 0.5, 24, 0.8
#: Seeds that a part of an item leaves at least.
PART_SEEDS = 16
MATCH, MISMATCH, GAP = 2, -1, -1
#: The bitmap has a power of two of bits, about 32 for each seed, within these powers (16 MB at most).
BITS_LEAST, BITS_MOST = 16, 27
#: Texts that are picked by a broadcast table (16 bytes each); beyond, by a shuffled join.
ASKED = 1_000_000
#: Hashes that a task keeps, and characters of a word whose hash is kept (14 MB at most, of words in ASCII). A table of 500,000 took as long.
KEPT, KEPT_CHARS = 1 << 16, 64
_WORD = re.compile(r"\w+")
_LONG = np.uint64(0x9E3779B97F4A7C15)
_OTHER = np.uint64(0xC2B2AE3D27D4EB4F)


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


class Hashes(dict):
    """Hashes of words, those met first up to ``KEPT`` of them."""

    def __missing__(self, word: str) -> int:
        h = xxhash.xxh3_64_intdigest(word.encode())
        if len(self) < KEPT and len(word) <= KEPT_CHARS:
            self[word] = h
        return h

    def of(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def pairs(h: np.ndarray, step: int = 1) -> np.ndarray:
    """Seeds of the words ``step`` apart."""
    return _mixed(h[:-step] * _LONG + h[step:] * _OTHER)


def wholes(h: np.ndarray, n: int) -> np.ndarray:
    """Seeds of short items: all runs of n words."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    return _mixed(sum((h[k : len(h) - n + 1 + k] * (_OTHER * np.uint64(2 * k + 1)) for k in range(n)), np.full(len(h) - n + 1, n, np.uint64)))


def need_of(n: int) -> int:
    """Seeds that a passage that counts leaves of an item of n words."""
    return 1 if n < LEAST else min(max(1, -(-n // 3) - 1), PART_SEEDS)


def align(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int, int]:
    """Smith-Waterman over word numbers: the best local score, the words of ``a`` it covers (start, stop), and how many of ``b``.

    Row by row, in memory for one row: a cell holds its score and, in lower bits, where its alignment began. A gap along the
    row is a running maximum, since gaps cost the same for each word. Of equal scores the shortest at the end of ``a`` wins.
    """
    n = len(b)
    if not len(a) or not n:
        return 0, 0, 0, 0
    one = 1 << 42
    column = np.arange(n + 1, dtype=np.int64)
    steps = column * (-GAP * one)
    row, best = column.copy(), (0, 0, 0, 0)
    for i, word in enumerate(a, 1):
        fresh = column + (i << 21)
        now = fresh.copy()
        now[1:] = np.maximum(np.maximum(row[:-1] + np.where(b == word, MATCH * one, MISMATCH * one), row[1:] + GAP * one), fresh[1:])
        row = np.maximum.accumulate(now + steps) - steps
        j = int(row.argmax())
        score = int(row[j]) >> 42
        if score > best[0]:
            start = int(row[j]) & (one - 1)
            best = (score, start >> 21, i, j - (start & ((1 << 21) - 1)))
    return best


def regions(words: list[str], item: list[str]) -> list[tuple[int, int]]:
    """Stretches of ``words`` that hold each passage of the item that may count. A passage has at most two words for one of the
    item, so a longer stretch is cut with that overlap."""
    number: dict[str, int] = {}
    b = np.array([number.setdefault(w, len(number)) for w in item], np.int64)
    w = np.fromiter((number.get(x, -1) for x in words), np.int64, len(words))
    if len(item) < LEAST:
        at = np.flatnonzero(np.logical_and.reduce([w[k : len(w) - len(b) + 1 + k] == x for k, x in enumerate(b)])) if len(w) >= len(b) else []
        return [(int(k), int(k) + len(b)) for k in at]
    own = np.unique(b[:-1] << 32 | b[1:])
    found = []
    for step in (1, 2):
        at = np.flatnonzero((w[:-step] >= 0) & (w[step:] >= 0))
        code = w[at] << 32 | w[at + step]
        k = np.minimum(np.searchsorted(own, code), len(own) - 1)
        found.append(at[own[k] == code])
    place = np.sort(np.concatenate(found))
    n, need = 2 * len(item) + 2, need_of(len(item))
    first, last = place[: max(0, len(place) - need + 1)], place[need - 1 :]
    near = last - first <= n
    out: list[tuple[int, int]] = []
    for p, q in zip(first[near].tolist(), last[near].tolist(), strict=True):
        p, q = max(0, q - n), min(len(words), p + n)
        if out and p <= out[-1][1]:
            p, q = out[-1][0], max(q, out.pop()[1])
        out.append((p, q))
    return [(x, min(q, x + 8 * n)) for p, q in out for x in range(p, max(p + 1, q - n), 7 * n)]


def passage(words: list[str], item: list[str]) -> tuple[float, int, int, int] | None:
    """(score against a perfect match, first word, word after the last, aligned words of the item) of the best passage of the
    item among ``words``, or nothing if none counts."""
    number: dict[str, int] = {}
    b = np.array([number.setdefault(w, len(number)) for w in item], np.int64)
    best = (0, 0, 0, 0)
    for start, stop in regions(words, item):
        a = np.fromiter((number.get(w, -1) for w in words[start:stop]), np.int64, stop - start)
        score, first, after, covered = align(a, b)
        best = max(best, (score, -(start + first), start + after, covered))
    score, first, after, covered = best
    if score and (score >= SCORE * MATCH * len(item) or covered >= PART_WORDS and score >= PART_SCORE * MATCH * covered):
        return score / (MATCH * len(item)), -first, after, covered
    return None


def _items(benchmark: DataFrame, text: str, id: str) -> DataFrame:
    """item (a hash of id and words), id, words, need, and seeds with how often the item has each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for batch in batches:
            rows = []
            for k, t in enumerate(batch.column(1)):
                w = words_of(t.as_py())
                if w:
                    h = hashes.of(w)
                    seeds, times = np.unique(pairs(h) if len(w) >= LEAST else wholes(h, len(w)), return_counts=True)
                    rows.append((k, w, need_of(len(w)), seeds.view(np.int64), times))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            types = (pa.list_(pa.string()), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))
            ids = batch.column(0).take(pa.array(columns[0], pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, t) for c, t in zip(columns[1:], types, strict=True))], names=["id", "words", "need", "seeds", "times"])

    kind = benchmark.schema[id].dataType.simpleString()
    found = benchmark.select(F.col(id).alias("id"), F.col(text).alias("text")).mapInArrow(run, f"id {kind}, words array<string>, need long, seeds array<long>, times array<long>")
    named = F.xxhash64(F.col("id").isNull(), "id", F.array_join("words", " "))
    return scratch.stored(found.withColumn("item", named).dropDuplicates(["item"]), "items")


class Bitmap:
    """Which hashes may be seeds: one bit for each value of a hash's upper bits."""

    def __init__(self, bits: int, at: np.ndarray, words: np.ndarray, runs: list[int]) -> None:
        self.shift = np.uint64(64 - bits)
        self.words = np.zeros(1 << (bits - 6), np.uint64)
        self.words[at] = words
        self.runs = runs  # lengths of short items

    def kept(self, x: np.ndarray) -> np.ndarray:
        k = x >> self.shift
        return x[(self.words[k >> np.uint64(6)] >> (k & np.uint64(63))) & np.uint64(1) == 1]

    def seeds(self, h: np.ndarray) -> np.ndarray:
        """The distinct hashes of a text's pairs and runs that may be seeds."""
        some = [pairs(h, step) for step in (1, 2) if len(h) > step] + [wholes(h, n) for n in self.runs]
        return np.unique(self.kept(np.concatenate(some))) if some else np.zeros(0, np.uint64)


def _bitmap(items: DataFrame) -> Bitmap:
    seeds = items.select(F.explode("seeds").alias("seed"))
    total = seeds.count()
    bits = min(max(BITS_LEAST, (32 * total).bit_length()), BITS_MOST)
    place = F.shiftrightunsigned("seed", 64 - bits)
    told = place.bitwiseAND(F.lit(63)).cast("int")
    rows = seeds.select(F.shiftrightunsigned(place, 6).alias("at"), F.expr("1L").alias("one"), told.alias("k")).groupBy("at").agg(F.bit_or(F.expr("shiftleft(one, k)")).alias("w")).toPandas()
    runs = sorted(r["n"] for r in items.where(F.size("words") < LEAST).select(F.size("words").alias("n")).distinct().collect())
    return Bitmap(bits, rows["at"].to_numpy(np.int64), rows["w"].to_numpy(np.int64).view(np.uint64), runs)


def _seeded(texts: DataFrame, bitmap: Bitmap) -> DataFrame:
    """t and seed: the seeds that each text may have; an equal text once a task."""
    shared = texts.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, done, bitmap = Hashes(), set(), shared.value
        for batch in batches:
            t, seeds = [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if key in done:
                    continue
                if len(done) < 1_000_000:
                    done.add(key)
                found = bitmap.seeds(hashes.of(words_of(text.as_py())))
                t.append(np.full(len(found), key, np.int64))
                seeds.append(found)
            if t:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(t)), pa.array(np.concatenate(seeds).view(np.int64))], names=["t", "seed"])

    return texts.mapInArrow(run, "t long, seed long")


def found(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_text: str = "text", item_id: str = "item_id") -> DataFrame:
    """t (the xxhash64 of a text), item_id, score, first_word, after_word and item_words of each passage that counts, the best
    one for each text and item; items with equal ids count as one."""
    items = _items(benchmark, item_text, item_id)
    texts = docs.where(F.col(text).isNotNull()).select(F.xxhash64(text).alias("t"), F.col(text).alias("text"))
    hits = scratch.stored(_seeded(texts, _bitmap(items)), "seeds")
    # of each item the most frequent seeds go, up to half of what a passage must leave
    own = items.select("item", "need", F.explode(F.arrays_zip("seeds", "times")).alias("s")).select("item", "need", F.col("s.seeds").alias("seed"), F.col("s.times").alias("times"))
    own = own.join(hits.groupBy("seed").agg(F.count("*").alias("n")), "seed")
    by_rarity = Window.partitionBy("item").orderBy(F.desc("n"), "seed").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    every = Window.partitionBy("item")
    dropped = F.when(F.sum("times").over(by_rarity) <= F.floor(F.col("need") / 2), F.col("times")).otherwise(0)
    own = own.withColumn("dropped", dropped).withColumn("need", F.col("need") - F.sum("dropped").over(every))
    rare = scratch.stored(own.where("dropped = 0").select("seed", "item", "need", "times"), "rare")
    met = hits.join(rare, "seed").groupBy("t", "item").agg(F.sum("times").alias("n"), F.first("need").alias("need"))
    met = scratch.stored(met.where("n >= need").select("t", "item"), "met")
    asked = scratch.stored(met.select("t").distinct(), "asked")
    some = texts.join(F.broadcast(asked) if asked.count() <= ASKED else asked, "t", "left_semi").dropDuplicates(["t"])
    kind = benchmark.schema[item_id].dataType
    schema = T.StructType([T.StructField("t", T.LongType()), T.StructField("id", kind), T.StructField("score", T.DoubleType()), *(T.StructField(c, T.LongType()) for c in ("first_word", "after_word", "item_words"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, words = None, []
        for batch in batches:
            rows = []
            keys = batch.column(0).to_pylist()
            for k, (text, item) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                if keys[k] != last:
                    last, words = keys[k], words_of(text.as_py())
                if p := passage(words, item.as_py()):
                    rows.append((k, *p))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            at = pa.array(columns[0], pa.int64())
            types = (pa.float64(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), *(pa.array(c, t) for c, t in zip(columns[1:], types, strict=True))], names=schema.names)

    # alignment is long work on few bytes, so the number of its tasks is set
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    joined = met.join(items.select("item", "id", "words"), "item").join(some, "t").select("t", "id", "text", "words").repartition(tasks, "t").sortWithinPartitions("t")
    best = F.max(F.struct("score", F.negative("first_word").alias("first"), "after_word", "item_words")).alias("b")
    told = joined.mapInArrow(run, schema).groupBy("t", "id").agg(best)
    return scratch.stored(told.select("t", F.col("id").alias(item_id), "b.score", F.negative("b.first").alias("first_word"), "b.after_word", "b.item_words"), "leaks")


def leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", id: str = "doc_id", item_text: str = "text", item_id: str = "item_id") -> DataFrame:
    """``id``, ``item_id``, score (1: the whole item, word for word), first_word, after_word and item_words of each passage of a
    test item that a document holds: the best one for each document and item.

    Case and punctuation do not count. A passage counts at half of a perfect score, or when at least ``PART_WORDS`` words of
    the item are aligned at ``PART_SCORE``. Null or empty texts and items match nothing, repeated rows give repeated results,
    items with equal ids count as one, and with an empty table on either side the result is empty. If the two id columns have
    one name, the item's is called item_id, or benchmark_item_id where that is the name.
    """
    hits = found(docs, benchmark, text, item_text, item_id)
    if id == item_id:
        hits = hits.withColumnRenamed(item_id, new := "item_id" if id != "item_id" else "benchmark_item_id")
        item_id = new
    own = docs.select(F.col(id), F.xxhash64(text).alias("t"), F.col(text).isNotNull().alias("told")).where("told")
    rest = [F.col(f"`{c}`") for c in hits.columns if c != "t"]
    return own.join(hits, "t").select(F.col(f"`{id}`"), *rest)


def without_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_text: str = "text", item_id: str = "item_id") -> DataFrame:
    """The rows of ``docs`` in which ``leaks`` finds nothing, as they are; null and empty texts stay. Up to ``ASKED`` leaking texts
    are taken out where the rows lie; beyond, by a shuffled join."""
    hits = found(docs, benchmark, text, item_text, item_id)
    bad = hits.select(F.col("t").alias(name := "t_" + "".join(docs.columns))).distinct()
    if bad.count() <= ASKED:
        bad = F.broadcast(bad)
    return docs.join(bad, F.col(text).isNotNull() & (F.xxhash64(text) == F.col(f"`{name}`")), "left_anti")
