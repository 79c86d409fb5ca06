"""Groups of near copies: texts whose five-word shingles have a similarity of at least 0.8, found without loss.

Similarity is shared over all shingles, repeats counted, of words lower-cased between ASCII white space; a text of fewer than
five words is one shingle. Candidates come from two sources, and each is verified on whole shingle sets before it links.

1. ``simhash``: fingerprints of the shingles within four bits, met over deletion-variant signatures. At a similarity of 0.8 two
   fingerprints differ in about ten of 64 bits, so this source alone finds close copies only.
2. A prefix-filtered join for all others. With shingles in any order that all texts share, two texts of similarity t have one
   in common among the first n - ceil(t n) + 1 of each, whatever their lengths. The order puts shingles that a sample shows to
   be common last, so that lines many texts share bring few of them together.

Two sets differ in at least as many shingles as the bits in which their parities differ, shingles dealt over about n bits; that
rules out nearly all candidates below 0.75 before any set is read.

Common shingles hold the hot groups, so their rows never meet by key: each text is tried against the one of its key, and of
its block of the key, with the fewest rare shingles, and only the keys that then still hold several components have the
others compared with the rest, in blocks, by sketches where they meet. There a text with ``a`` rare shingles of n, one with ``b`` of m, and no rare one in common, as
else the rare shingle's key has them, reach 0.8 only if 9 (a + b) <= n + m; so one of the two has 9 a <= n, and texts that
add more of their own to a shared passage are never compared with each other.

Plan: equal texts are one node. One scan of the texts marks them, another one reads the candidates' sets again (filtered by a
hash of the text before it reaches Python), so texts are not shuffled but where more than ``ASKED`` are candidates.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm import graph, scratch, simhash

#: Words of a shingle; nodes of a key that are compared at once; nodes of a block of a larger key.
WORDS, FEW, BLOCK = 5, 32, 256
#: One in so many texts is looked at to tell common shingles, how often one is seen there to count as common, and how many are
#: kept at most (16 bytes each in every task). The order of shingles decides the cost only.
SAMPLED, SEEN, COMMON = 16, 3, 200_000
#: Candidates whose texts are picked by a broadcast table (16 bytes each); beyond, by a shuffled join.
ASKED = 1_000_000
#: Least bits of a sketch; a larger set has the next power of two.
PARITIES = 512
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
_TABLE = 22  # bits of the table that most shingles are told not to be common by


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def node_of(words: list[bytes]) -> int:
    """One number for equal sequences of words, as a signed long; none gives 0."""
    x = xxhash.xxh3_64_intdigest(b" ".join(words), 7) if words else 0
    return x - (1 << 64) if x >> 63 else x


def hashes(words: list[bytes]) -> np.ndarray:
    """A hash of each shingle in turn."""
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < WORDS:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), 1)], np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = len(words) - WORDS + 1
    return _mixed(sum(h[k : k + n] * f for k, f in enumerate(_FACTORS)))


def distinct(x: np.ndarray) -> np.ndarray:
    """Of hashes of shingles those of (shingle, which of its repeats), ascending."""
    x = np.sort(x)
    same = np.flatnonzero(x[1:] == x[:-1]) + 1
    if not len(same):
        return x
    first = np.flatnonzero(np.r_[True, x[1:] != x[:-1]])
    repeat = np.arange(len(x)) - np.repeat(first, np.diff(np.r_[first, len(x)]))
    x[same] = _mixed(x[same] + repeat[same].astype(np.uint64) * _FACTORS[0])
    return np.sort(x)


def shingles(words: list[bytes]) -> np.ndarray:
    return distinct(hashes(words))


class Common:
    """The shingles that a sample shows to be common, and how often it has each."""

    def __init__(self, keys: np.ndarray, seen: np.ndarray) -> None:
        order = np.argsort(keys)
        self.keys, self.seen = keys[order], seen[order]
        self.table = np.zeros(1 << _TABLE, bool)
        self.table[self.keys >> np.uint64(64 - _TABLE)] = True

    def times(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), np.int64)
        if len(self.keys):
            at = np.flatnonzero(self.table[x >> np.uint64(64 - _TABLE)])
            k = np.minimum(np.searchsorted(self.keys, x[at]), len(self.keys) - 1)
            out[at] = np.where(self.keys[k] == x[at], self.seen[k], 0)
        return out

    def prefix(self, x: np.ndarray) -> tuple[np.ndarray, int]:
        """The first n - ceil(0.8 n) + 1 shingles, by how often the sample has them, then by hash; how many of all are rare."""
        n = len(x)
        times = self.times(x)
        rare = int((times == 0).sum())
        if rare < n:
            x = x[np.argsort(times, kind="stable")]
        return x[: n - -(-4 * n // 5) + 1], rare


def sketch(x: np.ndarray) -> np.ndarray:
    """Parities of the shingles as longs, over a power of two of bits: ``PARITIES``, or as many as there are shingles."""
    bits = max(PARITIES, 1 << (len(x) - 1).bit_length()) if len(x) else PARITIES
    odd = np.bincount((x & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _common(texts: DataFrame) -> Common:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(shingles(words_of(t.as_py())).view(np.int64))], names=["key"])

    some = texts.where(F.pmod("t", F.lit(SAMPLED)) == 0).select("text")
    rows = some.mapInArrow(run, "key long").groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") >= SEEN)
    rows = rows.orderBy(F.desc("n"), "key").limit(COMMON).toPandas()
    return Common(rows["key"].to_numpy(np.int64).view(np.uint64), rows["n"].to_numpy(np.int64))


def _sets(texts: DataFrame) -> DataFrame:
    """node and set of each text; a node may repeat, once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        for batch in batches:
            for t in batch.column(0):
                w = words_of(t.as_py())
                node = node_of(w)
                if node not in done:
                    if len(done) < 1_000_000:
                        done.add(node)
                    x = pa.array([shingles(w).view(np.int64)], pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_arrays([pa.array([node], pa.int64()), x], names=["node", "set"])

    return texts.select("text").mapInArrow(run, "node long, set array<long>")


def _apart(s: Column, t: Column) -> Column:
    """Bits in which two sketches differ, the longer one folded to the length of the other (one is at most twice the other)."""
    half = F.least(F.size(s), F.size(t))

    def folded(x: Column) -> Column:
        return F.when(F.size(x) == half, x).otherwise(F.zip_with(F.slice(x, F.lit(1), half), F.slice(x, half + 1, half), lambda p, q: p.bitwiseXOR(q)))

    bits = F.zip_with(folded(s), folded(t), lambda p, q: F.bit_count(p.bitwiseXOR(q)))
    return F.aggregate(bits, F.lit(0), lambda at, b: at + b)


def _narrow(s: Column) -> Column:
    """A sketch folded to ``PARITIES`` bits, as fields b0, b1, ..."""
    n = PARITIES // 64

    def folded(k: int) -> Column:
        every = F.filter(s, lambda _, i: F.pmod(i, F.lit(n)) == k)
        return F.aggregate(every, F.lit(0).cast("long"), lambda at, x: at.bitwiseXOR(x))

    return F.struct(*[F.when(F.size(s) == n, s[k]).otherwise(folded(k)).alias(f"b{k}") for k in range(n)])


def _verified(texts: DataFrame, pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b) of similarity 0.8 or more; a pair's sizes may not be further apart than that."""
    one = nodes.select(F.col("node").alias("a"), F.col("n").alias("n"), F.col("sketch").alias("s"))
    two = nodes.select(F.col("node").alias("b"), F.col("n").alias("m"), F.col("sketch").alias("t"))
    sizes = F.least("n", "m") * 5 >= F.greatest("n", "m") * 4
    may = pairs.distinct().join(one, "a").join(two, "b").where(sizes).where(_apart(F.col("s"), F.col("t")) * 9 <= F.col("n") + F.col("m"))
    pairs = scratch.stored(may.select("a", "b"), "candidates")
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    ends = scratch.stored(ends.join(nodes.select("node", "t"), "node").select("t").distinct(), "ends")
    some = texts.join(F.broadcast(ends) if ends.count() <= ASKED else ends, "t", "left_semi")
    sets = scratch.stored(_sets(some).groupBy("node").agg(F.first("set").alias("set")), "sets")
    met = pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("set").alias("y")), "b")
    return scratch.stored(met.where(F.size(F.array_intersect("x", "y")) * 9 >= (F.size("x") + F.size("y")) * 4).select("a", "b"), "copies")


def _may(p: Column, q: Column) -> Column:
    """Whether two texts that share a key can reach 0.8: by their sizes, the key's places in them, and their rare shingles."""
    n, i, m, j = p["n"], p["i"], q["n"], q["i"]
    most = F.least(i, j) + 1 + F.least(n - i - 1, m - j - 1)
    return (F.least(n, m) * 5 >= F.greatest(n, m) * 4) & (most * 9 >= (n + m) * 4) & ((p["a"] + q["a"]) * 9 <= n + m)


def near_copies(docs: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """``id`` and component_id (the smallest ``id`` of its group) of each row: groups of exact copies and of texts linked by a
    similarity of at least 0.8. Nulls and texts without words are a group; repeated rows stay. A null ``id`` names a group only
    where all its ids are null. An empty table gives an empty result."""
    texts = docs.select(F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("t"))
    shared = docs.sparkSession.sparkContext.broadcast(_common(texts))
    names = [id, "t", "node", "n", "a", "fp", "sketch", "prefix"]
    none = np.zeros(0, np.int64)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a node's marks are put out once a task
        common, done = shared.value, set()
        for batch in batches:
            rows = []
            for t in batch.column(2):
                w = words_of(t.as_py())
                node = node_of(w)
                if not w or node in done:
                    rows.append((node, -1, 0, 0, none, none))
                    continue
                if len(done) < 1_000_000:
                    done.add(node)
                h = hashes(w)
                x = distinct(h)
                first, rare = common.prefix(x)
                rows.append((node, len(x), rare, simhash.majority(h), sketch(x), first.view(np.int64)))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
            types = [pa.int64()] * 4 + [pa.list_(pa.int64())] * 2
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, k) for c, k in zip(columns, types, strict=True))], names=names)

    kind = docs.schema[id].dataType.simpleString()
    given = docs.select(F.col(id), F.xxhash64(F.col(text)).alias("t"), F.col(text).alias("text"))
    marked = scratch.stored(given.mapInArrow(mark, f"`{id}` {kind}, t long, node long, n long, a long, fp long, sketch array<long>, prefix array<long>"), "marked")
    nodes = scratch.stored(marked.where("n > 0").select(*names[1:]).dropDuplicates(["node"]), "nodes")

    # close copies: from each fingerprint's texts to one of them, and between the fingerprints that link
    of = nodes.groupBy("fp").agg(F.min("node").alias("top"))
    own = nodes.select("node", "fp").join(of, "fp").where("node <> top").select(F.col("top").alias("a"), F.col("node").alias("b"))
    met = simhash.links(of.select("fp")).select(F.col("a").alias("fp"), F.col("b").alias("other"))
    met = met.join(of, "fp").join(of.select(F.col("fp").alias("other"), F.col("top").alias("next")), "other")
    pairs = own.union(met.select(F.least("top", "next"), F.greatest("top", "next")))

    places = nodes.select("node", "n", "a", F.posexplode("prefix").alias("i", "key"))
    rare = places.where("i < a").select("key", "node", (F.shiftleft("n", 32) + F.col("i")).alias("n"))
    rare = rare.withColumn("size", F.count("*").over(Window.partitionBy("key"))).where("size > 1")
    rare = scratch.stored(rare.select("key", "size", F.struct("node", F.shiftright("n", 32).alias("n"), (F.col("n") % (1 << 32)).alias("i"), F.lit(0).cast("long").alias("a")).alias("own")), "keys")
    few = rare.where(F.col("size") <= FEW)
    one, two = few.select("key", F.col("own").alias("p")), few.select("key", F.col("own").alias("q"))
    both = one.join(two, "key").where((F.col("p.node") < F.col("q.node")) & _may(F.col("p"), F.col("q")))
    pairs = pairs.union(both.select("p.node", "q.node"))

    frequent = places.where("i >= a").select("key", F.struct("node", "n", F.col("i").cast("long").alias("i"), "a").alias("own"))
    large = scratch.stored(frequent.union(rare.where(F.col("size") > FEW).select("key", "own")), "large")
    # of each key, and of each block of it, the text with the fewest rare shingles
    first = F.min(F.struct(F.col("own.a"), F.col("own.node"), "own")).alias("first")
    hubs = scratch.stored(large.groupBy("key").agg(F.count("*").alias("size"), first).where("size > 1").select("key", F.floor((F.col("size") - 1) / BLOCK).alias("last"), F.col("first.own").alias("hub")), "hubs")
    block = F.pmod(F.xxhash64("own.node", "key"), F.col("last") + 1).alias("block")
    dealt = scratch.stored(large.join(hubs, "key").select("key", "own", "hub", "last", block), "dealt")
    near = dealt.where("last > 0").groupBy("key", "block").agg(first).select("key", "block", F.col("first.own").alias("q"))
    tries = dealt.select(F.col("own").alias("p"), F.col("hub").alias("q")).union(dealt.where("last > 0").join(near, ["key", "block"]).select(F.col("own").alias("p"), "q"))
    tries = tries.where((F.col("p.node") != F.col("q.node")) & _may(F.col("p"), F.col("q")))
    pairs = pairs.union(tries.select(F.least("p.node", "q.node"), F.greatest("p.node", "q.node")))
    found = _verified(texts, pairs, nodes)
    parts = graph.components(found)

    # of the larger keys those that are not of one component by now: what may link between components, in blocks
    # (stored tables on both sides of a join by key: those are the ones that adaptive execution splits)
    named = scratch.stored(dealt.withColumn("node", F.col("own.node")).join(parts, "node", "left").withColumn("component", F.coalesce("component", "node")), "named")
    apart = scratch.stored(named.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("key"), "keys-apart")
    rest = scratch.stored(named.join(apart, "key").select("key", "block", "last", "own", "component"), "rest")
    if not rest.isEmpty():
        # of two that differ in component one is outside of the key's largest, and their sketches are compared where they meet
        largest = scratch.stored(rest.groupBy("key", "component").agg(F.count("*").alias("rows")).groupBy("key").agg(F.max_by("component", F.struct("rows", "component")).alias("largest")), "largest")
        told = rest.join(largest, "key").join(nodes.select(F.col("node").alias("of"), _narrow(F.col("sketch")).alias("bits")), F.col("own.node") == F.col("of"))
        told = told.select("key", "block", "last", "own", "component", "bits", (F.col("component") != F.col("largest")).alias("minor"))
        of_block = F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"))).alias("block")
        one = told.where("minor").select("key", of_block, F.col("own").alias("p"), F.col("component").alias("x"), F.col("bits").alias("s"))
        two = told.select("key", "block", F.col("own").alias("q"), F.col("component").alias("y"), F.col("bits").alias("t"), "minor")
        once = ~F.col("minor") | (F.col("p.node") < F.col("q.node"))
        bits = sum((F.bit_count(F.col(f"s.b{k}").bitwiseXOR(F.col(f"t.b{k}"))) for k in range(PARITIES // 64)), F.lit(0))
        met = one.join(two, ["key", "block"]).where((F.col("x") != F.col("y")) & once & _may(F.col("p"), F.col("q")) & (bits * 9 <= F.col("p.n") + F.col("q.n")))
        more = _verified(texts, met.select(F.least("p.node", "q.node").alias("a"), F.greatest("p.node", "q.node").alias("b")), nodes)
        if not more.isEmpty():
            parts = graph.components(found.union(more))
    least = marked.groupBy("node").agg(F.min(id).alias("least"))
    joined = least.join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    top = joined.groupBy("component").agg(F.min("least").alias("component_id"))
    groups = scratch.stored(joined.join(top, "component").select("node", "component_id"), "groups")
    return marked.select(id, "node").join(groups, "node").select(id, "component_id")
