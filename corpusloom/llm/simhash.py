"""SimHash fingerprints of documents and the groups of those that differ in few bits.

Method: deletion-variant signatures. Fingerprints within d bits of each other, cut into d // 2 + 1 segments, have a segment
that differs in at most one bit. Each segment is therefore indexed once for each of its bits with that bit left out; two
segments that differ in at most one bit share such a variant, so an equality join on the variants meets every pair, which is
then verified. At d = 4 that is 3 segments and 64 variants of a 64-bit fingerprint.

Plan: equal fingerprints are one node from the start (a group of exact copies of any size is one row). The variants of the
distinct fingerprints are shuffled by key; a task reads its keys in order, compares what shares a key, and puts out only the
links that connect, not the pairs. Keys of more than ``BLOCK`` fingerprints go another way: a sample tells them beforehand, so
that their rows never meet in one task, and what it overlooks is handed on in blocks by the task that finds it. Heavy keys are
cut into blocks by a hash of fingerprint and key, and linked within the blocks; as the same group of copies has some sixty
heavy keys, each with other blocks, that connects it. Only the keys that then still hold several components have every pair
of their blocks compared, each pair as a group of its own. Memory is bounded, and no pair is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import graph, scratch

BITS, WORDS, DISTANCE, SEED, BLOCK = 64, 4, 4, 42, 2048
#: One in so many fingerprints is looked at to tell heavy keys; heavy keys that are broadcast (16 bytes each), else joined.
SAMPLED, BROADCAST_KEYS = 64, 100_000


def fingerprint(text: str | None, words: int = WORDS, seed: int = SEED) -> int:
    """Words are runs without ASCII white space, A-Z lower-cased; h is the XXH64 of each shingle of ``words``, repeats
    included, joined by a space. A bit is 1 if it is set in over half the h. A shorter text is one shingle; none gives 0."""
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    shingles = map(b" ".join, zip(*(w[k:] for k in range(words)), strict=False)) if len(w) >= words else [b" ".join(w)]
    digest = xxhash.xxh64_intdigest
    return int(majority(np.array([digest(s, seed) for s in shingles], "<u8")).view(np.uint64))


def majority(h: np.ndarray) -> np.int64:
    """The bits that are set in over half of the hashes."""
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(h), 8192):
        ones += np.unpackbits(h[at : at + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(2 * ones > len(h), bitorder="little").view("<i8")[0]


def fingerprints(docs: DataFrame, text: str = "text", id: str = "doc_id", words: int = WORDS, seed: int = SEED) -> DataFrame:
    """``id`` and fp (the fingerprint as a signed long) of each row; a null text is one without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # a scalar at a time, so that a batch of very long texts is not held twice
            fp = np.array([fingerprint(t.as_py(), words, seed) for t in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64), pa.int64())], names=[id, "fp"])

    kind = docs.schema[id].dataType.simpleString()
    return docs.select(F.col(id), F.col(text).alias("text")).mapInArrow(run, f"`{id}` {kind}, fp long")


def segments(distance: int, bits: int = BITS) -> list[tuple[int, int]]:
    """(offset, width) of the fewest segments of which one differs in at most one bit."""
    n = distance // 2 + 1
    cuts = [bits * k // n for k in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def variants(fp: Column, distance: int) -> Column:
    """Array of a fingerprint's keys: each segment without each of its bits, with the bit's number above."""
    out = []
    for offset, width in segments(distance):
        part = F.shiftrightunsigned(fp, offset).bitwiseAND(_long((1 << width) - 1))
        for b in range(width):
            low = part.bitwiseAND(_long((1 << b) - 1))
            high = F.shiftrightunsigned(part, b + 1)
            if width <= 56:
                out.append(low.bitwiseOR(F.shiftleft(high, b)).bitwiseOR(_long((offset + b) << 56)))
            else:
                out.append(F.xxhash64(F.lit(offset + b), low, high))
    return F.array(*out)


def _long(x: int) -> Column:
    return F.lit(x - (1 << 64) if x >= 1 << 63 else x).cast("long")


def near(x: np.ndarray, distance: int) -> np.ndarray:
    """Which differences of signed longs have few bits (the count of a signed number would be that of its absolute value)."""
    return np.bitwise_count(x.view(np.uint64)) <= distance


def spanning(fps: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links that connect what is connected within ``distance`` among ``fps``: a spanning forest, by breadth-first search.

    Each fingerprint taken is compared only with those not yet reached, so a tight group costs little more than its size.
    """
    left, out = fps, []
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            hit = near(left ^ at, distance)
            if hit.any():
                found = left[hit]
                out.extend((at, f) for f in found)
                queue.extend(found)
                left = left[~hit]
    return out


def links(distinct: DataFrame, distance: int = DISTANCE, block: int = BLOCK) -> DataFrame:
    """Links (a, b) between fingerprints ``fp``, which are distinct, that connect all pairs within ``distance`` bits."""
    empty = np.zeros(0, np.int64)

    def batch_of(a: np.ndarray, b: np.ndarray, key: np.ndarray, part: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (a, b, key, part)], names=["a", "b", "key", "part"])

    def linked(pairs: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        a, b = (np.concatenate([p[side] for p in pairs] or [empty]) for side in (0, 1))
        edges = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
        none = pa.nulls(len(edges), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(edges[:, 0]), pa.array(edges[:, 1]), none, none], names=["a", "b", "key", "part"])

    def heavy(key: int, fps: np.ndarray, part: int) -> pa.RecordBatch:
        return batch_of(fps, fps, np.full(len(fps), key), np.full(len(fps), part))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows come in order of key; ``held`` is the open key's rows, ``parts`` how many blocks of it have gone out
        keys, held, parts = empty, empty, 0
        for batch in batches:
            k, f = (np.concatenate([x, c.to_numpy(zero_copy_only=False)]) for x, c in zip((keys, held), batch.columns, strict=True))
            starts = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else empty
            stops = np.r_[starts[1:], len(k)]
            pairs = []
            if parts and len(starts) > 1:
                # what is left of the key whose blocks have gone out
                yield heavy(k[0], f[: stops[0]], parts)
                starts, stops, parts = starts[1:], stops[1:], 0
            if len(starts):
                closed = slice(starts[0], starts[-1])
                pairs += _small(k[closed], f[closed], starts[:-1] - starts[0], stops[:-1] - starts[0], distance)
                for a, b in zip(starts[:-1], stops[:-1], strict=True) if len(starts) > 1 else ():
                    if b - a > block:
                        for n, at in enumerate(range(a, b, block)):
                            yield heavy(k[a], f[at : min(at + block, b)], n)
                keys, held = k[starts[-1] :], f[starts[-1] :]
                while len(held) > block:
                    yield heavy(keys[0], held[:block], parts)
                    keys, held, parts = keys[block:], held[block:], parts + 1
            if pairs:
                yield linked(pairs)
        if parts:
            yield heavy(keys[0], held, parts)
        elif len(held) > 1:
            yield linked(_small(keys, held, np.array([0]), np.array([len(held)]), distance))

    def _small(k: np.ndarray, f: np.ndarray, starts: np.ndarray, stops: np.ndarray, distance: int) -> list:
        """Links within the keys of at most ``block`` rows; the keys of few rows all at once, by neighbours at each offset."""
        few, out = 12, []
        sizes = stops - starts
        size_of = np.repeat(sizes, sizes)
        small = size_of <= few
        for d in range(1, min(few, int(sizes.max(initial=0)))):
            hit = (k[d:] == k[:-d]) & small[d:]
            hit[hit] = near(f[d:][hit] ^ f[:-d][hit], distance)
            if hit.any():
                out.append((f[:-d][hit], f[d:][hit]))
        for a, b in zip(starts[(sizes > few) & (sizes <= block)], stops[(sizes > few) & (sizes <= block)], strict=True):
            if edges := spanning(f[a:b], distance):
                x = np.array(edges, np.int64)
                out.append((x[:, 0], x[:, 1]))
        return out

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows come in order of (key, pair of blocks): each group has at most two blocks
        now, held = None, empty
        names = ["a", "b"]

        def close() -> Iterator[pa.RecordBatch]:
            if len(held) > 1 and (edges := spanning(held, distance)):
                x = np.array(edges, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(x.min(1)), pa.array(x.max(1))], names=names)

        for batch in batches:
            g = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], 1)
            cuts = np.flatnonzero((g[1:, :3] != g[:-1, :3]).any(1)) + 1
            for part in np.split(g, cuts):
                if not len(part):
                    continue
                if now is None or (part[0, :3] != now).any():
                    yield from close()
                    now, held = part[0, :3].copy(), empty
                held = np.concatenate([held, part[:, 3]])
        yield from close()

    keyed = distinct.select("fp", F.explode(variants(F.col("fp"), distance)).alias("key")).select("key", "fp")
    # keys that a sample shows to be heavy skip the path by key; which way a key goes does not change its links
    sample = distinct.where(F.pmod(F.xxhash64("fp", F.lit("sample")), F.lit(SAMPLED)) == 0)
    counts = sample.select(F.explode(variants(F.col("fp"), distance)).alias("key")).groupBy("key").agg((F.count("*") * SAMPLED).alias("n")).where(F.col("n") > block)
    known = scratch.stored(counts.select("key", F.ceil(F.col("n") / block).alias("parts")), "heavy-keys")
    size = known.count()
    small = F.broadcast(known) if size <= BROADCAST_KEYS else known
    light = keyed.join(small, "key", "left_anti") if size else keyed
    grouped = light.repartition("key").sortWithinPartitions("key", "fp")
    found = scratch.stored(grouped.mapInArrow(run, "a long, b long, key long, part long"), "links")
    few = found.where("key is not null").select("key", F.col("a").alias("fp"))
    first = found.where("key is null").select("a", "b")
    sizes = few.groupBy("key").agg(F.ceil(F.count("*") / block).alias("parts"))
    many = few.join(sizes, "key").unionByName(keyed.join(small, "key").select("key", "fp", "parts")) if size else few.join(sizes, "key")
    # blocks of a heavy key, other ones for each key, so that what the keys link in their blocks joins up between them
    many = scratch.stored(many.select("key", F.pmod(F.xxhash64("fp", "key"), F.col("parts")).alias("part"), "fp"), "heavy")
    if many.isEmpty():
        return first.distinct()
    within = many.select("key", F.col("part").alias("i"), F.col("part").alias("j"), "fp").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "fp")
    near_by = scratch.stored(first.union(within.mapInArrow(blocks, "a long, b long")).distinct(), "links")
    # a heavy key whose fingerprints are all connected by now is done with; of the others every pair of blocks is compared
    parts = graph.components(near_by).withColumnRenamed("node", "fp")
    of = many.join(parts, "fp", "left").select("key", "part", "fp", F.coalesce("component", "fp").alias("component"))
    apart = of.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.max("part").alias("last")).where("x <> y").select("key", "last")
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"))).alias("other")
    dealt = many.join(apart, "key").select("key", "part", "fp", other).where("part <> other")
    dealt = dealt.select("key", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "fp")
    dealt = dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "fp")
    return near_by.union(dealt.mapInArrow(blocks, "a long, b long")).distinct()


def near_duplicates(docs: DataFrame, text: str = "text", id: str = "doc_id", distance: int = DISTANCE, words: int = WORDS, seed: int = SEED) -> DataFrame:
    """``id``, fingerprint (16 lower-case hex digits) and component_id (the smallest ``id`` reachable over fingerprints that
    differ in at most ``distance`` bits, itself included) of each row.

    Texts without words, nulls included, have fingerprint zero and are linked like any other. Repeated rows stay. A null id
    is never a component's name unless all its ids are null. An empty table gives an empty result.
    """
    marked = scratch.stored(fingerprints(docs, text, id, words, seed), "fingerprints")
    nodes = scratch.stored(marked.groupBy("fp").agg(F.min(id).alias("least")), "nodes")
    found = graph.components(links(nodes.select("fp"), distance))
    joined = scratch.stored(nodes.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("component")), "joined")
    # stored: joins of scans are split where a component or a fingerprint has very many rows, those with an aggregate on its key are not
    named = scratch.stored(joined.groupBy("component").agg(F.min("least").alias("component_id")), "named")
    of = scratch.stored(joined.join(named, "component").select("fp", "component_id"), "components")
    return marked.join(of, "fp").select(id, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
