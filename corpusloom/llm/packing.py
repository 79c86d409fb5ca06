"""Packing of documents into training sequences of bounded length.

Method: Karmarkar-Karp multiway differencing. Every piece starts as a partition of its own with one filled window out of k;
the two partial partitions with the largest spread are merged, the fullest windows of one onto the emptiest of the other, so
that opposing imbalances cancel, until one partition is left. k starts at the least that could hold the pool and rises
whenever a window exceeds the capacity.

Plan: one scan tokenises the documents, cuts off whole windows and writes a narrow table of pieces (about 50 bytes a
document) to the shared folder. A second scan of that table packs pools of a bounded number of pieces as they come. Nothing
is shuffled; a task holds one Arrow batch and one pool.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import scratch, vocab

CAPACITY, POOL = 4096, 768
#: Entries of a worker's table of word ids before it starts anew (about 60 MB), and the longest word that it keeps.
KEPT, KEPT_CHARS = 250_000, 48
_ID = 4  # bytes of an id


#: The word pre-tokenizer's pattern for lower-case text below U+0250, where all versions of Unicode agree and the
#: normaliser composes nothing.
_L, _N, _S = "a-zA-ZªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼-¾", r"\t\n\x0b\x0c\r \x85\xa0"
#: What is no mark in that pattern: white space, letters and numbers, as in a character class.
WORD = _S + _L + _N
PRE = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^{WORD}]+")
_BEYOND = re.compile("[^\\x00-ɏ]")


class WordIds:
    """Ids of texts as little-endian unsigned 32-bit bytes.

    BPE merges nothing across pre-tokens, so the ids of a text are those of its pre-tokens in turn. Each distinct one is
    encoded by the library once while it is kept; a text outside plain Latin, or with a special string, goes to the library
    whole.
    """

    def __init__(self, name: str) -> None:
        self.lib, self.plain = vocab.load(name), vocab.of_words(name)
        self.kept: dict[str, bytes] = {}
        self.special = [t.content for t in self.lib.get_added_tokens_decoder().values()]
        # the last piece of a pre-token, and no other, carries the mark of the word's end
        self.ends = np.zeros(self.lib.get_vocab_size(), bool)
        self.ends[[i for piece, i in self.lib.get_vocab().items() if piece.endswith("</w>")]] = True

    def block(self, texts: list[str | None]) -> list[bytes]:
        words: list[list[str] | bytes] = []
        for text in texts:
            lower = (text or "").lower()
            if _BEYOND.search(lower) or text and any(s in text for s in self.special):
                words.append(_packed(self.lib.encode(text, add_special_tokens=False).ids))
            else:
                words.append(PRE.findall(lower))
        if len(self.kept) > KEPT:
            self.kept = {}
        new = list(set().union(*(w for w in words if isinstance(w, list))).difference(self.kept))
        fresh = self.encoded(new)
        if len(fresh) > KEPT or max(map(len, new), default=0) > KEPT_CHARS:
            # too many, or too long, to keep: they serve this block only
            table = self.kept | fresh
            self.kept.update((w, b) for w, b in list(fresh.items())[:KEPT] if len(w) <= KEPT_CHARS)
        else:
            self.kept.update(fresh)
            table = self.kept
        get = table.__getitem__
        return [b"".join(map(get, w)) if isinstance(w, list) else w for w in words]

    def encoded(self, distinct: list[str], together: int = 64) -> dict[str, bytes]:
        """Ids of distinct pre-tokens of lower-case text below U+0250; some are encoded in one call and told apart by their ends."""
        out = {}
        for at in range(0, len(distinct), together):
            part = distinct[at : at + together]
            ids = np.array(self.plain.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) == len(part):
                data, start = ids.tobytes(), 0
                for w, stop in zip(part, (cuts * _ID).tolist(), strict=True):
                    out[w] = data[start:stop]
                    start = stop
            else:
                out.update((w, _packed(self.lib.encode(w, add_special_tokens=False).ids)) for w in part)
        return out


def _packed(ids: list[int]) -> bytes:
    return np.array(ids, "<u4").tobytes()


_words: dict[str, WordIds] = {}


def word_ids(name: str) -> WordIds:
    if name not in _words:
        _words[name] = WordIds(name)
    return _words[name]


def pieces_of(ids: bytes, capacity: int) -> Iterator[tuple[int, int, int]]:
    """(start, length, crc32) of a document's whole windows and of the rest."""
    n = len(ids) // _ID
    for start in range(0, n, capacity):
        part = ids[start * _ID : (start + capacity) * _ID]
        yield start, len(part) // _ID, zlib.crc32(part)


def differencing(sizes: list[int], k: int) -> list[list[int]]:
    """Karmarkar-Karp multiway differencing of the pieces into ``k`` windows; returns each window's piece numbers.

    A partial partition lists its filled windows, fullest first, as (sum, tree of pieces); the other windows are empty.
    """
    if not sizes:
        return []
    heap = [(-s, i, [(s, i)]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    ticket = len(sizes)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heap[0]
        shared = len(a) + len(b) - k
        if shared <= 0:
            merged = a + b
        else:
            # the emptiest filled windows of each meet; what is fuller stands opposite an empty window of the other
            x, y = a[len(a) - shared :], b[len(b) - shared :]
            merged = a[: len(a) - shared] + b[: len(b) - shared]
            merged += [(p[0] + q[0], (p[1], q[1])) for p, q in zip(x, reversed(y), strict=True)]
        merged.sort(key=_sum, reverse=True)
        ticket += 1
        low = merged[-1][0] if len(merged) == k else 0
        heapq.heapreplace(heap, (low - merged[0][0], ticket, merged))
    out = []
    for _, tree in heap[0][2]:
        members, stack = [], [tree]
        while stack:
            t = stack.pop()
            if isinstance(t, tuple):
                stack.extend(t)
            else:
                members.append(t)
        out.append(sorted(members))
    return out


def _sum(window: tuple) -> int:
    return window[0]


def packed(sizes: list[int], capacity: int) -> list[list[int]]:
    """Windows of at most ``capacity``: the fewest that the sum allows, one more each time that a window exceeds it."""
    k = max(1, -(-sum(sizes) // capacity))
    while True:
        windows = differencing(sizes, k)
        if all(sum(sizes[i] for i in w) <= capacity for w in windows):
            return windows
        k += 1


def pack(docs: DataFrame, text: str = "text", id: str = "doc_id", tokenizer: str = "word_bpe_49k.json", end_id: int = 2, capacity: int = CAPACITY, pool: int = POOL, rows: int = 256) -> DataFrame:
    """One row for each piece: ``id``, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document's ids are its text's (null: none) and ``end_id`` after them, so each row of ``docs``, repeated ones and empty
    texts included, has a piece. Ids longer than ``capacity`` are cut into whole windows, which are sequences of their own,
    and a rest. sequence_id is the task's number times 2^32 plus a running number; offsets in a sequence have no gaps.
    An empty table gives an empty result.
    """
    kind = docs.schema[id].dataType.simpleString()
    names = [id, "start", "length", "ids_crc32", "doc_tokens"]
    end = end_id.to_bytes(_ID, "little")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = word_ids(tokenizer)
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                out: list[tuple] = []
                for doc, ids in zip(part.column(0).to_pylist(), ids_of.block(part.column(1).to_pylist()), strict=True):
                    ids += end
                    out.extend((doc, *p, len(ids) // _ID) for p in pieces_of(ids, capacity))
                yield _batch(out, part.schema.field(0).type, names)

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        given, schema, waiting = 0, None, []

        def sequences(groups: list[list[tuple]]) -> pa.RecordBatch:
            nonlocal given
            out = []
            for group in groups:
                offset = 0
                for p in group:
                    out.append((*p, first + given, offset))
                    offset += p[2]
                given += 1
            return _batch(out, schema, [*names, "sequence_id", "offset"])

        for batch in batches:
            schema = batch.schema.field(0).type
            whole = []
            for p in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                (whole if p[2] == capacity else waiting).append([p] if p[2] == capacity else p)
            if whole:
                yield sequences(whole)
            while len(waiting) >= pool:
                now, waiting = waiting[:pool], waiting[pool:]
                yield sequences([[now[i] for i in w] for w in packed([p[2] for p in now], capacity)])
        if waiting:
            yield sequences([[waiting[i] for i in w] for w in packed([p[2] for p in waiting], capacity)])

    schema = f"`{id}` {kind}, start long, length long, ids_crc32 long, doc_tokens long"
    table = scratch.stored(docs.select(F.col(id), F.col(text).alias("text")).mapInArrow(cut, schema), "pieces")
    return table.mapInArrow(windows, schema + ", sequence_id long, offset long")


def _batch(rows: list[tuple], id_type: pa.DataType, names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, id_type if k == 0 else pa.int64()) for k, c in enumerate(columns)], names=names)
