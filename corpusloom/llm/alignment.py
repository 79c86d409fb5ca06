"""Alignment of two tokenizers over the same texts, and how often their tokens are linked in the corpus.

Method: a two-pointer merge of the cumulative byte ends of both token sequences gives the offsets where both end; they cut the
sequences into groups, and the two tokens that end there are a link. Both tokenizers cut at a space that follows another character
than white space, whatever stands around it, so a text is cut into units there: a worker encodes and merges each distinct unit once
while it keeps it, and a text's groups are those of its units in turn. A text with a unit whose bytes do not come out as they went in
is encoded and merged whole, and counts as without tokens if its own bytes do not.

Plan: one scan writes a row for each document with its distinct links and their numbers. Links are counted over the corpus by a
partially aggregated groupBy, which is stored, compared with the highest of their side, and joined back. Links heavier than one ``HEAVY``-th of
all are fewer than ``HEAVY``, whatever the corpus, so they are broadcast and their occurrences, nearly all, are not shuffled; the
rest joins them by a shuffle, where no key is hot.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm import scratch
from corpusloom.llm.tokenfile import busiest, slices

#: The most links that are broadcast, and the bits that a link's number in a document takes beside the link.
HEAVY, BITS = 1_000_000, 32
#: Units of a worker's table beyond which only the half that is used most stays, the longest that it keeps, and units encoded in one call.
KEPT, KEPT_CHARS, TOGETHER = 400_000, 64, 64
#: Rows and bytes of text that are aligned together.
ROWS, BYTES = 10_000, 2_000_000
_JOIN = pa.scalar(";", pa.large_string())
_RUN = re.compile(r"\s ")
_CUT = re.compile(r"(?<=\S)(?= )")


def _path(name: str) -> str:
    if "/" in name:
        return name
    import public_tokenizers

    return str(public_tokenizers.path(name))


@functools.lru_cache(maxsize=1)
def _letters() -> dict[str, int]:
    """The byte of each letter of a byte-level vocabulary: printable bytes stand for themselves, the others for letters from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class ByteLevel:
    """A byte-level BPE file of the tokenizers library; special strings in texts are plain text."""

    def __init__(self, name: str) -> None:
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(_path(name))
        self.lib.encode_special_tokens = True
        known, letters = self.lib.get_vocab(), _letters()
        self.bytes = [b""] * (max(known.values()) + 1)
        for token, i in known.items():
            self.bytes[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()

    def encode(self, text: str) -> list[int]:
        return self.lib.encode_batch_fast([text], add_special_tokens=False)[0].ids


class Pieces:
    """A model of the sentencepiece library, which puts a space before a text by itself."""

    def __init__(self, name: str) -> None:
        import sentencepiece

        self.lib = sentencepiece.SentencePieceProcessor(model_file=_path(name))
        self.bytes = [self._of(i) for i in range(self.lib.get_piece_size())]

    def _of(self, i: int) -> bytes:
        piece = self.lib.id_to_piece(i)
        return bytes([int(piece[1:-1], 16)]) if self.lib.is_byte(i) else piece.replace("▁", " ").encode()

    def encode(self, text: str) -> list[int]:
        """Of ``text`` from its second character on; the first is a space."""
        return self.lib.encode(text[1:], num_threads=1)


def merged(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """(tokens of a, tokens of b) up to each place where two ascending lists of ends meet."""
    out, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        x, y = a[i], b[j]
        i += x <= y
        j += y <= x
        if x == y:
            out.append((i, j))
    return out


class Aligned(NamedTuple):
    """Token numbers, links (a times the size of b, plus b) and groups of a text or unit; as many links as groups."""

    n_a: int
    n_b: int
    links: list[int]
    groups: str


def cut(text: str) -> list[str]:
    """The units of a space and a text, each without its leading space."""
    spaced = " " + text
    return [u[1:] for u in _CUT.split(spaced)] if _RUN.search(spaced) else text.split(" ")


class Aligner:
    """Aligns texts by two tokenizers, with a table of the units that it has met.

    Arrow looks a block's units up in the table, which holds no Python objects (some 110 bytes a unit); only distinct ones that are
    not there are met by Python."""

    def __init__(self, a: str, b: str) -> None:
        self.a, self.b = ByteLevel(a), Pieces(b)
        self.width = len(self.b.bytes)
        if len(self.a.bytes) * self.width >= 1 << 31:
            raise ValueError("a link of these vocabularies has more than 31 bits")
        self.size_a, self.size_b = (np.array([len(x) for x in t.bytes]) for t in (self.a, self.b))
        self.told = [str(i) for i in range(max(len(self.a.bytes), self.width))]
        #: The table: units, their groups (null: the unit does not come out as it went in), how many tokens of a, of b and links each has,
        #: the links one after the other, how often each was met.
        self.units, self.groups = pa.array([], pa.large_string()), pa.array([], pa.large_string())
        self.sizes, self.links, self.met = np.zeros((0, 3), np.int32), np.zeros(0, np.int32), np.zeros(0, np.int64)

    def _tokens(self, text: str) -> tuple[list[int], list[int]] | None:
        """Ids of a text that starts with a space; none where the bytes of either differ from it."""
        a, b, data = self.a.encode(text), self.b.encode(text), text.encode()
        same = b"".join(map(self.a.bytes.__getitem__, a)) == data and b"".join(map(self.b.bytes.__getitem__, b)) == data
        return (a, b) if same else None

    def _merge(self, a: list[int], b: list[int]) -> tuple[list[tuple[int, int]], list[int]]:
        ends = np.cumsum(self.size_a[a]).tolist()
        found = merged(ends, np.cumsum(self.size_b[b]).tolist())
        return found, [ends[i - 1] for i, _ in found]

    def _aligned(self, a: list[int], b: list[int], found: list[tuple[int, int]], i: int = 0, j: int = 0) -> Aligned:
        first, told, links, groups = (i, j), self.told, [], []
        for x, y in found:
            links.append(a[x - 1] * self.width + b[y - 1])
            groups.append(",".join([told[t] for t in a[i:x]]) + "|" + ",".join([told[t] for t in b[j:y]]))
            i, j = x, y
        return Aligned(i - first[0], j - first[1], links, ";".join(groups))

    def whole(self, text: str | None) -> Aligned:
        """A text's alignment without the table of units."""
        ids = self._tokens(" " + text) if text else None
        return self._aligned(*ids, self._merge(*ids)[0]) if ids else Aligned(0, 0, [], "")

    def learned(self, units: list[str]) -> list[Aligned | None]:
        """Alignments of distinct units, null where one does not come out as it went in; many are encoded as one text and told apart by
        their ends."""
        out: list[Aligned | None] = [None] * len(units)
        plain = [n for n, u in enumerate(units) if u and not u[-1].isspace()]
        for at in range(0, len(plain), TOGETHER):
            numbers = plain[at : at + TOGETHER]
            part = [units[n] for n in numbers]
            ids = self._tokens(" " + " ".join(part))
            found, ends = self._merge(*ids) if ids else ([], [])
            place = {e: k + 1 for k, e in enumerate(ends)}
            stops = np.cumsum([len(u.encode()) + 1 for u in part]).tolist()
            if not all(e in place for e in stops):
                for n in numbers:
                    out[n] = self._single(units[n])
                continue
            k = i = j = 0
            for n, e in zip(numbers, stops, strict=True):
                own = found[k : place[e]]
                out[n] = self._aligned(*ids, own, i, j)
                k, (i, j) = place[e], own[-1]
        for n, u in enumerate(units):
            if not u or u[-1].isspace():
                out[n] = self._single(u)
        return out

    def _single(self, unit: str) -> Aligned | None:
        ids = self._tokens(" " + unit)
        found, ends = self._merge(*ids) if ids else ([], [])
        return self._aligned(*ids, found) if ids and ends[-1:] == [len(unit.encode()) + 1] else None

    def block(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str], np.ndarray, np.ndarray]:
        """n_a, n_b, n_groups and groups of each text; links (with their number in the text, in the lower bits) of all and where
        each text's begin."""
        odd = [k for k, t in enumerate(texts) if t and _RUN.search(" " + t)]
        plain = sorted({k for k, t in enumerate(texts) if t}.difference(odd))
        by_space, cuts = pc.split_pattern(pa.array([texts[k] for k in plain], pa.large_string()), " "), [cut(texts[k]) for k in odd]
        units = pa.concat_arrays([by_space.flatten(), pa.array(itertools.chain.from_iterable(cuts), pa.large_string())])
        order, n = np.array([*plain, *odd], np.int64), np.array([*np.diff(by_space.offsets.to_numpy()), *map(len, cuts)], np.int64)
        found = pc.index_in(units, value_set=self.units)
        number = pc.fill_null(found, -1).to_numpy().copy()
        fresh = units.filter(found.is_null()).dictionary_encode()
        number[number < 0] = fresh.indices.to_numpy() + len(self.units)
        new = self.learned(fresh.dictionary.to_pylist())
        groups = pa.concat_arrays([self.groups, pa.array([x and x.groups for x in new], pa.large_string())])
        sizes = np.concatenate([self.sizes, np.array([(x.n_a, x.n_b, len(x.links)) if x else (0, 0, 0) for x in new], np.int32).reshape(-1, 3)])
        links = np.concatenate([self.links, np.fromiter(itertools.chain.from_iterable(x.links for x in new if x), np.int32)])
        stops, own = np.cumsum(n), sizes[number]
        sums = np.concatenate([np.zeros((1, 3), np.int64), np.cumsum(own, 0, np.int64)])
        sums = sums[stops] - sums[stops - n]
        # where each unit's links lie, and of which text they are
        many = own[:, 2]
        first = np.cumsum(sizes[:, 2], dtype=np.int64) - sizes[:, 2]
        at = np.repeat(first[number] - (np.cumsum(many, dtype=np.int64) - many), many)
        at += np.arange(len(at))
        keys = np.repeat(order << BITS, sums[:, 2]) | links[at]
        # null: a text with a unit that does not come out as it went in
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], stops]), pa.int32()), groups.take(pa.array(number))), _JOIN)
        told: list[str | None] = [""] * len(texts)
        for k, g in zip(order.tolist(), joined.to_pylist(), strict=True):
            told[k] = g
        totals = np.zeros((3, len(texts)), np.int64)
        totals[:, order] = sums.T
        alone = {k: self.whole(texts[k]) for k, g in enumerate(told) if g is None}
        if alone:
            keys = np.concatenate([keys[~np.isin(keys >> BITS, list(alone))], *(k << BITS | np.array(one.links, np.int64) for k, one in alone.items())])
        for k, one in alone.items():
            totals[:, k], told[k] = (one.n_a, one.n_b, len(one.links)), one.groups
        self._keep(fresh.dictionary, groups, sizes, links, np.bincount(number, minlength=len(sizes)))
        distinct, count = np.unique(keys, return_counts=True)
        begins = np.searchsorted(distinct >> BITS, np.arange(len(texts) + 1))
        return *totals, told, (distinct & (1 << BITS) - 1) << BITS | count, begins

    def _keep(self, fresh: pa.Array, groups: pa.Array, sizes: np.ndarray, links: np.ndarray, met: np.ndarray) -> None:
        """Put the new units into the table; of too many the ones met most stay."""
        met[: len(self.met)] += self.met
        stay = np.ones(len(sizes), bool)
        stay[len(self.met) :] = pc.less_equal(pc.utf8_length(fresh), KEPT_CHARS).to_numpy(zero_copy_only=False)
        stay = busiest(stay, met, KEPT)
        held = pa.array(stay)
        self.units, self.groups = pa.concat_arrays([self.units, fresh]).filter(held), groups.filter(held)
        self.links, self.sizes, self.met = links[np.repeat(stay, sizes[:, 2])], sizes[stay], met[stay]


@functools.lru_cache(maxsize=2)
def aligner(a: str, b: str) -> Aligner:
    return Aligner(a, b)


def aligned(docs: DataFrame, text: str = "text", id: str = "doc_id", a: str = "byte_bpe_50k.json", b: str = "piece_bpe_32k.model", groups: bool = True) -> DataFrame:
    """row (unique), ``id``, n_a, n_b, n_groups, groups_sha256, links and, if wanted, groups of each row of ``docs``.

    Texts are encoded behind a space, which ``b`` adds by itself, special strings as plain text. groups is `a1,a2|b1;a3|b2,b3`,
    groups_sha256 its digest, and links has the distinct links: a times the size of ``b`` plus b, then ``BITS`` bits for how
    often the text has it. A null or empty text, and one whose joined bytes of either side are not the text's, has no tokens:
    zeros and empty texts. Repeated rows and null ids are kept; other columns do not reach the workers."""
    kind = docs.schema[id].dataType
    fields = [("row", T.LongType()), (id, kind), ("n_a", T.LongType()), ("n_b", T.LongType()), ("n_groups", T.LongType()), ("groups_sha256", T.StringType()), ("links", T.ArrayType(T.LongType()))]
    fields += [("groups", T.StringType())] * groups

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, row = aligner(a, b), TaskContext.get().partitionId() << 33
        for batch in batches:
            for part, texts in slices(batch, 1, ROWS, BYTES):
                n_a, n_b, n_groups, told, links, first = own.block(texts)
                digests = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in told]
                columns = [pa.array(range(row, row + len(texts)), pa.int64()), part.column(0), *(pa.array(n, pa.int64()) for n in (n_a, n_b, n_groups)), pa.array(digests, pa.string())]
                columns.append(pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(links)))
                columns += [pa.array(told, pa.string())] * groups
                yield pa.RecordBatch.from_arrays(columns, names=[n for n, _ in fields])
                row += len(texts)
                pa.default_memory_pool().release_unused()  # else a worker holds the most that a block took

    schema = T.StructType([T.StructField(n, t) for n, t in fields])
    return docs.select(F.col(id), F.col(text).alias("text")).mapInArrow(run, schema)


def _links(rows: DataFrame) -> DataFrame:
    """row, link and m, its number in the row, of stored alignments."""
    each = rows.select("row", F.explode("links").alias("x"))
    return each.select("row", F.shiftrightunsigned("x", BITS).alias("link"), F.col("x").bitwiseAND((1 << BITS) - 1).alias("m"))


def counted(rows: DataFrame, b: str = "piece_bpe_32k.model") -> DataFrame:
    """link, a, b and n (how many links of the corpus are of the pair) of stored alignments, stored."""
    width = Pieces(b).lib.get_piece_size()
    return scratch.stored(_links(rows).groupBy("link").agg(F.sum("m").alias("n")).select("link", F.floor(F.col("link") / width).cast("int").alias("a"), (F.col("link") % width).cast("int").alias("b"), "n"), "pairs")


def _best(pairs: DataFrame, counts: DataFrame, side: str) -> DataFrame:
    """Pairs with best_a or best_b. A side has at most as many rows as the other's vocabulary."""
    top = counts.groupBy(side).agg(F.max("n").alias("top"))
    return pairs.join(top, side).withColumn(f"best_{side}", F.col("n") == F.col("top")).drop("top")


def pairs(rows: DataFrame, b: str = "piece_bpe_32k.model") -> DataFrame:
    """link, a, b, n (how many links of the corpus are of the pair), best_a and best_b (whether no pair of the same a, or b, has
    more) of stored alignments."""
    counts = counted(rows, b)
    return _best(_best(counts, counts, "a"), counts, "b").select("link", "a", "b", "n", "best_a", "best_b")


def alignment(docs: DataFrame, id: str = "doc_id", text: str = "text", a: str = "byte_bpe_50k.json", b: str = "piece_bpe_32k.model", heavy: int = HEAVY) -> DataFrame:
    """``id``, n_a, n_b, n_groups, n_links, n_best (links whose pair is the most frequent of its b, ties included), count_sum (the
    pairs' counts summed over the links) and groups_sha256 of each row. An empty table gives an empty result."""
    rows = scratch.stored(aligned(docs, text, id, a, b, groups=False), "aligned")
    counts = counted(rows, b)
    least = (counts.agg(F.sum("n")).first()[0] or 0) // heavy
    # n > total / heavy holds for fewer than ``heavy`` pairs
    known = _best(counts, counts, "b").select("link", "n", "best_b")
    top, rest = known.where(F.col("n") > least), known.where(F.col("n") <= least)
    sums = [F.sum("m").alias("n_links"), F.sum(F.when(F.col("best_b"), F.col("m")).otherwise(0)).alias("n_best"), F.sum(F.col("m") * F.col("n")).alias("count_sum")]
    met = _links(rows).join(F.broadcast(top), "link").groupBy("row").agg(*sums)
    if least:
        others = _links(rows).join(F.broadcast(counts.where(F.col("n") > least).select("link")), "link", "left_anti").join(rest, "link").groupBy("row").agg(*sums)
        met = met.union(others).groupBy("row").agg(*(F.sum(c).alias(c) for c in ("n_links", "n_best", "count_sum")))
    out = rows.drop("links").join(met, "row", "left")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_links", "n_best", "count_sum")]
    return out.select(id, "n_a", "n_b", "n_groups", *zero, "groups_sha256")
