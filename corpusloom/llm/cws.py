"""Document fingerprints by consistent weighted sampling.

Method: a document is a set of weighted terms, its word shingles with their frequencies. For each of k samples a term of weight
S gets, from gamma variates r, c ~ Gamma(2, 1) and a uniform b that depend on the term and the sample's number alone,
t = floor(ln S / r + b), y = exp(r (t - b)) and a = c / (y e^r). The term with the smallest a, with its t, is the sample. Two
documents share a sample with a probability equal to their generalised Jaccard similarity, sum of min / sum of max of weights.

Plan: one shuffle of the texts by ranges of id, in which each range also gets the first document of the next one, so that a
task reads its documents in order and holds one neighbour at a time. Ranges are cut at quantiles of the id column alone; there are
as many as shuffle partitions, one for each, so what the driver holds depends on that setting and not on the rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Samples of a fingerprint, words of a shingle.
SAMPLES, WORDS = 64, 5
#: Ids for each range (about) that the ends of ranges are told from.
ENDS_SAMPLE = 200
_ROWS = 512  # terms at a time: a block of terms by samples stays in a core's cache
#: Odd multipliers of the mixing steps.
_M, _ODD = 0xFF51AFD7ED558CCD, 0x9E3779B97F4A7C15


def shingles(text: str, words: int = WORDS, known: np.ndarray | None = None) -> np.ndarray:
    """Hashes of the shingles in turn; words are lower-cased runs between white space, and of fewer words the whole sequence
    is one shingle. ``known`` are the first hashes, where the caller has them."""
    w = text.lower().split()
    if known is None or len(w) < words:
        known = np.zeros(0, np.uint64)
    w = w[len(known) :]
    if not w:
        return known
    parts = map(" ".join, zip(*(w[k:] for k in range(words)), strict=False)) if len(w) >= words else [" ".join(w)] if not len(known) else []
    digest = xxhash.xxh3_64_intdigest
    return np.concatenate([known, np.fromiter((digest(s) for s in parts), np.uint64)])


def weighted(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes, ascending, and how often each occurs."""
    h, n = np.unique(hashes, return_counts=True)
    return h, n.astype(float)


def terms(text: str, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    return weighted(shingles(text, words))


def _mix(x: np.ndarray) -> np.ndarray:
    x ^= x >> np.uint64(33)
    x *= np.uint64(_M)
    x ^= x >> np.uint64(29)
    return x


def _quantiles(n: int) -> np.ndarray:
    """Gamma(2, 1) at the middles of n equal shares of probability, by bisection of its distribution function."""
    p = (np.arange(n) + 0.5) / n
    low, high = np.zeros(n), np.full(n, 64.0)
    for _ in range(60):
        x = (low + high) / 2
        under = 1 - (1 + x) * np.exp(-x) < p
        low, high = np.where(under, x, low), np.where(under, high, x)
    return (low + high) / 2


class Sampler:
    """Draws the k samples; the same on every worker.

    The variates of a term and a sample come from 64 bits that mix the two: 16 of them pick c among 2^16 equally likely
    values of its distribution, 16 others pick a pair of r and b, so no logarithm is taken for a term.
    """

    def __init__(self, samples: int = SAMPLES, seed: int = 1) -> None:
        draw = np.random.Generator(np.random.PCG64(seed))
        self.k = samples
        self.salts = draw.integers(0, 1 << 64, samples, np.uint64)
        gamma = _quantiles(1 << 16)
        self.log_c = np.log(gamma).astype(np.float32)
        self.r = gamma.astype(np.float32)
        # steps of the golden ratio spread b evenly over every range of r
        self.b = ((np.arange(1 << 16) + 0.5) * ((5**0.5 - 1) / 2) % 1).astype(np.float32)
        self.one = self.r * (self.b - 1)  # what a term of weight 1, whose t is 0, adds to ln c

    def values(self, hashes: np.ndarray, weights: np.ndarray | None) -> tuple[np.ndarray, np.ndarray | None]:
        """ln a and t of each term (row) and sample (column); without weights all are 1 and t is 0."""
        x = _mix((hashes[:, None] ^ self.salts) * np.uint64(_ODD)).view(np.uint16)
        # the upper half of the bits, which are mixed best
        c, k = self.log_c.take(x[:, 2::4]), x[:, 3::4]
        if weights is None:
            c += self.one.take(k)
            return c, None
        r, b = self.r.take(k), self.b.take(k)
        t = np.floor(np.log(weights).astype(np.float32)[:, None] / r + b)
        return c - r * (t - b) - r, t

    def sample(self, hashes: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The signature of weighted terms: for each sample a hash of the term chosen and its t, and the value that won."""
        best = np.full(self.k, np.inf, np.float32)
        chosen = np.zeros(self.k, np.uint64)
        one = weights == 1
        if not one.all():
            # terms of weight 1, mostly all, need no t: they go first, in blocks of their own
            order = np.argsort(~one, kind="stable")
            hashes, weights = hashes[order], weights[order]
        ones = int(one.sum())
        for at in [*range(0, ones, _ROWS), *range(ones, len(hashes), _ROWS)]:
            stop = min(at + _ROWS, ones if at < ones else len(hashes))
            h = hashes[at:stop]
            a, t = self.values(h, weights[at:stop] if at >= ones else None)
            row = a.argmin(0)
            columns = np.arange(self.k)
            low = a[row, columns]
            better = low < best
            best[better] = low[better]
            code = h[row] * np.uint64(_ODD)
            if t is not None:
                code += t[row, columns].astype(np.int64).view(np.uint64)
            chosen[better] = code[better]
        return chosen, best


def signature(text: str, sampler: Sampler, words: int = WORDS) -> np.ndarray:
    """32 bits of each sample; an empty array for a text without words."""
    h, n = terms(text, words)
    return _short(sampler.sample(h, n)[0]) if len(h) else np.zeros(0, np.uint32)


def _short(chosen: np.ndarray) -> np.ndarray:
    return (_mix(chosen.copy()) >> np.uint64(32)).astype(np.uint32)


def pair(text: str, edited: str, kept: int, sampler: Sampler, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of a text and of its edited form, whose first ``kept`` code points are the text's; the terms that both have
    with equal weights are drawn once."""
    own = shingles(text, words)
    # shingles within the words that end before the cut
    whole = len(text[:kept].split()) - words
    h, n = weighted(own)
    g, m = weighted(shingles(edited, words, own[:whole] if whole > 0 else None))
    if not len(h) or not len(g):
        return tuple(_short(sampler.sample(a, b)[0]) if len(a) else np.zeros(0, np.uint32) for a, b in ((h, n), (g, m)))
    at = np.minimum(np.searchsorted(g, h), len(g) - 1)
    same = (g[at] == h) & (m[at] == n)
    rest = np.ones(len(g), bool)
    rest[at[same]] = False
    both = sampler.sample(h[same], n[same])
    out = []
    for part, weight in ((h[~same], n[~same]), (g[rest], m[rest])):
        chosen, low = sampler.sample(part, weight)
        out.append(_short(np.where(both[1] <= low, both[0], chosen)))
    return out[0], out[1]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal samples: the estimate of the generalised Jaccard similarity. Two texts without words are alike."""
    return float(np.mean(a == b)) if len(a) and len(b) else float(len(a) == len(b))


def edited_text(text: str, after: str) -> str:
    """The last quarter of the code points replaced by as many first ones of ``after`` (or all, if it has fewer)."""
    cut = len(text) // 4
    return text[: len(text) - cut] + after[:cut]


def with_next(docs: DataFrame, id: str, text: str, ranges: int | None = None) -> DataFrame:
    """Rows (part, place, ``id``, text) in order of ``id`` (a number) within each part, each followed by its next one.

    A part is a range of ids, and there are as many as shuffle partitions (or ``ranges``). Its last rows, of place 1, are guests:
    the first rows of the next part that has any (of the last part, the first of all). Rows with equal ids are ordered by a
    hash of the text, nulls come first, and all rows of one id are in one part. Ranges end at quantiles of the ids, found
    without reading a text; the table of their first ids has a row for each range.
    """
    spark = docs.sparkSession
    kind = docs.schema[id].dataType
    total = docs.count()
    n = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # some ids are enough to tell where even ranges end; where they end changes no result
    some = docs.select(id).where(F.pmod(F.xxhash64(id), F.lit(1 << 20)) <= int((1 << 20) * min(1.0, ENDS_SAMPLE * n / max(total, 1))))
    ends = some.agg(F.percentile_approx(id, [k / n for k in range(1, n)], 10 * n).alias("q")).first()["q"] if n > 1 else []
    parted = docs.select(F.col(id), F.coalesce(F.col(text), F.lit("")).alias("text"), _below(F.col(id), sorted(set(ends or [])), kind).alias("part"))
    heads = parted.groupBy("part").agg(F.min(F.struct(id)).alias("head")).orderBy("part").collect()
    before = [heads[k - 1]["part"] for k in range(len(heads))]
    firsts = spark.createDataFrame(
        [(r["part"], r["head"][0], b) for r, b in zip(heads, before, strict=True)],
        T.StructType([T.StructField("part", T.IntegerType()), T.StructField("first", kind), T.StructField("before", T.IntegerType())]),
    )
    # the number that hash partitioning sends to the range's own partition
    deal = F.element_at(F.array(*map(F.lit, _numbers(spark, n))), F.col("to") + 1)
    own = F.struct(F.col("part").alias("to"), F.lit(0).alias("place"))
    guest = F.struct(F.col("before").alias("to"), F.lit(1).alias("place"))
    to = F.when(F.col(id).eqNullSafe(F.col("first")), F.array(own, guest)).otherwise(F.array(own))
    dealt = parted.join(F.broadcast(firsts), "part").select(F.explode(to).alias("to"), id, "text").select("to.to", "to.place", id, "text")
    dealt = dealt.select(deal.alias("part"), "place", id, "text")
    return dealt.repartition(n, "part").sortWithinPartitions("part", "place", id, F.xxhash64("text"))


def _numbers(spark: SparkSession, n: int) -> list[int]:
    """For each of n hash partitions the least number that falls into it."""
    found: dict[int, int] = {}
    most = 4 * n
    while len(found) < n:
        most *= 4
        rows = spark.range(most).select(F.col("id").cast("int").alias("i")).groupBy(F.pmod(F.hash("i"), F.lit(n)).alias("k")).agg(F.min("i").alias("i")).collect()
        found = {r["k"]: r["i"] for r in rows}
    return [found[k] for k in range(n)]


def _below(id: Column, ends: list, kind: T.DataType) -> Column:
    """How many of the ``ends``, ascending, lie below an id (null: none), by halving."""
    array = F.split(F.lit(",".join(map(str, ends))), ",").cast(T.ArrayType(kind)) if ends else F.array().cast(T.ArrayType(kind))
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(len(ends).bit_length()))]) if ends else F.array().cast("array<int>")
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(array, at + step - 1) < id, at + step).otherwise(at))


def fingerprint(docs: DataFrame, text: str = "text", id: str = "doc_id", samples: int = SAMPLES, words: int = WORDS) -> DataFrame:
    """For each row its ``id``, n_chars (code points), edited_sha256, fingerprint, edited_fingerprint (hex, 8 digits a
    sample; empty for a text without words), near_edited and near_next.

    The edited text has its last quarter replaced by the start of the next document, in ascending order of ``id`` (equal
    ids: by a hash of the text; after the last comes the first; a document alone is its own next one). A null text is empty.
    Texts without words have likeness 1 to each other and 0 to others. Equal texts have equal fingerprints. An empty table
    gives an empty result.
    """
    kind = docs.schema[id].dataType
    schema = T.StructType(
        [T.StructField(id, kind), T.StructField("n_chars", T.LongType()), *(T.StructField(c, T.StringType()) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")), T.StructField("near_edited", T.DoubleType()), T.StructField("near_next", T.DoubleType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler(samples)
        waiting = None  # (part, id, text)
        rows: list[tuple] = []
        done = None  # the row before, but for near_next, which needs this one's fingerprint

        def emit(limit: int) -> Iterator[pa.RecordBatch]:
            if len(rows) > limit:
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, f) for c, f in zip(columns, id_types, strict=True)], names=schema.names)
                rows.clear()

        for batch in batches:
            id_types = [batch.schema.field(2).type, pa.int64(), *[pa.string()] * 3, pa.float64(), pa.float64()]
            for part, place, doc, text in zip(*(batch.column(k) for k in range(4)), strict=True):
                part, place, doc, text = part.as_py(), place.as_py(), doc.as_py(), text.as_py()
                if waiting is not None and waiting[0] == part:
                    _, doc_before, text_before = waiting
                    edited = edited_text(text_before, text)
                    own, other = pair(text_before, edited, len(text_before) - len(text_before) // 4, sampler, words)
                    if done is not None:
                        rows.append((*done[0], likeness(done[1], own)))
                    sha = hashlib.sha256(edited.encode()).hexdigest()
                    done = ((doc_before, len(text_before), sha, own.astype(">u4").tobytes().hex(), other.astype(">u4").tobytes().hex(), likeness(own, other)), own)
                if place:
                    # the guest ends its part: only its fingerprint is still wanted
                    if done is not None:
                        rows.append((*done[0], likeness(done[1], signature(text, sampler, words))))
                    waiting, done = None, None
                else:
                    waiting = (part, doc, text)
                yield from emit(500)
        yield from emit(0)

    return with_next(docs, id, text).select("part", "place", id, "text").mapInArrow(run, schema)
