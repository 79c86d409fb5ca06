"""Language identification by rank-order n-gram profiles.

Method: a language's profile is its most frequent character n-grams (1 to 3 letters, words padded) in order of frequency. A
document's most frequent n-grams are ranked the same way, and the distance to a language is the sum of how far out of place
each of them is in its profile, or the profile's length where it is absent. The nearest profile gives the language.

Profiles are fitted on a bounded sample of labelled documents (``SAMPLE`` in expectation for each language, chosen by a hash
of the id); predictions read whole texts of all documents in one scan without a shuffle.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: n-grams of a profile and of a document's ranking; labelled documents of a language to fit on; languages from which a table is
#: refused, as profiles are held on the driver and in every task.
PROFILE, SAMPLE, LANGUAGES = 300, 4000, 50_000
#: Share of held-out documents that may score lower than twice the least score of a text in a learned language.
SHARE = 0.001
_WORDS = re.compile(r"[^\W\d_]+")


def counted(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams of a whole text, ascending, and how often each occurs.

    Words are runs of letters, lower-cased, with a space on either side; n is 1 to 3, and three code points of 21 bits make
    a code. The n-grams of each distinct word count as often as the word.
    """
    words = {w: n for w, n in Counter(_WORDS.findall((text or "").lower())).items() if w.isalpha() or any(map(str.isalpha, w))}
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    p = np.frombuffer(f" {' '.join(words)} ".encode("utf-32-le"), "<u4").astype(np.int64)
    # how often the word of each letter occurs; 0 at the spaces
    times = np.zeros(len(p), np.int64)
    times[1:] = np.repeat(np.fromiter(words.values(), np.int64, len(words)), [len(w) + 1 for w in words])
    times[p == 0x20] = 0
    inner = np.flatnonzero(times)
    two = p[:-1] << 21 | p[1:]
    codes = np.concatenate([p[inner], two, two[inner - 1] << 21 | p[inner + 1]])
    times = np.concatenate([times[inner], np.maximum(times[:-1], times[1:]), times[inner]])
    order = np.argsort(codes)
    codes, times = codes[order], times[order]
    first = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
    return codes[first], np.add.reduceat(times, first)


def ranked(codes: np.ndarray, times: np.ndarray, top: int = PROFILE) -> np.ndarray:
    """The most frequent n-grams, most frequent first; of equally frequent ones the smaller code first."""
    if len(codes) > top:
        least = np.partition(times, len(times) - top)[len(times) - top]
        codes, times = codes[times >= least], times[times >= least]
    return codes[np.lexsort((codes, -times))][:top]


class Profiles:
    """Ranked n-grams of each language, ready for out-of-place distances to all of them at once."""

    def __init__(self, ranks: dict[str, list[int]]) -> None:
        self.langs = sorted(ranks)
        self.codes = np.array(sorted({c for r in ranks.values() for c in r}), np.int64)
        # rank of each n-gram in each language; -1: absent
        self.ranks = np.full((len(self.langs), len(self.codes)), -1, np.int32)
        for k, lang in enumerate(self.langs):
            self.ranks[k, np.searchsorted(self.codes, ranks[lang])] = np.arange(len(ranks[lang]))

    def predict(self, text: str | None) -> tuple[str, float]:
        """The nearest language and 1 - distance / the largest distance; of equally near ones the first by name."""
        own = ranked(*counted(text))
        if not len(own) or not self.langs:
            return "und", 0.0
        total = len(own) * PROFILE
        distance = np.full(len(self.langs), total, np.int64)
        if len(self.codes):
            at = np.minimum(np.searchsorted(self.codes, own), len(self.codes) - 1)
            known = np.flatnonzero(self.codes[at] == own)
            there = self.ranks[:, at[known]]
            saved = np.where(there >= 0, PROFILE - np.minimum(np.abs(there - known), PROFILE), 0)
            distance -= saved.sum(1)
        best = int(distance.argmin())
        return self.langs[best], float(1 - distance[best] / total)


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", id: str = "doc_id", sample: int = SAMPLE) -> Profiles:
    """Profiles of the languages of ``labelled``; rows with a null text or language teach nothing.

    Of a language with more rows than ``sample``, those are taken whose id hashes low enough that about ``sample`` remain; a
    repeated id is taken or left as one. ``PROFILE`` n-grams of each language reach the driver; over ``LANGUAGES`` languages are an
    error, never left out.
    """
    usable = labelled.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(id).alias("id"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    sizes = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count("*").alias("n")).limit(LANGUAGES + 1).collect()}
    if len(sizes) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    if not sizes:
        return Profiles({})
    share = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, sample / n))])
    spot = F.pmod(F.xxhash64(F.col("id").cast("string"), F.lit("fit")), F.lit(1 << 20)) / F.lit(1 << 20)
    chosen = usable.where(spot < F.element_at(share, F.col("lang"))).select("lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums: dict[str, Counter] = {}
            for label, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                codes, times = counted(t)
                sums.setdefault(label, Counter()).update(dict(zip(codes.tolist(), times.tolist(), strict=True)))
            rows = [(k, c, n) for k, s in sums.items() for c, n in s.items()]
            columns = list(zip(*rows, strict=True)) if rows else [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.string(), pa.int64(), pa.int64()), strict=True)], names=["lang", "code", "n"])

    counts = chosen.mapInArrow(run, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "code"))
    ranks: dict[str, list[int]] = {k: [] for k in sizes}
    for r in counts.withColumn("place", place).where(F.col("place") <= PROFILE).orderBy("lang", "place").collect():
        ranks[r["lang"]].append(r["code"])
    return Profiles({k: v for k, v in ranks.items() if v})


def held_out(id: Column) -> Column:
    """Whether a document is kept from learning: crc32 of its id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def predict(docs: DataFrame, profiles: Profiles, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score (0 to 1). Whole texts; `und` and 0 where the text is null or has no letter.

    Columns of those names are replaced. Repeated rows and an empty table need nothing special.
    """
    names = [c for c in docs.columns if c not in ("lang_pred", "score")]
    fields = [docs.schema[c] for c in names] + [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    at = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [profiles.predict(t.as_py()) for t in batch.column(at)]
            new = [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*names, "lang_pred", "score"])

    return docs.select(*[F.col(f"`{c}`") for c in names]).mapInArrow(run, T.StructType(fields))


def least_score(docs: DataFrame, profiles: Profiles, text: str = "text", lang: str = "lang", share: float = SHARE) -> float:
    """The score below which a text is in no learned language: half of what all but ``share`` of the rows of ``docs`` that have a
    language and a letter reach. Take rows that the profiles were not learned from. Without any it is 0.

    Scores of all rows are counted by thousandths, so 1,001 counts reach the driver, and the result does not depend on partitions."""
    told = predict(docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(text).alias("text")), profiles, "text").where("lang_pred <> 'und'")
    counts = sorted((r["at"], r["n"]) for r in told.groupBy(F.floor(F.col("score") * 1000).alias("at")).agg(F.count("*").alias("n")).collect())
    left = share * sum(n for _, n in counts)
    for at, n in counts:
        left -= n
        if left < 0:
            return at / 2000
    return 0.0


def identified(docs: DataFrame, profiles: Profiles, text: str = "text", least: float = 0.0) -> DataFrame:
    """The rows of ``docs`` in a learned language, as they are: their text has a letter, and the nearest profile gives it a score of
    ``least`` or more. Without profiles (no row has a language to learn from) any text with a letter is kept."""
    at = docs.columns.index(text)

    def kept(t: str | None) -> bool:
        if not profiles.langs:
            return len(counted(t)[0]) > 0
        lang, score = profiles.predict(t)
        return lang != "und" and score >= least

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([kept(t.as_py()) for t in batch.column(at)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def identify(docs: DataFrame, text: str = "text", lang: str = "lang", id: str = "doc_id") -> DataFrame:
    """``id``, held_out, lang_pred and score of each row; profiles are learned from the rows that are not held out."""
    profiles = fit(docs.where(~held_out(F.col(id))), text, lang, id)
    return predict(docs.select(id, text), profiles, text).select(id, held_out(F.col(id)).alias("held_out"), "lang_pred", "score")
