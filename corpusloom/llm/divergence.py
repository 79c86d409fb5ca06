"""How far the sources of a language stand apart in their words, exactly, in integers.

Method: a heavy-light split of the terms. Terms that more than ``RARE`` groups of a language hold are compared in dense numpy tiles
of groups by terms. For the others every pair of groups starts from what it would have with none of them; the terms that one group has
are corrected by a histogram of the group's shares, and the terms that both have by pairs of postings, of which a term has few.
The partial sums are added; all are integers, so their order does not matter.

Plan: one scan counts terms, with a table in each task that is sent on when full, and the counts are aggregated by (language,
source, term); all after that works on these counts. A tile's task holds two tiles of groups by one block of terms. Nothing is
broadcast but the numbers of languages and what Spark itself finds small.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm import scratch

#: Documents of a language that a kept term is in, what is added to each count, what shares are multiplied by, ranks of terms.
LEAST, PRIOR, SCALE, RANKS = 30, 5, 1_000_000_000, 50
#: The most groups that hold a rare term; groups and terms of a tile; entries of a task's table of counts.
RARE, GROUPS, TERMS, ENTRIES = 8, 128, 2048, 300_000
_UPPER = bytes(range(65, 91))
#: Letters are lowered, non-ASCII bytes kept, all else separates.
_TABLE = bytes(b + 32 if b in _UPPER else b if b in range(97, 123) or b >= 128 else 32 for b in range(256))


def terms_of(text: str | None) -> list[bytes]:
    """The terms of a text, in UTF-8: runs of ASCII letters and of anything beyond ASCII, only A-Z lower-cased."""
    return text.encode().translate(_TABLE).split() if text else []


def counted(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """lang, source, term, n (occurrences) and docs (rows that have it); nulls count as ''. Each group also has a row of the term
    '', with n 0, so that groups without terms are there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[str, str], Counter] = {}
        held: dict[tuple[str, str], Counter] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for group, own in counts.items():
                n = list(own.values())
                docs = list(map(held[group].__getitem__, own))
                columns = [pa.array([g] * len(own), pa.string()) for g in group]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([w.decode() for w in own], pa.string()), pa.array(n, pa.int64()), pa.array(docs, pa.int64())], names=["lang", "source", "term", "n", "docs"])
            counts.clear()
            held.clear()

        for batch in batches:
            for k, (language, origin) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                group = (language, origin)
                if group not in counts:
                    counts[group], held[group] = Counter({b"": 0}), Counter()
                words = terms_of(batch.column(2)[k].as_py())
                counts[group].update(words)
                held[group].update(set(words))
                held[group][b""] += 1
                if k % 64 == 0 and sum(map(len, counts.values())) > ENTRIES:
                    yield from flush()
        yield from flush()

    told = docs.select(F.coalesce(F.col(lang), F.lit("")).alias("lang"), F.coalesce(F.col(source), F.lit("")).alias("source"), F.col(text).alias("text"))
    rows = told.mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return rows.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: Column | str, total: str = "total", kept: str = "kept") -> Column:
    """1 + floor(``SCALE`` (n + ``PRIOR``) / (total + ``PRIOR`` kept)), in decimals, as the product may leave 64 bits."""
    n = F.col(n) if isinstance(n, str) else n
    above = (n + PRIOR).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)")
    below = (F.col(total) + PRIOR * F.col(kept)).cast("decimal(20,0)")
    return F.call_function("div", above, below).cast("long") + 1


class Audit:
    """The shares of a table, stored: ``groups`` (gid, lang, source, total, kept, p0), ``postings`` (gid, tid, lang, p) of kept
    terms with a count and ``terms`` (tid, lang, term, n, held, q)."""

    def __init__(self, docs: DataFrame, least: int = LEAST, rare: int = RARE, **columns: str) -> None:
        self.rare = rare
        counts = scratch.stored(counted(docs, **columns), "term-counts")
        kept = counts.where("term <> ''").groupBy("lang", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"), F.count("*").alias("held")).where(F.col("docs") >= least)
        kept = scratch.stored(kept.drop("docs").withColumn("tid", F.monotonically_increasing_id()), "kept-terms")
        sizes = kept.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("n").alias("total"), F.count_if(F.col("held") <= rare).alias("light"))
        posted = scratch.stored(counts.where("term <> ''").join(kept.select("lang", "term", "tid", "held"), ["lang", "term"]).select("lang", "source", "tid", "held", "n"), "postings")
        totals = posted.groupBy("lang", "source").agg(F.sum("n").alias("total"))
        groups = counts.where("term = ''").select("lang", "source").join(totals, ["lang", "source"], "left").join(sizes.select("lang", "kept", "light"), "lang", "left")
        groups = groups.select("lang", "source", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "kept", "light")))
        self.groups = scratch.stored(groups.withColumn("p0", F.when(F.col("kept") > 0, share(F.lit(0)))).withColumn("gid", F.monotonically_increasing_id()), "groups")
        self.postings = scratch.stored(posted.join(self.groups.select("lang", "source", "gid", "total", "kept", "p0"), ["lang", "source"]).select("gid", "lang", "tid", "held", "n", share("n").alias("p"), "p0"), "shares")
        self.terms = scratch.stored(kept.join(sizes.select("lang", "kept", "total"), "lang").select("tid", "lang", "term", "held", share("n").alias("q")), "kept-shares")

    def _tiles(self) -> DataFrame:
        """gid, lang, p0, light, tile and tiles: groups dealt by a hash over as many tiles as their language needs."""
        own = self.groups.where("kept > 0")
        many = own.groupBy("lang").agg(F.ceil(F.count("*") / GROUPS).alias("tiles"))
        return own.join(many, "lang").select("gid", "lang", "p0", "light", F.pmod(F.xxhash64("gid"), "tiles").alias("tile"), "tiles")

    def dense(self) -> DataFrame:
        """s, t and d of every two groups of a language, s < t: the sum over its other than rare terms, by tiles."""
        tiles = self._tiles()
        heavy = self.terms.where(F.col("held") > self.rare).select("lang", "tid")
        many = heavy.groupBy("lang").agg(F.ceil(F.count("*") / TERMS).alias("blocks"))
        block = F.pmod(F.xxhash64("tid"), "blocks").alias("block")
        sizes = heavy.join(many, "lang").groupBy("lang", block).agg(F.count("*").alias("size"))
        spots = self.postings.where(F.col("held") > self.rare).join(many, "lang").select("gid", "tid", "p", block)
        own = tiles.select("gid", "lang", "p0", "tile", "tiles")
        marks = own.join(sizes, "lang").withColumns({"tid": F.lit(None).cast("long"), "p": F.lit(None).cast("long")})
        rows = own.join(spots, "gid").withColumn("size", F.lit(None).cast("long")).unionByName(marks)

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            named = pdf[pdf["tid"].isna()].drop_duplicates("gid").sort_values("gid")
            real = pdf[pdf["tid"].notna()].drop_duplicates(["gid", "tid"])
            gids, words = named["gid"].to_numpy(), np.unique(real["tid"].to_numpy(np.int64))
            m = np.repeat(named["p0"].to_numpy(np.int64)[:, None], len(words), 1)
            m[np.searchsorted(gids, real["gid"]), np.searchsorted(words, real["tid"].to_numpy(np.int64))] = real["p"].to_numpy(np.int64)
            mine, other = (named["tile"].to_numpy() == pdf[k].iloc[0] for k in "ij")
            # the block's terms that no group of the two tiles has
            p0, rest = named["p0"].to_numpy(np.int64), int(named["size"].iloc[0]) - len(words)
            return _pairs(gids[mine], gids[other], [np.abs(m[other] - row).sum(1) + rest * np.abs(p0[other] - own) for row, own in zip(m[mine], p0[mine], strict=True)])

        return self._met(rows).groupBy("lang", "i", "j", "block").applyInPandas(run, "s long, t long, d long")

    @staticmethod
    def _met(rows: DataFrame) -> DataFrame:
        """Each row for every pair of tiles (i, j), i <= j, that its own is one of."""
        every = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other")
        return rows.select("*", every).withColumns({"i": F.least("tile", "other"), "j": F.greatest("tile", "other")}).drop("other", "tiles")

    def single(self) -> DataFrame:
        """s, t and d of every two groups, s < t: what the rare terms would add if no term were in both."""
        tiles = self._tiles()
        some = self.postings.where(F.col("held") <= self.rare).groupBy("gid", "p").agg(F.count("*").alias("m"))
        rows = tiles.join(some, "gid").unionByName(tiles.withColumns({"p": F.lit(None).cast("long"), "m": F.lit(None).cast("long")}))

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            named = pdf[pdf["p"].isna()].drop_duplicates("gid").sort_values("gid")
            real = pdf[pdf["p"].notna()].drop_duplicates(["gid", "p"])
            gids, p0 = named["gid"].to_numpy(), named["p0"].to_numpy(np.int64)
            apart = np.abs(p0[:, None] - p0[None, :])
            total = apart * int(named["light"].iloc[0])
            for at, own in real.groupby(np.searchsorted(gids, real["gid"])):
                # for each share of a group's, m terms stand off another group's share of none
                p, m = own["p"].to_numpy(np.int64), own["m"].to_numpy(np.int64)
                off = np.array([int((np.abs(p - q) * m).sum()) for q in p0], np.int64) - apart[at] * int(m.sum())
                total[at] += off
                total[:, at] += off
            mine, other = (named["tile"].to_numpy() == pdf[k].iloc[0] for k in "ij")
            return _pairs(gids[mine], gids[other], list(total[mine][:, other]))

        return self._met(rows).groupBy("lang", "i", "j").applyInPandas(run, "s long, t long, d long")

    def both(self) -> DataFrame:
        """s, t and d: the correction of each rare term that both groups have; a term has at most ``rare`` postings."""
        held = self.postings.where((F.col("held") <= self.rare) & (F.col("held") > 1)).groupBy("tid").agg(F.array_sort(F.collect_list(F.struct("gid", "p", "p0"))).alias("at"))
        two = held.select("at", F.posexplode("at").alias("k", "x")).select("x", F.explode(F.slice("at", F.col("k") + 2, F.size("at"))).alias("y"))
        gap = lambda x, y: F.abs(F.col(x) - F.col(y))
        return two.select(F.col("x.gid").alias("s"), F.col("y.gid").alias("t"), (gap("x.p", "y.p") - gap("x.p", "y.p0") - gap("x.p0", "y.p") + gap("x.p0", "y.p0")).alias("d"))

    def pairs(self) -> DataFrame:
        """lang, source, item (another source of the language) and value, both ways."""
        sums = scratch.stored(self.dense().union(self.single()).union(self.both()).groupBy("s", "t").agg(F.sum("d").alias("value")), "pair-sums")
        names = self.groups.where("kept > 0").select("gid", "lang", "source")
        ways = sums.union(sums.select("t", "s", "value")).toDF("gid", "other", "value")
        out = ways.join(names, "gid").join(names.select(F.col("gid").alias("other"), F.col("source").alias("item")), "other").select("lang", "source", "item", "value")
        # without a kept term all distances are zero
        none = self.groups.where("kept = 0").select("lang", "source")
        return out.union(none.join(none.withColumnRenamed("source", "item"), "lang").where("source <> item").select("lang", "source", "item", F.lit(0).cast("long")))

    def words(self) -> DataFrame:
        """lang, source, item (a term that the group has and uses more than its language does) and value."""
        near = self.postings.join(self.terms.select("tid", "term", "q"), "tid").where("p > q").select("gid", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
        return near.join(self.groups.select("gid", "lang", "source"), "gid").select("lang", "source", "item", "value")


def _pairs(left: np.ndarray, right: np.ndarray, sums: list[np.ndarray]) -> pd.DataFrame:
    """s < t and d of two tiles, which may be the same."""
    s, t = np.repeat(left, len(right)), np.tile(right, len(left))
    d = np.concatenate(sums) if sums else np.zeros(0, np.int64)
    same = len(left) == len(right) and bool((left == right).all())
    keep = s < t if same else s != t
    return pd.DataFrame({"s": np.minimum(s, t)[keep], "t": np.maximum(s, t)[keep], "d": d[keep]})


def audit(docs: DataFrame, ranks: int = RANKS, **how) -> DataFrame:
    """lang, source, part, item, value and rank of every group of ``docs``.

    Part ``pair``: the other sources of the language, by the sum of the absolute differences of shares over the language's kept
    terms, all of them. Part ``term``: the first ``ranks`` terms that the group uses more than the language does. A text without
    terms, a null text or an empty one counts for its group, which is listed as any other; with one source a language has no
    pairs. Repeated rows count each. An empty table gives an empty result."""
    own = Audit(docs, **how)
    place = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = own.pairs().withColumn("part", F.lit("pair")).withColumn("rank", F.row_number().over(place))
    words = own.words().withColumn("part", F.lit("term")).withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= ranks)
    return pairs.unionByName(words).select("lang", "source", "part", "item", "value", "rank")
