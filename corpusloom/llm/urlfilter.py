"""URL filtering: host and path rules first, then gradient-boosted trees on lexical features.

The rules are lists as ad and crawl blockers keep them. Where none fits, the method decides: boosted regression trees (logistic
loss, histogram splits) over the length, depth, digit ratio, entropy, parameter counts and suffix statistics of a URL, trained
from labelled URLs. Any labelled table will do; by default the URLs that rules decide are the labelled ones, which teaches the
trees what the lists' authors block.

A labelled URL's suffix statistics leave out all URLs of its fold of hosts, so no tree sees a label in a feature. The trees are
measured on what they have not seen, in two ways: on folds of hosts, which is how they meet a URL of a suffix that has labelled
URLs, and on folds of suffixes, each with suffixes of both kinds, which is how they meet any other. A held-out URL is ranked only
against those of its own fold, as each fold's trees have another base rate. The verdict is block from the score at which held-out
URLs are blocked with the precision asked for; where no score reaches it, from the score of the highest precision, if that is
above the share of blocked URLs. Where the ranking is not better than chance by more than its error, the labels teach nothing
that carries over, and the method allows.

Plan: host, path, rules and all features are JVM expressions in one scan. Suffix statistics are a grouped aggregate over all
labelled URLs, joined by suffix. The trees are fitted on a bounded sample of labelled rows (``SAMPLE``, those of smallest
hash); scoring is one vectorised pass.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm import scratch

#: Labelled URLs to fit on; trees, their depth, the step, histogram bins and the least rows of a leaf.
SAMPLE, TREES, DEPTH, STEP, BINS, LEAF = 20_000, 60, 4, 0.15, 32, 20
#: Pseudo-URLs, half of them blocked, that each suffix's share of blocked URLs starts from.
SHRINK = 5.0
#: Folds; the precision of block asked for, held out; normal variates of its bound (95 %) and of what is more than chance (99.5 %).
FOLDS, PRECISION, SURE, CHANCE = 4, 0.8, 1.645, 2.58
#: (verdict, host, path) of each rule.
Rule = tuple[str, str, str]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def rule(verdict: str, text: str) -> Rule:
    """A rule from text like ``example.com/de/``."""
    host, slash, path = text.partition("/")
    return verdict, host, slash + path


#: The default lists: fixed values.
RULES = (rule("block", "net/"), rule("allow", "example.net/en/"), rule("block", "example.com/de/"), rule("allow", "org/fr/"))


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty without `://` or for a null."""
    rest = F.substring_index(_rest(url), "/", 1)
    return F.translate(F.substring_index(F.substring_index(rest, "?", 1), "#", 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end."""
    whole = F.substring_index(F.substring_index(_rest(url), "?", 1), "#", 1)
    at = F.instr(whole, "/")
    return F.when(at > 0, F.substr(whole, at)).otherwise(F.lit(""))


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def deciding(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """Number of the longest rule that fits: its host is the URL's or a parent of it, its path a prefix of the URL's. Of
    equally long rules the first; null if none fits."""
    out = None
    for k, (_, h, p) in sorted(enumerate(rules), key=lambda r: (-len(r[1][1] + r[1][2]), r[0])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        out = F.when(fits, F.lit(k)) if out is None else out.when(fits, F.lit(k))
    return F.lit(None).cast("int") if out is None else out


NUMBERS = ("url_length", "host_length", "path_length", "depth", "labels", "digit_ratio", "symbol_ratio", "entropy", "parameters", "has_fragment", "secure")


def features(url: Column, host: Column, path: Column) -> list[Column]:
    """Lexical features; the entropy is that of the URL's characters, in bits."""
    u = F.coalesce(url, F.lit(""))
    n = F.char_length(u)
    query = F.when(F.instr(u, "?") > 0, F.substring_index(F.substring_index(u, "?", -1), "#", 1)).otherwise(F.lit(""))
    chars = F.array_sort(F.split(u, ""))
    # equal characters stand together: n * entropy = n ln n - sum of run * ln run, folded over the sorted characters
    start = F.struct(F.lit("").alias("c"), F.lit(0).alias("run"), F.lit(0.0).alias("sum"))

    def add(acc: Column, c: Column) -> Column:
        same = acc["c"] == c
        run = F.when(same, acc["run"] + 1).otherwise(F.lit(1))
        ended = F.when(same | (acc["run"] == 0), F.lit(0.0)).otherwise(acc["run"] * F.log(acc["run"].cast("double")))
        return F.struct(c.alias("c"), run.alias("run"), (acc["sum"] + ended).alias("sum"))

    total = F.aggregate(chars, start, add, lambda a: a["sum"] + F.when(a["run"] > 0, a["run"] * F.log(a["run"].cast("double"))).otherwise(0.0))
    entropy = F.when(n > 0, (n * F.log(n.cast("double")) - total) / (n * F.log(F.lit(2.0)))).otherwise(0.0)
    some = F.greatest(n, F.lit(1))
    return [
        c.cast("double").alias(name)
        for name, c in zip(
            NUMBERS,
            (
                n,
                F.char_length(host),
                F.char_length(path),
                F.char_length(path) - F.char_length(F.translate(path, "/", "")),
                F.size(F.split(host, "\\.")),
                (n - F.char_length(F.translate(u, "0123456789", ""))) / some,
                F.char_length(F.translate(u, _UPPER + _LOWER + "0123456789./:", "")) / some,
                entropy,
                F.when(query == "", 0).otherwise(F.size(F.split(query, "[&;]"))),
                F.instr(u, "#") > 0,
                F.lower(u).startswith("https:"),
            ),
            strict=True,
        )
    ]


@dataclass
class Boosted:
    """Gradient-boosted trees. A tree is complete to its depth: arrays of split features and thresholds by node, and leaves."""

    base: float = 0.0
    splits: list[np.ndarray] = field(default_factory=list)
    cuts: list[np.ndarray] = field(default_factory=list)
    leaves: list[np.ndarray] = field(default_factory=list)

    def fit(self, x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, step: float = STEP, bins: int = BINS, leaf: int = LEAF) -> Boosted:
        if not len(y):
            return self
        share = (y.sum() + 1) / (len(y) + 2)
        self.base = float(np.log(share / (1 - share)))
        edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)], 1)
        score = np.full(len(y), self.base)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-score))
            g, h = y - p, p * (1 - p)
            node = np.zeros(len(y), np.int64)
            split, cut = np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, np.inf)
            for level in range(depth):
                first, wide = 2**level - 1, 2**level
                best = np.full(wide, 1e-6)
                chosen = [(0, None)] * wide
                for f, e in enumerate(edges):
                    if not len(e):
                        continue
                    key = node * (len(e) + 1) + binned[:, f]
                    gs, hs, ns = (np.bincount(key, w, wide * (len(e) + 1)).reshape(wide, -1).cumsum(1) for w in (g, h, None))
                    gain = gs[:, :-1] ** 2 / (hs[:, :-1] + 1) + (gs[:, -1:] - gs[:, :-1]) ** 2 / (hs[:, -1:] - hs[:, :-1] + 1) - gs[:, -1:] ** 2 / (hs[:, -1:] + 1)
                    gain[(ns[:, :-1] < leaf) | (ns[:, -1:] - ns[:, :-1] < leaf)] = 0
                    at = gain.argmax(1)
                    for k in np.flatnonzero(gain[np.arange(wide), at] > best):
                        best[k], chosen[k] = gain[k, at[k]], (f, int(at[k]))
                right = np.zeros(len(y), bool)
                for k, (f, b) in enumerate(chosen):
                    if b is not None:
                        split[first + k], cut[first + k] = f, edges[f][b]
                        right |= (node == k) & (binned[:, f] > b)
                node = 2 * node + right
            gs, hs = (np.bincount(node, w, 2**depth) for w in (g, h))
            value = step * gs / (hs + 1)
            score += value[node]
            self.splits.append(split)
            self.cuts.append(cut)
            self.leaves.append(value)
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1."""
        score = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for split, cut, value in zip(self.splits, self.cuts, self.leaves, strict=True):
            at = np.zeros(len(x), np.int64)
            while len(at) and at[0] < len(split):
                at = 2 * at + 1 + (x[rows, split[at]] > cut[at])
            score += value[at - len(split)]
        return 1 / (1 + np.exp(-score))


def suffix_of(host: Column) -> Column:
    """The last two labels of a host: the part that registries and their customers share."""
    return F.substring_index(host, ".", -2)


def area(score: np.ndarray, y: np.ndarray) -> float:
    """Area under the ROC curve: how often a blocked URL scores above an allowed one, ties as half. 0.5 with one class."""
    n = int((y == 1).sum())
    if not n or n == len(y):
        return 0.5
    _, place, size = np.unique(score, return_inverse=True, return_counts=True)
    rank = (np.cumsum(size) - (size - 1) / 2)[place]
    return float((rank[y == 1].sum() - n * (n + 1) / 2) / (n * (len(y) - n)))


def least_score(score: np.ndarray, y: np.ndarray, precision: float = PRECISION) -> float:
    """The least score, 0.5 or more, from which the share of blocked URLs has ``precision`` as its lower bound (Wilson's, one
    side, 95 %): midway to the next lower one of ``score``. Infinite where none has."""
    order = np.argsort(-score, kind="stable")
    s, right = score[order], np.cumsum(y[order])
    n, z = np.arange(1, len(s) + 1), SURE
    p = right / n
    low = (p + z * z / (2 * n) - z * np.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)
    ends = np.r_[s[1:] != s[:-1], True] if len(s) else np.zeros(0, bool)
    fit = np.flatnonzero(ends & (low >= precision) & (s >= 0.5))
    return max(0.5, float(s[fit[-1]] + (s[fit[-1] + 1] if fit[-1] + 1 < len(s) else 0.0)) / 2) if len(fit) else float("inf")


@dataclass
class Fitted:
    """The trees, and for suffixes with labelled URLs and for others: the score from which they block, and their held-out area."""

    model: Boosted
    threshold: float = float("inf")
    area: float = 0.5
    new_threshold: float = float("inf")
    new_area: float = 0.5


def skill(score: np.ndarray, y: np.ndarray, fold: np.ndarray) -> tuple[float, float]:
    """The area under the ROC curve within folds, each weighted by its pairs of a blocked and an allowed URL, and the error that it
    would have for scores that know nothing; larger than that of independent folds, as the folds' trees share rows (Nadeau and
    Bengio's correction)."""
    pairs = total = variance = 0.0
    folds = np.unique(fold)
    for k in folds:
        own = fold == k
        n, m = float((y[own] == 1).sum()), float((y[own] == 0).sum())
        total += area(score[own], y[own]) * n * m
        variance += n * m * (n + m + 1) / 12
        pairs += n * m
    return (total / pairs, (variance * (1 + len(folds) / max(len(folds) - 1, 1))) ** 0.5 / pairs) if pairs else (0.5, 0.5)


def blocking_score(score: np.ndarray, y: np.ndarray, fold: np.ndarray) -> tuple[float, float]:
    """The score from which held-out URLs are to be blocked, infinite without skill, and the area within folds."""
    found, error = skill(score, y, fold)
    if found - CHANCE * error <= 0.5:
        return float("inf"), found
    for precision in np.arange(PRECISION, float(y.mean()), -0.02):
        if (least := least_score(score, y, float(precision))) < np.inf:
            return least, found
    return float("inf"), found


def suffix_folds(suffix: np.ndarray, y: np.ndarray, folds: int = FOLDS) -> np.ndarray:
    """A fold of each row by its suffix: mostly blocked and mostly allowed suffixes are dealt apart, so that as many folds as can
    have both have them. All 0 where one kind is missing."""
    names, at = np.unique(suffix, return_inverse=True)
    blocked = np.bincount(at, y, len(names)) * 2 > np.bincount(at, None, len(names))
    own = np.zeros(len(names), np.int64)
    n = min(folds, int(blocked.sum()), int((~blocked).sum()))
    if n:
        for kind in (blocked, ~blocked):
            own[kind] = np.arange(kind.sum()) % n
    return own[at]


def fit(x: np.ndarray, y: np.ndarray, fold: np.ndarray, suffix: np.ndarray | None = None) -> Fitted:
    """Trees of all rows; those of all folds but one score the rows of that one. The last two columns of ``x`` are the suffix
    statistics, which a held-out suffix has not."""

    def held(folds: np.ndarray, unseen: bool) -> np.ndarray:
        out = np.full(len(y), 0.5)
        for k in np.unique(folds):
            own = folds == k
            if not own.all():
                asked = x[own].copy()
                if unseen:
                    asked[:, -2:] = 0.5, 0.0
                out[own] = Boosted().fit(x[~own], y[~own]).predict(asked)
        return out

    threshold, found = blocking_score(held(fold, False), y, fold)
    out = Fitted(Boosted().fit(x, y), threshold, found)
    if suffix is not None and len(y):
        folds = suffix_folds(suffix, y)
        out.new_threshold, out.new_area = blocking_score(held(folds, True), y, folds)
    return out


def described(df: DataFrame, *keep: str) -> DataFrame:
    """``keep``, host, path, suffix, fold, a hash h and the features of column url."""
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    parts = df.select(*keep, "url", host.alias("host"), path.alias("path"))
    fold = F.pmod(F.xxhash64("host", F.lit("fold")), F.lit(FOLDS)).cast("int").alias("fold")
    return parts.select(*keep, "host", "path", suffix_of(F.col("host")).alias("suffix"), fold, F.xxhash64("url").alias("h"), *features(F.col("url"), F.col("host"), F.col("path")))


COLUMNS = [*NUMBERS, "suffix_rate", "suffix_urls"]


def _suffix(urls: Column, blocked: Column) -> list[Column]:
    """Suffix statistics, the share of blocked URLs shrunk towards even odds."""
    return [((blocked + SHRINK / 2) / (urls + SHRINK)).alias("suffix_rate"), F.log1p(urls.cast("double")).alias("suffix_urls")]


def learned(known: DataFrame, sample: int = SAMPLE) -> tuple[Fitted, DataFrame]:
    """What ``described`` URLs with a label teach, and the labelled URLs of each suffix (suffix, urls, blocked)."""
    by_fold = scratch.stored(known.groupBy("suffix", "fold").agg(F.count("*").alias("u"), F.sum("label").alias("b")), "suffixes")
    suffixes = by_fold.groupBy("suffix").agg(F.sum("u").alias("urls"), F.sum("b").alias("blocked"))
    total = by_fold.agg(F.sum("u")).first()[0] or 0
    rows = scratch.smallest(known, total, sample, "h", "label").join(by_fold, ["suffix", "fold"]).join(suffixes, "suffix")
    rows = rows.select(*NUMBERS, *_suffix(F.col("urls") - F.col("u"), F.col("blocked") - F.col("b")), "h", "label", "fold", "suffix").orderBy("h", "label", *NUMBERS)
    taught = rows.select(*COLUMNS, "label", "fold", "suffix").toPandas()
    return fit(taught[COLUMNS].to_numpy(float), taught["label"].to_numpy(float), taught["fold"].to_numpy(), taught["suffix"].to_numpy(str)), suffixes


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, labelled: DataFrame | None = None, url: str = "url", id: str = "page_id", sample: int = SAMPLE) -> DataFrame:
    """``id``, host, path, rule (like ``net/``; null if none fits), verdict (allow or block) and score (the trees' probability
    of block) of each row.

    ``labelled`` has columns url and label (1: block); by default the rows that a rule decides. Null urls, repeated rows and
    urls without a host are judged like others; without labelled URLs the score is 0.5. URLs that no rule decides are blocked
    from the score that ``fit`` finds for their kind of suffix, else allowed. An empty table gives an empty result.
    """
    blocks = F.array(*[F.lit(int(v == "block")) for v, _, _ in rules]) if rules else F.array().cast("array<int>")
    own = described(pages.select(F.col(id).alias("id"), F.col(url).alias("url")), "id").withColumn("k", deciding(F.col("host"), F.col("path"), rules))
    if labelled is None:
        known = own.where("k is not null").withColumn("label", F.get(blocks, F.col("k")))
    else:
        known = described(labelled.where("label is not null").select(F.col("url"), F.col("label").cast("int").alias("label")), "label")
    taught, suffixes = learned(known, sample)
    model = taught.model
    none = F.lit(0)
    ready = own.join(suffixes, "suffix", "left").select("id", "host", "path", "k", *NUMBERS, *_suffix(F.coalesce("urls", none), F.coalesce("blocked", none)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[4:]], 1) if batch.num_rows else np.zeros((0, len(COLUMNS)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(model.predict(x)), pa.array(x[:, -1] > 0)], names=["id", "host", "path", "k", "score", "known"])

    kind = pages.schema[id].dataType
    schema = T.StructType([T.StructField("id", kind), *(T.StructField(c, T.StringType()) for c in ("host", "path")), T.StructField("k", T.IntegerType()), T.StructField("score", T.DoubleType()), T.StructField("known", T.BooleanType())])
    judged = ready.mapInArrow(run, schema)
    names = F.array(*[F.lit(h + p) for _, h, p in rules]) if rules else F.array().cast("array<string>")
    verdicts = F.array(*[F.lit(v) for v, _, _ in rules]) if rules else F.array().cast("array<string>")
    # a suffix without labelled URLs has 0 of them
    by_score = F.when(F.col("score") >= F.when(F.col("known"), F.lit(taught.threshold)).otherwise(F.lit(taught.new_threshold)), "block").otherwise("allow")
    return judged.select(F.col("id").alias(id), "host", "path", F.get(names, F.col("k")).alias("rule"), F.coalesce(F.get(verdicts, F.col("k")), by_score).alias("verdict"), "score")
