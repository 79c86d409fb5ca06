"""Token counts without token ids.

Method: a document is cut into pre-tokens, the units that byte-level BPE never merges across.

1. One scan finds the distinct pre-tokens of the corpus, summed on the map side first, so that a task sends each once (once more for
   every ``KEPT`` new ones or ``READ`` characters that it meets).
2. The pieces of each distinct pre-token are counted once, in a stored table.
3. A second scan joins that table to each document's pre-token frequencies and sums pieces times frequency. The most frequent, at most
   ``KEPT``, pre-tokens of up to ``KEPT_CHARS`` characters are joined in the task, from a broadcast table whose size these two bound; a
   document's other pre-tokens, if the corpus has any, go by a join of two stored tables, which adaptive execution splits.

The library makes ids only of single pre-tokens, to count them. A special string is a pre-token of its own.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import scratch, vocab

#: Entries of the broadcast table of piece counts, and of a task's sums before it sends them on; the longest pre-token in either.
KEPT, KEPT_CHARS = 250_000, 64
#: Characters that a task reads before it sends its sums on, as pre-tokens may be long.
READ = 1 << 26
#: Letters below U+0250, where all versions of Unicode agree: the pre-tokenizer's pattern for texts of such characters only.
_L = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
_N = "0-9²³¹¼-¾"
_S = r"\t\n\x0b\x0c\r \x85\xa0"
_PRE = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
_REST = pa.list_(pa.struct([("pre", pa.string()), ("n", pa.int64())]))
_BEYOND = re.compile("[^\\x00-ɏ]")


class PieceCounter:
    """The pre-tokens of texts, and the pieces of each, as a byte-level BPE file of the tokenizers library has them."""

    def __init__(self, name: str) -> None:
        self.lib = vocab.load(name)
        added = self.lib.get_added_tokens_decoder().values()
        # a special string that takes in its surroundings cannot be cut out: a text with one is a single unit
        self.greedy = [t.content for t in added if t.lstrip or t.rstrip or t.single_word]
        plain = sorted({t.content for t in added} - set(self.greedy), key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, plain)) + ")") if plain else None

    def pretokens(self, text: str) -> list[str]:
        """The units of a text; the pieces of a text are those of its units, taken one by one."""
        if any(s in text for s in self.greedy):
            return [text]
        if self.special is None or not self.special.search(text):
            return self._plain(text)
        parts = self.special.split(text)
        return [u for k, part in enumerate(parts) for u in ([part] if k % 2 else self._plain(part) if part else [])]

    def _plain(self, text: str) -> list[str]:
        # outside plain Latin the library's own pre-tokenizer cuts
        if not _BEYOND.search(text):
            return _PRE.findall(text)
        return [text[a:b] for _, (a, b) in self.lib.pre_tokenizer.pre_tokenize_str(text)]

    def pieces(self, distinct: list[str]) -> list[int]:
        """Pieces of each distinct pre-token."""
        return [len(e) for e in self.lib.encode_batch_fast(distinct, add_special_tokens=False)]


_counters: dict[str, PieceCounter] = {}


def counter(name: str) -> PieceCounter:
    if name not in _counters:
        _counters[name] = PieceCounter(name)
    return _counters[name]


def piece_counts(texts: DataFrame, tokenizer: str, kept: int = KEPT) -> DataFrame:
    """pre, n (how often it occurs) and pieces of each distinct pre-token of the one column of ``texts``: a stored table."""

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, sums = counter(tokenizer).pretokens, Counter()

        def told(found: Counter) -> Iterator[pa.RecordBatch]:
            pre, n = list(found), list(found.values())
            for at in range(0, len(pre), 10_000):
                yield pa.RecordBatch.from_arrays([pa.array(pre[at : at + 10_000], pa.string()), pa.array(n[at : at + 10_000], pa.int64())], names=["pre", "n"])

        read = 0
        for batch in batches:
            for text in batch.column(0):
                if t := text.as_py():
                    sums.update(cut(t))
                    read += len(t)
                if len(sums) > kept or read > READ:
                    yield from told(sums)
                    sums.clear()
                    read = 0
        yield from told(sums)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(counter(tokenizer).pieces(part.column(0).to_pylist()), pa.int64())], names=["pre", "n", "pieces"])

    rows = texts.mapInArrow(distinct, "pre string, n long").groupBy("pre").agg(F.sum("n").alias("n"))
    return scratch.stored(rows.mapInArrow(counted, "pre string, n long, pieces long"), "pieces")


def count_tokens(docs: DataFrame, text: str = "text", id: str = "doc_id", tokenizer: str = "byte_bpe_50k.json", limit: int = 512, kept: int = KEPT) -> DataFrame:
    """``id``, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > ``limit``) of each row; a null text counts as empty.

    Each row is kept, repeated ids included; other columns of ``docs`` do not reach the workers. An empty table gives an
    empty result. ``kept`` bounds the broadcast table; it does not change the result.
    """
    counts = piece_counts(docs.select(F.col(text).alias("text")), tokenizer, kept)
    short = counts.where(F.char_length("pre") <= KEPT_CHARS)
    # all pre-tokens that occur as often as a power of two, the lowest at which they are no more than may be kept
    level = F.floor(F.log2(F.col("n").cast("double"))).cast("int")
    least, total = 63, 0
    for r in sorted(short.groupBy(level.alias("level")).agg(F.count("*").alias("size")).collect(), reverse=True):
        if (total := total + r["size"]) > kept:
            break
        least = r["level"]
    frequent = short.where(level >= least).select("pre", "pieces").toPandas()
    every = len(frequent) == counts.count()
    shared = docs.sparkSession.sparkContext.broadcast(dict(zip(frequent["pre"], frequent["pieces"].astype(int).tolist(), strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, known = counter(tokenizer).pretokens, shared.value
        for batch in batches:
            sums, rest = [], []
            for t in batch.column(2):
                found = Counter(cut(t.as_py())) if t.is_valid else {}
                if every:
                    sums.append(sum(map(int.__mul__, map(known.__getitem__, found), found.values())))
                else:
                    sums.append(sum(known.get(p, 0) * n for p, n in found.items()))
                    rest.append([{"pre": p, "n": n} for p, n in found.items() if p not in known])
            columns = [batch.column(0), batch.column(1), pa.array(sums, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns if every else [*columns, pa.array(rest, _REST)], names=[id, "n_bytes", "n_tokens"] if every else [id, "n_bytes", "n_tokens", "rest"])

    kind = docs.schema[id].dataType.simpleString()
    slim = docs.select(F.col(id), _bytes(F.col(text)).alias("n_bytes"), F.col(text).alias("text"))
    schema = f"`{id}` {kind}, n_bytes long, n_tokens long"
    if every:
        return slim.mapInArrow(run, schema).withColumn("over_limit", F.col("n_tokens") > limit)
    row = "row_" + id  # no column of theirs
    summed = scratch.stored(slim.mapInArrow(run, schema + ", rest array<struct<pre string, n long>>").withColumn(row, F.monotonically_increasing_id()), "summed")
    more = summed.select(row, F.explode("rest").alias("r")).select(row, F.col("r.pre").alias("pre"), F.col("r.n").alias("times"))
    more = more.join(counts.select("pre", "pieces"), "pre").groupBy(row).agg(F.sum(F.col("pieces") * F.col("times")).alias("more"))
    out = summed.drop("rest").join(more, row, "left")
    n_tokens = F.col("n_tokens") + F.coalesce("more", F.lit(0))
    return out.select(id, "n_bytes", n_tokens.alias("n_tokens"), (n_tokens > limit).alias("over_limit"))


def _bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")
