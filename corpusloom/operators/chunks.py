"""Structure-aware chunking of parsed documents.

Sections end at headings; prose fills a chunk to the token target and carries an overlap of words into the next one; tables
and code stay whole up to twice the target, and beyond it are cut between rows or lines only.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from corpusloom.operators.blocks import CODE, HEADING, TABLE, pipe_table, slices

TARGET, OVERLAP = 512, 64
_TOKEN = re.compile(r"[^\W_]+|[^\s\w]|_")

CHUNK = T.StructType(
    [
        T.StructField("position", T.IntegerType()),
        T.StructField("heading_path", T.ArrayType(T.StringType())),
        T.StructField("content", T.StringType()),
        T.StructField("embed_text", T.StringType()),
        T.StructField("token_count", T.IntegerType()),
    ]
)


def estimate(text: str) -> int:
    """Runs of letters and digits, and other visible characters one by one."""
    return sum(1 for _ in _TOKEN.finditer(text))


@dataclass(frozen=True)
class Splitter:
    """An overlap of 0 means the default, and one not under the target is half of it."""

    target: int = TARGET
    overlap: int = OVERLAP
    count: Callable[[str], int] = estimate

    def settled(self) -> Splitter:
        target = self.target if self.target > 0 else TARGET
        overlap = self.overlap if self.overlap > 0 else OVERLAP
        return Splitter(target, overlap if overlap < target else target // 2, self.count)

    def split(self, title: str, blocks: list[dict]) -> list[dict]:
        own = self.settled()
        out = []
        for path, content in own._contents(blocks):
            content = content.strip()
            if content:
                out.append({"position": len(out), "heading_path": path, "content": content, "embed_text": embed_text(title, path, content), "token_count": self.count(content)})
        return out

    def _contents(self, blocks: list[dict]) -> Iterator[tuple[list[str], str]]:
        path: list[str] = []
        prose: list[str] = []
        held = 0
        for b in blocks:
            text = (b["text"] or "").strip()
            if b["type"] not in (HEADING, TABLE, CODE):
                if not text:
                    continue
                n = self.count(text)
                if held and held + n > self.target:
                    whole = "\n\n".join(prose)
                    yield path, whole
                    tail = self.tail(whole)
                    prose, held = ([tail], self.count(tail)) if tail else ([], 0)
                prose.append(text)
                held += n
                continue
            if prose:
                yield path, "\n\n".join(prose)
            prose, held = [], 0
            if b["type"] == HEADING:
                depth = min(max(b["level"] or 1, 1), 6) - 1
                path = [*path[:depth], *[""] * (depth - len(path)), text]
            elif self.count(text) <= 2 * self.target:
                yield path, text
            else:
                yield from ((path, part) for part in self.parts(b, text))
        if prose:
            yield path, "\n\n".join(prose)

    def tail(self, text: str) -> str:
        """The last words whose estimates reach the overlap."""
        words, total, kept = text.split(), 0, 0
        while kept < len(words) and total < self.overlap:
            kept += 1
            total += self.count(words[-kept])
        return " ".join(words[len(words) - kept :])

    def parts(self, b: dict, text: str) -> Iterator[str]:
        """An oversize table by rows, each part with the header; code, or a table of one row, by lines."""
        rows = b["rows"] if b["type"] == TABLE else None
        if rows is not None and len(rows) > 1:
            part = [rows[0]]
            for row in rows[1:]:
                part.append(row)
                if self.count(pipe_table(part)) >= self.target:
                    yield pipe_table(part)
                    part = [rows[0]]
            if len(part) > 1:
                yield pipe_table(part)
            return
        lines, held = [], 0
        for line in text.split("\n"):
            n = self.count(line)
            if lines and held + n > self.target:
                yield "\n".join(lines)
                lines, held = [], 0
            lines.append(line)
            held += n
        yield "\n".join(lines)


def embed_text(title: str | None, path: list[str], content: str) -> str:
    """The content under its context line, title > headings; a part that repeats the one before is left out."""
    parts: list[str] = []
    for p in (title or "", *path):
        if p.strip() and parts[-1:] != [p.strip()]:
            parts.append(p.strip())
    return " > ".join(parts) + "\n" + content if parts else content


def chunked(title: Column, blocks: Column, target: int = TARGET, overlap: int = OVERLAP) -> Column:
    """The chunks of a document, an array of structs, by slices of Arrow batches."""
    splitter, kind = Splitter(target, overlap), to_arrow_type(T.ArrayType(CHUNK))

    @F.arrow_udf(T.ArrayType(CHUNK))
    def run(parts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for titles, trees in parts:
            mean = trees.nbytes // max(1, len(trees))
            for at, n in slices([mean] * len(trees)):
                rows = zip(titles.slice(at, n).to_pylist(), trees.slice(at, n).to_pylist(), strict=True)
                yield pa.array([splitter.split(t, bs or []) for t, bs in rows], kind)

    return run(title, blocks)


def exploded(docs: DataFrame, id: str, target: int = TARGET, overlap: int = OVERLAP) -> DataFrame:
    """One row for each chunk of documents with title and blocks: ``id``, position, heading_path, content, embed_text,
    token_count and chunk_hash (SHA-256 of the embed text)."""
    rows = docs.select(id, F.explode(chunked(F.col("title"), F.col("blocks"), target, overlap)).alias("c")).select(id, "c.*")
    return rows.withColumn("chunk_hash", F.sha2("embed_text", 256))
