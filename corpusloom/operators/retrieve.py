"""Hybrid retrieval: filtered top-k by vector and by text, fused by reciprocal rank, joined back to the chunks.

The lists are cut to their k before anything wide is joined: a top-k is a per-task heap (TakeOrderedAndProject), and the fused
list of at most k_vector + k_text ids is broadcast to the chunks.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import datetime
from typing import TYPE_CHECKING, Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from corpusloom.functions.times import utc
from corpusloom.functions import textquery
from corpusloom.functions.vector import cosine_distance, literal

if TYPE_CHECKING:
    from corpusloom.operators.index import Index

RRF = 60
#: Defaults and the ceiling of final_k.
K_VECTOR, K_TEXT, FINAL_K, MAX_K = 40, 40, 8, 100
#: Rows that a task compares with all queries of a batch at once.
SLICE_ROWS = 1024


@dataclass(frozen=True)
class Filters:
    """Unset filters, empty lists too, do not apply. Prefixes are literal; times are inclusive; tags must all be there."""

    sources: list[str] | None = None
    uri_prefix: str | None = None
    since: datetime | None = None
    until: datetime | None = None
    tags: dict[str, Any] = field(default_factory=dict)

    def condition(self, source: str = "source", uri: str = "uri", created: str = "created_at", metadata: str = "metadata") -> Column:
        """One predicate of the filters that are set; it reaches the scan."""
        out = F.lit(True)
        if self.sources:
            out &= F.col(source).isin(list(self.sources))
        if self.uri_prefix:
            out &= F.col(uri).startswith(self.uri_prefix)
        if self.since is not None:
            out &= F.col(created) >= utc(self.since)
        if self.until is not None:
            out &= F.col(created) <= utc(self.until)
        for k, v in sorted(self.tags.items()):
            # plain texts are compared by the JVM; numbers, lists and objects by containment
            out &= F.get_json_object(metadata, f"$['{k}']").eqNullSafe(F.lit(v)) if isinstance(v, str) else contained(F.col(metadata), {k: v})
        return out


def contains_json(outer: object, inner: object) -> bool:
    """Whether a JSON value holds another: objects by names, lists by elements, a list also a scalar of it."""
    if isinstance(inner, dict):
        return isinstance(outer, dict) and all(k in outer and contains_json(outer[k], v) for k, v in inner.items())
    if isinstance(inner, list):
        return isinstance(outer, list) and all(any(contains_json(o, i) for o in outer) for i in inner)
    return outer == inner or isinstance(outer, list) and inner in [o for o in outer if not isinstance(o, dict | list)]


def contained(metadata: Column, inner: Any) -> Column:
    """Whether a JSON text holds a value; false for a null or a malformed text."""

    @F.pandas_udf(T.BooleanType())
    def test(texts: pd.Series) -> pd.Series:
        def one(text: str | None) -> bool:
            try:
                return text is not None and contains_json(json.loads(text), inner)
            except ValueError:
                return False

        return texts.map(one)

    return test(metadata)


def live(chunks: DataFrame, documents: DataFrame, version: str = "version_id") -> DataFrame:
    """Chunks of the current versions of active documents: a semi-join."""
    current = documents.where("status = 'active'").select(F.col("current_version").alias(version))
    return chunks.join(current, version, "left_semi")


def ranked(df: DataFrame, k: int, *order: Column) -> DataFrame:
    """The first k rows with r, their place. Only k rows reach the window."""
    return df.orderBy(*order).limit(k).withColumn("r", F.row_number().over(Window.orderBy(*order)))


def top_vector(chunks: DataFrame, query: list[float], k: int = K_VECTOR, id: str = "chunk_id", embedding: str = "embedding") -> DataFrame:
    """``id``, distance and r of the k nearest chunks; those without a comparable vector are left out, ties go by id."""
    scored = chunks.select(id, cosine_distance(F.col(embedding), literal(query)).alias("distance")).where("distance is not null")
    return ranked(scored, k, F.col("distance"), F.col(id))


def top_text(chunks: DataFrame, query: str, k: int = K_TEXT, id: str = "chunk_id", content: str = "content") -> DataFrame:
    """``id``, score and r of the k best chunks that match a text query; ties go by id."""
    q = textquery.parse(query)
    matching = chunks.where(q.matches(F.col(content))).select(id, q.rank(F.col(content)).alias("score"))
    return ranked(matching, k, F.col("score").desc(), F.col(id))


def fused(lists: list[DataFrame], k: int | None = None, id: str = "chunk_id", constant: int = RRF) -> DataFrame:
    """``id`` and score, the sum of 1 / (constant + r) over the lists, best first."""
    all_rows = lists[0].select(id, "r")
    for other in lists[1:]:
        all_rows = all_rows.unionByName(other.select(id, "r"))
    out = all_rows.groupBy(id).agg(F.sum(F.lit(1.0).cast("double") / (F.lit(constant) + F.col("r"))).alias("score"))
    return out.orderBy(F.col("score").desc(), F.col(id)).limit(k) if k else out


def final_k(asked: int | None, setting: int | None, ceiling: int = MAX_K) -> int:
    """The request's, else the setting's, else the default; within 1 and the ceiling."""
    k = asked if asked and asked > 0 else setting if setting and setting > 0 else FINAL_K
    return min(k, ceiling)


def hybrid(chunks: DataFrame, vector: list[float], text: str, filters: Filters | None = None, k_vector: int = K_VECTOR, k_text: int = K_TEXT, k: int = FINAL_K, id: str = "chunk_id", index: Index | None = None, share: float = 1.0) -> DataFrame:
    """The chunks' rows with score, best first. Filters apply before either ranking.

    With ``index`` both lists come from it: the words' postings, and the vector lists that can hold a neighbour which passes the
    filters (``share`` below 1 reads fewer, see ``Index.search``); ``chunks`` is then read for the best rows only. It must have been
    built of these chunks, with the columns that the filters read."""
    if not text.strip():
        raise ValueError("the query is blank")
    if index is None:
        kept = chunks.where(filters.condition()) if filters else chunks
        lists = [top_vector(kept, vector, k_vector, id), top_text(kept.select(id, "content"), text, k_text, id)]
    else:
        held = F.col("held") & filters.condition() if filters else F.col("held")
        lists = [index.search(vector, k_vector, held, share)[0], index.top_text(text, k_text, index.attributes.where(filters.condition()) if filters else None)]
    # at most k rows
    return chunks.join(F.broadcast(fused(lists, k, id)), id).orderBy(F.col("score").desc(), F.col(id))


def top_vector_batch(chunks: DataFrame, queries: list[tuple[int, list[float]]], k: int = K_VECTOR, id: str = "chunk_id", embedding: str = "embedding", lists: dict[int, list[int]] | None = None) -> DataFrame:
    """query, ``id``, distance and r for many queries at once: each task keeps the k nearest of its rows for each query by one
    matrix product for each ``SLICE_ROWS`` rows, and only those are shuffled. ``queries`` travel to the tasks, so take some thousands at a
    time. With ``lists``, a row of column list is compared with the queries (by place) that its list names, and other rows
    are not read."""
    keys = [q for q, _ in queries]
    wanted = np.array([v for _, v in queries], np.float64).reshape(len(queries), -1)
    size = np.linalg.norm(wanted, axis=1, keepdims=True)
    unit = np.divide(wanted, size, out=np.zeros_like(wanted), where=size > 0)
    kind = chunks.schema[id].dataType
    own_kind = to_arrow_type(kind)

    some = [q for q in range(len(keys)) if size[q, 0] > 0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near = np.full((len(keys), k), np.inf)
        ids, places, seen = np.full((len(keys), k), None, object), np.zeros((len(keys), k), np.int64), 0
        for batch in (b.slice(at, SLICE_ROWS) for b in batches for at in range(0, b.num_rows, SLICE_ROWS)):
            rows = [r for r in zip(*(c.to_pylist() for c in batch.columns), strict=True) if r[1] is not None and len(r[1]) == unit.shape[1] and None not in r[1]]
            if not rows or not some:
                continue
            m = np.array([r[1] for r in rows], np.float64)
            n = np.linalg.norm(m, axis=1)
            rows, m = [r for r, x in zip(rows, n, strict=True) if x > 0], m[n > 0] / n[n > 0, None]
            parts: dict[int, list[int]] = {}
            for j, r in enumerate(rows):
                parts.setdefault(r[2] if lists else -1, []).append(j)
            for part, at in parts.items():
                asked = [q for q in lists[part] if size[q, 0] > 0] if lists else some
                own, order = np.fromiter((rows[j][0] for j in at), object, len(at)), np.array(at) + seen
                distance = 1 - unit[asked] @ m[at].T
                # rows come in the order of ids, so of equal distances the earlier one stays
                least = np.argsort(distance, axis=1, kind="stable")[:, :k]
                both = np.concatenate([near[asked], np.take_along_axis(distance, least, 1)], axis=1)
                named = np.concatenate([ids[asked], own[least]], axis=1)
                placed = np.concatenate([places[asked], order[least]], axis=1)
                kept = np.lexsort((placed, both))[:, :k]
                near[asked], ids[asked], places[asked] = (np.take_along_axis(x, kept, 1) for x in (both, named, placed))
            seen += len(rows)
        for at in range(0, len(keys), SLICE_ROWS):
            q, place = np.nonzero(near[at : at + SLICE_ROWS] < np.inf)
            found = [pa.array([keys[at + x] for x in q], pa.int64()), pa.array(ids[at + q, place].tolist(), own_kind), pa.array(near[at + q, place])]
            yield pa.RecordBatch.from_arrays(found, names=["query", id, "distance"])

    schema = T.StructType([T.StructField("query", T.LongType()), T.StructField(id, kind), T.StructField("distance", T.DoubleType())])
    # rows of equal distance in id order, so that a task's cut agrees with the final one
    read = chunks.where(F.col("list").isin(sorted(lists))).select(id, embedding, "list") if lists is not None else chunks.select(id, embedding)
    found = read.sortWithinPartitions(id).mapInArrow(run, schema)
    place = F.row_number().over(Window.partitionBy("query").orderBy("distance", id))
    return found.withColumn("r", place).where(F.col("r") <= k)


def reranked(fused_rows: DataFrame, scores: DataFrame, n: int, id: str = "chunk_id", place: str = "r") -> DataFrame:
    """Rows in a new order (new_r): of the first n, those with a score by it, then those without as they stood; the rest
    untouched. Scores of unknown ids are ignored, and of an id's several scores the best counts."""
    best = scores.groupBy(id).agg(F.max("rerank_score").alias("rerank_score"))
    rows = fused_rows.join(best, id, "left")
    bucket = F.when(F.col(place) > n, 2).when(F.col("rerank_score").isNull(), 1).otherwise(0)
    within = F.when(bucket == 0, -F.col("rerank_score"))
    return rows.withColumn("new_r", F.row_number().over(Window.orderBy(bucket, within, F.col(place))))


def lexical_scores(candidates: DataFrame, question: str, id: str = "chunk_id", content: str = "content") -> DataFrame:
    """A deterministic reranker: the share of the question's words that a candidate has."""
    from corpusloom.functions.text import lexemes

    words = F.array_distinct(lexemes(F.lit(question)))
    hit = F.size(F.array_intersect(lexemes(F.col(content)), words))
    return candidates.select(id, F.try_divide(hit.cast("double"), F.size(words)).alias("rerank_score"))


def ranking_scores(answer: str, n: int) -> list[tuple[int, float]]:
    """(0-based candidate, score) from a model's answer: its first balanced list of 1-based numbers; bad and repeated ones are
    dropped, scores fall strictly."""
    for start in (k for k, c in enumerate(answer) if c == "["):
        depth = 0
        for stop in range(start, len(answer)):
            depth += {"[": 1, "]": -1}.get(answer[stop], 0)
            if not depth:
                break
        if depth:
            continue
        try:
            found = json.loads(answer[start : stop + 1])
        except ValueError:
            continue
        out: list[tuple[int, float]] = []
        for x in found:
            given = None
            if isinstance(x, dict):
                x, given = x.get("id", x.get("index")), x.get("score")
            if isinstance(x, int) and not isinstance(x, bool) and 1 <= x <= n and x - 1 not in [k for k, _ in out]:
                top = out[-1][1] if out else float("inf")
                score = float(given) if isinstance(given, int | float) else 1 - len(out) / max(n, 1)
                out.append((x - 1, min(score, float(np.nextafter(top, -np.inf)))))
        return out
    return []
