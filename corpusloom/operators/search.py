"""Search as a whole: how much to fetch, whether and by whom to rerank, and what becomes of failures.

Every step that may fail has a result to go on with: a reranker that cannot be had leaves the fused order, a rewrite that
fails the question as it was, a generator that fails the passages without an answer.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import unwrapped

#: Candidates that a reranker is given if the settings name no number (fixed value).
TOP_N = 20


@dataclass(frozen=True)
class Reranking:
    """Settings of a reranker."""

    enabled: bool = False
    provider: str = ""
    allowed: tuple[str, ...] = ()
    has_key: bool = False
    top_n: int = TOP_N

    @property
    def usable(self) -> bool:
        """Whether it can be had: off, unknown, not allowed or without a key means no reranker, not an error."""
        return self.enabled and (self.provider == "llm" or self.provider in self.allowed) and self.has_key


def fetch_k(final: int, settings: Reranking) -> int:
    """Fused candidates to fetch: a reranker sees top_n of them, and the cut to ``final`` comes after it."""
    return max(final, settings.top_n if settings.top_n > 0 else TOP_N) if settings.usable else final


def mapped(candidates: DataFrame, results: DataFrame, id: str = "chunk_id", place: str = "r") -> DataFrame:
    """``id`` and rerank_score from a provider's (query, index from 0, relevance, at): by place among the query's candidates; indexes
    out of range are dropped, and of a repeated one the first stands."""
    once = results.groupBy("query", "index").agg(F.min_by("relevance", "at").alias("rerank_score"))
    return candidates.join(once, (candidates["query"] == once["query"]) & (candidates[place] == once["index"] + 1)).select(candidates["query"], candidates[id], "rerank_score")


def completed(candidates: DataFrame, scores: DataFrame, id: str = "chunk_id") -> DataFrame:
    """Scores of all candidates of a query: those that the reranker left out have 0, so they come last and are kept."""
    return candidates.select("query", id).join(scores, ["query", id], "left").withColumn("rerank_score", F.coalesce("rerank_score", F.lit(0.0)))


def searched(fused: DataFrame, scores: DataFrame | None, final: int, settings: Reranking, id: str = "chunk_id", place: str = "r") -> DataFrame:
    """query, ``id`` and r of each query's final results: of the fetched fused rows the first top_n in the reranker's order (its
    omissions after what it scored, as they stood), then the rest; cut to ``final``."""
    rows = fused.where(F.col(place) <= fetch_k(final, settings))
    if settings.usable and scores is not None:
        n = settings.top_n if settings.top_n > 0 else TOP_N
        head = F.col(place) <= n
        rows = rows.join(completed(rows.where(head), scores, id), ["query", id], "left")
        order = [F.when(head, 0).otherwise(1), F.when(head, -F.col("rerank_score")), F.col(place)]
    else:
        order = [F.col(place)]
    ranked = rows.withColumn("_n", F.row_number().over(Window.partitionBy("query").orderBy(*order))).where(F.col("_n") <= final)
    return ranked.select("query", id, F.col("_n").alias("r"))


def standalone(question: Column, turns: Column, enabled: Column, rewritten: Column) -> Column:
    """The question to search by: a rewrite where that is on, there is history and the model gave one, else the question."""
    told = unwrapped(rewritten)
    return F.when(enabled & (F.coalesce(turns, F.lit(0)) > 0) & (told != ""), told).otherwise(question)


def answered(questions: DataFrame, sources: DataFrame, id: str = "chunk_id", place: str = "r") -> DataFrame:
    """``questions`` (query, answer, error, grounded, streamed) with outcome and citations.

    Ungrounded questions are refused and cite nothing. Where the generator failed, the result is degraded: the candidates
    without an answer. A streamed answer records its candidates, as they were known before it was generated; any other
    one the sources that it cites, in order of number.
    """
    own = F.array_sort(F.collect_list(F.struct(F.col(place).alias("n"), F.col(id).alias("id"))))
    rows = questions.join(sources.groupBy("query").agg(own.alias("_s")), "query", "left")
    kind = rows.schema["_s"].dataType  # ids of any type
    rows = rows.withColumn("_s", F.coalesce("_s", F.array().cast(kind)))
    cited = F.transform(F.regexp_extract_all(F.coalesce("answer", F.lit("")), F.lit(r"\[([0-9]{1,9})\]"), F.lit(1)), lambda s: s.cast("int"))
    outcome = F.when(~F.coalesce("grounded", F.lit(False)), "refused").when(F.col("error").isNotNull() | F.col("answer").isNull(), "degraded").otherwise("answered")
    every = F.transform("_s", lambda s: s["id"])
    told = F.transform(F.filter("_s", lambda s: F.array_contains(F.col("_c"), s["n"])), lambda s: s["id"])
    rows = rows.withColumns({"outcome": outcome, "_c": cited})
    citations = F.when(F.col("outcome") == "refused", F.array().cast(sources.select(F.array(id)).schema[0].dataType)).when(F.col("streamed") | (F.col("outcome") == "degraded"), every).otherwise(told)
    return rows.withColumn("citations", citations).drop("_s", "_c")
