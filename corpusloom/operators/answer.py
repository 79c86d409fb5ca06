"""From ranked chunks to a grounded answer: floor, token budget, numbered prompt, citations, history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import budget_tokens, citations, snippet

MIN_SCORE, BUDGET, HISTORY = 0.02, 6000, 6


def floor(reranked: bool, min_score: float | None = None) -> float:
    """Fused scores have no floor; a reranker's have the setting's, or the default."""
    return (min_score if min_score and min_score > 0 else MIN_SCORE) if reranked else 0.0


def grounded(ranked: DataFrame, reranked: bool, min_score: float | None = None, score: str = "score") -> DataFrame:
    return ranked.where(F.col(score) >= floor(reranked, min_score))


def budget_prefix(ranked: DataFrame, budget: int = BUDGET, partition: list[str] | None = None, place: str = "r", content: str = "content") -> DataFrame:
    """The leading rows whose tokens fit the budget: it stops at the first that does not, rather than skip it. A first row
    that alone is too large stays, cut to the budget's bytes at a whole code point. Adds tokens and running."""
    by = Window.partitionBy(*(partition or [])).orderBy(place)
    upto = by.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = ranked.withColumn("tokens", budget_tokens(F.col(content)))
    rows = rows.withColumn("running", F.sum("tokens").over(upto)).withColumn("_n", F.row_number().over(by))
    kept = rows.where((F.col("running") <= budget) | (F.col("_n") == 1))
    # the running sum never falls, so what fits is a prefix
    cut = (F.col("_n") == 1) & (F.col("tokens") > budget)
    return kept.withColumn(content, F.when(cut, byte_prefix(F.col(content), 4 * budget)).otherwise(F.col(content))).drop("_n")


def byte_prefix(text: Column, size: int) -> Column:
    """The longest prefix of whole code points of at most ``size`` UTF-8 bytes."""
    head = F.substring(text.cast("binary"), 1, size)
    # a cut code point decodes to replacement characters at the end, at most three of them
    whole = F.regexp_replace(F.decode(head, "UTF-8"), "�{1,3}$", "")
    return F.when(F.octet_length(text) <= size, text).otherwise(whole)


def rendered_block(number: Column, title: Column, path: Column, uri: Column, content: Column) -> Column:
    """A numbered source: its title and headings, its address, its text; empty headings are left out."""
    where = F.array_join(F.filter(F.concat(F.array(F.coalesce(title, F.lit(""))), F.coalesce(path, F.array().cast("array<string>"))), lambda s: s != ""), " > ")
    return F.concat(F.lit("["), number.cast("string"), F.lit("] "), where, F.lit("\n"), F.coalesce(uri, F.lit("")), F.lit("\n"), content)


def context(rows: DataFrame, partition: list[str], block: str = "block", place: str = "r") -> DataFrame:
    """The blocks of each partition in order, between blank lines. The budget bounds what a partition gathers."""
    ordered = F.array_sort(F.collect_list(F.struct(place, block)))
    return rows.groupBy(*partition).agg(F.array_join(F.transform(ordered, lambda s: s[block]), "\n\n").alias("context"))


def last_turns(turns: DataFrame, n: int = HISTORY, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """The last n turns of each conversation."""
    place = F.row_number().over(Window.partitionBy(conv).orderBy(F.col(turn).desc()))
    return turns.withColumn("_n", place).where(F.col("_n") <= n).drop("_n")


def messages(system: str, history: list[tuple[str, str]], context_text: str, question: str, n: int = HISTORY) -> list[tuple[str, str]]:
    """(role, content) of a prompt: instructions, the last turns, then the sources with the question."""
    return [("system", system), *history[len(history) - min(n, len(history)) :], ("user", f"Sources:\n\n{context_text}\n\nQuestion: {question}")]


def cited(answers: DataFrame, sources: DataFrame, key: str, answer: str = "answer", number: str = "r", content: str = "content") -> DataFrame:
    """One row for each citation of an answer: ``key``, the number, the source's other columns and its snippet."""
    counts = sources.groupBy(key).agg(F.max(number).alias("_n"))
    numbers = answers.join(counts, key).select(key, F.explode(citations(F.col(answer), F.col("_n"))).alias(number))
    return numbers.join(sources, [key, number]).withColumn("snippet", snippet(F.col(content)))


def refusal(tenant: str) -> str:
    """What a refused question is answered with (fixed value)."""
    return f"I couldn't find information about that in {tenant}'s content."


def search_text(question: Column, rewritten: Column, hypothetical: Column) -> Column:
    """What is embedded: a hypothetical answer if there is one, else the rewritten question, else the question."""
    some = lambda c: F.nullif(F.trim(c), F.lit(""))
    return F.coalesce(some(hypothetical), some(rewritten), question)


def query_log(ranked: DataFrame, key: str, place: str = "r") -> DataFrame:
    """One record for each query: its retrieved chunks in order, with rank from 1."""
    entry = F.struct(F.col(place).alias("rank"), "chunk_id", "score")
    return ranked.groupBy(key).agg(F.array_sort(F.collect_list(entry)).alias("retrieved"))


def feedback_latest(feedback: DataFrame, query: str = "query_id", at: str = "created_at", rating: str = "rating") -> DataFrame:
    """The last valid rating (-1 or 1) of each query."""
    return feedback.where(F.col(rating).isin(-1, 1)).groupBy(query).agg(F.max_by(F.struct(rating, at), F.struct(at, rating)).alias("_l")).select(query, f"_l.{rating}", f"_l.{at}")


def permitted_model(model: Column, patterns: list[str]) -> Column:
    """Whether a model is on an allow-list; a trailing * stands for any ending, an empty list for nothing."""
    out = F.lit(False)
    for p in patterns:
        out |= model.startswith(p[:-1]) if p.endswith("*") else model == p
    return out
