"""Evaluation of retrieval and answers, all cases in one batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def recall_hit(expected: Column, retrieved: Column) -> Column:
    """Whether any expected document was retrieved; null where nothing is expected."""
    return F.when(F.size(F.coalesce(expected, F.array().cast("array<string>"))) > 0, F.coalesce(F.arrays_overlap(expected, retrieved), F.lit(False)))


def run(cases: DataFrame, retrieved: DataFrame) -> DataFrame:
    """Of each case (case_id, question, expected) retrieved, its documents in order (from case_id, r, document_id), recall_hit and
    error. A blank question or one that nothing came back for is a result like others, so one case never stops the rest."""
    rows = cases.join(retrieved_documents(retrieved), "case_id", "left")
    blank = F.trim(F.coalesce("question", F.lit(""))) == ""
    found = F.coalesce("retrieved", F.array().cast("array<string>"))
    return rows.select("case_id", found.alias("retrieved"), F.when(~blank, recall_hit(F.col("expected"), found)).alias("recall_hit"), F.when(blank, "the question is blank").alias("error"))


def verdict(answer: Column) -> Column:
    """A judge's word: INCORRECT is looked for before CORRECT, which it contains; neither is null."""
    return F.when(F.rlike(answer, F.lit(r"(?i)\bINCORRECT\b")), False).when(F.rlike(answer, F.lit(r"(?i)\bCORRECT\b")), True)


def summary(results: DataFrame) -> DataFrame:
    """One row: cases, errors, recall_scored, recall, grounded_rate, correctness, mean_latency_ms (whole milliseconds, failed
    cases included). Null recall hits and correctness are not counted; a rate over nothing is null."""
    share = lambda c: F.try_divide(F.count_if(c).cast("double"), F.count(c).cast("double"))
    return results.agg(
        F.count("*").alias("cases"),
        F.count("error").alias("errors"),
        F.count("recall_hit").alias("recall_scored"),
        share(F.col("recall_hit")).alias("recall"),
        F.try_divide(F.count_if("grounded").cast("double"), F.count("*").cast("double")).alias("grounded_rate"),
        share(F.col("correct")).alias("correctness"),
        F.floor(F.try_divide(F.sum("latency_ms").cast("double"), F.count("*").cast("double"))).cast("long").alias("mean_latency_ms"),
    )


def gate(summaries: DataFrame, recall: float | None = None, grounded: float | None = None, correctness: float | None = None) -> DataFrame:
    """``summaries`` with skipped (no cases) and failures: the names of thresholds missed. A threshold whose rate has no cases
    behind it is a failure. At least one threshold must be set."""
    wanted = {"recall": recall, "grounded_rate": grounded, "correctness": correctness}
    if all(v is None for v in wanted.values()):
        raise ValueError("a gate needs a threshold")
    missed = [F.when(F.col(c).isNull() | (F.col(c) < v), F.lit(c)) for c, v in wanted.items() if v is not None]
    return summaries.withColumn("skipped", F.col("cases") == 0).withColumn("failures", F.when(F.col("cases") == 0, F.array().cast("array<string>")).otherwise(F.array_compact(F.array(*missed))))


def report(results: DataFrame, cases: DataFrame) -> DataFrame:
    """Results with their cases' questions, oldest case first, results of removed cases last."""
    return results.join(cases, "case_id", "left").orderBy(F.col("created_at").asc_nulls_last(), "case_id")


def retrieved_documents(ranked: DataFrame, case: str = "case_id", document: str = "document_id", place: str = "r") -> DataFrame:
    """Each case's distinct documents in the order retrieved."""
    rows = F.transform(F.array_sort(F.collect_list(F.struct(place, document))), lambda s: s[document])
    return ranked.groupBy(case).agg(F.array_distinct(rows).alias("retrieved"))


def merged_settings(base: dict, overlay: dict) -> dict:
    """Settings with an overlay: objects merge by name, all else is replaced, null removes nothing."""
    out = dict(base)
    for k, v in overlay.items():
        out[k] = merged_settings(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def boilerplate(pages: DataFrame) -> DataFrame:
    """One row for a corpus of parsed pages (text, content and boilerplate: markers that should stay and go): pages, removal (the mean
    share of boilerplate that is gone; 1 for a page without any), retention (the share of all content markers that are left)."""
    left = lambda c: F.size(F.filter(c, lambda m: F.contains(F.col("text"), m)))
    gone = F.coalesce(F.try_divide((F.size("boilerplate") - left("boilerplate")).cast("double"), F.size("boilerplate").cast("double")), F.lit(1.0))
    kept = F.try_divide(F.sum(left("content")).cast("double"), F.sum(F.size("content")).cast("double"))
    return pages.agg(F.count("*").alias("pages"), F.avg(gone).alias("removal"), F.coalesce(kept, F.lit(1.0)).alias("retention"))


def cases_changed(cases: DataFrame, changes: DataFrame) -> DataFrame:
    """The cases (case_id, question, expected) after a list of changes (seq, op: put or delete, and the same columns): the last change
    of each case stands."""
    last = changes.groupBy("case_id").agg(F.max_by(F.struct("op", "question", "expected"), "seq").alias("_c"))
    rows = cases.join(last, "case_id", "full_outer").where(F.col("_c").isNull() | (F.col("_c.op") == "put"))
    pick = lambda c: F.when(F.col("_c").isNotNull(), F.col(f"_c.{c}")).otherwise(F.col(c)).alias(c)
    return rows.select("case_id", pick("question"), pick("expected"))
