"""The corpus pipeline: language ID, near-dedup, decontamination, PII masking, packing, each applied to what the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the next one's docs.
All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import copies, decontam, langid, packing, pii, scratch
from corpusloom.session import bound_batches, ship
from corpusloom.sources.tables import spread, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in no learned language: null texts, texts without a letter, and those whose nearest profile is farther than half
    of what held-out documents reach allows (texts in another script, strings of letters that are no words). Profiles are learned from
    the documents that the operator's split does not hold out, the bound from those it does; where no document has a language to
    learn from, letters alone decide."""
    held = langid.held_out(F.col("doc_id"))
    profiles = langid.fit(docs.where(~held))
    return langid.identified(docs, profiles, least=langid.least_score(docs.where(held), profiles))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest id of each group of exact copies and of texts linked by a five-word shingle similarity
    of at least 0.8; of repeated rows of that id, one. Candidates are SimHash links over deletion variants and what a shingle join
    finds beyond them; every link is verified on whole texts.

    A document without an id goes by a hash of its text, above all ids."""
    key = F.coalesce(F.col("doc_id").cast("long"), F.shiftrightunsigned(F.xxhash64("text"), 2) + F.lit(1 << 62))
    name = "key_" + "".join(docs.columns)  # no column of theirs
    keyed = docs.withColumn(name, key)
    kept = copies.near_copies(keyed.select(name, "text"), id=name).select(F.col("component_id").alias(name)).distinct()
    return keyed.join(kept, name, "left_semi").dropDuplicates([name]).select(*[F.col(f"`{c}`") for c in docs.columns])


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a passage of a test item, edited ones included."""
    return decontam.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def mask_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks personal data; other text stays as it is."""
    return pii.mask(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents into sequences."""
    return packing.pack(docs)


def _bounded(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """The stage with bounded Arrow batches: stages follow each other in the same executors, beside a heap that the one before has filled."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        bound_batches(spark)
        return stage(spark, docs, sf_dir)

    return run


STAGES = [(stage.__name__, _bounded(stage)) for stage in (language_id, near_dedup, decontaminate, mask_pii, pack)]

#: SimHash components, alignment, classifiers and packing are not expressible in SQL; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents."""
    ship(spark)
    docs = spread(table(spark, sf_dir, "documents"))
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = scratch.stored(docs, f"stage-{name}")
    return docs


QUERIES = {"pipeline": run}
ORACLE = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
