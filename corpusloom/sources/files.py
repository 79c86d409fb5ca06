"""File sources: uploads checked by name and content, and evaluation cases from CSV."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Extensions that may be uploaded, and their types: fixed values.
TYPES = {
    "pdf": "application/pdf",
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "md": "text/markdown",
    "markdown": "text/markdown",
    "html": "text/html",
    "htm": "text/html",
    "txt": "text/plain",
    "csv": "text/csv",
}
#: Columns of a case file; lists are separated by |.
CASE_COLUMNS = ("question", "expected_answer", "expected_doc_ids", "tags")


def declared_type(path: Column) -> Column:
    """The type that a file's extension stands for, null if it is not allowed."""
    extension = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    out = F.lit(None).cast("string")
    for k, v in TYPES.items():
        out = F.when(extension == k, v).otherwise(out)
    return out


def plausible(kind: Column, content: Column) -> Column:
    """Whether a file's first 512 bytes fit its type: magic numbers for PDF and zipped Office files, no control bytes in text."""
    head = F.hex(F.substring(content, 1, 512))
    # byte values that no text has: 00-08, 0B, 0E-1A, 1C-1F
    binary = F.rlike(head, F.lit(r"^(?:..)*?(?:0[0-8BEF]|1[0-9ACDEF])"))
    magic = F.startswith(head, F.lit("25504446")) | F.startswith(head, F.lit("504B0304"))
    return (
        F.when(kind == TYPES["pdf"], F.startswith(head, F.lit("255044462D")))
        .when(kind == TYPES["docx"], F.startswith(head, F.lit("504B0304")))
        .when(kind.isNotNull(), ~binary & ~magic)
        .otherwise(F.lit(False))
    )


def uploads(spark: SparkSession, path: str) -> DataFrame:
    """One row for each file: external_id, mime, content, ok and reason."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    kind = declared_type(F.col("path"))
    ok = plausible(F.col("mime"), F.col("content"))
    rows = files.select(F.substring_index("path", "/", -1).alias("external_id"), kind.alias("mime"), "content", F.col("modificationTime").alias("updated_at"))
    reason = F.when(F.col("mime").isNull(), "type not allowed").when(~ok, "content does not match the type")
    return rows.withColumns({"ok": F.col("mime").isNotNull() & ok, "reason": reason})


def cases(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation cases from CSV files with a header that names question and any of the other columns, in any order; short
    rows are filled with nothing, an unknown or missing column is an error."""
    raw = spark.read.option("header", "true").option("multiLine", "true").option("escape", '"').csv(path)
    names = {c: c.strip().lower() for c in raw.columns}
    unknown = sorted(set(names.values()) - set(CASE_COLUMNS))
    if unknown or "question" not in names.values():
        raise ValueError(f"unknown columns {unknown}" if unknown else "there is no column question")
    rows = raw.select(*[F.trim(F.col(f"`{c}`")).alias(n) for c, n in names.items()])
    for c in CASE_COLUMNS:
        if c not in rows.columns:
            rows = rows.withColumn(c, F.lit(None).cast("string"))
    listed = lambda c: F.filter(F.transform(F.split(F.coalesce(F.col(c), F.lit("")), r"\|"), lambda v: F.trim(v)), lambda v: v != "")
    return rows.where("coalesce(question, '') <> ''").select("question", "expected_answer", listed("expected_doc_ids").alias("expected_doc_ids"), listed("tags").alias("tags"))
