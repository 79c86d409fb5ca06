"""Dense vectors as arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """Inner product; null if a vector is null or their lengths differ."""
    terms = F.zip_with(_double(a), _double(b), lambda x, y: x * y)
    return F.when(F.size(a) == F.size(b), F.aggregate(terms, F.lit(0.0), lambda s, t: s + t))


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(_double(a), F.lit(0.0), lambda s, x: s + x * x))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; null if a vector is null or zero or their lengths differ."""
    size = norm(a) * norm(b)
    return F.lit(1.0) - F.when(size > 0, dot(a, b) / size)


def literal(values: list[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def parse(text: Column) -> Column:
    """``[1,2.5]`` as a vector."""
    return F.transform(F.split(F.regexp_replace(text, r"[\[\]\s]", ""), ","), lambda s: s.cast("float"))


def render(v: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(v.cast("array<string>"), ","), F.lit("]"))
