"""Vector functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda total, x: total + x)


def norm(vector: Column) -> Column:
    return F.sqrt(_sum(F.transform(vector, lambda x: x.cast("double") * x.cast("double"))))


def cosine_similarity(a: Column, b: Column) -> Column:
    """Cosine similarity in double; NULL where a vector has no length."""
    dot = _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))
    lengths = norm(a) * norm(b)
    return F.when(lengths > 0, dot / lengths)


def cosine_distance(a: Column, b: Column) -> Column:
    return F.lit(1.0) - cosine_similarity(a, b)


def l2_normalize(vector: Column) -> Column:
    """The vector scaled to length 1; NULL where it has no length."""
    length = norm(vector)
    return F.when(length > 0, F.transform(vector, lambda x: (x / length).cast("float")))


def vector_to_text(vector: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(vector.cast("array<string>"), ","), F.lit("]"))


def vector_from_text(text: Column) -> Column:
    return F.from_json(text, "array<float>")
