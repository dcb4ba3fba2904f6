"""Column functions on embeddings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corvane.functions.text import col


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine similarity in doubles, 0 where a norm is 0."""
    a, b = col(a), col(b)
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size == 0, F.lit(0.0)).otherwise(dot(a, b) / size)


def cosine_distance(a: Column | str, b: Column | str) -> Column:
    return F.lit(1.0) - cosine(a, b)


def hash_embedding(text: Column | str, dim: int = 8) -> Column:
    """A deterministic stand-in for an embedding model: bytes of the text's SHA-256 as (b - 128) / 128, zeros beyond 32."""
    digest = F.sha2(col(text), 256)
    return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.when(i < 32, (F.conv(F.substring(digest, i * 2 + 1, F.lit(2)), 16, 10).cast("double") - 128) / 128).otherwise(F.lit(0.0)))


def checked(embedding: Column | str, dim: int) -> Column:
    """The embedding; the job fails if its length is not dim."""
    e = col(embedding)
    return F.when(F.size(e) == dim, e).otherwise(F.raise_error(F.concat(F.lit(f"embedding of length other than {dim}: "), F.size(e).cast("string"))))
