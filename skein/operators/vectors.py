"""Embedding spaces and the reuse of embeddings of equal content."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.operators.catalog import with_cached_embeddings

SPACES = "space long, name string, provider string, model string, dimensions int, distance string"


def ensure_space(spaces: DataFrame, name: str, provider: str, model: str, dimensions: int) -> tuple[DataFrame, int]:
    """The spaces with this one, and its number; the same name with another identity is an error."""
    if dimensions <= 0:
        raise ValueError("dimensions must be positive")
    known = spaces.where(F.col("name") == name).first()
    if known is not None:
        if (known.provider, known.model, known.dimensions) != (provider, model, dimensions):
            raise ValueError(f"space {name} has another identity")
        return spaces, known.space
    number = (spaces.agg(F.max("space")).first()[0] or 0) + 1
    row = spaces.sparkSession.createDataFrame([(number, name, provider, model, dimensions, "cosine")], SPACES)
    return spaces.unionByName(row), number


def attach(docs: DataFrame, cache: DataFrame, space: int, dimensions: int, embed: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """``docs`` (doc_id, content_hash, body) with embeddings of ``space``, and the rows to append to ``cache``.

    ``embed`` gets each distinct missing content once (content_hash, body) and returns (content_hash, embedding).
    """
    rows = with_cached_embeddings(docs.withColumn("space", F.lit(space).cast("long")), cache)
    missing = rows.where("not cached").groupBy("content_hash").agg(F.first("body").alias("body"))
    made = embed(missing).select("content_hash", "embedding")
    right = F.size("embedding") == dimensions
    made = made.withColumn("embedding", F.when(right, F.col("embedding")).otherwise(F.raise_error(F.lit(f"an embedding of {dimensions} numbers was expected"))))
    done = rows.where("cached").select("doc_id", "content_hash", "embedding")
    fresh = rows.where("not cached").select("doc_id", "content_hash").join(made, "content_hash").select("doc_id", "content_hash", "embedding")
    return done.unionByName(fresh), made.select(F.lit(space).cast("long").alias("space"), "content_hash", "embedding")
