"""Small score transforms and keys used around retrieval."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def relevance_from_distance(distance: Column) -> Column:
    """Squared distance to a 0..1 relevance."""
    return F.greatest(F.lit(0.0), 1 - distance / 2)


def relevance_linear(distance: Column) -> Column:
    return 1 - distance


def clamp01(score: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))


def fusion_key(source: Column, chunk_id: Column, text: Column) -> Column:
    """Identity of a document in fusion: source::chunk, chunk, source, else a content hash."""
    src, chunk = F.nullif(source, F.lit("")), F.nullif(chunk_id, F.lit(""))
    return F.coalesce(F.concat(src, F.lit("::"), chunk), chunk, src, F.sha2(text, 256))
