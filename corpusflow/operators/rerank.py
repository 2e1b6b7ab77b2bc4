"""Second-stage ordering of candidates by a pair scorer."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.functions.text import token_overlap
from corpusflow.operators.sparse import top_ranked


def rerank(
    candidates: DataFrame,
    top_k: int = 5,
    scorer: Callable[[Column, Column], Column] = token_overlap,
    query: str = "query_text",
    text: str = "text",
) -> DataFrame:
    """Top-k candidates by ``scorer(query, text)``: a column expression or a pandas UDF.

    Candidates keep their key, so details found earlier stay attached.
    """
    scored = candidates.withColumn("rerank_score", scorer(F.col(query), F.col(text)).cast("double"))
    return top_ranked(scored.drop("rank"), top_k, "rerank_score")


def rerank_without_model(candidates: DataFrame, top_k: int = 5) -> DataFrame:
    """Keep the given order: 1.0, 0.9, 0.8 and so on."""
    kept = candidates.filter(F.col("rank") <= top_k)
    return kept.withColumn("rerank_score", 1.0 - 0.1 * (F.col("rank") - 1))
