"""Retrieval plans: two lists, fusion, reranking, context."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.functions.text import token_overlap
from corpusflow.operators import dense, fusion, rerank, sparse
from corpusflow.operators.context import hybrid_part, packed_context
from corpusflow.options import DEFAULTS, Options
from corpusflow.session import BROADCAST_MAX_ROWS, is_small


def vector_list(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Nearest vectors as a ranked list; the distance is negated so that higher is better."""
    near = dense.nearest(vectors, queries, k)
    return near.select("query_id", "chunk_key", "rank", (-F.col("distance")).alias("score"))


def bm25_list(index: sparse.SparseIndex, queries: DataFrame, k: int, options: Options = DEFAULTS) -> DataFrame:
    return sparse.search(index, queries, k, options=options).select("query_id", "chunk_key", "rank", "score")


def few_results(queries: DataFrame, k: int) -> bool:
    """Whether k results per query stay within the broadcast limit."""
    return is_small(queries.select("query_id", "text"), max_rows=BROADCAST_MAX_ROWS // k)


def attach_text(ranked: DataFrame, chunks: DataFrame, few: bool) -> DataFrame:
    """Add source, section and text to ranked rows by key.

    ``few`` tells that the ranked rows were found to be within the broadcast
    limit; the text table is not shuffled then.
    """
    side = F.broadcast(ranked) if few else ranked
    return chunks.select("chunk_key", "source", "section", "text").join(side, "chunk_key")


def fused_candidates(
    index: sparse.SparseIndex | None,
    vectors: DataFrame,
    queries: DataFrame,
    options: Options = DEFAULTS,
) -> DataFrame:
    """Both lists fused to the candidate set. Without a sparse index only the vector list counts."""
    lists = [vector_list(vectors, queries, options.vector_k)]
    weights = [1.0]
    if index is not None and index.n_docs:
        lists.append(bm25_list(index, queries, options.bm25_k, options))
        weights = [options.vector_weight, options.bm25_weight]
    return fusion.reciprocal_rank(lists, options.fusion_k, weights, options.rrf_k)


def hybrid_search(
    index: sparse.SparseIndex | None,
    vectors: DataFrame,
    chunks: DataFrame,
    queries: DataFrame,
    options: Options = DEFAULTS,
    scorer: Callable[[Column, Column], Column] | None = token_overlap,
) -> DataFrame:
    """query_id, chunk_key, rank, score, rrf_score, ranks, source, section, text, method.

    ``queries``: query_id, text, embedding. ``chunks``: chunk_key, source, section, text.
    """
    small = few_results(queries, options.fusion_k)
    candidates = fused_candidates(index, vectors, queries, options)
    texts = queries.select("query_id", F.col("text").alias("query_text"))
    if small:
        texts = F.broadcast(texts)
    rows = attach_text(candidates, chunks, small).join(texts, "query_id")
    if scorer is None:
        final = rerank.rerank_without_model(rows, options.final_k)
    else:
        final = rerank.rerank(rows, options.final_k, scorer)
    method = "hybrid" if index is not None and index.n_docs else "vector_only"
    return final.select(
        "query_id", "chunk_key", "rank", F.col("rerank_score").alias("score"), "rrf_score", "ranks",
        "source", "section", "text", F.lit(method).alias("method"),
    )


def hybrid_context(results: DataFrame, budget: int = DEFAULTS.max_context_chars) -> DataFrame:
    parts = results.withColumn("part", hybrid_part(F.col("source"), F.col("section"), F.col("ranks"), F.col("text")))
    return packed_context(parts.select("query_id", "rank", "part"), budget)
