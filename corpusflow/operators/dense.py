"""Exact nearest neighbours by squared distance for a batch of query vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusflow.session import cut_lineage

# Query vectors held by every task; a larger batch meets the vectors in a grid.
MAX_BROADCAST_QUERIES = 4096
# Vectors of one grid cell, as doubles.
CELL_BYTES = 64 * 1024 * 1024
# Vectors of a cell that are compared at once, which bounds the distance matrix.
BLOCK_VECTORS = 8192
# The same of a scan, whose tasks hold the rows of a batch besides.
SCAN_VECTORS = 2048
# Queries compared with a block of vectors at a time, which bounds the distance matrix.
STRIPE = 256
# Results of the tasks are merged in two steps, by groups of tasks first.
MERGE_SALTS = 64
DIGITS = 9


def _distances(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Squared distances, rounded so that equal vectors give equal values."""
    dots = queries @ vectors.T
    raw = (queries**2).sum(1)[:, None] + (vectors**2).sum(1)[None, :] - 2.0 * dots
    return np.round(np.maximum(raw, 0.0), DIGITS)


def _smallest(dist: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k smallest distances; ties go to the smaller id."""
    if len(dist) > k:
        bound = np.partition(dist, k - 1)[k - 1]
        at = np.flatnonzero(dist <= bound)
    else:
        at = np.arange(len(dist))
    return at[np.lexsort((ids[at], dist[at]))[:k]]


def _merge_block(best, qids, queries, ids, vectors, k):
    """Fold a block of vectors into the running best lists, one per query."""
    for start in range(0, len(qids), STRIPE):
        dist = _distances(queries[start : start + STRIPE], vectors)
        for qid, row in zip(qids[start : start + STRIPE], dist):
            d, x = row, ids
            if qid in best:
                d, x = np.concatenate([best[qid][0], d]), np.concatenate([best[qid][1], x])
            at = _smallest(d, x, k)
            best[qid] = (d[at], x[at])


def _best_frame(best) -> pd.DataFrame:
    frames = [pd.DataFrame({"query_id": qid, "chunk_key": x, "distance": d}) for qid, (d, x) in best.items()]
    return pd.concat(frames) if frames else pd.DataFrame({"query_id": [], "chunk_key": [], "distance": []})


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def _schema(corpus: DataFrame, queries: DataFrame) -> str:
    key, qid = corpus.schema["chunk_key"], queries.schema["query_id"]
    return f"query_id {qid.dataType.simpleString()}, chunk_key {key.dataType.simpleString()}, distance double"


def _scan(corpus: DataFrame, queries: DataFrame, batch: list, k: int) -> DataFrame:
    """One pass over the corpus; every task keeps k rows per query and nothing is shuffled before that."""
    qids = [row["query_id"] for row in batch]
    matrix = np.array([row["embedding"] for row in batch], dtype=np.float64)
    shared = corpus.sparkSession.sparkContext.broadcast((qids, matrix))

    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: dict = {}
        ids, held = shared.value
        for frame in frames:
            for start in range(0, len(frame), SCAN_VECTORS):
                block = frame.iloc[start : start + SCAN_VECTORS]
                _merge_block(best, ids, held, block["chunk_key"].to_numpy(), _matrix(block["embedding"]), k)
        yield _best_frame(best)

    return corpus.select("chunk_key", "embedding").mapInPandas(partial, _schema(corpus, queries))


def _merged(near: DataFrame, k: int) -> DataFrame:
    """Best k rows per query out of the k that each task found.

    The rows of a query are first cut down in groups of tasks, so that no
    single task sorts the results of all of them.
    """
    salted = near.withColumn("salt", F.spark_partition_id() % MERGE_SALTS)
    by_group = Window.partitionBy("query_id", "salt").orderBy("distance", "chunk_key")
    near = salted.withColumn("rank", F.row_number().over(by_group)).filter(F.col("rank") <= k).drop("salt", "rank")
    window = Window.partitionBy("query_id").orderBy("distance", "chunk_key")
    return near.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= k)


def _usable(rows: DataFrame) -> DataFrame:
    """Rows with a vector that has no missing component."""
    return rows.filter(F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull()))


def _grid(corpus: DataFrame, queries: DataFrame, k: int, max_queries: int, cell_bytes: int) -> DataFrame:
    """Best k per query and cell; both sides are dealt over the cells of a grid, and nothing passes through the driver.

    Rows are dealt by their place in a written copy, so a repeated key or vector does not fill one cell.
    """
    corpus, queries = (
        cut_lineage(side.withColumn("place", F.xxhash64(F.monotonically_increasing_id())), "grid") for side in (corpus, queries)
    )
    n_queries, widest = queries.agg(F.count("*"), F.max(F.size("embedding"))).first()
    per_cell = max(cell_bytes // (8 * max(widest, 1)), 1)
    across, down = -(-n_queries // max_queries), max(-(-corpus.count() // per_cell), 1)

    def dealt(side: DataFrame, own: int, other: int, cell) -> DataFrame:
        copies = side.withColumn("own", F.pmod("place", F.lit(own))).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(other - 1))))
        return copies.withColumn("cell", cell).drop("place", "own", "other")

    vectors = dealt(corpus, down, across, F.col("own") * across + F.col("other"))
    asked = dealt(queries, across, down, F.col("other") * across + F.col("own"))

    def best_of(held: pd.DataFrame, asking: pd.DataFrame) -> pd.DataFrame:
        best: dict = {}
        if len(asking):
            ids, matrix = asking["query_id"].to_list(), _matrix(asking["embedding"])
            for start in range(0, len(held), BLOCK_VECTORS):
                block = held.iloc[start : start + BLOCK_VECTORS]
                _merge_block(best, ids, matrix, block["chunk_key"].to_numpy(), _matrix(block["embedding"]), k)
        return _best_frame(best)

    return vectors.groupBy("cell").cogroup(asked.groupBy("cell")).applyInPandas(best_of, _schema(corpus, queries))


def nearest(
    corpus: DataFrame, queries: DataFrame, k: int, max_queries: int = MAX_BROADCAST_QUERIES, cell_bytes: int = CELL_BYTES
) -> DataFrame:
    """query_id, chunk_key, distance, rank: the k nearest vectors of each query, exactly.

    ``corpus``: chunk_key, embedding. ``queries``: query_id, embedding. Rows
    without a vector take no part. Up to ``max_queries`` queries are sent to the
    tasks, and the corpus is scanned once and never shuffled. More queries meet
    the vectors in the cells of a grid: ``max_queries`` of them with about
    ``cell_bytes`` of vectors each. All distances are computed in doubles.
    """
    corpus = _usable(corpus.select("chunk_key", "embedding"))
    queries = _usable(queries.select("query_id", "embedding"))
    batch = queries.limit(max_queries + 1).collect()
    if len(batch) > max_queries:
        return _merged(_grid(corpus, queries, k, max_queries, cell_bytes), k)
    return _merged(_scan(corpus, queries, batch, k), k)


def within(ranked: DataFrame, max_distance: float) -> DataFrame:
    """Distance cut. It applies to distances only, never to similarities."""
    return ranked.filter(F.col("distance") < max_distance)
