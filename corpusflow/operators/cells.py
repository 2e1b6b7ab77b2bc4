"""Approximate nearest neighbours by inverted-file cells.

Cells are fitted on a bounded sample, but every vector is stored in one. A query
looks into the few cells whose centres are nearest; the others are not read.
``dense.nearest`` is the exact way.
"""

from __future__ import annotations

import json
import os
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusflow.operators.dense import _smallest, _usable
from corpusflow.session import cut_lineage

# Vectors that the centres are fitted on, and rounds of the fit.
SAMPLE = 8_192
ROUNDS = 12
# Rows of a cell that a task compares with the queries at once; larger cells are several parts.
PART_ROWS = 8_192
# Queries of a cell that go to a task together.
BATCH_QUERIES = 1_024


@dataclass(frozen=True)
class CellIndex:
    vectors: DataFrame  # cell, part, chunk_key, embedding
    centres: np.ndarray


def fitted(vectors: DataFrame, cells: int, sample: int = SAMPLE, rounds: int = ROUNDS) -> np.ndarray:
    """Centres by k-means on at most ``sample`` vectors, those with the smallest hash of their key; at most ``cells``."""
    rows = _usable(vectors.select("chunk_key", "embedding")).orderBy(F.xxhash64("chunk_key"), "chunk_key").limit(sample)
    held = np.array([r.embedding for r in rows.select("embedding").collect()], np.float64)
    if not len(held):
        return np.zeros((0, 0))
    # Farthest points first, so that small far groups get a centre.
    picked, far = [0], ((held - held[0]) ** 2).sum(1)
    while len(picked) < min(cells, len(held)) and far.max() > 0:
        picked.append(int(far.argmax()))
        far = np.minimum(far, ((held - held[picked[-1]]) ** 2).sum(1))
    centres = held[picked].copy()
    for _ in range(rounds):
        own = _squared(held, centres).argmin(1)
        for i in np.unique(own):
            centres[i] = held[own == i].mean(0)
    return centres


def _squared(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (rows**2).sum(1)[:, None] + (centres**2).sum(1)[None, :] - 2 * rows @ centres.T


def _with_cells(rows: DataFrame, key: str, centres: np.ndarray, n: int) -> DataFrame:
    """The rows once for each of their ``n`` nearest cells; ``near`` is 0 for the nearest."""

    def assign(frames):
        for frame in frames:
            if len(frame):
                held = np.stack(frame["embedding"].to_numpy()).astype(np.float64)
                frame["cell"] = list(np.argsort(_squared(held, centres), axis=1, kind="stable")[:, :n].astype(np.int32))
                yield frame

    name = rows.schema[key].dataType.simpleString()
    kind = rows.schema["embedding"].dataType.simpleString()
    found = rows.select(key, "embedding").mapInPandas(assign, f"{key} {name}, embedding {kind}, cell array<int>")
    return found.select(key, "embedding", F.explode("cell").alias("cell"))


def build(vectors: DataFrame, cells: int = 64, part_rows: int = PART_ROWS) -> CellIndex:
    """Every usable vector (chunk_key, embedding; one length) in the cell of its nearest centre."""
    vectors = _usable(vectors.select("chunk_key", "embedding"))
    centres = fitted(vectors, cells)
    if not len(centres):
        return CellIndex(vectors.select(F.lit(0).alias("cell"), F.lit(0).cast("long").alias("part"), "chunk_key", "embedding"), centres)
    placed = cut_lineage(_with_cells(vectors, "chunk_key", centres, 1), "placed")
    sizes = placed.groupBy("cell").agg(F.ceil(F.count("*") / part_rows).alias("parts"))  # at most one row per centre
    dealt = placed.join(F.broadcast(sizes), "cell")
    part = F.pmod(F.xxhash64("chunk_key"), F.col("parts"))
    return CellIndex(dealt.select("cell", part.alias("part"), "chunk_key", "embedding"), centres)


def save(index: CellIndex, path: str) -> None:
    """The index as a folder divided by cell, with its centres beside it."""
    index.vectors.repartition("cell", "part").write.mode("overwrite").partitionBy("cell").parquet(os.path.join(path, "vectors"))
    spark = index.vectors.sparkSession
    row = spark.createDataFrame([(json.dumps(index.centres.tolist()),)], "centres string")
    row.coalesce(1).write.mode("overwrite").parquet(os.path.join(path, "centres"))


def load(spark: SparkSession, path: str) -> CellIndex:
    centres = np.array(json.loads(spark.read.parquet(os.path.join(path, "centres")).first().centres), np.float64)
    return CellIndex(spark.read.parquet(os.path.join(path, "vectors")), centres)


def nearest(index: CellIndex, queries: DataFrame, k: int, probes: int = 8) -> DataFrame:
    """query_id, chunk_key, distance, rank: the k nearest vectors in the ``probes`` nearest cells of each query.

    With as many probes as cells the result is exact. Ties go to the smaller
    key. Queries meet parts of their cells in tasks; neither queries nor vectors
    pass through the driver. Rows without a usable vector take no part.
    """
    types = index.vectors.schema["chunk_key"].dataType.simpleString(), queries.schema["query_id"].dataType.simpleString()
    shape = f"query_id {types[1]}, chunk_key {types[0]}, distance double"
    if not len(index.centres):
        return queries.sparkSession.createDataFrame([], f"{shape}, rank int")
    asked = cut_lineage(_with_cells(_usable(queries.select("query_id", "embedding")), "query_id", index.centres, probes), "asked")
    touched = [r.cell for r in asked.select("cell").distinct().collect()]  # at most one number per centre
    vectors = index.vectors.filter(F.col("cell").isin(touched))
    parts = cut_lineage(vectors.select("cell", "part").distinct(), "parts")
    sizes = asked.groupBy("cell").agg(F.ceil(F.count("*") / BATCH_QUERIES).alias("deals"))
    parts = cut_lineage(parts.join(F.broadcast(sizes), "cell"), "deals")
    # A query goes to each part of its cells, a vector to each batch of queries of its cell.
    left = asked.join(F.broadcast(parts), "cell").withColumn("deal", F.pmod(F.xxhash64("query_id"), F.col("deals")))
    right = vectors.join(F.broadcast(sizes), "cell").withColumn("deal", F.explode(F.sequence(F.lit(0).cast("long"), F.col("deals") - 1)))

    def compare(left, right):
        import pandas as pd

        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "chunk_key": [], "distance": []})
        held = np.stack(right["embedding"].to_numpy()).astype(np.float64)
        keys = right["chunk_key"].to_numpy()
        out = []
        for name, vector in zip(left["query_id"], left["embedding"]):
            distance = np.round(((held - np.asarray(vector, np.float64)) ** 2).sum(1), 9)
            at = _smallest(distance, keys, k)
            out.append(pd.DataFrame({"query_id": name, "chunk_key": keys[at], "distance": distance[at]}))
        return pd.concat(out)

    keys = ["cell", "part", "deal"]
    met = left.select(*keys, "query_id", "embedding").groupBy(*keys).cogroup(right.select(*keys, "chunk_key", "embedding").groupBy(*keys))
    found = met.applyInPandas(compare, shape)
    best = Window.partitionBy("query_id").orderBy("distance", "chunk_key")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
