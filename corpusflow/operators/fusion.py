"""Fusion of ranked lists: reciprocal rank and score level.

A list is a DataFrame (query_id, chunk_key, rank, score), higher scores first.
All groups here hold at most the summed length of the lists per query.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusflow.functions.hashing import hamming
from corpusflow.options import DEFAULTS
from corpusflow.session import cut_lineage, stable, union_on


def union_lists(lists: list[DataFrame]) -> DataFrame:
    """One table with the list number as ``list_id``."""
    tagged = [
        df.select("query_id", "chunk_key", "rank", F.col("score").cast("double").alias("score"), F.lit(i).alias("list_id"))
        for i, df in enumerate(lists)
    ]
    return union_on(tagged, "chunk_key")


def _weight(weights: list[float]) -> Column:
    return F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("list_id") + 1)


def _per_list_map(n: int, value: str) -> Column:
    """map<list, value>; when a list names a key twice its last occurrence counts."""
    entries = [
        F.struct(
            F.lit(i).alias("list"),
            F.max_by(F.when(F.col("list_id") == i, F.col(value)), F.when(F.col("list_id") == i, F.col("rank"))).alias("v"),
        )
        for i in range(n)
    ]
    return F.map_from_entries(F.filter(F.array(*entries), lambda e: e["v"].isNotNull()))


def _cut(fused: DataFrame, score: str, top_k: int) -> DataFrame:
    window = Window.partitionBy("query_id").orderBy(stable(F.col(score)).desc(), "first_seen", "chunk_key")
    return fused.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= top_k).drop("first_seen")




def _first_seen() -> Column:
    """Position of a key's first occurrence, list by list: the order that breaks ties."""
    return F.min(F.col("list_id").cast("long") * F.lit(2**32) + F.col("rank")).alias("first_seen")


def reciprocal_rank(
    lists: list[DataFrame], top_k: int = 5, weights: list[float] | None = None, k: int = DEFAULTS.rrf_k
) -> DataFrame:
    """Sum of weight / (k + rank), the weights scaled to sum 1."""
    weights = [1.0 / len(lists)] * len(lists) if weights is None else weights
    total = sum(weights)
    scaled = [w / total for w in weights] if total > 0 else weights
    fused = union_lists(lists).groupBy("query_id", "chunk_key").agg(
        F.sum(_weight(scaled) / (F.lit(k) + F.col("rank"))).alias("rrf_score"),
        _per_list_map(len(lists), "rank").alias("ranks"),
        _per_list_map(len(lists), "score").alias("original_scores"),
        _first_seen(),
    )
    return _cut(fused, "rrf_score", top_k)


def normalised(lists: list[DataFrame], normalise: bool = True) -> DataFrame:
    """Scores scaled to 0..1 within each list of a query; a flat list gives 0."""
    rows = union_lists(lists)
    if not normalise:
        return rows
    window = Window.partitionBy("query_id", "list_id")
    low, high = F.min("score").over(window), F.max("score").over(window)
    spread = F.when(high != low, high - low).otherwise(F.lit(1.0))
    return rows.withColumn("score", (F.col("score") - low) / spread)


def score_level(
    lists: list[DataFrame],
    top_k: int = 5,
    weights: list[float] | None = None,
    method: str = "average",
    normalise: bool = True,
) -> DataFrame:
    """Weighted sum, maximum or minimum of scaled scores; given weights are used as they are."""
    weights = [1.0 / len(lists)] * len(lists) if weights is None else weights
    rows = normalised(lists, normalise).withColumn("weighted", _weight(weights) * F.col("score"))
    in_order = F.array_sort(F.collect_list(F.struct("list_id", "rank", "weighted")))
    folds = {
        "average": F.sum("weighted"),
        "weighted": F.sum("weighted"),
        "max": F.greatest(F.lit(0.0), F.max("weighted")),
        # Zero means "nothing yet", so a true zero is replaced by the next value.
        "min": F.aggregate(
            in_order,
            F.lit(0.0),
            lambda acc, x: F.when(acc == 0, x["weighted"]).otherwise(F.least(acc, x["weighted"])),
        ),
    }
    fused = rows.groupBy("query_id", "chunk_key").agg(
        folds[method].alias("fused_score"),
        _per_list_map(len(lists), "score").alias("original_scores"),
        _first_seen(),
    )
    return _cut(fused, "fused_score", top_k)


def fuse(method: str, lists: list[DataFrame], top_k: int = 5, weights: list[float] | None = None) -> DataFrame:
    """Fusion by name; an unknown name means reciprocal rank."""
    if method in ("average", "weighted", "max", "min"):
        return score_level(lists, top_k, weights, method)
    return reciprocal_rank(lists, top_k, weights)


def without_near_copies(candidates: DataFrame, top_k: int, max_distance: int) -> DataFrame:
    """query_id, chunk_key, rank: candidates in rank order, without those close to a better one that stays.

    ``candidates``: query_id, chunk_key, rank, signature; at most a few times
    top_k per query, so one query's candidates fit in one row.
    """
    kind = F.array().cast("array<struct<rank:int,chunk_key:{},signature:bigint>>".format(
        candidates.schema["chunk_key"].dataType.simpleString()
    ))
    in_order = F.array_sort(F.collect_list(F.struct(F.col("rank").cast("int").alias("rank"), "chunk_key", "signature")))

    def keep(kept, x):
        close = F.exists(kept, lambda y: hamming(x["signature"], y["signature"]) <= max_distance)
        return F.when(close, kept).otherwise(F.array_append(kept, x))

    rows = candidates.groupBy("query_id").agg(in_order.alias("in_order"))
    kept = rows.select("query_id", F.posexplode(F.aggregate("in_order", kind, keep)).alias("pos", "c"))
    return kept.filter(F.col("pos") < top_k).select("query_id", F.col("c.chunk_key").alias("chunk_key"), (F.col("pos") + 1).alias("rank"))


def fuse_distinct(
    lists: list[DataFrame], top_k: int, signatures: Callable[[DataFrame], DataFrame] | None = None,
    max_distance: int = 3, weights: list[float] | None = None,
) -> DataFrame:
    """Reciprocal rank over twice top_k candidates, cut to top_k.

    ``signatures`` maps the distinct candidate keys (chunk_key) to chunk_key,
    signature; with it, near copies are removed before the cut.
    """
    fused = reciprocal_rank(lists, 2 * top_k, weights)
    if signatures is None:
        return fused.filter(F.col("rank") <= top_k)
    fused = cut_lineage(fused, "fused")
    found = signatures(fused.select("chunk_key").distinct())
    kept = without_near_copies(fused.join(found, "chunk_key"), top_k, max_distance)
    return fused.drop("rank").join(kept, ["query_id", "chunk_key"])
