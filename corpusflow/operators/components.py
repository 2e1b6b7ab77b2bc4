"""Connected components of a large edge table."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.session import cut_lineage

# Edges that one task takes in at once.
TASK_EDGES = 500_000


def roots_of(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the edges and the smallest node that each reaches."""
    nodes, at = np.unique(np.concatenate([first, second]), return_inverse=True)
    a, b = at[: len(first)], at[len(first) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[a], root[b])
        lower = root.copy()
        np.minimum.at(lower, root[a], low)
        np.minimum.at(lower, root[b], low)
        while True:
            jumped = lower[lower]
            if (jumped == lower).all():
                break
            lower = jumped
        if (lower == root).all():
            return nodes, nodes[root]
        root = lower


def _contracted(edges: DataFrame, parts: int, key: str) -> DataFrame:
    """node, comp of each task's own edges, dealt by ``key`` over ``parts`` tasks."""

    def local(frame):
        import pandas as pd

        nodes, comp = roots_of(frame["first"].to_numpy(), frame["second"].to_numpy())
        return pd.DataFrame({"node": nodes, "comp": comp})

    dealt = edges.select("first", "second", F.pmod(F.xxhash64(key), F.lit(parts)).alias("part"))
    return dealt.groupBy("part").applyInPandas(local, "node long, comp long")


def _to_roots(offers: DataFrame, task_edges: int) -> DataFrame:
    """comp, lower with ``lower`` the root of its tree; every component names one smaller one."""
    if offers.count() <= task_edges:
        joined = offers.select(F.col("lower").alias("first"), F.col("comp").alias("second"))
        return cut_lineage(_contracted(joined, 1, "first").select(F.col("node").alias("comp"), F.col("comp").alias("lower")), "roots")
    while True:
        further = offers.select(F.col("comp").alias("lower"), F.col("lower").alias("lowest"))
        jumped = offers.join(further, "lower", "left")
        offers = cut_lineage(jumped.select("comp", F.coalesce("lowest", "lower").alias("lower"), F.col("lowest").isNotNull().alias("moved")), "jumps")
        if offers.filter("moved").isEmpty():
            return offers.select("comp", "lower")


def components(edges: DataFrame, task_edges: int = TASK_EDGES) -> DataFrame:
    """node, comp: the smallest node that each node of ``edges`` (first, second, both long) reaches.

    Tasks contract bounded shares of the edges to stars. Up to ``task_edges``
    edges are one share and one step. Beyond that, stars are joined in rounds:
    every component names the smallest one next to it, and the trees of names
    are followed to their roots, so at least half of the components that still
    have a neighbour disappear in a round. Each round is written to the shared
    folder; the driver sees counts only.
    """
    edges = edges.select("first", "second").filter("first <> second")
    n = edges.count()
    if n <= task_edges:
        return cut_lineage(_contracted(edges, 1, "first"), "components")
    links = _contracted(edges, -(-n // task_edges), "first").filter("node <> comp")
    links = cut_lineage(links.select(F.col("comp").alias("a"), F.col("node").alias("b")), "stars")
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = cut_lineage(both.groupBy(F.col("a").alias("node")).agg(F.least("a", F.min("b")).alias("comp")), "labels")
    while True:
        ends = [labels.select(F.col("node").alias(x), F.col("comp").alias(f"comp_{x}")) for x in "ab"]
        met = links.join(ends[0], "a").join(ends[1], "b").filter("comp_a <> comp_b")
        offers = cut_lineage(
            met.groupBy(F.greatest("comp_a", "comp_b").alias("comp")).agg(F.min(F.least("comp_a", "comp_b")).alias("lower")), "offers"
        )
        if offers.isEmpty():
            return labels
        offers = _to_roots(offers, task_edges)
        labels = cut_lineage(labels.join(offers, "comp", "left").select("node", F.coalesce("lower", "comp").alias("comp")), "labels")
