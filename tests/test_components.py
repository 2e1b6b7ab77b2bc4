"""Components and the first-seen rule on chains, crowds and components that no task may hold."""

import random

import pytest
from pyspark.sql import functions as F

from corpusflow.operators import components, dedup


def greedy(edges):
    """Rows dropped: in order, a row goes if an earlier row that stays is close."""
    near = {}
    for a, b in edges:
        near.setdefault(b, []).append(a)
    gone = set()
    for b in sorted(near):
        if any(a not in gone for a in near[b]):
            gone.add(b)
    return gone


def smallest(edges):
    """Smallest reachable node of every node, by repeated merging."""
    label = {x: x for e in edges for x in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return label


def random_edges(seed, n=400, links=420):
    rng = random.Random(seed)
    pairs = {tuple(sorted(rng.sample(range(n), 2))) for _ in range(links)}
    pairs |= {(n + i, n + i + 1) for i in range(30)}
    return sorted(pairs)


@pytest.mark.parametrize("limit", [10, 60, 10_000])
def test_components(spark, limit):
    edges = random_edges(limit)
    frame = spark.createDataFrame(edges, "first long, second long")
    got = {r.node: r.comp for r in components.components(frame, limit).collect()}
    assert got == smallest(edges)


@pytest.mark.parametrize("limit", [20, 200, 10_000])
def test_first_seen_rule_by_component(spark, limit):
    edges = random_edges(limit + 1)
    frame = spark.createDataFrame(edges, "first long, second long")
    assert {r.ord for r in dedup.greedy_dropped(frame, limit).collect()} == greedy(edges)


def test_order_of_structs(spark):
    rows = [((1, 10), (2, 1)), ((1, 2), (1, 10)), ((2, 1), (2, 2))]
    frame = spark.createDataFrame(rows, "first struct<doc_id:long,chunk_idx:int>, second struct<doc_id:long,chunk_idx:int>")
    assert {tuple(r.ord) for r in dedup.greedy_dropped(frame).collect()} == {(1, 10), (2, 2)}


def test_no_edges(spark):
    assert dedup.greedy_dropped(spark.createDataFrame([], "first long, second long")).collect() == []


def test_a_long_chain_takes_few_jobs(spark):
    """20,000 rows, each close to the next: the number of jobs does not follow the chain."""
    chain = spark.range(20_000).select(F.col("id").alias("first"), (F.col("id") + 1).alias("second"))
    spark.sparkContext.setJobGroup("chain", "chain")
    try:
        dropped = dedup.greedy_dropped(chain)
        assert dropped.agg(F.count("*"), F.sum("ord")).first()[:] == (10_000, sum(range(1, 20_001, 2)))
        # Adaptive execution submits each shuffle stage as a job.
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("chain")) <= 40
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_a_long_chain_over_many_tasks(spark):
    """With shares of 400 edges the chain is contracted and its component settled in one task."""
    n = 1_200
    chain = spark.range(n).select(F.col("id").alias("first"), (F.col("id") + 1).alias("second"))
    labels = components.components(chain, 400)
    assert labels.agg(F.count("*"), F.max("comp")).first()[:] == (n + 1, 0)
