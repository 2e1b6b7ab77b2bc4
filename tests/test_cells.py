"""Inverted-file cells against the exact search, and first submissions at any distance."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusflow.operators import cells, dense
from corpusflow.streaming import jobs


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(3)
    heads = rng.normal(size=(30, 16)) * 3
    rows = [(i, (heads[i % 30] + rng.normal(size=16)).tolist()) for i in range(3000)]
    rows += [(5000 + i, rows[0][1]) for i in range(50)] + [(9000, None), (9001, [None] + [0.0] * 15)]
    return spark.createDataFrame(rows, "chunk_key long, embedding array<double>")


@pytest.fixture(scope="module")
def queries(vectors):
    picked = vectors.filter("chunk_key % 40 = 0 or chunk_key = 9000")
    return picked.select(F.col("chunk_key").alias("query_id"), F.transform("embedding", lambda x: x + 0.05).alias("embedding"))


def rows_of(frame):
    return sorted((r.query_id, r.rank, r.chunk_key, r.distance) for r in frame.collect())


@pytest.fixture(scope="module")
def index(spark, vectors, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("cells"))
    cells.save(cells.build(vectors, 24, part_rows=100), path)
    return cells.load(spark, path)


def test_every_vector_is_in_one_cell(index, vectors):
    assert index.vectors.count() == 3050 == index.vectors.select("chunk_key").distinct().count()
    assert index.vectors.groupBy("cell", "part").count().agg(F.max("count")).first()[0] < 250


def test_all_probes_are_exact(index, vectors, queries, monkeypatch):
    monkeypatch.setattr(cells, "BATCH_QUERIES", 20)
    assert rows_of(cells.nearest(index, queries, 10, probes=24)) == rows_of(dense.nearest(vectors, queries, 10))


def test_few_probes_find_most(index, vectors, queries):
    exact = {(q, c) for q, _, c, _ in rows_of(dense.nearest(vectors, queries, 10))}
    near = {(q, c) for q, _, c, _ in rows_of(cells.nearest(index, queries, 10, probes=5))}
    assert len(near & exact) >= 0.95 * len(exact)


def test_other_cells_are_not_read(index, queries):
    one = queries.limit(1)
    held = cells._with_cells(one, "query_id", index.centres, 2)
    wanted = [r.cell for r in held.select("cell").distinct().collect()]
    read = index.vectors.filter(F.col("cell").isin(wanted)).select(F.input_file_name().alias("f")).distinct().collect()
    assert {int(r.f.split("cell=")[1].split("/")[0]) for r in read} <= set(wanted)
    assert len(wanted) == 2


def test_nothing(spark, vectors, queries, index):
    empty = cells.build(vectors.limit(0), 8)
    assert cells.nearest(empty, queries, 3).collect() == []
    assert cells.nearest(index, queries.limit(0), 3).collect() == []


def test_first_submissions_at_any_distance(spark, tmp_path):
    """Copies years apart and rows out of order: each hash once, with no stream state."""
    rows = [("aa1", 10), ("bb1", 20), ("aa1", 10**9), ("cc1", 5), ("bb1", 1), ("dd1", 7), ("aa1", 3)]
    frame = spark.createDataFrame(rows, "file_hash string, t long").select("file_hash", F.timestamp_seconds("t").alias("ts"))
    source, root = str(tmp_path / "in"), str(tmp_path / "out")
    for i in range(0, len(rows), 2):
        part = frame.filter(F.col("file_hash").isin([r[0] for r in rows[i : i + 2]]) & F.unix_timestamp("ts").isin([r[1] for r in rows[i : i + 2]]))
        part.coalesce(1).write.mode("append").parquet(source)
        registry = jobs.SubmissionRegistry(spark, root)
        stream = jobs.read_stream(spark, source, "*.parquet", frame.schema)
        query = jobs.run_available(stream, f"{root}/checkpoint", registry.handle)
        assert not any(p["stateOperators"] for p in query.recentProgress)
    got = sorted((r.file_hash, r.batch) for r in registry.seen().collect())
    assert [h for h, _ in got] == ["aa1", "bb1", "cc1", "dd1"] and len({b for _, b in got}) > 1
    registry.handle(frame, 0)  # a repeated batch replaces its own rows
    assert registry.seen().select("file_hash").distinct().count() == registry.seen().count() == 4
