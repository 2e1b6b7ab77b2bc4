"""The stored inverted index against the scan of all documents."""

import random

import pytest
from pyspark.sql import functions as F

from corpusflow.operators import inverted, sparse
from corpusflow.sources.stores import TermIndexStore


@pytest.fixture(scope="module")
def chunks(spark):
    rng = random.Random(7)
    common = [f"w{i}" for i in range(40)]
    rows = []
    for i in range(400):
        words = [rng.choice(common) for _ in range(rng.randrange(3, 30))]
        if i % 9 == 0:
            words += [f"rare{rng.randrange(30)}"] * rng.randrange(1, 5)
        rows.append((i, " ".join(words)))
    rows += [(1000 + i, "w1 w2 w3") for i in range(30)] + [(2000, ""), (2001, None), (2002, "w5 " * 3000)]
    return spark.createDataFrame(rows, "chunk_key long, text string")


@pytest.fixture(scope="module")
def queries(spark):
    rows = [(1, "rare1 rare2 w1"), (2, "w1 w2 w3 w4"), (3, "w7"), (4, "unknown words"), (5, None), (6, "rare3 rare3 rare4"), (7, "w5 w6 rare9")]
    return spark.createDataFrame(rows, "query_id long, text string")


def rows_of(frame):
    return sorted((r.query_id, r.rank, r.chunk_key, round(r.score, 9)) for r in frame.collect())


@pytest.fixture(scope="module")
def scanned(chunks, queries):
    return rows_of(sparse.search(sparse.build_index(chunks), queries, 6))


def built(chunks):
    return sparse.build_documents(chunks, "chunk_key", "text")


@pytest.fixture(scope="module")
def store(spark, chunks, tmp_path_factory):
    store = TermIndexStore(spark, str(tmp_path_factory.mktemp("terms")), shard_docs=32)
    store.save("whole", built(chunks))
    return store


def test_search_equals_the_scan(store, queries, scanned):
    assert rows_of(inverted.search(store.load("whole"), queries, 6)) == scanned


def test_least_score(store, queries, scanned):
    got = rows_of(inverted.search(store.load("whole"), queries, 6, min_score=3.0))
    assert got == [r for r in scanned if r[3] >= 3.0]


def test_growing_changes_nothing(spark, store, chunks, queries, scanned):
    for part in range(3):
        store.append("grown", built(chunks.filter(F.col("chunk_key") % 3 == part)))
    index = store.load("grown")
    whole = store.load("whole")
    assert (index.n_docs, index.total_len, round(index.mean_idf, 9)) == (whole.n_docs, whole.total_len, round(whole.mean_idf, 9))
    assert rows_of(inverted.search(index, queries, 6)) == scanned


def test_an_append_reads_no_stored_posting(store, chunks, monkeypatch):
    """Statistics of a grown collection come from the stored sums."""
    store.append("apart", built(chunks.filter("chunk_key < 300")))
    read = []
    real = inverted.mean_idf
    monkeypatch.setattr(inverted, "mean_idf", lambda terms, n: read.append(terms) or real(terms, n))
    store.append("apart", built(chunks.filter("chunk_key >= 300")))
    files = read[0].inputFiles()
    assert files and all("/terms/" in f for f in files)


def test_directories_of_other_terms_are_not_read(spark, store):
    index = store.load("whole")
    one = spark.createDataFrame([(1, "rare1")], "query_id long, text string")
    _, wanted = inverted.query_weights(index, one)
    assert len(wanted) == 1
    pruned = index.postings.filter(F.col("bucket").isin(wanted))
    plan = pruned._jdf.queryExecution().executedPlan()
    scan = plan.toString()
    assert "PartitionFilters" in scan and f"bucket" in scan.split("PartitionFilters")[1].split("]")[0]
    read = {f for f in pruned.select(F.input_file_name().alias("f")).distinct().toPandas()["f"]}
    assert read and all(f"bucket={wanted[0]}/" in f for f in read)
    assert len(index.postings.inputFiles()) > len(read)


def test_shards_below_the_cutoff_are_skipped(store, spark, monkeypatch):
    """A rare term stands in few shards; shards with common terms only are not scored."""
    index = store.load("whole")
    one = spark.createDataFrame([(1, "rare1 rare2 w1")], "query_id long, text string")
    weights, wanted = inverted.query_weights(index, one)
    bounds = inverted.shard_bounds(index, index.postings.filter(F.col("bucket").isin(wanted)), weights).count()
    scored = []
    real = inverted._score_shards
    monkeypatch.setattr(inverted, "_score_shards", lambda i, b, w, pairs, k, o: scored.append(pairs.count()) or real(i, b, w, pairs, k, o))
    inverted.search(index, one, 1).collect()
    assert scored[0] == 1 and sum(scored) < bounds


def test_bounds_hold_after_growth(spark, store, chunks, queries):
    """Heads written at another mean length still bound every score."""
    for part in ("chunk_key < 50", "chunk_key >= 50"):
        store.append("lengths", built(chunks.filter(part)))
    index = store.load("lengths")
    weights, _ = inverted.query_weights(index, queries)
    bounds = {(r.query_id, r.shard): r.bound for r in inverted.shard_bounds(index, index.postings, weights).collect()}
    places = {r.k: r.shard for r in index.postings.select("shard", F.explode("keys").alias("k")).distinct().collect()}
    every = sparse.search(sparse.build_index(chunks), queries, 10_000).collect()
    assert every and all(r.score <= bounds[r.query_id, places[r.chunk_key]] for r in every)


def test_failed_batch_does_not_count(store, chunks, queries, scanned, monkeypatch):
    store.save("safe", built(chunks))
    with monkeypatch.context() as patch:
        patch.setattr(store, "_enter", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            store.append("safe", built(chunks.withColumn("chunk_key", F.col("chunk_key") + 5000)))
    assert rows_of(inverted.search(store.load("safe"), queries, 6)) == scanned


def test_empty_and_removed(spark, store, queries, chunks):
    store.save("none", built(chunks.limit(0)))
    assert inverted.search(store.load("none"), queries, 5).collect() == []
    store.remove("none")
    with pytest.raises(KeyError):
        store.load("none")


def test_text_keys(spark, store):
    rows = spark.createDataFrame([("a", "x y"), ("b", "x x"), ("c", "z"), ("d", "q")], "chunk_key string, text string")
    store.save("names", built(rows))
    asked = spark.createDataFrame([("q1", "x"), ("q2", "z y")], "query_id string, text string")
    assert rows_of(inverted.search(store.load("names"), asked, 5)) == rows_of(sparse.search(sparse.build_index(rows), asked, 5))


def test_shards_of_long_documents_are_smaller():
    assert inverted.shard_count(0, 0) == 1
    assert inverted.shard_count(10_000, 300 * 10_000) == 3
    assert inverted.shard_count(4_096, 100_000 * 4_096) > 100


def test_postings_of_many_documents_lie_in_many_files(spark):
    """What one task writes stays the same while the documents grow."""
    rows = spark.range(0, 2_000).select(F.lit(0).alias("bucket"), F.lit("w").alias("term"), F.col("id").alias("shard"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        places = inverted.file_layout(rows, 1_000_000, "shard").select(F.spark_partition_id().alias("p")).distinct().count()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert places > 1


def test_counted_terms_with_nulls(spark):
    """Terms come in their order, a null one first, as the column function gives them."""
    rows = spark.createDataFrame([(1, ["b", None, "a", "b"]), (2, [])], "id long, tokens array<string>")
    got = sparse.build_documents(rows.withColumn("text", F.lit("x")), "id", "text", lambda _: F.col("tokens")).collect()
    assert [(r.chunk_key, r.len, [tuple(x) for x in r.runs]) for r in got] == [(1, 4, [(None, 1), ("a", 1), ("b", 2)]), (2, 0, [])]
