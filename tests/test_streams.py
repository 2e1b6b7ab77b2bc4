"""Streams over several batches give what the batch operators give."""

import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from corpusflow.functions.hashing import file_hash, max_hamming
from corpusflow.functions.text import clean_text
from corpusflow.operators import chunking, dedup, memory, sparse
from corpusflow.plans.ingest import Corpus, ingest
from corpusflow.sources.tables import table
from corpusflow.streaming import jobs, keyed

FOLDER = "/root/testdata/sf0.001"


def write_parts(df, path, n):
    """n files in key order that arrive one second apart."""
    key = df.columns[0] if "ts" not in df.columns else "ts"
    df.repartitionByRange(n, key).sortWithinPartitions(key).write.parquet(path)
    for i, name in enumerate(sorted(f for f in os.listdir(path) if f.endswith(".parquet"))):
        os.utime(os.path.join(path, name), (1_700_000_000 + i, 1_700_000_000 + i))
    return path


def one_by_one(spark, path, schema):
    return jobs.read_stream(spark, path, "*.parquet", schema, max_files=1)


def test_ingest_stream_equals_batch(spark, tmp_path):
    docs = table(spark, FOLDER, "documents").select("doc_id", "source", "text")
    parts = [docs.filter((F.col("doc_id") >= lo) & (F.col("doc_id") < lo + 70)) for lo in (0, 70, 140)]
    assert sum(p.count() for p in parts) == docs.count()
    corpus = Corpus(spark, str(tmp_path / "corpus"))
    for batch, part in enumerate(parts):
        ingest(corpus, part, batch)

    cleaned = docs.select("doc_id", "source", clean_text(F.col("text")).alias("text"))
    first = dedup.first_per_hash(cleaned.withColumn("file_hash", file_hash(F.col("text"))), "doc_id")
    chunks = chunking.chunk_documents(cleaned.join(first.select("doc_id"), "doc_id", "left_semi"))
    chunks = chunks.withColumn("ord", dedup.chunk_ordinal(F.col("doc_id"), F.col("chunk_idx"))).cache()
    verdicts = dedup.near_duplicates(dedup.projected_signature(chunks, "ord"), max_hamming(0.95))
    want = {tuple(r.ord) for r in verdicts.filter("duplicate_of is null").collect()}
    got = {(r.doc_id, r.chunk_idx) for r in corpus.read("chunks").collect()}
    assert got == want and 0 < len(want) < chunks.count()
    assert corpus.read("registry").count() == first.count()

    before = corpus.read("chunks").count()
    ingest(corpus, parts[2], 2)  # a repeated batch leaves the same tables
    assert corpus.read("chunks").count() == before
    ingest(corpus, parts[0], 3)  # known files add nothing
    assert corpus.read("chunks").count() == before

    queries = table(spark, FOLDER, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    assert sparse.search(corpus.index(), queries, 3).count() > 0
    corpus.clear()
    assert all(corpus.read(n).count() == 0 for n in ("registry", "chunks", "signatures", "postings"))


@pytest.mark.parametrize("snapshot_every", [100, 2])
def test_trigger_stream_equals_batch(spark, tmp_path, snapshot_every):
    turns = table(spark, FOLDER, "conversations")
    path = write_parts(turns.select("turn", "conv_id", "role", "text"), str(tmp_path / "in"), 4)
    counter = jobs.TriggerCounter(spark, str(tmp_path / "state"), 2, 4, snapshot_every)
    stream = one_by_one(spark, path, spark.read.parquet(path).schema)
    jobs.run_available(stream, str(tmp_path / "cp"), counter.handle)
    got = {(r.conv_id, r.turn, r.user_turns) for r in counter.triggers().collect()}
    want = {(r.conv_id, r.turn, r.user_turns) for r in memory.summary_triggers(turns, 2, 4).collect()}
    assert got == want and want


def test_keyed_triggers_across_a_restart(spark, tmp_path):
    """The second run finds the counters of the first in the checkpoint."""
    turns = table(spark, FOLDER, "conversations").select("turn", "conv_id", "role")
    cut = turns.agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY turn)")).first()[0]
    path, setting = str(tmp_path / "in"), spark.conf.get(keyed.STORE_SETTING, None)
    for part in (turns.filter(F.col("turn") <= cut), turns.filter(F.col("turn") > cut)):
        part.coalesce(1).write.mode("append").parquet(path)
        with keyed.keyed_state(spark):
            found = keyed.keyed_triggers(jobs.read_stream(spark, path, "*.parquet", turns.schema), 2, 4)
            jobs.run_available(found, str(tmp_path / "cp"), jobs.write_batch(str(tmp_path / "out")))
    rows = spark.read.parquet(str(tmp_path / "out"))
    assert sum(name.startswith("batch=") for name in os.listdir(tmp_path / "out")) == 2
    got = {(r.conv_id, r.turn, r.user_turns) for r in rows.collect()}
    assert got == {(r.conv_id, r.turn, r.user_turns) for r in memory.summary_triggers(turns, 2, 4).collect()} and got
    assert spark.conf.get(keyed.STORE_SETTING, None) == setting


def test_keyed_state_ends(spark, tmp_path):
    """A silent conversation is forgotten once the watermark has passed its end; one that goes on before that is not."""
    path, hour = str(tmp_path / "in"), 3600
    batches = [
        [(1, 1, "user", 0), (1, 2, "user", 10), (1, 3, "user", 20), (2, 1, "user", 0), (None, 1, "user", 5)],
        [(2, 2, "user", 20 * hour), (2, None, "assistant", 20 * hour), (3, 1, None, 20 * hour), (3, 2, "user", None)],
        [(1, 4, "user", 21 * hour), (2, 3, "user", 21 * hour)],
    ]
    schema = "conv_id long, turn long, role string, seconds long"
    for rows in batches:
        df = spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_seconds(F.col("seconds") + 1_600_000_000))
        df.coalesce(1).write.mode("append").parquet(path)
        with keyed.keyed_state(spark):
            stream = jobs.read_stream(spark, path, "*.parquet", df.schema)
            found = keyed.keyed_triggers(stream, 1, 1, ts="ts", idle_ms=10 * hour * 1000, delay="1 hour")
            jobs.run_available(found, str(tmp_path / "cp"), jobs.write_batch(str(tmp_path / "out")))
    got = sorted((r.conv_id or 0, r.turn or 0, r.user_turns, r.n_messages) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [(0, 1, 1, 1), (1, 1, 1, 1), (1, 2, 2, 2), (1, 3, 3, 3), (1, 4, 1, 1), (2, 1, 1, 1), (2, 2, 2, 3), (2, 3, 3, 4)]


def test_metrics_stream_in_batches(spark, tmp_path):
    events = table(spark, FOLDER, "events").select(
        F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("duration"), (F.col("event_type") == "error").alias("is_error")
    )
    path = write_parts(events, str(tmp_path / "in"), 3)
    stream = jobs.service_metrics(one_by_one(spark, path, spark.read.parquet(path).schema), "1 hour")
    jobs.run_available(stream, str(tmp_path / "cp"), jobs.write_batch(str(tmp_path / "out")), "update")
    rows = spark.read.parquet(str(tmp_path / "out"))
    last = rows.groupBy("window_start").agg(F.max_by("n", "batch").alias("n"))
    want = events.groupBy(F.window("ts", "1 hour").start.alias("window_start")).agg(F.count("*").alias("n"))
    assert {tuple(r) for r in last.collect()} == {tuple(r) for r in want.collect()}


def test_first_submissions_in_batches(spark, tmp_path):
    rows = [(i, f"h{i % 7}") for i in range(40)]
    df = spark.createDataFrame(rows, "i long, file_hash string").withColumn("ts", F.timestamp_seconds("i"))
    path = write_parts(df, str(tmp_path / "in"), 4)
    stream = jobs.first_submissions(one_by_one(spark, path, spark.read.parquet(path).schema))
    jobs.run_available(stream, str(tmp_path / "cp"), jobs.write_batch(str(tmp_path / "out")))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 7


@pytest.mark.parametrize("name", ["stream_metrics", "stream_route", "stream_triggers", "stream_first_submissions"])
def test_streams_over_tables_of_many_files(spark, tmp_path, name):
    """Folders of part files, some taken in several batches, give the same rows as one file."""
    for t in ("events", "conversations", "documents"):
        table(spark, FOLDER, t).repartition(3).write.parquet(str(tmp_path / f"{t}.parquet"))
    query = entry.queries()[name]
    want, got = (sorted(map(str, query(spark, f).collect())) for f in (FOLDER, str(tmp_path)))
    assert got == want and len(got) > 0


def test_a_window_of_several_batches_is_one_row(spark, tmp_path):
    from corpusflow.plans import catalog_streams

    events = table(spark, FOLDER, "events").select(
        F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("duration"), (F.col("event_type") == "error").alias("is_error")
    )
    events.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = jobs.read_stream(spark, str(tmp_path / "in"), "*.parquet", events.schema, max_files=1)
    rows = catalog_streams.collected(spark, jobs.service_metrics(stream, delay="100 days"), "metrics", "update", "window_start").collect()
    want = {r.w: r.n for r in events.groupBy(F.window("ts", "1 minute").start.alias("w")).agg(F.count("*").alias("n")).collect()}
    assert len(rows) == len(want) and {r.window_start: r.n for r in rows} == want


def test_first_batch_of_a_corpus_looks_up_no_stored_signatures(spark, tmp_path, monkeypatch):
    asked = []
    find = dedup.close_to_bands
    monkeypatch.setattr(dedup, "close_to_bands", lambda *args: asked.append(args) or find(*args))
    docs = spark.createDataFrame([(i, "s", f"words of text {i}") for i in range(4)], "doc_id long, source string, text string")
    corpus = Corpus(spark, str(tmp_path / "corpus"))
    ingest(corpus, docs.filter("doc_id < 2"), 0)
    assert not asked
    ingest(corpus, docs, 1)
    assert asked and corpus.read("registry").count() == 4
