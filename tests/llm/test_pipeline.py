"""The stages of the pipeline on documents with known faults, and the registered queries against their SQL."""

import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import compare
import corpus_pipeline

FOLDER = "/root/testdata/sf0.001"


def test_stages_take_effect(spark, tmp_path):
    good = [f"calm water {i} flows under the old bridge while people walk slowly home number {i * 7} again and rest" for i in range(60)]
    bad = [f"BUY!! {i} NOW!! $$$ CHEAP### deal%%% {i} BUY!! NOW!! %%%" for i in range(30)]
    item = "this passage belongs to a benchmark and must never be part of any training text"
    key = "0641917ea4e9feb9cda83477b57ac2654884f485"
    rows = [(i, t) for i, t in enumerate(good + bad)]
    rows += [(200, good[3]), (201, good[5] + " " + item), (202, good[6] + f' token = "{key}" now and here again ' + good[7]), (3, good[3])]
    docs = spark.createDataFrame([(i, t, "en", "src0", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, 1 if i < 60 else 0, 0) for i in range(90)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    folder, kept = str(tmp_path), {}
    frame = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        frame = stage(spark, frame, folder)
        frame.write.parquet(f"{folder}/{name}")
        frame = spark.read.parquet(f"{folder}/{name}")
        assert frame.columns == docs.columns
        kept[name] = {r.doc_id: r.text for r in frame.collect()}
    first, second, third, fourth = kept.values()
    assert set(range(60)) <= set(first) and not set(range(60, 90)) & set(first)
    assert set(first) - set(second) == {200} and frame.count() == len(fourth)
    assert set(second) - set(third) == {201}
    assert set(fourth) == set(third) and key not in fourth[202] and "[SECRET]" in fourth[202]
    packed = corpus_pipeline.run(spark, folder)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == set(fourth)
    top = packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.max("n")).first()[0]
    assert top <= 1024


def shingles(text, size):
    words = text.lower().split()
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}


def similarity(x, y, size):
    a, b = shingles(x, size), shingles(y, size)
    return len(a & b) / len(a | b)


def test_near_duplicates_share_five_words(spark, documents):
    words = [f"w{i}" for i in range(200)]
    every = lambda step, first: " ".join(f"new{i}" if i % step == first else w for i, w in enumerate(words))
    rows = [(1, " ".join(words)), (2, every(20, 10)), (3, every(20, 10) + " and one"), (4, every(100, 50)), (5, "other words " * 3)]
    pairs = [(a, b, x, y) for a, x in rows for b, y in rows if a < b]
    assert similarity(rows[0][1], rows[1][1], 2) >= 0.8 > 0.7 > similarity(rows[0][1], rows[1][1], 5)
    # No chains among these rows: each later one of a similar pair goes.
    gone = {b for a, b, x, y in pairs if similarity(x, y, 5) >= 0.8}
    kept = {r.doc_id for r in corpus_pipeline.near_dedup(spark, documents(rows), "").collect()}
    assert gone == {3, 4} and kept == {i for i, _ in rows} - gone


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")
@pytest.mark.parametrize("name", sorted(n for n in entry.queries() if n.startswith("op") or n == "pipeline"))
def test_query(spark, name):
    if name in entry.oracle_sql():
        ok, note = compare.compare(spark, compare.duck(FOLDER), FOLDER, name)
        assert ok, note
    else:
        assert entry.queries()[name](spark, FOLDER).count() > 0 or name == "op2_secrets"
