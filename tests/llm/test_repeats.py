"""Very many rows with one doc_id and text, longer than a window."""

from pyspark.sql import functions as F

from corpusflow.llm import substrings


def test_copies_of_a_row_are_searched_once(spark):
    text = " ".join(f"w{i}" for i in range(300))
    part = " ".join(f"w{i}" for i in range(100, 220))
    rows = [(5, "x " + part + " y"), (9, text), (3, "a b c"), (None, text)]
    few = spark.createDataFrame(rows, "doc_id long, text string")
    many = few.unionByName(spark.range(10_000).select(F.lit(9).cast("long").alias("doc_id"), F.lit(text).alias("text")))
    got = substrings.without_repeats(many).drop("kept")
    counts = {tuple(r)[:3]: r["count"] for r in got.groupBy("doc_id", "n_words", "n_removed").count().collect()}
    assert counts == {(5, 122, 0): 1, (9, 300, 120): 10_001, (3, 3, 0): 1, (None, 300, 0): 1}

    def spans(frame):
        keyed = frame.withColumn("row", F.xxhash64("text")).select("doc_id", "row", "text")
        return sorted((r.doc_id, sorted(map(tuple, r.ranges))) for r in substrings.covered(substrings._once(keyed)).collect())

    assert spans(many) == spans(few)
