"""Dictionary segmentation against every possible cut, and its two forms against each other."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from corpusflow.functions.text import index_tokens
from corpusflow.operators import segment, sparse

WORDS = [("天地", 40), ("地人", 40), ("人", 90), ("天", 7), ("山水火", 5), ("山", 3), ("水火", 60), ("火木", 1), ("天地人山", 2), ("木", 12), ("木", 3), ("ab", 99), ("金", 0)]


def costs():
    held = {}
    for word, n in WORDS:
        if n > 0 and word != "ab":
            held[word] = held.get(word, 0) + n
    total = sum(held.values())
    return {w: round((math.log(total) - math.log(n)) * 1_000_000) for w, n in held.items()}, round(math.log(total) * 1_000_000)


def by_force(run):
    """Cheapest of all cuts; a tie goes to the longest first word, then the longest second one."""
    held, unknown = costs()
    best = None
    for bars in itertools.product([False, True], repeat=len(run) - 1):
        words, word = [], run[0]
        for ch, bar in zip(run[1:], bars):
            if bar:
                words.append(word)
                word = ch
            else:
                word += ch
        words.append(word)
        if any(w not in held and len(w) > 1 for w in words):
            continue
        key = (sum(held.get(w, unknown) for w in words), [-len(w) for w in words])
        if best is None or key < best[0]:
            best = (key, words)
    return best[1]


@pytest.fixture(scope="module")
def frequencies(spark):
    return spark.createDataFrame(WORDS, "word string, freq long")


@pytest.fixture(scope="module")
def runs():
    rng = random.Random(5)
    made = {"".join(rng.choice("天地人山水火木金") for _ in range(rng.randint(1, 11))) for _ in range(150)}
    return sorted(made)


@pytest.mark.parametrize("max_words", [segment.MAX_WORDS, 0])
def test_equals_every_cut(spark, frequencies, runs, max_words):
    table = spark.createDataFrame([(r, i) for i, r in enumerate(runs + runs[:20] + ["", None])], "run string, id int")
    rows = segment.segmented_runs(table, frequencies, max_words).collect()
    assert len(rows) == len(runs)
    assert {r["run"]: r["tokens"] for r in rows} == {r: by_force(r) for r in runs}


def test_equal_paths_take_the_longer_first_word(spark):
    even = spark.createDataFrame([("天地", 5), ("人", 5), ("天", 5), ("地人", 5)], "word string, freq long")
    for limit in (segment.MAX_WORDS, 0):
        row = segment.segmented_runs(spark.createDataFrame([("天地人",)], "run string"), even, limit).first()
        assert row["tokens"] == ["天地", "人"]


@pytest.mark.parametrize("max_words", [segment.MAX_WORDS, 0])
def test_long_run_crosses_parts(spark, frequencies, max_words):
    run = "天地人山水火木" * 3000
    row = segment.segmented_runs(spark.createDataFrame([(run,)], "run string"), frequencies, max_words).first()
    assert "".join(row["tokens"]) == run
    assert row["tokens"][:-20] == segment.WordGraph(list(costs()[0].items()), costs()[1]).cut(run)[:-20]


@pytest.mark.parametrize("max_words", [segment.MAX_WORDS, 0])
def test_empty_tables(spark, frequencies, max_words):
    none = frequencies.limit(0)
    row = segment.segmented_runs(spark.createDataFrame([("天地",)], "run string"), none, max_words).first()
    assert row["tokens"] == ["天", "地"]
    assert segment.segmented_runs(spark.createDataFrame([], "run string"), frequencies, max_words).count() == 0


def test_tokens_keep_other_words(spark, frequencies):
    texts = ["Spark 天地人, ab12山水火x", "plain Words only_", "", None, "。！"]
    table = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    cut = segment.dictionary_tokens(spark, frequencies)
    got = {r["id"]: (r["a"], r["b"]) for r in table.select("id", cut(F.col("text")).alias("a"), index_tokens(F.col("text")).alias("b")).collect()}
    assert got[0][0] == ["Spark", *by_force("天地人"), "ab12", *by_force("山水火"), "x"]
    for i in (1, 2, 3, 4):
        assert got[i][0] == got[i][1]


def test_index_with_dictionary(spark, frequencies):
    """A word finds the documents that hold it as a word, and not those where it only spans two."""
    docs = spark.createDataFrame([(1, "水火 山"), (2, "人水。火人"), (3, "地人地人"), (4, "木木木")], "id long, text string")
    built = sparse.build_documents(docs, "id", "text", segment.dictionary_tokens(spark, frequencies))
    held = {r["chunk_key"]: [x["term"] for x in r["runs"]] for r in built.collect()}
    assert "水火" in held[1] and "水火" not in held[2]
    assert held[3] == ["地人"]


def test_too_large_a_dictionary_is_refused(spark, frequencies):
    with pytest.raises(ValueError):
        segment.dictionary_tokens(spark, frequencies, max_words=2)


def test_frequencies_are_computed_once(spark):
    """The table of frequencies may be a scan of a whole corpus: later steps read the written sums."""
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    frequencies = spark.createDataFrame([("天地", 3), ("人", 2)], "word string, freq long").coalesce(1)
    frequencies = frequencies.mapInArrow(counted, "word string, freq long")
    runs = spark.createDataFrame([("天地人",)], "run string")
    for limit in (segment.MAX_WORDS, 0):
        before = seen.value
        assert [r.tokens for r in segment.segmented_runs(runs, frequencies, limit).collect()] == [["天地", "人"]]
        assert seen.value - before == 2
