"""Han text cut into words: the most probable path over a dictionary's word graph.

A dictionary is a table of words with their frequencies. Every run of Han
characters is a graph whose edges are the dictionary words found in it, and any
single character with the frequency 1; the words of the cheapest path (sum of
negative logarithms of relative frequencies) are the tokens. Costs are whole
numbers, so that equal paths tie exactly; a tie goes to the longer first word.

A dictionary below a checked size goes to the tasks. A larger one stays a table
that meets the substrings of the distinct runs in a join.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.functions.text import HAN, HAN_OR_WORD, WORD
from corpusflow.session import cut_lineage, is_small

#: Costs are logarithms times this, as whole numbers.
COST_SCALE = 1_000_000
#: Largest dictionary that is sent to the tasks.
MAX_WORDS = 500_000
#: Characters of a run that make their substrings together.
PART = 256
#: Copies of a joined dictionary, over which a common word is dealt.
SALTS = 16


def word_costs(frequencies: DataFrame) -> tuple[DataFrame, int]:
    """(word, length, cost) of a table word, freq, and the cost of a character that it does not hold.

    Only words of Han characters with a positive frequency count; frequencies of
    a repeated word are added. An empty table gives no words and a cost of 0. The
    sums are written out, so the table of frequencies is computed once.
    """
    han = frequencies.filter(F.col("word").rlike(rf"^{HAN}+$") & (F.col("freq") > 0))
    merged = cut_lineage(han.groupBy("word").agg(F.sum(F.col("freq").cast("long")).alias("freq")), "dictionary")
    total = merged.agg(F.sum("freq")).first()[0]
    if total is None:
        return merged.select("word", F.lit(1).alias("length"), F.lit(0).cast("long").alias("cost")), 0
    cost = F.round((F.lit(math.log(total)) - F.log(F.col("freq").cast("double"))) * COST_SCALE).cast("long")
    return merged.select("word", F.length("word").alias("length"), cost.alias("cost")), round(math.log(total) * COST_SCALE)


def cheapest_path(n: int, edges: Callable[[int], Sequence[tuple[int, int]]]) -> list[tuple[int, int]]:
    """(start, end) of the words of the cheapest path through n characters.

    ``edges(i)`` gives (length, cost) of the words that start at i; a tie goes to the longest.
    """
    costs, steps = [0] * (n + 1), [1] * (n + 1)
    for i in range(n - 1, -1, -1):
        costs[i], longest = min((cost + costs[i + length], -length) for length, cost in edges(i))
        steps[i] = -longest
    path, i = [], 0
    while i < n:
        path.append((i, i + steps[i]))
        i += steps[i]
    return path


class WordGraph:
    """The words of a dictionary as nested characters; a word's cost is kept under the empty string."""

    def __init__(self, words: list[tuple[str, int]], unknown: int):
        self.root: dict = {}
        self.unknown = unknown
        for word, cost in words:
            node = self.root
            for ch in word:
                node = node.setdefault(ch, {})
            node[""] = cost

    def edges(self, run: str, at: int) -> list[tuple[int, int]]:
        node, found, end = self.root, [], at
        while end < len(run) and (node := node.get(run[end])) is not None:
            end += 1
            if "" in node:
                found.append((end - at, node[""]))
        if not found or found[0][0] > 1:
            found.append((1, self.unknown))
        return found

    def cut(self, run: str) -> list[str]:
        return [run[a:b] for a, b in cheapest_path(len(run), lambda i: self.edges(run, i))]


def dictionary_tokens(spark: SparkSession, frequencies: DataFrame, max_words: int = MAX_WORDS) -> Callable[[Column], Column]:
    """Index tokens with Han runs cut by a dictionary, to be used in place of the bigrams.

    The dictionary is sent to the tasks, so it must stay below ``max_words`` rows
    and the size limit of broadcasts; use ``segmented_runs`` for a larger one. Other
    words, texts without Han characters and nulls come out as without a dictionary.
    """
    words, unknown = word_costs(frequencies)
    if not is_small(words, max_words):
        raise ValueError("the dictionary is too large for the tasks: use segmented_runs")
    return _graph_tokens(spark, words, unknown)


def _graph_tokens(spark: SparkSession, words: DataFrame, unknown: int) -> Callable[[Column], Column]:
    """``dictionary_tokens`` of words that are known to be few."""
    shared = spark.sparkContext.broadcast([(row["word"], row["cost"]) for row in words.collect()])
    graphs: list[WordGraph] = []

    @F.pandas_udf("array<string>")
    def cut_words(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        if not graphs:
            graphs.append(WordGraph(shared.value, unknown))

        def one(pieces, are_han):
            if pieces is None:
                return None
            return [w for p, is_han in zip(pieces, are_han) for w in (graphs[0].cut(p) if is_han else [p])]

        for pieces, are_han in parts:
            yield pd.Series([one(p, h) for p, h in zip(pieces, are_han)], dtype=object)

    def tokens(text: Column) -> Column:
        # A text without Han characters reaches Python as a null and is cut in the JVM.
        pieces = F.when(text.rlike(HAN), F.regexp_extract_all(text, F.lit(HAN_OR_WORD), F.lit(0)))
        cut = cut_words(pieces, F.transform(pieces, lambda p: p.rlike(HAN)))
        return F.coalesce(cut, F.regexp_extract_all(text, F.lit(WORD), F.lit(0)))

    return tokens


def segmented_runs(runs: DataFrame, frequencies: DataFrame, max_words: int = MAX_WORDS) -> DataFrame:
    """run, tokens: the words of every distinct Han run of a table with a column run.

    A dictionary of any size: a small one goes to the tasks, a larger one is joined.
    Nulls and empty runs are left out; repeated runs are cut once. In the join a
    run is a few rows per character until it is cut, in one task of its own.
    """
    words, unknown = word_costs(frequencies)
    distinct = runs.select("run").filter(F.length("run") > 0).distinct()
    if is_small(words, max_words):
        return distinct.select("run", _graph_tokens(runs.sparkSession, words, unknown)(F.col("run")).alias("tokens"))
    return _joined(distinct, words, unknown)


def _joined(distinct: DataFrame, words: DataFrame, unknown: int) -> DataFrame:
    """The words found in each run by a join on its substrings, then the path of each run in a task.

    Long runs are taken apart into overlapping parts before substrings are made,
    and common words are dealt over salted copies of the dictionary.
    """
    lengths = sorted(row["length"] for row in words.select("length").distinct().collect())
    keyed = cut_lineage(distinct.withColumn("id", F.monotonically_increasing_id()), "runs")
    pattern = F.lit(rf"(?s)(.{{1,{PART}}})(?=(.{{0,{max(lengths, default=1) - 1}}}))")
    heads, tails = (F.regexp_extract_all("run", pattern, F.lit(group)) for group in (1, 2))
    parts = keyed.select("id", F.posexplode(F.arrays_zip(heads.alias("head"), tails.alias("tail"))).alias("part", "s"))
    starts = parts.select(
        "id", "part", F.concat("s.head", "s.tail").alias("span"), F.explode(F.sequence(F.lit(1), F.length("s.head"))).alias("i")
    )
    tried = starts.select(
        "id", (F.col("part") * PART + F.col("i") - 1).alias("at"), "i", "span", F.explode(F.array(*map(F.lit, lengths))).alias("length")
    ).filter(F.col("i") + F.col("length") - 1 <= F.length("span"))
    salt = F.pmod(F.xxhash64("id", "at"), F.lit(SALTS)).cast("int")
    tried = tried.select("id", "at", "length", F.substring("span", F.col("i"), F.col("length")).alias("word"), salt.alias("salt"))
    dealt = words.select("word", "cost", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    edges = tried.join(dealt, ["word", "salt"]).groupBy("id").agg(F.collect_list(F.struct("at", "length", "cost")).alias("edges"))

    @F.pandas_udf("array<string>")
    def cut(runs: pd.Series, found: pd.Series) -> pd.Series:
        def one(run: str, edges) -> list[str]:
            starts: list[list[tuple[int, int]]] = [[] for _ in run]
            for edge in [] if edges is None else edges:
                starts[edge["at"]].append((edge["length"], edge["cost"]))
            for here in starts:
                if all(length > 1 for length, _ in here):
                    here.append((1, unknown))
            return [run[a:b] for a, b in cheapest_path(len(run), starts.__getitem__)]

        return pd.Series([one(*pair) for pair in zip(runs, found)], dtype=object)

    return keyed.join(edges, "id", "left").select("run", cut("run", "edges").alias("tokens"))
