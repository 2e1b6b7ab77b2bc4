"""Literal rows for edges the tables lack."""

import hashlib

import pytest
from pyspark.sql import functions as F

from corpusflow.functions import classify, hashing, parsing, scoring, text


def values(spark, column, rows, kind="string"):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, x {kind}")
    return [r[0] for r in df.select(column(F.col("x")).alias("y"), "i").orderBy("i").collect()]


def test_clean_text(spark):
    assert values(spark, text.clean_text, ["  a \n\n\t\n b  ", "\u3000x\u00a0\n", ""]) == ["a\nb", "x", ""]


def test_words(spark):
    assert values(spark, text.words, ["Été déjà 数据 a_b-1"]) == [["été", "déjà", "数据", "a_b", "1"]]


def test_index_tokens_keep_case_and_split_han(spark):
    assert values(spark, text.index_tokens, ["Été A_b", "机器学习 is 好", "数据x"]) == [
        ["Été", "A_b"], ["机器", "器学", "学习", "is", "好"], ["数据", "x"],
    ]


def test_term_counts(spark):
    got = values(spark, lambda c: text.term_counts(text.words(c)), ["b a b c a b", "z", ""])
    assert [sorted(map(tuple, g)) if g else g for g in got] == [[("a", 2), ("b", 3), ("c", 1)], [("z", 1)], None]


def test_clean_subqueries(spark):
    assert values(spark, text.clean_subqueries, ["1. 什么是RAG？\n2、compare a, b!"]) == ["什么是RAG\ncompare a, b"]


def test_extract_path(spark):
    rows = [r"请分析 C:\data\my loans.csv 对该文件清洗", r"D:\a\b 请处理", "no path here"]
    assert values(spark, text.extract_path, rows) == [r"C:\data\my loans.csv", r"D:\a\b.csv", ""]


def test_token_overlap(spark):
    df = spark.createDataFrame([("a b c", "B c d e"), ("", "a")], "a string, b string")
    got = [r[0] for r in df.select(text.token_overlap(F.col("a"), F.col("b"))).collect()]
    assert got == [pytest.approx(2 / 12**0.5), 0.0]


def test_head_tail(spark):
    assert values(spark, lambda c: text.head(c, 2), ["äbc", "a"]) == ["äb", "a"]
    assert values(spark, lambda c: text.tail(c, 2), ["äbc", "a"]) == ["bc", "a"]


def reference_token_signature(s: str) -> int:
    import re

    h = 0
    for i, token in enumerate(re.findall(r"\w+", s.lower())):
        x = int(hashlib.md5(token.encode()).hexdigest()[:16], 16)
        h ^= x if i % 2 == 0 else ~x
    h = abs(h) % 2**64
    return h - 2**64 if h >= 2**63 else h


def test_token_signature(spark):
    rows = ["", "a a", "a b", "b a", "one two three four five", "x", "déjà vu 数据 q w e r t y"]
    got = values(spark, hashing.token_signature, rows)
    assert got == [reference_token_signature(r) for r in rows]
    assert got[0] == 0 and got[1] == 1 and got[2] == got[3]


def test_vector_signature(spark):
    vector = [float((i * 37) % 64) for i in range(64)]
    mean = sum(vector) / 64
    want = sum(1 << i for i, v in enumerate(vector) if v > mean)
    want = want - 2**64 if want >= 2**63 else want
    assert values(spark, hashing.vector_signature, [vector], "array<float>") == [want]


def test_max_hamming():
    assert hashing.max_hamming(0.95) == 3 and hashing.max_hamming(0.7) == 19


def test_numbers(spark):
    rows = ["1.0d", "nan", " 12 ", "0x1F", "inf", "-1e3", ".5", "n/a"]
    assert values(spark, parsing.to_number, rows) == [None, None, 12.0, None, float("inf"), -1000.0, 0.5, None]


def test_employment(spark):
    assert values(spark, parsing.employment_years, ["10+ years", "< 1 year", "n/a", "3 years", None]) == [10, 0, None, 3, None]


def test_first_integer(spark):
    assert values(spark, parsing.first_integer, [" 36 months", "none", None]) == [36.0, None, None]


def test_json(spark):
    rows = ['x ```json\n{"query_type": "chat", "confidence": 0.9}\n``` y', 'a {"keywords": ["k"]} b', "nothing"]
    got = values(spark, parsing.parse_intent, rows)
    assert (got[0].query_type, got[0].confidence, got[0].keywords) == ("chat", 0.9, [])
    assert (got[1].query_type, got[1].confidence, got[1].keywords) == ("unknown", 0.5, ["k"])
    assert got[2].query_type == "unknown" and got[2].needs_tools is False


def test_thought(spark):
    got = values(spark, parsing.parse_thought, ['{"analysis": "当前分析": "内容", "gap": "g"}', "no json"])
    assert (got[0].analysis, got[0].gap, got[0].next_action) == ("内容", "g", "FINISH")
    assert got[1] is None


def test_keyword_codec(spark):
    assert values(spark, parsing.decode_keywords, ['["a","b"]', "bad", None]) == [["a", "b"], [], []]


def test_route(spark):
    rows = ["什么是神经网络？", "你是谁", "最新进展", "x" * 51, "x" * 9, "EDA", "处理 a.csv", "帮我搜一下", "x" * 9 + "?"]
    want = ["rag", "pure_llm", "react", "react", "pure_llm", "pure_llm", "tools", "react", "rag"]
    assert values(spark, classify.route, rows) == want


def test_complexity(spark):
    got = values(spark, classify.complexity, ["你好", "什么是RAG", "请分析一下今天的趋势", "zzz" * 20])
    assert [(g.level, g.confidence) for g in got] == [("simple", 0.95), ("simple", 0.9), ("complex", 0.8), ("medium", 0.5)]
    assert got[2].reasoning == "关键词: 分析, 今天, 趋势"


def test_complexity_with_intent(spark):
    df = spark.createDataFrame(
        [("zzz", "knowledge", 0.85, False), ("zzz", "knowledge", 0.65, False), ("zzz", "web_search", 0.7, True), ("zzz", None, None, None)],
        "q string, query_type string, confidence double, needs_tools boolean",
    )
    intent = F.when(F.col("query_type").isNotNull(), F.struct("query_type", "confidence", "needs_tools"))
    got = [r[0] for r in df.select(classify.complexity(F.col("q"), intent)).collect()]
    assert [g.level for g in got] == ["simple", "medium", "complex", "medium"]
    assert got[0].reasoning == "高置信度知识库查询(0.85)"
    assert got[2].reasoning == "联网搜索意图" and got[2].requires_web
    follow = [r[0] for r in df.select(classify.complexity(F.col("q"), None, F.lit(True))).collect()]
    assert {g.level for g in follow} == {"complex"}


def test_intent_step(spark):
    rows = ["你好", "今天天气", "对比两者", "看 csv", "zzz"]
    assert values(spark, lambda c: classify.intent_step(c, F.lit("chat"), F.lit(0.5)), rows) == [
        "chat", "web_search", "retriever", "tools", "retriever",
    ]
    assert values(spark, lambda c: classify.intent_step(c, F.lit("unknown"), F.lit(0.9)), ["你好"]) == ["retriever"]


def test_chat_fallback(spark):
    df = spark.createDataFrame([(0, "web_search", 0.9), (0, "knowledge", 0.9), (3, "knowledge", 0.2), (3, "chat", 0.5)], "n int, k string, c double")
    got = [r[0] for r in df.select(classify.falls_back_to_chat(F.col("n"), F.col("k"), F.col("c"))).collect()]
    assert got == [False, True, True, False]


def test_context_sufficient(spark):
    df = spark.createDataFrame(
        [("最新", 5, 0, 1), ("q", 3, 0, 1), ("q", 1, 1, 1), ("q", 0, 0, 2), ("q", 1, 0, 5)], "q string, d int, w int, r int"
    )
    got = [r[0] for r in df.select(classify.context_sufficient(F.col("q"), F.col("d"), F.col("w"), F.col("r"))).collect()]
    assert got == [False, True, True, True, False]


def test_fusion_key(spark):
    df = spark.createDataFrame([("s", "c", "t"), ("", "c", "t"), ("s", None, "t"), (None, "", "t")], "s string, c string, t string")
    got = [r[0] for r in df.select(scoring.fusion_key(F.col("s"), F.col("c"), F.col("t"))).collect()]
    assert got[:3] == ["s::c", "c", "s"] and got[3] == hashlib.sha256(b"t").hexdigest()


def test_boxplots_in_one_pass(spark):
    """Columns without values have no box; NULLs count nowhere; a constant column has no outliers."""
    from corpusflow.operators.profile import boxplot_stats

    rows = [(float(v), 5, None) for v in [1, 2, 3, 4, 5, 100]] + [(None, 5, None)]
    df = spark.createDataFrame(rows, "x double, same int, gone double")
    got = {r["column"]: tuple(r)[1:] for r in boxplot_stats(df, ["x", "same", "gone"]).collect()}
    assert got == {"x": (2.25, 3.5, 4.75, 1.0, 5.0, 1), "same": (5.0, 5.0, 5.0, 5.0, 5.0, 0)}
    assert boxplot_stats(df, ["gone"]).columns == ["column", "q1", "median", "q3", "whisker_low", "whisker_high", "n_outliers"]
    assert boxplot_stats(df.limit(0), ["x"]).collect() == []
