import pandas as pd
import pytest
from pyspark.sql import functions as F

from corpusflow.operators import memory, metrics
from corpusflow.operators.windows import running_sums


@pytest.fixture(scope="module")
def turns(spark):
    rows = []
    for conv, n in [(1, 3), (2, 50), (3, 1)]:
        rows += [(conv, t, "user" if t % 2 == 0 else "assistant", f"m{conv}.{t}") for t in range(n)]
    rows.append((1, 3, "system", "note"))
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def test_recent_context(turns):
    got = {r.conv_id: r.context for r in memory.conversation_context(turns, 1).collect()}
    assert got == {1: "用户：m1.2\n助手：note", 2: "用户：m2.48\n助手：m2.49", 3: "用户：m3.0"}
    spoken = {r.conv_id: r.context for r in memory.conversation_context(turns, 1, system=False).collect()}
    assert spoken[1] == "助手：m1.1\n用户：m1.2"


def test_truncated(turns):
    got = memory.truncated_messages(turns, 10).groupBy("conv_id").count().collect()
    assert [(r.conv_id, r["count"]) for r in got] == [(2, 40)]


@pytest.mark.parametrize("every, minimum", [(3, 4), (1, 4), (10, 4)])
def test_triggers(turns, every, minimum):
    want, state = [], {}
    for r in turns.orderBy("conv_id", "turn").collect():
        users, n = state.get(r.conv_id, (0, 0))
        users, n = users + (r.role == "user"), n + 1
        state[r.conv_id] = (users, n)
        if r.role == "user" and users % every == 0 and n >= minimum:
            want.append((r.conv_id, r.turn))
    got = sorted((r.conv_id, r.turn) for r in memory.summary_triggers(turns, every, minimum).collect())
    assert got == want


def test_running_sum_over_blocks(spark):
    pdf = pd.DataFrame({"k": [1] * 95 + [2] * 5, "p": list(range(95)) + list(range(5)), "v": range(100)})
    got = running_sums(spark.createDataFrame(pdf), ["k"], "p", {"s": F.col("v")}, block=7).orderBy("k", "p").toPandas()
    assert list(got["s"]) == list(pdf.groupby("k")["v"].cumsum())


def test_gate(turns):
    got = {r.conv_id: r.should_summarize for r in memory.needs_summary(turns, 20).collect()}
    assert got == {1: False, 2: True, 3: False}


def test_top_characters(spark):
    df = spark.createDataFrame([(1, "的的的 数据数据 ab a")], "k int, text string")
    rows = memory.top_characters(df, "k").orderBy("rank").collect()
    assert [(r.ch, r.n) for r in rows] == [("数", 2), ("据", 2), ("a", 2), ("b", 1)]


@pytest.fixture(scope="module")
def memories(spark):
    rows = [(i, i % 2, f"c{i}", [float(i), 0.0]) for i in range(6)]
    return spark.createDataFrame(rows, "memory_id long, session_id long, content string, embedding array<float>")


def test_recall_filters_after_the_top_k(spark, memories):
    query = spark.createDataFrame([(9, [0.0, 0.0])], "query_id long, embedding array<float>")
    in_one = F.col("session_id") == 1
    assert [r.content for r in memory.recall(memories, query, 3, in_one).collect()] == ["c1"]
    got = memory.recall(memories, query, 3, in_one, filter_first=True).orderBy("rank").collect()
    assert [r.content for r in got] == ["c1", "c3", "c5"]
    assert [r.content for r in memory.first_memories(memories, 2).collect()] == ["c0", "c1"]


def test_assembled_context(spark):
    recalled = spark.createDataFrame([(1, 1, "old"), (1, 2, "older")], "query_id long, rank int, content string")
    now = spark.createDataFrame([(1, "用户：x"), (2, "用户：y")], "query_id long, context string")
    got = {r.query_id: r.context for r in memory.assembled_context(recalled, now).collect()}
    assert got == {1: "【相关历史记忆】\n- old\n- older\n\n【当前对话】\n用户：x", 2: "【当前对话】\n用户：y"}


def log(spark, rows):
    return spark.createDataFrame(rows, "seq long, duration double, is_error boolean, cache_hit boolean")


def test_metrics(spark):
    row = metrics.query_metrics(log(spark, [(i, float(i + 1), i == 0, i < 5) for i in range(20)])).first()
    assert (row.total_queries, row.avg_response_time, row.p95_response_time, row.p99_response_time) == (20, 10.5, 20.0, 20.0)
    assert (row.error_rate, row.cache_hit_rate) == (5.0, 25.0)


def test_metrics_window(spark):
    row = metrics.query_metrics(log(spark, [(i, float(i), False, None) for i in range(30)]), window=10).first()
    assert (row.total_queries, row.avg_response_time, row.p95_response_time, row.cache_hit_rate) == (30, 24.5, 29.0, 0.0)


def test_metrics_of_an_empty_log(spark):
    assert tuple(metrics.query_metrics(log(spark, [])).first()) == (0, 0.0, 0.0, 0.0, 0.0, 0.0)


def test_top_characters_of_odd_texts(spark):
    rows = [(1, None), (2, ""), (3, " \n\u3000\x1c"), (4, "的的b a𝄞𝄞a"), (None, "zz")]
    got = memory.top_characters(spark.createDataFrame(rows, "k long, text string"), "k", n=2).collect()
    assert [tuple(r) for r in got] == [(4, 1, "a", 2), (4, 2, "𝄞", 2), (None, 1, "z", 2)]
