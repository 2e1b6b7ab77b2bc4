"""Conversation memory: recent turns, triggers, keywords, recall, context.

Messages are rows (conv_id, turn, role, text); ``turn`` orders a conversation.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusflow.functions.batches import exploded
from corpusflow.functions.text import ordered_join
from corpusflow.operators import dense
from corpusflow.operators.windows import running_sums
from corpusflow.options import DEFAULTS

# Words that are no keywords. Only single characters can match.
STOP_WORDS = [
    "的", "了", "是", "在", "我", "有", "和", "就", "不", "人", "都", "一", "一个", "上", "也", "很", "到", "说",
    "要", "去", "你", "会", "着", "没有", "看", "好", "自己", "这",
]


def speaker_line(role: Column, text: Column) -> Column:
    """'user: text'; every speaker that is not the user counts as the assistant."""
    return F.concat(F.when(role == "user", "用户").otherwise("助手"), F.lit("："), text)


def recent_messages(turns: DataFrame, n: int) -> DataFrame:
    """Last n messages of each conversation; each partition keeps n before the shuffle."""
    window = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return turns.withColumn("back", F.row_number().over(window)).filter(F.col("back") <= n)


def conversation_context(turns: DataFrame, n_turns: int = DEFAULTS.recent_turns, system: bool = True) -> DataFrame:
    """conv_id, n_messages, context: the last n turns, a turn being two messages.

    Without ``system``, system messages are left out of the history first.
    """
    spoken = turns if system else turns.filter(F.col("role").isin("user", "assistant"))
    line = speaker_line(F.col("role"), F.col("text"))
    return recent_messages(spoken, 2 * n_turns).groupBy("conv_id").agg(
        F.count("*").alias("n_messages"), ordered_join(F.col("turn"), line, "\n").alias("context")
    )


def truncated_messages(turns: DataFrame, keep: int = DEFAULTS.keep_recent) -> DataFrame:
    """Messages before the last ``keep`` of their conversation.

    The oldest kept turn is found by the top-k above, then rows are compared
    with it, so a long conversation is never sorted as a whole.
    """
    oldest = recent_messages(turns.select("conv_id", "turn"), keep).groupBy("conv_id").agg(F.min("turn").alias("first_kept"))
    return turns.join(oldest, "conv_id").filter(F.col("turn") < F.col("first_kept")).drop("first_kept")


def needs_summary(turns: DataFrame, max_messages: int = DEFAULTS.max_messages) -> DataFrame:
    """conv_id, n_messages, should_summarize: the length gate."""
    counts = turns.groupBy("conv_id").agg(F.count("*").alias("n_messages"))
    return counts.withColumn("should_summarize", F.col("n_messages") >= max_messages)


def summary_triggers(
    turns: DataFrame,
    every: int = DEFAULTS.summarize_after_turns,
    min_messages: int = DEFAULTS.summarize_min_messages,
) -> DataFrame:
    """conv_id, turn, user_turns, n_messages of the messages that trigger a summary.

    The counter restarts after ``every`` user messages whether or not the
    conversation is long enough to be summarised.
    """
    is_user = (F.col("role") == "user").cast("long")
    counts = {"user_turns": is_user, "n_messages": F.lit(1).cast("long")}
    rows = running_sums(turns.select("conv_id", "turn", "role"), ["conv_id"], "turn", counts)
    fires = (F.col("role") == "user") & (F.col("user_turns") % every == 0) & (F.col("n_messages") >= min_messages)
    return rows.filter(fires).select("conv_id", "turn", "user_turns", "n_messages")


def top_characters(texts: DataFrame, key: str, text: str = "text", n: int = 5) -> DataFrame:
    """key, rank, ch, n: most frequent characters without stop words; the first seen wins a tie.

    Counted inside the row in one pass over its characters; nothing is shuffled.
    """
    single = {w for w in STOP_WORDS if len(w) == 1}

    def best(body: str) -> list[tuple[int, str, int]]:
        # Counted in order of first sight, which the sort keeps among equals.
        counts = [(c, k) for c, k in Counter(body).items() if not c.isspace() and c not in single]
        counts.sort(key=lambda x: -x[1])
        return [(rank, c, k) for rank, (c, k) in enumerate(counts[:n], 1)]

    return exploded(texts, [key], text, best, [("rank", "int"), ("ch", "string"), ("n", "long")])


def recall(
    memories: DataFrame,
    queries: DataFrame,
    k: int = DEFAULTS.recall_k,
    session: Column | None = None,
    filter_first: bool = False,
) -> DataFrame:
    """query_id, rank, memory_id, session_id, content: nearest memories of each query.

    ``memories``: memory_id, session_id, content, embedding. A ``session``
    condition is applied after the top-k and may leave fewer rows; with
    ``filter_first`` it is applied to the memories before it.
    """
    pool = memories.filter(session) if session is not None and filter_first else memories
    near = dense.nearest(pool.select(F.col("memory_id").alias("chunk_key"), "embedding"), queries, k)
    rows = near.withColumnRenamed("chunk_key", "memory_id").join(
        pool.select("memory_id", "session_id", "content"), "memory_id"
    )
    if session is not None and not filter_first:
        rows = rows.filter(session)
    return rows.select("query_id", "rank", "memory_id", "session_id", "content")


def first_memories(
    memories: DataFrame, k: int = DEFAULTS.recall_k, order: str = "memory_id", session: Column | None = None
) -> DataFrame:
    """Recall without vectors: the first k memories in insertion order, of a session if one is given."""
    pool = memories if session is None else memories.filter(session)
    return pool.orderBy(order).limit(k)


def all_memories(memories: DataFrame, session: Column | None = None) -> DataFrame:
    """memory_id, session_id, content of every memory, or of those of a session."""
    pool = memories if session is None else memories.filter(session)
    return pool.select("memory_id", "session_id", "content")


def assembled_context(recalled: DataFrame, conversations: DataFrame) -> DataFrame:
    """query_id, context: recalled memories first, then the current conversation.

    ``recalled``: query_id, rank, content. ``conversations``: query_id, context.
    """
    line = F.concat(F.lit("- "), F.col("content"))
    old = recalled.groupBy("query_id").agg(ordered_join(F.col("rank"), line, "\n").alias("memories"))
    both = old.join(conversations.select("query_id", F.col("context").alias("recent")), "query_id", "full")
    long_part = F.when(F.col("memories").isNotNull(), F.concat(F.lit("【相关历史记忆】\n"), F.col("memories"), F.lit("\n")))
    short_part = F.when(F.col("recent") != "", F.concat(F.lit("【当前对话】\n"), F.col("recent")))
    return both.select("query_id", F.concat_ws("\n", long_part, short_part).alias("context"))
