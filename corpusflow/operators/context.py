"""Context strings from ranked results: headers, character budgets, numbered formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusflow.functions.scoring import clamp01, relevance_from_distance, relevance_linear
from corpusflow.functions.text import ordered_join, two_decimals

SEPARATOR = "\n---\n"
WIDE_SEPARATOR = "\n\n---\n\n"


def distance_part(source: Column, distance: Column, text: Column) -> Column:
    """Part of the plain retriever: source and 1 - distance."""
    return F.concat(
        F.lit("[来源: "), source, F.lit(", 相关度: "), two_decimals(relevance_linear(distance)), F.lit("]\n"), text, F.lit("\n")
    )


def vector_part(source: Column, section: Column, distance: Column, text: Column) -> Column:
    """Part of the vector search: source, section when there is one, relevance."""
    named = F.when(F.coalesce(section, F.lit("")) != "", F.concat(F.lit(" | 章节: "), section)).otherwise("")
    shown = two_decimals(relevance_from_distance(distance))
    return F.concat(F.lit("[来源: "), source, named, F.lit(" | 相关度: "), shown, F.lit("]\n"), text, F.lit("\n"))


def hybrid_part(source: Column, section: Column, ranks: Column, text: Column) -> Column:
    """Part of the hybrid search: source, section, and both ranks with '-' for a missing one."""
    named = F.when(F.coalesce(section, F.lit("")) != "", F.concat(F.lit(" | 章节: "), section)).otherwise("")

    def shown(i: int) -> Column:
        return F.coalesce(ranks[F.lit(i)].cast("string"), F.lit("-"))

    return F.concat(
        F.lit("[来源: "), source, named,
        F.lit(" | 向量排名: "), shown(0), F.lit(", BM25排名: "), shown(1), F.lit("]\n"), text, F.lit("\n"),
    )


def packed_context(parts: DataFrame, budget: int, part: str = "part") -> DataFrame:
    """query_id, n_parts, context: parts in rank order until the next one would exceed the budget.

    Lengths are positive, so a running sum within the budget is the same as
    stopping at the first part that does not fit. Separators are not counted. A
    query whose first part is too long gets an empty context.
    """
    window = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    fits = F.sum(F.length(part)).over(window) <= budget
    kept = F.filter(
        F.array_sort(F.collect_list(F.struct("rank", F.when(F.col("fits"), F.col(part)).alias("p")))),
        lambda x: x["p"].isNotNull(),
    )
    return parts.withColumn("fits", fits).groupBy("query_id").agg(
        F.count_if("fits").alias("n_parts"), F.array_join(F.transform(kept, lambda x: x["p"]), SEPARATOR).alias("context")
    )


def _joined(results: DataFrame, part: Column, separator: str) -> DataFrame:
    return results.groupBy("query_id").agg(
        F.count("*").alias("n_results"), ordered_join(F.col("rank"), part, separator).alias("context")
    )


def knowledge_context(results: DataFrame) -> DataFrame:
    """Numbered sources with a relevance clamped to 0..1. Columns: query_id, rank, source, section, score, text."""
    section = F.when(F.coalesce("section", F.lit("")) != "", F.concat(F.lit(" | "), F.col("section"))).otherwise("")
    part = F.concat(
        F.lit("[来源 "), F.col("rank").cast("string"), F.lit(": "), F.coalesce("source", F.lit("未知来源")), section,
        F.lit("] (相关度: "), two_decimals(clamp01(F.col("score"))), F.lit(")\n"), F.col("text"),
    )
    return _joined(results, part, WIDE_SEPARATOR)


def web_part(rank: Column, title: Column, url: Column, snippet: Column) -> Column:
    link = F.when(url != "", F.concat(F.lit("\n链接: "), url)).otherwise("")
    return F.concat(
        F.lit("[网页 "), rank.cast("string"), F.lit(": "), F.coalesce(title, F.lit("无标题")), F.lit("]"), link,
        F.lit("\n"), snippet,
    )


def web_context(results: DataFrame) -> DataFrame:
    """Numbered pages. Columns: query_id, rank, title, url, snippet."""
    return _joined(results, web_part(F.col("rank"), F.col("title"), F.col("url"), F.col("snippet")), WIDE_SEPARATOR)


def web_listing(results: DataFrame) -> DataFrame:
    """Numbered list of search hits under a heading."""
    part = F.concat(
        F.col("rank").cast("string"), F.lit(". "), F.col("title"), F.lit("\n   链接: "), F.col("url"),
        F.lit("\n   摘要: "), F.col("snippet"), F.lit("\n"),
    )
    body = _joined(results, part, "\n")
    return body.withColumn("context", F.concat(F.lit("【网页搜索结果】\n\n"), F.col("context")))


def numbered_documents(results: DataFrame) -> DataFrame:
    part = F.concat(F.lit("[文档"), F.col("rank").cast("string"), F.lit("] "), F.col("text"))
    return _joined(results, part, "\n\n")


def combined_context(knowledge: DataFrame, web: DataFrame, web_first: bool = False) -> DataFrame:
    """Knowledge and web context of each query in one string, in the wanted order."""
    k_head, w_head = "【知识库检索结果】\n", "【网络检索结果】\n"
    both = (
        knowledge.select("query_id", F.concat(F.lit(k_head), F.col("context")).alias("k"))
        .join(web.select("query_id", F.concat(F.lit(w_head), F.col("context")).alias("w")), "query_id", "full")
    )
    order = ["w", "k"] if web_first else ["k", "w"]
    return both.select("query_id", F.concat_ws("\n\n", *order).alias("context"))
