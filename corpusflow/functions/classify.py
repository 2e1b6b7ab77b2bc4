"""Rule-based classification of queries: the first matching rule wins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusflow.functions.text import contains_any, strip

# ---- Fixed values: word lists that decide the outcome, kept in their given order ----

ROUTE_DATA = [
    "数据处理", "数据清洗", "数据清洗", "数据预处理", "EDA", "探索性数据分析", "数据分析", "清洗数据",
    "处理数据", "整理数据", "缺失值", "异常值", "数据质量", "请对", "csv", ".csv", "表格",
]
ROUTE_SEARCH = ["帮我搜", "帮我查", "帮我找", "去网上", "上网", "搜索一下", "网上查", "帮我在网上"]
ROUTE_CHAT = [
    "你好", "hi", "hello", "嗨", "嗨嗨", "谢谢", "thanks", "感谢", "谢啦", "再见", "拜拜", "bye", "结束",
    "好的", "收到", "明白", "了解", "可以", "没问题", "你是谁", "你叫什么", "你能做什么", "有什么功能",
    "你的功能", "你的工具", "有什么工具", "你觉得", "你的看法", "你的观点",
]
ROUTE_DEFINITION = ["^什么是", "^什么叫", "的概念", "的定义", "是什么"]
ROUTE_REACT = [
    "最新", "今天", "现在", "当前", "最近", "分析", "趋势", "预测", "对比", "比较", "搜索", "查找", "帮我查",
    "查一下", "研究", "调研", "深入", "全面", "结合", "综合", "多角度", "2025", "2026", "news",
]

COMPLEX_WORDS = [
    "最新", "今天", "现在", "当前", "此时此刻", "最近", "近期", "最近几天", "最近一周", "分析", "分析一下",
    "趋势", "展望", "预测", "预判", "对比", "比较", "区别", "差异", "哪个好", "评估", "评价", "判断", "推荐",
    "建议", "搜索", "查找", "帮我查", "帮我找", "查一下", "搜一下", "网上", "网上查", "研究", "调研", "深入",
    "详细", "全面", "总结", "概括", "概述", "摘要", "结合", "综合", "多角度", "各个方面",
]
FAST_WORDS = [
    "你好", "hi", "hello", "嗨", "嗨嗨", "谢谢", "thanks", "感谢", "谢啦", "再见", "拜拜", "bye", "结束",
    "好的", "收到", "明白", "了解", "可以", "行", "没问题",
]
COMPLEX_DEFINITION = ["^什么是", "^什么叫", "^xx是", "的概念", "的定义", "的意思", "是什么"]
COMPLEX_SEARCH = ["帮我搜", "帮我查", "去网上", "上网", "搜索一下"]

INTENT_CHAT = ["你好", "hi", "hello", "谢谢", "thanks", "拜拜", "再见", "好的", "好的"]
INTENT_WEB = ["今天", "现在", "最新", "实时", "新闻", "价格", "股价", "天气", "当前", "此刻"]
INTENT_HYBRID = ["结合", "综合", "比较", "对比", "分析"]
INTENT_DATA = [
    "数据处理", "清洗", "分析", "csv", "表格", "eda", "数据清洗", "数据预处理", "好坏样本", "分布分析", "数据报告",
]

NEEDS_WEB = ["最新", "最近", "news", "recent", "2024", "2025", "进展", "动态"]
FORCES_WEB = ["最新", "最近", "recent", "2024", "2025", "进展", "动态"]
FOLLOW_UP = [
    "这类", "上述", "刚才", "这个任务", "这个", "接着", "继续", "上一轮", "其", "他的", "她的", "参考",
]

# Intent type to next step.
INTENT_STEP = {
    "chat": "chat", "web_search": "web_search", "hybrid": "retriever", "knowledge": "retriever",
    "data_processing": "tools",
}

# ---- Rules ----


def _definition(text: Column, patterns: list[str]) -> Column:
    return text.rlike("|".join(patterns))


def route(query: Column) -> Column:
    """tools, react, pure_llm or rag. Words are matched on stripped lower-case text, lengths on the raw text."""
    text, n = strip(F.lower(query)), F.length(query)
    no_question = ~F.contains(query, F.lit("?")) & ~F.contains(query, F.lit("？"))
    return (
        F.when(contains_any(text, ROUTE_DATA), "tools")
        .when(contains_any(text, ROUTE_SEARCH), "react")
        .when(contains_any(text, ROUTE_CHAT), "pure_llm")
        .when(_definition(text, ROUTE_DEFINITION) & (n < 20), "rag")
        .when(contains_any(text, ROUTE_REACT), "react")
        .when(n > 50, "react")
        .when((n < 10) & no_question, "pure_llm")
        .otherwise("rag")
    )


def _complexity(level, confidence, reasoning, react=False, web=False, think=False, fast=False) -> Column:
    def col(v):
        return v if isinstance(v, Column) else F.lit(v)

    return F.struct(
        F.lit(level).alias("level"),
        col(confidence).cast("double").alias("confidence"),
        col(reasoning).alias("reasoning"),
        F.lit(react).alias("use_react"),
        col(web).alias("requires_web"),
        F.lit(think).alias("requires_reasoning"),
        F.lit(fast).alias("use_fast_path"),
    )


def complexity_by_intent(intent: Column) -> Column:
    """Complexity from an intent struct alone, by type and confidence band."""
    kind, conf = intent["query_type"], intent["confidence"]
    shown = F.format_string("%.2f", conf)
    return (
        F.when(kind == "chat", _complexity("simple", 0.95, "闲聊意图", fast=True))
        .when(
            (kind == "knowledge") & (conf >= 0.8),
            _complexity("simple", conf, F.concat(F.lit("高置信度知识库查询("), shown, F.lit(")")), fast=True),
        )
        .when(
            (kind == "knowledge") & (conf >= 0.6),
            _complexity("medium", conf, F.concat(F.lit("中等置信度知识库查询("), shown, F.lit(")"))),
        )
        .when(
            kind == "knowledge",
            _complexity(
                "complex", 0.5, F.concat(F.lit("低置信度知识库查询("), shown, F.lit(")，可能需要多轮")), react=True
            ),
        )
        .when(kind == "hybrid", _complexity("complex", 0.8, "混合查询，需要联网+知识库", react=True, web=True))
        .when(kind == "web_search", _complexity("complex", 0.85, "联网搜索查询", react=True, web=True))
        .otherwise(_complexity("medium", 0.5, "标准复杂度"))
    )


def _complex_case(text: Column, n: Column, intent: Column | None) -> Column:
    """Result for a query that needs several steps; the reasons found are listed in its text."""
    found = F.regexp_extract_all(text, F.lit("|".join(COMPLEX_WORDS)), F.lit(0))
    by_words = F.when(F.size(found) > 0, F.concat(F.lit("关键词: "), F.array_join(F.slice(found, 1, 3), ", ")))
    by_length = F.when(n > 50, F.format_string("查询较长(%d字)", n))
    by_intent, web = F.lit(None).cast("string"), F.lit(False)
    if intent is not None:
        by_intent = F.when(intent["query_type"] == "web_search", "联网搜索意图").when(
            intent["query_type"] == "hybrid", "混合查询意图"
        )
        web = F.coalesce(intent["needs_tools"], F.lit(False))
    reasons = F.concat_ws("; ", by_intent, by_words, by_length)
    reasoning = F.when(reasons != "", reasons).otherwise("复杂查询")
    return _complexity("complex", 0.8, reasoning, react=True, web=web, think=True)


def complexity(query: Column, intent: Column | None = None, is_followup: Column | None = None) -> Column:
    """Complexity struct of a query; intent struct and follow-up flag are optional."""
    text, n = F.lower(query), F.length(query)
    needs_steps = contains_any(text, COMPLEX_WORDS) | contains_any(text, COMPLEX_SEARCH)
    if is_followup is not None:
        needs_steps = needs_steps | F.coalesce(is_followup, F.lit(False))
    if intent is not None:
        needs_steps = needs_steps | F.coalesce(intent["query_type"].isin("web_search", "hybrid"), F.lit(False))
    fallback = _complexity("medium", 0.5, "默认标准路径")
    if intent is not None:
        fallback = F.when(intent.isNotNull(), complexity_by_intent(intent)).otherwise(fallback)
    return (
        F.when(contains_any(text, FAST_WORDS), _complexity("simple", 0.95, "闲聊/简单确认，直接快速路径", fast=True))
        .when(
            (F.length(text) < 20) & _definition(text, COMPLEX_DEFINITION),
            _complexity("simple", 0.9, "简单定义类查询，知识库直接匹配", fast=True),
        )
        .when(needs_steps, _complex_case(text, n, intent))
        .otherwise(fallback)
    )


def keyword_intent(query: Column) -> Column:
    """Intent struct found by words alone."""
    text = F.lower(query)

    def intent(kind, confidence, reasoning, tools):
        return F.struct(
            F.lit(kind).alias("query_type"),
            F.lit(confidence).alias("confidence"),
            F.lit(reasoning).alias("reasoning"),
            F.lit(tools).alias("needs_tools"),
        )

    return (
        F.when(contains_any(text, INTENT_CHAT), intent("chat", 0.9, "检测到闲聊关键词", False))
        .when(contains_any(text, INTENT_WEB), intent("web_search", 0.7, "检测到联网关键词", True))
        .when(contains_any(text, INTENT_HYBRID), intent("hybrid", 0.6, "检测到混合查询关键词", True))
        .when(contains_any(text, INTENT_DATA), intent("data_processing", 0.8, "检测到数据处理关键词", True))
        .otherwise(intent("knowledge", 0.5, "默认使用知识库检索", False))
    )


def intent_step(query: Column, query_type: Column, confidence: Column) -> Column:
    """Next step for an intent; an intent below 0.6 is judged again by its words."""
    kind = F.when(confidence < 0.6, keyword_intent(query)["query_type"]).otherwise(query_type)
    step = F.when(F.lit(False), F.lit(""))
    for name, target in INTENT_STEP.items():
        step = step.when(kind == name, target)
    return step.otherwise("retriever")


def needs_web(query: Column) -> Column:
    return contains_any(query, NEEDS_WEB)


def forces_web(query: Column) -> Column:
    return contains_any(query, FORCES_WEB)


def is_follow_up(query: Column) -> Column:
    return contains_any(query, FOLLOW_UP)


def falls_back_to_chat(n_results: Column, query_type: Column, confidence: Column) -> Column:
    """No results on a query that is not for the web, or next to no confidence."""
    offline = ~F.coalesce(query_type.isin("web_search", "hybrid"), F.lit(False))
    return ((F.coalesce(n_results, F.lit(0)) < 1) & offline) | F.coalesce(confidence < 0.3, F.lit(False))


def context_sufficient(query: Column, n_docs: Column, n_web: Column, rounds: Column) -> Column:
    """Whether enough was gathered to stop searching."""
    return (
        F.when(needs_web(query) & (n_web == 0), False)
        .when(n_docs + n_web >= 3, True)
        .when((n_docs > 0) & (n_web > 0), True)
        .otherwise((rounds >= 2) & (n_docs == 0))
    )
