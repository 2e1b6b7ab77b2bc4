"""Registered queries over conversations and the service log: rules, memory, metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.functions import classify, parsing
from corpusflow.functions.text import clean_subqueries as subqueries
from corpusflow.functions.text import extract_path
from corpusflow.operators import dedup, memory, metrics
from corpusflow.plans.catalog_corpus import vector_sql
from corpusflow.plans.catalog_retrieval import text_queries
from corpusflow.plans.registry import query
from corpusflow.session import cut_lineage
from corpusflow.sources.tables import table

# Questions about parts: the phrase depends on the part type, the mark on its brand.
PHRASES = {
    "ECONOMY": ("什么是", ""), "LARGE": ("帮我搜", ""), "MEDIUM": ("", "的定义"), "PROMO": ("对比", "的最新价格"),
    "SMALL": ("你好 ", ""), "STANDARD": ("", " csv 数据清洗"),
}


def questions(spark, folder) -> DataFrame:
    """query_id, text: every user message, and a question about every part."""
    said = table(spark, folder, "conversations").filter(F.col("role") == "user").select(
        F.concat_ws("-", F.lit("c"), "conv_id", "turn").alias("query_id"), "text"
    )
    pre = F.create_map(*[F.lit(v) for k, (a, _) in PHRASES.items() for v in (k, a)])
    post = F.create_map(*[F.lit(v) for k, (_, b) in PHRASES.items() for v in (k, b)])
    kind = F.col("p_type")
    asked = table(spark, folder, "part").select(
        F.concat_ws("-", F.lit("p"), "p_partkey").alias("query_id"),
        F.concat(
            F.coalesce(pre[kind], F.lit("")), F.col("p_name"), F.coalesce(post[kind], F.lit("")),
            F.when(F.col("p_size") > 25, "？").otherwise(""),
        ).alias("text"),
    )
    return said.unionByName(asked)


def _case(i: int) -> str:
    return "CASE p_type " + " ".join(f"WHEN '{k}' THEN '{v[i]}'" for k, v in PHRASES.items()) + " ELSE '' END"


QUESTIONS_SQL = f"""
q AS (SELECT 'c-' || conv_id || '-' || turn AS query_id, text FROM conversations WHERE role = 'user'
  UNION ALL SELECT 'p-' || p_partkey, {_case(0)} || p_name || {_case(1)} || CASE WHEN p_size > 25 THEN '？' ELSE '' END FROM part)
"""


def _any(column: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({column}, '{w}')" for w in dict.fromkeys(words)) + ")"


def _pattern(column: str, patterns: list[str]) -> str:
    return f"regexp_matches({column}, '{'|'.join(patterns)}')"


ROUTE_SQL = f"""CASE WHEN {_any('t', classify.ROUTE_DATA)} THEN 'tools' WHEN {_any('t', classify.ROUTE_SEARCH)} THEN 'react'
  WHEN {_any('t', classify.ROUTE_CHAT)} THEN 'pure_llm' WHEN {_pattern('t', classify.ROUTE_DEFINITION)} AND length(text) < 20 THEN 'rag'
  WHEN {_any('t', classify.ROUTE_REACT)} THEN 'react' WHEN length(text) > 50 THEN 'react'
  WHEN length(text) < 10 AND NOT contains(text, '?') AND NOT contains(text, '？') THEN 'pure_llm' ELSE 'rag' END"""

INTENT_SQL = f"""
i AS (SELECT query_id, text, lower(text) AS t, CASE WHEN {_any('lower(text)', classify.INTENT_CHAT)} THEN 'chat'
  WHEN {_any('lower(text)', classify.INTENT_WEB)} THEN 'web_search' WHEN {_any('lower(text)', classify.INTENT_HYBRID)} THEN 'hybrid'
  WHEN {_any('lower(text)', classify.INTENT_DATA)} THEN 'data_processing' ELSE 'knowledge' END AS kind FROM q),
intent AS (SELECT *, CASE kind WHEN 'chat' THEN 0.9 WHEN 'web_search' THEN 0.7 WHEN 'hybrid' THEN 0.6
  WHEN 'data_processing' THEN 0.8 ELSE 0.5 END::DOUBLE AS confidence FROM i)
"""


@query(f"WITH {QUESTIONS_SQL}, x AS (SELECT *, trim(lower(text)) AS t FROM q) SELECT query_id, {ROUTE_SQL} AS route FROM x")
def route_queries(spark, folder):
    return questions(spark, folder).select("query_id", classify.route(F.col("text")).alias("route"))


@query(
    f"""WITH {QUESTIONS_SQL}, {INTENT_SQL} SELECT query_id, kind AS query_type, confidence,
    kind IN ('web_search', 'hybrid', 'data_processing') AS needs_tools FROM intent"""
)
def keyword_intent(spark, folder):
    rows = questions(spark, folder).select("query_id", classify.keyword_intent(F.col("text")).alias("i"))
    return rows.select("query_id", "i.query_type", "i.confidence", "i.needs_tools")


def _fields(column: str) -> list:
    return [F.col(f"{column}.{n}").alias(n) for n in ("level", "confidence", "reasoning", "use_react", "requires_web", "use_fast_path")]


FOUND_SQL = f"regexp_extract_all(t, '{'|'.join(classify.COMPLEX_WORDS)}')"
STEPS_SQL = f"({_any('t', classify.COMPLEX_WORDS)} OR {_any('t', classify.COMPLEX_SEARCH)})"
SIMPLE_SQL = f"({_pattern('t', classify.COMPLEX_DEFINITION)} AND length(t) < 20)"
CHAT_SQL = _any("t", classify.FAST_WORDS)
REASONS_SQL = f"""concat_ws('; ', CASE WHEN len({FOUND_SQL}) > 0 THEN '关键词: ' || list_aggregate({FOUND_SQL}[1:3], 'string_agg', ', ') END,
  CASE WHEN length(text) > 50 THEN '查询较长(' || length(text) || '字)' END)"""


@query(
    f"""WITH {QUESTIONS_SQL}, x AS (SELECT *, lower(text) AS t FROM q)
    SELECT query_id, CASE WHEN {CHAT_SQL} OR {SIMPLE_SQL} THEN 'simple' WHEN {STEPS_SQL} THEN 'complex' ELSE 'medium' END AS level,
      CASE WHEN {CHAT_SQL} THEN 0.95 WHEN {SIMPLE_SQL} THEN 0.9 WHEN {STEPS_SQL} THEN 0.8 ELSE 0.5 END::DOUBLE AS confidence,
      CASE WHEN {CHAT_SQL} THEN '闲聊/简单确认，直接快速路径' WHEN {SIMPLE_SQL} THEN '简单定义类查询，知识库直接匹配'
        WHEN {STEPS_SQL} THEN coalesce(nullif({REASONS_SQL}, ''), '复杂查询') ELSE '默认标准路径' END AS reasoning,
      NOT ({CHAT_SQL} OR {SIMPLE_SQL}) AND {STEPS_SQL} AS use_react, false AS requires_web, {CHAT_SQL} OR {SIMPLE_SQL} AS use_fast_path
    FROM x"""
)
def query_complexity(spark, folder):
    rows = questions(spark, folder).select("query_id", classify.complexity(F.col("text")).alias("c"))
    return rows.select("query_id", *_fields("c"))


@query(
    f"""WITH {QUESTIONS_SQL}, {INTENT_SQL}
    SELECT query_id, CASE kind WHEN 'chat' THEN 'simple' WHEN 'data_processing' THEN 'medium' ELSE 'complex' END AS level,
      CASE kind WHEN 'chat' THEN 0.95 WHEN 'hybrid' THEN 0.8 WHEN 'web_search' THEN 0.85 ELSE 0.5 END::DOUBLE AS confidence,
      CASE kind WHEN 'chat' THEN '闲聊意图' WHEN 'hybrid' THEN '混合查询，需要联网+知识库' WHEN 'web_search' THEN '联网搜索查询'
        WHEN 'knowledge' THEN '低置信度知识库查询(0.50)，可能需要多轮' ELSE '标准复杂度' END AS reasoning,
      kind IN ('knowledge', 'hybrid', 'web_search') AS use_react, kind IN ('hybrid', 'web_search') AS requires_web,
      kind = 'chat' AS use_fast_path
    FROM intent"""
)
def complexity_by_intent(spark, folder):
    rows = questions(spark, folder).withColumn("i", classify.keyword_intent(F.col("text")))
    return rows.select("query_id", classify.complexity_by_intent(F.col("i")).alias("c")).select("query_id", *_fields("c"))


# A given intent per question: its confidence rises with the length of the text.
@query(
    f"""WITH {QUESTIONS_SQL}, {INTENT_SQL}, g AS (SELECT *, CASE WHEN length(text) > 100 THEN 0.9 ELSE 0.4 END AS given FROM intent)
    SELECT query_id, CASE WHEN given >= 0.6 THEN 'retriever' WHEN kind = 'chat' THEN 'chat' WHEN kind = 'web_search' THEN 'web_search'
      WHEN kind = 'data_processing' THEN 'tools' ELSE 'retriever' END AS step FROM g"""
)
def intent_route(spark, folder):
    given = F.when(F.length("text") > 100, 0.9).otherwise(0.4)
    step = classify.intent_step(F.col("text"), F.lit("knowledge"), given)
    return questions(spark, folder).select("query_id", step.alias("step"))


@query(
    f"""WITH {QUESTIONS_SQL} SELECT query_id, {_any('text', classify.NEEDS_WEB)} AS needs_web,
    {_any('text', classify.FORCES_WEB)} AS forces_web, {_any('text', classify.FOLLOW_UP)} AS is_follow_up FROM q"""
)
def query_flags(spark, folder):
    text = F.col("text")
    return questions(spark, folder).select(
        "query_id", classify.needs_web(text).alias("needs_web"), classify.forces_web(text).alias("forces_web"),
        classify.is_follow_up(text).alias("is_follow_up"),
    )


# Gathered context per conversation: assistant messages are documents, system messages web results.
GATHERED_SQL = """
g AS (SELECT conv_id, max(text) FILTER (role = 'user') AS text, count(*) FILTER (role = 'assistant') AS n_docs,
  count(*) FILTER (role = 'system') AS n_web, count(*) FILTER (role = 'user') AS rounds FROM conversations GROUP BY conv_id)
"""


def gathered(spark, folder) -> DataFrame:
    role = F.col("role")
    return table(spark, folder, "conversations").groupBy("conv_id").agg(
        F.max(F.when(role == "user", F.col("text"))).alias("text"),
        F.count_if(role == "assistant").alias("n_docs"),
        F.count_if(role == "system").alias("n_web"),
        F.count_if(role == "user").alias("rounds"),
    )


@query(
    f"""WITH {GATHERED_SQL} SELECT conv_id, n_docs, n_web, CASE WHEN {_any('text', classify.NEEDS_WEB)} AND n_web = 0 THEN false
      WHEN n_docs + n_web >= 3 THEN true WHEN n_docs > 0 AND n_web > 0 THEN true ELSE rounds >= 2 AND n_docs = 0 END AS sufficient FROM g"""
)
def context_sufficiency(spark, folder):
    enough = classify.context_sufficient(F.col("text"), F.col("n_docs"), F.col("n_web"), F.col("rounds"))
    return gathered(spark, folder).select("conv_id", "n_docs", "n_web", enough.alias("sufficient"))


GIVEN_KINDS = ["chat", "knowledge", "hybrid", "web_search", "data_processing"]

# Given intents of every type and confidence, by the length of the text.
GIVEN_SQL = f"""
g AS (SELECT *, ({GIVEN_KINDS})[length(text) % 5 + 1] AS gk, (length(text) // 5 % 10) / 10.0::DOUBLE AS conf, length(text) % 7 = 0 AS follows FROM intent),
c4 AS (SELECT *,
  CASE WHEN gk = 'chat' OR (gk = 'knowledge' AND conf >= 0.8) THEN 'simple' WHEN (gk = 'knowledge' AND conf >= 0.6) OR gk = 'data_processing' THEN 'medium'
    ELSE 'complex' END AS level4,
  CASE WHEN gk = 'chat' THEN 0.95 WHEN gk = 'knowledge' AND conf >= 0.6 THEN conf WHEN gk = 'hybrid' THEN 0.8 WHEN gk = 'web_search' THEN 0.85 ELSE 0.5 END::DOUBLE AS conf4,
  CASE WHEN gk = 'chat' THEN '闲聊意图' WHEN gk = 'knowledge' AND conf >= 0.8 THEN '高置信度知识库查询(' || format('{{:.2f}}', conf) || ')'
    WHEN gk = 'knowledge' AND conf >= 0.6 THEN '中等置信度知识库查询(' || format('{{:.2f}}', conf) || ')'
    WHEN gk = 'knowledge' THEN '低置信度知识库查询(' || format('{{:.2f}}', conf) || ')，可能需要多轮'
    WHEN gk = 'hybrid' THEN '混合查询，需要联网+知识库' WHEN gk = 'web_search' THEN '联网搜索查询' ELSE '标准复杂度' END AS reason4,
  (gk = 'knowledge' AND conf < 0.6) OR gk IN ('hybrid', 'web_search') AS react4, gk IN ('hybrid', 'web_search') AS web4,
  gk = 'chat' OR (gk = 'knowledge' AND conf >= 0.8) AS fast4 FROM g)
"""


def given_intents(spark, folder) -> DataFrame:
    """query_id, text, i (intent struct), follows."""
    n = F.length("text")
    kind = F.element_at(F.array(*[F.lit(k) for k in GIVEN_KINDS]), (n % 5 + 1).cast("int"))
    intent = F.struct(
        kind.alias("query_type"), (F.floor(n / 5) % 10 / 10.0).alias("confidence"), F.lit("").alias("reasoning"),
        kind.isin("web_search", "hybrid", "data_processing").alias("needs_tools"),
    )
    return questions(spark, folder).select("query_id", "text", intent.alias("i"), (n % 7 == 0).alias("follows"))


@query(
    f"""WITH {QUESTIONS_SQL}, {INTENT_SQL}, {GIVEN_SQL}
    SELECT query_id, level4 AS level, conf4 AS confidence, reason4 AS reasoning, react4 AS use_react, web4 AS requires_web, fast4 AS use_fast_path FROM c4"""
)
def complexity_by_confidence(spark, folder):
    rows = given_intents(spark, folder).select("query_id", classify.complexity_by_intent(F.col("i")).alias("c"))
    return rows.select("query_id", *_fields("c"))


GIVEN_STEPS_SQL = f"({STEPS_SQL} OR follows OR gk IN ('web_search', 'hybrid'))"
GIVEN_REASONS_SQL = f"""concat_ws('; ', CASE gk WHEN 'web_search' THEN '联网搜索意图' WHEN 'hybrid' THEN '混合查询意图' END,
  CASE WHEN len({FOUND_SQL}) > 0 THEN '关键词: ' || list_aggregate({FOUND_SQL}[1:3], 'string_agg', ', ') END,
  CASE WHEN length(text) > 50 THEN '查询较长(' || length(text) || '字)' END)"""


@query(
    f"""WITH {QUESTIONS_SQL}, {INTENT_SQL}, {GIVEN_SQL}, x AS (SELECT * EXCLUDE (t), lower(text) AS t FROM c4)
    SELECT query_id, CASE WHEN {CHAT_SQL} OR {SIMPLE_SQL} THEN 'simple' WHEN {GIVEN_STEPS_SQL} THEN 'complex' ELSE level4 END AS level,
      CASE WHEN {CHAT_SQL} THEN 0.95 WHEN {SIMPLE_SQL} THEN 0.9 WHEN {GIVEN_STEPS_SQL} THEN 0.8 ELSE conf4 END::DOUBLE AS confidence,
      CASE WHEN {CHAT_SQL} THEN '闲聊/简单确认，直接快速路径' WHEN {SIMPLE_SQL} THEN '简单定义类查询，知识库直接匹配'
        WHEN {GIVEN_STEPS_SQL} THEN coalesce(nullif({GIVEN_REASONS_SQL}, ''), '复杂查询') ELSE reason4 END AS reasoning,
      NOT ({CHAT_SQL} OR {SIMPLE_SQL}) AND ({GIVEN_STEPS_SQL} OR react4) AS use_react,
      NOT ({CHAT_SQL} OR {SIMPLE_SQL}) AND CASE WHEN {GIVEN_STEPS_SQL} THEN gk IN ('web_search', 'hybrid', 'data_processing') ELSE web4 END AS requires_web,
      ({CHAT_SQL} OR {SIMPLE_SQL}) OR (NOT {GIVEN_STEPS_SQL} AND fast4) AS use_fast_path
    FROM x"""
)
def complexity_of_given_intents(spark, folder):
    rows = given_intents(spark, folder)
    return rows.select("query_id", classify.complexity(F.col("text"), F.col("i"), F.col("follows")).alias("c")).select("query_id", *_fields("c"))


@query(
    f"""WITH {QUESTIONS_SQL}, {INTENT_SQL}, {GIVEN_SQL}, k AS (SELECT query_id, CASE WHEN conf < 0.6 THEN kind ELSE gk END AS k FROM g)
    SELECT query_id, CASE k WHEN 'chat' THEN 'chat' WHEN 'web_search' THEN 'web_search' WHEN 'data_processing' THEN 'tools' ELSE 'retriever' END AS step FROM k"""
)
def intent_route_by_confidence(spark, folder):
    step = classify.intent_step(F.col("text"), F.col("i.query_type"), F.col("i.confidence"))
    return given_intents(spark, folder).select("query_id", step.alias("step"))


@query(
    f"""WITH {QUESTIONS_SQL}, {INTENT_SQL}, {GIVEN_SQL}
    SELECT query_id, (length(text) % 3 = 0 AND gk NOT IN ('web_search', 'hybrid')) OR conf < 0.3 AS falls_back FROM g"""
)
def fallback_by_confidence(spark, folder):
    """The number of results is the length of the text modulo 3."""
    rows = given_intents(spark, folder)
    fallback = classify.falls_back_to_chat(F.length("text") % 3, F.col("i.query_type"), F.col("i.confidence"))
    return rows.select("query_id", fallback.alias("falls_back"))


@query(
    f"""WITH {QUESTIONS_SQL}, {INTENT_SQL}, r AS (SELECT 'c-' || u.conv_id || '-' || u.turn AS query_id, count(a.turn) AS n
      FROM conversations u LEFT JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'
      WHERE u.role = 'user' GROUP BY ALL)
    SELECT query_id, coalesce(n, 0) AS n_results, (coalesce(n, 0) < 1 AND kind NOT IN ('web_search', 'hybrid')) OR confidence < 0.3 AS falls_back
    FROM intent LEFT JOIN r USING (query_id)"""
)
def chat_fallback(spark, folder):
    """A question without a following answer counts as one without results."""
    turns = table(spark, folder, "conversations")
    answers = turns.filter(F.col("role") == "assistant").select(
        F.concat_ws("-", F.lit("c"), "conv_id", (F.col("turn") - 1).cast("string")).alias("query_id")
    )
    counts = answers.groupBy("query_id").agg(F.count("*").alias("n"))
    rows = questions(spark, folder).withColumn("i", classify.keyword_intent(F.col("text"))).join(counts, "query_id", "left")
    return rows.select(
        "query_id", F.coalesce("n", F.lit(0)).alias("n_results"),
        classify.falls_back_to_chat(F.col("n"), F.col("i.query_type"), F.col("i.confidence")).alias("falls_back"),
    )


@query(
    r"""SELECT conv_id, turn, regexp_replace(regexp_replace(turn || '. ' || text || chr(10) || '2、' || role, '(?m)^\d+[.、]?\s*', '', 'g'),
      '[^\p{L}\p{N}_\s,，]', '', 'g') AS keywords FROM conversations"""
)
def clean_subqueries(spark, folder):
    numbered = F.concat(F.col("turn").cast("string"), F.lit(". "), F.col("text"), F.lit("\n2、"), F.col("role"))
    return table(spark, folder, "conversations").select("conv_id", "turn", subqueries(numbered).alias("keywords"))


@query(
    r"""SELECT o_orderkey, 'D:\data\' || lower(substr(o_orderpriority, 3)) || '\orders ' || o_orderkey || '.csv' AS path FROM orders"""
)
def extract_paths(spark, folder):
    """A request text per order names a file; half of the names lack their suffix."""
    suffix = F.when(F.col("o_orderstatus") == "F", ".csv").otherwise("")
    folder_name = F.lower(F.substr("o_orderpriority", F.lit(3)))
    text = F.concat(
        F.lit("请处理 D:\\data\\"), folder_name, F.lit("\\orders "), F.col("o_orderkey").cast("string"), suffix, F.lit(" 对该文件做清洗")
    )
    return table(spark, folder, "orders").select("o_orderkey", extract_path(text).alias("path"))


@query(
    """SELECT event_id, (props->>'$.k')::INT AS k, event_type AS query_type, 0.5::DOUBLE AS confidence, false AS needs_tools FROM events"""
)
def parse_json_props(spark, folder):
    """Event properties inside a fenced block, next to an intent that lacks most fields."""
    fenced = F.concat(F.lit("答案如下\n```json\n"), F.col("props"), F.lit("\n```\n完"))
    intent = F.concat(F.lit("结果: {\"query_type\": \""), F.col("event_type"), F.lit("\"} 完"))
    rows = table(spark, folder, "events").select(
        "event_id", F.from_json(parsing.json_block(fenced), "k int").alias("p"), parsing.parse_intent(intent).alias("i")
    )
    return rows.select("event_id", "p.k", "i.query_type", "i.confidence", "i.needs_tools")


@query("""SELECT event_id, event_type AS next_action, '' AS gap FROM events""")
def repair_json_values(spark, folder):
    """A doubled value in the JSON of a reasoning step: the second one counts."""
    broken = F.concat(F.lit('{"next_action": "当前动作": "'), F.col("event_type"), F.lit('"}'))
    rows = table(spark, folder, "events").select("event_id", parsing.parse_thought(broken).alias("t"))
    return rows.select("event_id", "t.next_action", "t.gap")


@query(
    r"""SELECT conv_id, turn, to_json([role, text])::VARCHAR AS encoded, 2 AS n_decoded, role AS first_keyword FROM conversations"""
)
def keyword_lists(spark, folder):
    """Keyword lists written to JSON and read back."""
    rows = table(spark, folder, "conversations").select(
        "conv_id", "turn", parsing.encode_keywords(F.array("role", "text")).alias("encoded")
    )
    back = parsing.decode_keywords(F.col("encoded"))
    return rows.select("conv_id", "turn", "encoded", F.size(back).alias("n_decoded"), F.get(back, F.lit(0)).alias("first_keyword"))


def turns(spark, folder) -> DataFrame:
    return table(spark, folder, "conversations")


LINE_SQL = "CASE WHEN role = 'user' THEN '用户' ELSE '助手' END || '：' || text"


@query(
    f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations)
    SELECT conv_id, count(*) AS n_messages, string_agg({LINE_SQL}, chr(10) ORDER BY turn) AS context FROM r WHERE back <= 4 GROUP BY conv_id"""
)
def recent_context(spark, folder):
    return memory.conversation_context(turns(spark, folder), 2)


@query(
    f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations WHERE role <> 'system')
    SELECT conv_id, count(*) AS n_messages, string_agg({LINE_SQL}, chr(10) ORDER BY turn) AS context FROM r WHERE back <= 10 GROUP BY conv_id"""
)
def dialog_history(spark, folder):
    return memory.conversation_context(turns(spark, folder), 5, system=False)


@query(
    """WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations)
    SELECT conv_id, turn, role, text FROM r WHERE back > 3"""
)
def truncated_turns(spark, folder):
    return memory.truncated_messages(turns(spark, folder), 3).select("conv_id", "turn", "role", "text")


@query("SELECT conv_id, count(*) AS n_messages, count(*) >= 6 AS should_summarize FROM conversations GROUP BY conv_id")
def summary_gate(spark, folder):
    return memory.needs_summary(turns(spark, folder), 6)


@query(
    """WITH r AS (SELECT conv_id, turn, role, sum((role = 'user')::INT) OVER w AS user_turns, count(*) OVER w AS n_messages
      FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
    SELECT conv_id, turn, user_turns::BIGINT AS user_turns, n_messages FROM r WHERE role = 'user' AND user_turns % 2 = 0 AND n_messages >= 4"""
)
def summary_triggers(spark, folder):
    return memory.summary_triggers(turns(spark, folder), every=2)


@query(
    r"""WITH c AS (SELECT doc_id, unnest(string_split(text, '')) AS ch, generate_subscripts(string_split(text, ''), 1) AS pos FROM documents),
    k AS (SELECT doc_id, ch, count(*) AS n, min(pos) AS first FROM c WHERE NOT regexp_matches(ch, '^[\s\p{Z}]*$') GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first) AS rank FROM k)
    SELECT doc_id, rank, ch, n FROM r WHERE rank <= 5"""
)
def top_chars(spark, folder):
    from corpusflow.session import spread

    return memory.top_characters(spread(table(spark, folder, "documents").select("doc_id", "text")), "doc_id")


def memories(spark, folder) -> DataFrame:
    """One memory per assistant message, with a vector that is derived from its text."""
    said = turns(spark, folder).filter(F.col("role") == "assistant")
    held = said.select((F.col("conv_id") * 100_000 + F.col("turn")).alias("memory_id"), F.col("conv_id").alias("session_id"), F.col("text").alias("content"))
    held = cut_lineage(held, "messages")
    # Written, since a recall reads them twice.
    vectors = cut_lineage(dedup.projected_vector(held, "memory_id", "content"), "vectors")
    return held.join(vectors, "memory_id")


def asked_texts(spark, folder) -> DataFrame:
    """query_id, text, embedding of every benchmark text."""
    queries = text_queries(spark, folder)
    return queries.join(dedup.projected_vector(queries, "query_id"), "query_id")


MEMORY_SQL = f"""
mem AS (SELECT conv_id * 100000 + turn AS n, conv_id, text FROM conversations WHERE role = 'assistant'),
bv AS (SELECT item_id AS n, text FROM benchmark), {vector_sql('bv', 'q')}, {vector_sql('mem', 'm')},
md AS (SELECT q_vec.n AS query_id, mem.n AS memory_id, conv_id AS session_id, text AS content,
         round(list_sum(list_transform(list_zip(q_vec.v, m_vec.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 9) AS distance
       FROM q_vec, m_vec JOIN mem ON mem.n = m_vec.n),
recalled AS (SELECT query_id, memory_id, session_id, content, row_number() OVER (PARTITION BY query_id ORDER BY distance, memory_id) AS rank FROM md)
"""


@query(f"WITH {MEMORY_SQL} SELECT query_id, rank, memory_id, session_id, content FROM recalled WHERE rank <= 3")
def memory_recall(spark, folder):
    return memory.recall(memories(spark, folder), asked_texts(spark, folder), 3)


@query(f"WITH {MEMORY_SQL} SELECT query_id, rank, memory_id, session_id, content FROM recalled WHERE rank <= 3 AND session_id % 2 = 0")
def session_recall(spark, folder):
    """The session condition comes after the top-k, so fewer than three may be left."""
    return memory.recall(memories(spark, folder), asked_texts(spark, folder), 3, F.col("session_id") % 2 == 0)


@query(
    f"""WITH {MEMORY_SQL}, r AS (SELECT query_id, memory_id, session_id, content, row_number() OVER (PARTITION BY query_id ORDER BY distance, memory_id) AS rank
      FROM md WHERE session_id % 2 = 0) SELECT query_id, rank, memory_id, session_id, content FROM r WHERE rank <= 3"""
)
def session_recall_first(spark, folder):
    """The session condition comes before the top-k."""
    return memory.recall(memories(spark, folder), asked_texts(spark, folder), 3, F.col("session_id") % 2 == 0, filter_first=True)


@query(f"WITH {MEMORY_SQL} SELECT n AS memory_id, conv_id AS session_id, text AS content FROM mem WHERE conv_id % 2 = 0 ORDER BY 1 LIMIT 3")
def recall_without_vectors(spark, folder):
    return memory.first_memories(memories(spark, folder), 3, session=F.col("session_id") % 2 == 0).select("memory_id", "session_id", "content")


@query(f"WITH {MEMORY_SQL} SELECT n AS memory_id, conv_id AS session_id, text AS content FROM mem")
def all_memories(spark, folder):
    return memory.all_memories(memories(spark, folder))


@query(
    f"""WITH {MEMORY_SQL}, old AS (SELECT query_id, string_agg('- ' || content, chr(10) ORDER BY rank) AS memories FROM recalled WHERE rank <= 3 GROUP BY query_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations),
    now AS (SELECT conv_id AS query_id, string_agg({LINE_SQL}, chr(10) ORDER BY turn) AS recent FROM r WHERE back <= 4 GROUP BY conv_id)
    SELECT query_id, '【相关历史记忆】' || chr(10) || memories || chr(10) ||
      CASE WHEN recent IS NOT NULL THEN chr(10) || '【当前对话】' || chr(10) || recent ELSE '' END AS context FROM old LEFT JOIN now USING (query_id)"""
)
def assembled_context(spark, folder):
    """Benchmark item i is asked in conversation i."""
    asked = asked_texts(spark, folder)
    recalled = memory.recall(memories(spark, folder), asked, 3)
    asked_in = turns(spark, folder).join(asked.select(F.col("query_id").alias("conv_id")), "conv_id", "left_semi")
    current = memory.conversation_context(asked_in, 2).withColumnRenamed("conv_id", "query_id")
    return memory.assembled_context(recalled, current)


LOG_SQL = """
log AS (SELECT ts, event_id, value AS duration, event_type = 'error' AS is_error, event_type = 'view' AS cache_hit FROM events),
recent AS (SELECT duration FROM log ORDER BY ts DESC, event_id DESC LIMIT 1000),
s AS (SELECT list(duration ORDER BY duration) AS t FROM recent)
"""


def service_log(spark, folder) -> DataFrame:
    return table(spark, folder, "events").select(
        F.struct("ts", "event_id").alias("seq"), F.col("value").alias("duration"),
        (F.col("event_type") == "error").alias("is_error"), (F.col("event_type") == "view").alias("cache_hit"),
    )


@query(
    f"""WITH {LOG_SQL} SELECT (SELECT count(*) FROM log) AS total_queries, (SELECT round(avg(duration), 6) FROM recent) AS avg_response_time,
      t[floor(len(t) * 0.95)::INT + 1] AS p95_response_time, t[floor(len(t) * 0.99)::INT + 1] AS p99_response_time,
      (SELECT round(count(*) FILTER (is_error) / count(*) * 100, 6) FROM log) AS error_rate,
      (SELECT round(count(*) FILTER (cache_hit) / count(*) * 100, 6) FROM log) AS cache_hit_rate FROM s"""
)
def query_metrics(spark, folder):
    row = metrics.query_metrics(service_log(spark, folder))
    return row.withColumns({c: F.round(c, 6) for c in ("avg_response_time", "error_rate", "cache_hit_rate")})
