"""Registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpusflow.sources.tables import table

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[QueryFn], QueryFn]:
    """Register a query under its function name, with its SQL where SQL can say it."""

    def register(fn: QueryFn) -> QueryFn:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql.strip()
        return fn

    return register


@query()
def op1_packing(spark: SparkSession, folder: str) -> DataFrame:
    from corpusflow.llm import packing

    return packing.packed_documents(table(spark, folder, "documents"))


@query()
def op7_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    from corpusflow.llm import counting

    return counting.token_counts(table(spark, folder, "documents"))


# Distinct 2-word shingles are compared as strings; links by brute force over pairs that share one.
OP5_SQL = """
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'),
    lambda x: x <> '') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) = 1 THEN [w[1]]
    ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s
  FROM words),
sizes AS (SELECT doc_id, len(s) AS n FROM sets),
items AS (SELECT doc_id, unnest(s) AS x FROM sets),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared
  FROM items a JOIN items b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM common JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b
  WHERE 100 * shared >= 80 * (p.n + q.n - shared)),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM sizes UNION SELECT r.doc_id, w.b FROM reach r JOIN ways w ON w.a = r.other)
SELECT s.doc_id, s.n AS n_shingles, min(r.other) AS component_id, s.doc_id = min(r.other) AS kept
FROM sizes s JOIN reach r USING (doc_id) GROUP BY s.doc_id, s.n
"""


@query(OP5_SQL)
def op5_minhash(spark: SparkSession, folder: str) -> DataFrame:
    from corpusflow.llm import minhash

    return minhash.near_duplicates(table(spark, folder, "documents"))


@query()
def op8_quality(spark: SparkSession, folder: str) -> DataFrame:
    from corpusflow.llm import quality

    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, folder, "labels"))
    return quality.scored(docs, model).select("doc_id", "held_out", "score", "predicted")


@query()
def op9_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    from corpusflow.llm import decontaminate

    return decontaminate.contaminations(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


OP3_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM scores
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5
"""


@query(OP3_SQL)
def op3_topk(spark: SparkSession, folder: str) -> DataFrame:
    from pyspark.sql import functions as F

    from corpusflow.llm import topk

    vectors = topk.quantised(table(spark, folder, "embeddings"))
    return topk.top_k(vectors, F.col("vec_id") % 50 == 0)


@query()
def op4_token_files(spark: SparkSession, folder: str) -> DataFrame:
    from corpusflow.llm import binary

    return binary.token_files(table(spark, folder, "documents"))


@query()
def op10_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    from corpusflow.llm import substrings

    return substrings.without_repeats(table(spark, folder, "documents")).drop("kept")


@query()
def op6_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    from corpusflow.llm import pages

    return pages.extracted(table(spark, folder, "pages"))


@query()
def op2_secrets(spark: SparkSession, folder: str) -> DataFrame:
    from corpusflow.llm import secrets

    forest = secrets.fit_forest(secrets.public_findings(spark))
    return secrets.findings(table(spark, folder, "documents"), forest)


OP13_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, list_inner_product(a.v, c.v)::BIGINT AS score
  FROM v a JOIN v c ON a.vec_id <> c.vec_id WHERE a.vec_id % 50 = 0),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scores WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER w::INTEGER AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scores USING (anchor_id)
WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER w <= 3
"""


@query(OP13_SQL)
def op13_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    from pyspark.sql import functions as F

    from corpusflow.llm import negatives

    rows = negatives.prepared(table(spark, folder, "embeddings"))
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(rows.withColumn("label", moved), F.col("vec_id") % 50 == 0)


def _op12_sql() -> str:
    """One row at a time from the end; each grammar state keeps its cheapest (cost, audit, text)."""
    end = "{'c': 0, 'a': '', 'r': ''}", "{'c': 10, 'a': 'II', 'r': 'user:' || chr(10) || 'assistant:'}", "{'c': 5, 'a': 'I', 'r': 'assistant:'}"

    def after(edit: str, cost: str, line: str, rest: str) -> str:
        return f"{{'c': {cost} + {rest}.c, 'a': '{edit}' || {rest}.a, 'r': {line} || CASE WHEN {rest}.r = '' THEN '' ELSE chr(10) || {rest}.r END}}"

    def state(q: int) -> str:
        kept = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}[q]
        free, who = (3, "assistant") if q == 2 else (2, "user")
        offers = [f"[{{'c': 2 + f{q}.c, 'a': 'D' || f{q}.a, 'r': f{q}.r}}]"]
        offers.append(f"CASE WHEN drop_it THEN [] ELSE [{after('R', '1 + fine', repr(who + ':') + ' || text', f'f{free}')}] END")
        offers += [f"CASE WHEN drop_it OR init <> '{c}' THEN [] ELSE [{after('K', 'fine', chr(39) * 2 + ' || role || ' + repr(':') + ' || text', f'f{n}')}] END" for c, n in kept.items()]
        return f"list_sort({' || '.join(offers)})[1]"

    def with_insert(q: int, source: str) -> str:
        who = "assistant:" if q == 2 else "user:"
        return f"list_sort([e{q}, {after('I', '5', repr(who), source)}])[1]"

    return f"""
WITH RECURSIVE named AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name FROM conversations),
summed AS (
  SELECT *, xor(4294967295::BIGINT, list_reduce(
    list_concat([4294967295::BIGINT], list_transform(range(1, length(name) + 1), lambda k: ascii(substr(name, k, 1))::BIGINT)),
    lambda c, b: list_reduce(list_concat([xor(c, b)], range(8)), lambda x, k: xor(x >> 1, (x & 1) * 3988292384)))) % 20 AS code
  FROM named),
rows0 AS (
  SELECT conv_id, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role,
    CASE code WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE WHEN code = 3 THEN [1, 2] ELSE [1] END) AS t FROM summed WHERE code <> 0),
rows1 AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
    rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS cut FROM rows0),
rows2 AS (
  SELECT conv_id, turn, role, text, i, substr(role, 1, 1) AS init, cut = '' AS blank,
    cut <> '' AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS duplicate, cut FROM rows1),
rows3 AS (
  SELECT *, blank OR duplicate AS drop_it, NOT blank AND NOT duplicate AND right(cut, 1) NOT IN ('.', '!', '?') AS truncated,
    i > 1 AND lag(init) OVER (PARTITION BY conv_id ORDER BY i) || init NOT IN ('su', 'ua', 'au') AS illegal FROM rows2),
counts AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank,
    count(*) FILTER (duplicate) AS duplicate, count(*) FILTER (truncated) AS truncated, count(*) FILTER (illegal) AS illegal
  FROM rows3 GROUP BY conv_id),
step AS (
  SELECT conv_id, n + 1 AS i, {end[0]} AS f0, {end[1]} AS f1, {end[2]} AS f2, {end[0]} AS f3 FROM counts
  UNION ALL
  SELECT conv_id, i, {with_insert(0, 'g2')} AS f0, {with_insert(1, 'g2')} AS f1, g2 AS f2, {with_insert(3, 'e2')} AS f3 FROM (
    SELECT *, {with_insert(2, 'e3')} AS g2 FROM (
      SELECT conv_id, i, {', '.join(f'{state(q)} AS e{q}' for q in range(4))} FROM (
        SELECT s.conv_id, r.i, r.role, r.text, r.init, r.drop_it, CASE WHEN r.truncated THEN 5 ELSE 0 END AS fine, s.f0, s.f1, s.f2, s.f3
        FROM step s JOIN rows3 r ON r.conv_id IS NOT DISTINCT FROM s.conv_id AND r.i = s.i - 1) AS x) AS y) AS z)
SELECT o.conv_id, coalesce(c.gaps, 0) AS gaps, coalesce(c.blank, 0) AS blank, coalesce(c.duplicate, 0) AS duplicate,
  coalesce(c.truncated, 0) AS truncated, coalesce(c.illegal, 0) AS illegal, coalesce(s.f0.c, 0)::BIGINT AS cost,
  coalesce(s.f0.a, '') AS audit, sha256(coalesce(s.f0.r, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN step s ON s.conv_id IS NOT DISTINCT FROM o.conv_id AND s.i = 1
"""


@query(_op12_sql())
def op12_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    from corpusflow.llm import repair

    rows = table(spark, folder, "conversations")
    return repair.repairs(rows, repair.damaged(rows))


# The same join on sets of 3-word shingles as strings, with the number of linked documents.
OP11_SQL = (
    OP5_SQL.replace("WHEN len(w) = 1 THEN [w[1]]", "WHEN len(w) < 3 THEN [array_to_string(w, ' ')]")
    .replace("range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]", "range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]")
    .replace(">= 80 *", ">= 90 *")
    .replace("s.doc_id = min(r.other) AS kept", "(SELECT count(*) FROM ways WHERE ways.a = s.doc_id) AS n_links")
)


@query(OP11_SQL)
def op11_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    from corpusflow.llm import jaccard

    return jaccard.jaccard_join(table(spark, folder, "documents"))
