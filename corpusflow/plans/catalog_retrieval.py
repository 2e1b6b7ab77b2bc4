"""Registered retrieval queries.

The corpus is the whole ``documents`` table. The query batch is the whole
``benchmark`` table; where vectors are needed, an item's vector is the one with
its number in ``embeddings``, and a document's vector likewise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.functions.scoring import fusion_key
from corpusflow.operators import cells, context, dense, fusion, inverted, rerank, segment, sparse
from corpusflow.operators.sparse import top_ranked
from corpusflow.plans import retrieval
from corpusflow.plans.registry import query
from corpusflow.session import cut_lineage, scratch_path, spread
from corpusflow.sources import stores
from corpusflow.sources.tables import table


def documents(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "source", "lang", "text")
    return spread(docs).withColumnsRenamed({"doc_id": "chunk_key", "lang": "section"})


def text_queries(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select(F.col("vec_id").alias("chunk_key"), "embedding")


def vector_queries(spark: SparkSession, folder: str) -> DataFrame:
    """query_id, text, embedding."""
    held = table(spark, folder, "embeddings").select(F.col("vec_id").alias("query_id"), "embedding")
    return text_queries(spark, folder).join(held, "query_id")


def document_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors that belong to a document of the corpus."""
    keys = documents(spark, folder).select("chunk_key")
    return vectors(spark, folder).join(keys, "chunk_key", "left_semi")


def build(spark: SparkSession, folder: str) -> sparse.SparseIndex:
    return sparse.build_index(documents(spark, folder))


TOKENS = r"'[\p{L}\p{N}_]+'"

# Shared SQL: postings and term statistics.
TERMS_SQL = rf"""
docs AS (SELECT doc_id, source, lang, text FROM documents WHERE trim(text) <> ''),
toks AS (SELECT doc_id, unnest(regexp_extract_all(text, {TOKENS})) AS term FROM docs),
tf AS (SELECT doc_id, term, count(*) AS tf FROM toks GROUP BY ALL),
dl AS (SELECT doc_id, len(regexp_extract_all(text, {TOKENS})) AS len FROM docs),
corpus AS (SELECT count(*) AS n, avg(len) AS avglen FROM dl),
dfs AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
raw AS (SELECT term, df, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM dfs, corpus),
terms AS (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw)
"""

# Shared SQL: BM25 scores of the benchmark texts.
BM25_SQL = rf"""
{TERMS_SQL},
qt AS (SELECT item_id AS query_id, unnest(regexp_extract_all(text, {TOKENS})) AS term FROM benchmark),
qw AS (SELECT query_id, term, count(*) * any_value(idf) AS w FROM qt JOIN terms USING (term) GROUP BY ALL),
pairs AS (
  SELECT query_id, doc_id, sum(w * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / avglen))) AS score
  FROM tf JOIN qw USING (term) JOIN dl USING (doc_id), corpus GROUP BY ALL),
bm25_all AS (
  SELECT query_id, doc_id, score,
         row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM pairs)
"""

# Shared SQL: squared distances between benchmark vectors and all vectors.
VECTOR_SQL = """
vq AS (SELECT item_id AS query_id, embedding::DOUBLE[] AS q FROM benchmark JOIN embeddings ON item_id = vec_id),
vd AS (SELECT query_id, vec_id, round(list_sum(list_transform(list_zip(q, embedding::DOUBLE[]),
         lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 9) AS distance FROM vq, embeddings),
vdoc AS (SELECT query_id, vec_id, distance FROM vd WHERE vec_id IN (SELECT doc_id FROM documents)),
vec_all AS (SELECT query_id, vec_id AS doc_id, distance,
         row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM vdoc)
"""

# Shared SQL: both lists of 30 for the queries that have a vector.
LISTS_SQL = f"""
{BM25_SQL}, {VECTOR_SQL},
lists AS (
  SELECT query_id, doc_id, 0 AS list_id, rank, -distance AS score FROM vec_all WHERE rank <= 30
  UNION ALL
  SELECT query_id, doc_id, 1, rank, score FROM bm25_all
  WHERE rank <= 30 AND score > 0 AND query_id IN (SELECT query_id FROM vq)),
normed AS (
  SELECT query_id, doc_id, list_id, rank, (score - min(score) OVER l) /
    CASE WHEN max(score) OVER l <> min(score) OVER l THEN max(score) OVER l - min(score) OVER l ELSE 1 END AS s
  FROM lists WINDOW l AS (PARTITION BY query_id, list_id))
"""

RRF_SQL = f"""
{LISTS_SQL},
rrf AS (
  SELECT query_id, doc_id, sum(0.5 / (60 + rank)) AS rrf_score,
         max(CASE WHEN list_id = 0 THEN rank END) AS vector_rank,
         max(CASE WHEN list_id = 1 THEN rank END) AS bm25_rank,
         min(list_id * 4294967296 + rank) AS first_seen
  FROM lists GROUP BY ALL),
fused AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(rrf_score, 9) DESC, first_seen, doc_id) AS rank
  FROM rrf)
"""

# Shared SQL: candidates reordered by token overlap.
RERANK_SQL = rf"""
{RRF_SQL},
cand AS (
  SELECT f.query_id, f.doc_id, f.rank AS fused_rank, f.rrf_score, f.vector_rank, f.bm25_rank, d.source, d.lang, d.text,
         list_distinct(regexp_extract_all(lower(b.text), {TOKENS})) AS qa,
         list_distinct(regexp_extract_all(lower(d.text), {TOKENS})) AS da
  FROM fused f JOIN documents d USING (doc_id) JOIN benchmark b ON b.item_id = f.query_id WHERE f.rank <= 20),
scored AS (
  SELECT *, CASE WHEN len(qa) * len(da) > 0 THEN len(list_intersect(qa, da)) / sqrt(len(qa)::DOUBLE * len(da)) ELSE 0 END AS s
  FROM cand),
final AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, doc_id) AS rank FROM scored)
"""


@query(f"WITH {TERMS_SQL} SELECT term, df, round(idf, 6) AS idf FROM terms")
def bm25_term_stats(spark, folder):
    return build(spark, folder).terms.select("term", "df", F.round("idf", 6).alias("idf"))


@query(
    f"""WITH {BM25_SQL} SELECT query_id, doc_id, round(score, 6) AS score, rank
    FROM bm25_all WHERE rank <= 20 AND score > 0"""
)
def bm25_search(spark, folder):
    found = sparse.search(build(spark, folder), text_queries(spark, folder), 20)
    return found.select("query_id", F.col("chunk_key").alias("doc_id"), F.round("score", 6).alias("score"), "rank")


@query(
    f"""WITH {BM25_SQL} SELECT query_id, doc_id, round(score, 6) AS score, rank
    FROM bm25_all WHERE rank <= 20 AND score > 0 AND score >= 60"""
)
def bm25_min_score(spark, folder):
    found = sparse.search(build(spark, folder), text_queries(spark, folder), 20, min_score=60.0)
    return found.select("query_id", F.col("chunk_key").alias("doc_id"), F.round("score", 6).alias("score"), "rank")


@query(
    f"""WITH {BM25_SQL} SELECT query_id, doc_id, round(score, 6) AS score, rank
    FROM bm25_all WHERE rank <= 20 AND score > 0"""
)
def index_append(spark, folder):
    """Documents with labels form the first index, the others are appended."""
    first, others = _halves(spark, folder)
    grown = sparse.append(sparse.build_index(first), others, "chunk_key", "text")
    found = sparse.search(grown, text_queries(spark, folder), 20)
    return found.select("query_id", F.col("chunk_key").alias("doc_id"), F.round("score", 6).alias("score"), "rank")


def _halves(spark, folder) -> list[DataFrame]:
    """Documents with labels, and the others; the texts meet the labels once."""
    labelled = table(spark, folder, "labels").select(F.col("doc_id").alias("chunk_key")).distinct()
    marked = documents(spark, folder).join(labelled.withColumn("labelled", F.lit(True)), "chunk_key", "left")
    marked = cut_lineage(marked, "halves")
    return [marked.filter(f"labelled is {kind}").drop("labelled") for kind in ("not null", "null")]


def _stored_index(spark, folder, label: str, halves: bool) -> inverted.TermIndex:
    """The documents in a stored inverted index, at once or the labelled ones first."""
    store = stores.TermIndexStore(spark, scratch_path(spark, label))
    if not halves:
        store.save("documents", sparse.build_documents(documents(spark, folder), "chunk_key", "text"))
        return store.load("documents")
    for half in _halves(spark, folder):
        store.append("documents", sparse.build_documents(half, "chunk_key", "text"))
    return store.load("documents")


def _searched(index: inverted.TermIndex, queries: DataFrame, k: int, min_score: float | None = None) -> DataFrame:
    found = inverted.search(index, queries, k, min_score)
    return found.select("query_id", F.col("chunk_key").alias("doc_id"), F.round("score", 6).alias("score"), "rank")


INDEXED_SQL = f"""WITH {BM25_SQL} SELECT query_id, doc_id, round(score, 6) AS score, rank
    FROM bm25_all WHERE rank <= 20 AND score > 0"""


@query(INDEXED_SQL)
def bm25_indexed(spark, folder):
    """The search over a stored inverted index with block maxima."""
    return _searched(_stored_index(spark, folder, "indexed", False), text_queries(spark, folder), 20)


@query(f"{INDEXED_SQL} AND score >= 60")
def bm25_index_grown(spark, folder):
    """The same over an index that grew by a batch; statistics are sums over the batches."""
    return _searched(_stored_index(spark, folder, "grown", True), text_queries(spark, folder), 20, 60.0)


@query(f"WITH {TERMS_SQL} SELECT term, df FROM terms")
def index_frequencies(spark, folder):
    """Document frequencies as stored by two batches."""
    index = _stored_index(spark, folder, "frequencies", True)
    return index.terms.groupBy("term").agg(F.sum("df").alias("df"))


VECTOR_TOPK_SQL = f"""WITH {VECTOR_SQL}, r AS (SELECT query_id, vec_id, distance,
      row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM vd)
    SELECT query_id, vec_id, round(distance, 6) AS distance, rank FROM r WHERE rank <= 20"""


@query(VECTOR_TOPK_SQL)
def vector_topk(spark, folder):
    near = dense.nearest(vectors(spark, folder), vector_queries(spark, folder), 20)
    return near.select("query_id", F.col("chunk_key").alias("vec_id"), F.round("distance", 6).alias("distance"), "rank")


@query(VECTOR_TOPK_SQL)
def vector_topk_grid(spark, folder):
    """The same in the cells of a grid, as for more queries than the tasks hold."""
    near = dense.nearest(vectors(spark, folder), vector_queries(spark, folder), 20, max_queries=16, cell_bytes=256 * 1024)
    return near.select("query_id", F.col("chunk_key").alias("vec_id"), F.round("distance", 6).alias("distance"), "rank")


@query(
    f"""WITH {VECTOR_SQL}, r AS (SELECT query_id, vec_id, distance,
      row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM vd)
    SELECT query_id, vec_id, round(distance, 6) AS distance, round(greatest(0, 1 - distance / 2), 6) AS relevance, rank
    FROM r WHERE rank <= 5 AND distance < 1.2"""
)
def vector_within_distance(spark, folder):
    near = dense.within(dense.nearest(vectors(spark, folder), vector_queries(spark, folder), 5), 1.2)
    return near.select(
        "query_id", F.col("chunk_key").alias("vec_id"), F.round("distance", 6).alias("distance"),
        F.round(context.relevance_from_distance(F.col("distance")), 6).alias("relevance"), "rank",
    )


@query("SELECT count(DISTINCT item_id) AS n_queries, TRUE AS reaches_95 FROM benchmark JOIN embeddings ON item_id = vec_id")
def vector_cells_recall(spark, folder):
    """Neighbours from the nearest cells against the exact ones: at least 95 of 100 are found."""
    path = scratch_path(spark, "cells")
    cells.save(cells.build(vectors(spark, folder), 16), path)
    queries = vector_queries(spark, folder)
    near = cells.nearest(cells.load(spark, path), queries, 20, probes=14).select("query_id", "chunk_key", F.lit(1).alias("found"))
    exact = dense.nearest(vectors(spark, folder), queries, 20).select("query_id", "chunk_key")
    return exact.join(near, ["query_id", "chunk_key"], "left").agg(
        F.count_distinct("query_id").alias("n_queries"), (F.count("found") >= 0.95 * F.count("*")).alias("reaches_95")
    )


@query(
    f"""WITH {VECTOR_SQL}, r AS (SELECT query_id, vec_id, distance,
      row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM vd)
    SELECT query_id, vec_id, round(distance, 6) AS distance, rank FROM r WHERE rank <= 20"""
)
def vector_cells_exact(spark, folder):
    """The exact neighbours from the cells, when a query looks into all of them."""
    near = cells.nearest(cells.build(vectors(spark, folder), 16), vector_queries(spark, folder), 20, probes=16)
    return near.select("query_id", F.col("chunk_key").alias("vec_id"), F.round("distance", 6).alias("distance"), "rank")


def ranked_lists(spark, folder):
    queries = vector_queries(spark, folder)
    return [
        retrieval.vector_list(document_vectors(spark, folder), queries, 30),
        retrieval.bm25_list(build(spark, folder), queries, 30),
    ]


@query(
    f"""WITH {RRF_SQL} SELECT query_id, doc_id, round(rrf_score, 9) AS rrf_score, vector_rank, bm25_rank, rank
    FROM fused WHERE rank <= 20"""
)
def rrf_fusion(spark, folder):
    fused = fusion.reciprocal_rank(ranked_lists(spark, folder), 20, [0.5, 0.5], 60)
    return fused.select(
        "query_id", F.col("chunk_key").alias("doc_id"), F.round("rrf_score", 9).alias("rrf_score"),
        F.col("ranks")[0].alias("vector_rank"), F.col("ranks")[1].alias("bm25_rank"), "rank",
    )


def _score_sql(fold: str) -> str:
    return f"""WITH {LISTS_SQL},
    f AS (SELECT query_id, doc_id, {fold} AS fused_score, min(list_id * 4294967296 + rank) AS first_seen
          FROM normed GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(fused_score, 9) DESC, first_seen, doc_id) AS rank
          FROM f)
    SELECT query_id, doc_id, round(fused_score, 6) AS fused_score, rank FROM r WHERE rank <= 20"""


def _score_fusion(spark, folder, method):
    fused = fusion.fuse(method, ranked_lists(spark, folder), 20)
    return fused.select("query_id", F.col("chunk_key").alias("doc_id"), F.round("fused_score", 6).alias("fused_score"), "rank")


@query(_score_sql("sum(0.5 * s)"))
def score_fusion_avg(spark, folder):
    return _score_fusion(spark, folder, "average")


@query(_score_sql("greatest(0, max(0.5 * s))"))
def score_fusion_max(spark, folder):
    return _score_fusion(spark, folder, "max")


@query(
    _score_sql(
        """CASE WHEN coalesce(max(CASE WHEN list_id = 0 THEN 0.5 * s END), 0) = 0
                THEN coalesce(max(CASE WHEN list_id = 1 THEN 0.5 * s END), 0)
                ELSE least(max(CASE WHEN list_id = 0 THEN 0.5 * s END),
                           coalesce(max(CASE WHEN list_id = 1 THEN 0.5 * s END), max(CASE WHEN list_id = 0 THEN 0.5 * s END)))
           END"""
    )
)
def score_fusion_min(spark, folder):
    return _score_fusion(spark, folder, "min")


def _hybrid(spark, folder):
    return retrieval.hybrid_search(
        build(spark, folder), document_vectors(spark, folder), documents(spark, folder), vector_queries(spark, folder)
    )


@query(
    f"""WITH {RERANK_SQL} SELECT query_id, doc_id, rank, round(s, 6) AS score, round(rrf_score, 9) AS rrf_score,
    vector_rank, bm25_rank, source FROM final WHERE rank <= 5"""
)
def hybrid_search(spark, folder):
    return _hybrid(spark, folder).select(
        "query_id", F.col("chunk_key").alias("doc_id"), "rank", F.round("score", 6).alias("score"),
        F.round("rrf_score", 9).alias("rrf_score"), F.col("ranks")[0].alias("vector_rank"),
        F.col("ranks")[1].alias("bm25_rank"), "source",
    )


# The same search without a sparse index: the vector list alone, with weight 1.
VECTOR_ONLY_SQL = RERANK_SQL.replace("sum(0.5 / (60 + rank))", "sum(1.0 / (60 + rank))").replace(
    "WHERE rank <= 30 AND score > 0 AND query_id IN", "WHERE FALSE AND query_id IN"
)


@query(
    f"""WITH {VECTOR_ONLY_SQL} SELECT query_id, doc_id, rank, round(s, 6) AS score, round(rrf_score, 9) AS rrf_score, vector_rank, source,
    'vector_only' AS method FROM final WHERE rank <= 5"""
)
def vector_only_search(spark, folder):
    """Hybrid search where no sparse index is stored."""
    found = retrieval.hybrid_search(None, document_vectors(spark, folder), documents(spark, folder), vector_queries(spark, folder))
    return found.select(
        "query_id", F.col("chunk_key").alias("doc_id"), "rank", F.round("score", 6).alias("score"),
        F.round("rrf_score", 9).alias("rrf_score"), F.col("ranks")[0].alias("vector_rank"), "source", "method",
    )


@query(
    f"""WITH {RERANK_SQL},
    parts AS (SELECT query_id, rank, '[来源: ' || source || ' | 章节: ' || lang || ' | 向量排名: ' ||
      coalesce(vector_rank::VARCHAR, '-') || ', BM25排名: ' || coalesce(bm25_rank::VARCHAR, '-') || ']' || chr(10) ||
      text || chr(10) AS part FROM final WHERE rank <= 5),
    run AS (SELECT *, sum(length(part)) OVER (PARTITION BY query_id ORDER BY rank) AS used FROM parts)
    SELECT query_id, count(*) FILTER (used <= 4000) AS n_parts,
      coalesce(string_agg(part, chr(10) || '---' || chr(10) ORDER BY rank) FILTER (used <= 4000), '') AS context
    FROM run GROUP BY query_id"""
)
def packed_context(spark, folder):
    return retrieval.hybrid_context(_hybrid(spark, folder))


def _bm25_candidates(spark, folder, k):
    """Top BM25 documents with their texts; the pair scorer sees nothing else."""
    queries = text_queries(spark, folder)
    found = sparse.search(build(spark, folder), queries, k)
    few = retrieval.few_results(queries, k)
    texts = queries.select("query_id", F.col("text").alias("query_text"))
    rows = retrieval.attach_text(found, documents(spark, folder), few)
    return rows.join(F.broadcast(texts) if few else texts, "query_id")


RERANK_BM25_SQL = rf"""
{BM25_SQL},
cand AS (
  SELECT p.query_id, p.doc_id, p.rank AS bm25_rank,
         list_distinct(regexp_extract_all(lower(b.text), {TOKENS})) AS qa,
         list_distinct(regexp_extract_all(lower(d.text), {TOKENS})) AS da
  FROM bm25_all p JOIN documents d USING (doc_id) JOIN benchmark b ON b.item_id = p.query_id
  WHERE p.rank <= 20 AND p.score > 0),
s AS (SELECT *, CASE WHEN len(qa) * len(da) > 0 THEN len(list_intersect(qa, da)) / sqrt(len(qa)::DOUBLE * len(da)) ELSE 0 END AS s
  FROM cand),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, doc_id) AS rank FROM s)
"""


@query(f"WITH {RERANK_BM25_SQL} SELECT query_id, doc_id, round(s, 6) AS rerank_score, rank FROM r WHERE rank <= 5")
def rerank_topk(spark, folder):
    best = rerank.rerank(_bm25_candidates(spark, folder, 20), 5)
    return best.select(
        "query_id", F.col("chunk_key").alias("doc_id"), F.round("rerank_score", 6).alias("rerank_score"), "rank"
    )


@query(
    f"""WITH {BM25_SQL} SELECT query_id, doc_id, round(1.0 - 0.1 * (rank - 1), 6)::DOUBLE AS rerank_score, rank
    FROM bm25_all WHERE rank <= 5 AND score > 0"""
)
def rerank_fallback(spark, folder):
    found = sparse.search(build(spark, folder), text_queries(spark, folder), 20)
    best = rerank.rerank_without_model(found, 5)
    return best.select(
        "query_id", F.col("chunk_key").alias("doc_id"), F.round("rerank_score", 6).alias("rerank_score"), "rank"
    )


@query(
    f"""WITH {BM25_SQL},
    p AS (SELECT query_id, rank, '[来源 ' || rank || ': ' || source || ' | ' || lang || '] (相关度: ' ||
      printf('%.2f', greatest(0, least(1, score))) || ')' || chr(10) || text AS part
      FROM bm25_all JOIN docs USING (doc_id) WHERE rank <= 5 AND score > 0)
    SELECT query_id, count(*) AS n_results,
      string_agg(part, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS context FROM p GROUP BY query_id"""
)
def format_knowledge_context(spark, folder):
    return context.knowledge_context(_bm25_candidates(spark, folder, 5))


@query(
    r"""WITH p AS (SELECT regexp_extract(url, '^https?://([^/]+)', 1) AS query_id, page_id, url,
      regexp_extract(html, '<title>(.*?)</title>', 1) AS title,
      regexp_extract(html, '(?s)<p>(.*?)</p>', 1) AS snippet FROM pages),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY page_id) AS rank FROM p),
    f AS (SELECT query_id, rank, '[网页 ' || rank || ': ' || title || ']' ||
      CASE WHEN url <> '' THEN chr(10) || '链接: ' || url ELSE '' END || chr(10) || snippet AS part FROM r WHERE rank <= 5)
    SELECT query_id, count(*) AS n_results,
      string_agg(part, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS context FROM f GROUP BY query_id"""
)
def format_web_context(spark, folder):
    """The first five pages of each site as its search results."""
    return context.web_context(web_results(spark, folder))


def web_results(spark, folder, k: int = 5) -> DataFrame:
    pages = table(spark, folder, "pages").select(
        F.regexp_extract("url", r"^https?://([^/]+)", 1).alias("query_id"),
        F.col("page_id").alias("chunk_key"),
        F.regexp_extract("html", "<title>(.*?)</title>", 1).alias("title"),
        "url",
        F.regexp_extract("html", "(?s)<p>(.*?)</p>", 1).alias("snippet"),
    )
    return top_ranked(pages, k, "chunk_key", descending=False)


@query(
    rf"""WITH {BM25_SQL},
    pk AS (SELECT page_id, unnest(regexp_extract_all(html, {TOKENS})) AS term FROM pages),
    ptf AS (SELECT page_id, term, count(*) AS tf FROM pk GROUP BY ALL),
    pl AS (SELECT page_id, len(regexp_extract_all(html, {TOKENS})) AS len FROM pages),
    pc AS (SELECT count(*) AS n, avg(len) AS avglen FROM pl),
    pr AS (SELECT term, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM ptf, pc GROUP BY term, n),
    pt AS (SELECT term, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM pr) ELSE raw END AS idf FROM pr),
    pw AS (SELECT query_id, term, count(*) * any_value(idf) AS w FROM qt JOIN pt USING (term) GROUP BY ALL),
    ps AS (SELECT query_id, page_id, sum(w * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / avglen))) AS score
      FROM ptf JOIN pw USING (term) JOIN pl USING (page_id), pc GROUP BY ALL),
    pn AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, page_id) AS rank FROM ps),
    web AS (SELECT query_id, string_agg('[网页 ' || rank || ': ' || regexp_extract(html, '<title>(.*?)</title>', 1) || ']' || chr(10) ||
      '链接: ' || url || chr(10) || regexp_extract(html, '(?s)<p>(.*?)</p>', 1), chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS w
      FROM pn JOIN pages USING (page_id) WHERE rank <= 3 AND score > 0 GROUP BY query_id),
    kb AS (SELECT query_id, string_agg('[来源 ' || rank || ': ' || source || ' | ' || lang || '] (相关度: ' ||
      printf('%.2f', greatest(0, least(1, score))) || ')' || chr(10) || text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS k
      FROM bm25_all JOIN docs USING (doc_id) WHERE rank <= 3 AND score > 0 GROUP BY query_id)
    SELECT query_id, concat_ws(chr(10) || chr(10), '【知识库检索结果】' || chr(10) || k, '【网络检索结果】' || chr(10) || w) AS context
    FROM kb FULL JOIN web USING (query_id)"""
)
def combined_context(spark, folder):
    """Documents and pages found for every benchmark text, documents first."""
    queries = text_queries(spark, folder)
    pages = spread(table(spark, folder, "pages").select(F.col("page_id").alias("chunk_key"), "url", F.col("html").alias("text")))
    hits = sparse.search(sparse.build_index(pages), queries, 3)
    title = F.regexp_extract("text", "<title>(.*?)</title>", 1).alias("title")
    snippet = F.regexp_extract("text", "(?s)<p>(.*?)</p>", 1).alias("snippet")
    side = F.broadcast(hits) if retrieval.few_results(queries, 3) else hits
    web = pages.select("chunk_key", "url", title, snippet).join(side, "chunk_key")
    return context.combined_context(context.knowledge_context(_bm25_candidates(spark, folder, 3)), context.web_context(web))


@query(
    """SELECT doc_id, source || '::' || lang AS fusion_key FROM documents"""
)
def fusion_keys(spark, folder):
    docs = documents(spark, folder)
    key = fusion_key(F.col("source"), F.col("section"), F.col("text"))
    return docs.select(F.col("chunk_key").alias("doc_id"), key.alias("fusion_key"))


# A Han character for each letter of the tables' invented words, so that their texts can stand for unspaced writing.
LETTERS = "abcdefghijklmnopqrstuvwxyz"
HAN_LETTERS = "天地人山水火木金土日月星風雨雪花草石田河海江東西南北"

HAN_SEGMENTS_SQL = f"""WITH RECURSIVE freqs AS (
  SELECT translate(w, '{LETTERS}', '{HAN_LETTERS}') AS word, count(*) AS freq
  FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM documents) GROUP BY 1),
dict AS (SELECT word, round((ln((SELECT sum(freq) FROM freqs)) - ln(freq)) * 1000000)::BIGINT AS cost FROM freqs),
unknown AS (SELECT round(ln(sum(freq)) * 1000000)::BIGINT AS cost FROM freqs),
runs AS (SELECT DISTINCT unnest(regexp_extract_all(translate(regexp_replace(lower(text), '[ ]', '', 'g'), '{LETTERS}', '{HAN_LETTERS}'), '[{HAN_LETTERS}]+')) AS run
  FROM benchmark),
starts AS (SELECT run, unnest(range(1, length(run) + 1)) AS i FROM runs),
spans AS (SELECT run, i, n, substr(run, i, n) AS word FROM starts, (SELECT DISTINCT length(word) AS n FROM dict UNION SELECT 1) WHERE i + n - 1 <= length(run)),
edges AS (SELECT run, i, n, word, coalesce(dict.cost, unknown.cost) AS cost FROM spans LEFT JOIN dict USING (word), unknown WHERE dict.cost IS NOT NULL OR n = 1),
choices AS (SELECT run, i, list({{'n': n, 'word': word, 'cost': cost}}) AS c FROM edges GROUP BY ALL),
best AS (
  SELECT run, length(run) + 1 AS i, [{{'cost': 0::BIGINT, 'tokens': []::VARCHAR[]}}] AS held FROM runs
  UNION ALL
  SELECT run, choices.i, list_prepend(list_transform(list_sort(list_transform(c, lambda e: {{'cost': e.cost + held[e.n].cost, 'longer': -e.n, 'word': e.word, 'n': e.n}}))[:1],
    lambda e: {{'cost': e.cost, 'tokens': list_prepend(e.word, held[e.n].tokens)}})[1], held)[:64] AS held
  FROM best JOIN choices USING (run) WHERE choices.i = best.i - 1)
SELECT run, array_to_string(held[1].tokens, ' ') AS tokens, len(held[1].tokens) AS n_tokens FROM best WHERE i = 1"""


def han_text(text):
    return F.translate(F.lower(text), LETTERS, HAN_LETTERS)


def han_runs(spark, folder) -> DataFrame:
    """run: the unspaced sentences of all benchmark texts."""
    unspaced = F.regexp_replace(han_text(F.col("text")), "[ ]", "")
    return table(spark, folder, "benchmark").select(F.explode(F.regexp_extract_all(unspaced, F.lit(f"[{HAN_LETTERS}]+"), F.lit(0))).alias("run"))


def han_frequencies(spark, folder) -> DataFrame:
    """word, freq: the words of all documents."""
    found = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))
    # The plain generator would make the optimizer find the words once more, as a filter.
    words = spread(table(spark, folder, "documents").select("text")).select(F.explode_outer(found).alias("w")).filter("w is not null")
    counts = words.groupBy("w").agg(F.count("*").alias("freq"))
    return counts.select(han_text(F.col("w")).alias("word"), "freq")


@query(HAN_SEGMENTS_SQL)
def han_segments(spark, folder):
    """Unspaced benchmark sentences cut by the dictionary of the documents' words."""
    cut = segment.segmented_runs(han_runs(spark, folder), han_frequencies(spark, folder))
    return cut.select("run", F.array_join("tokens", " ").alias("tokens"), F.size("tokens").cast("long").alias("n_tokens"))


@query(HAN_SEGMENTS_SQL)
def han_segments_joined(spark, folder):
    """The same by the join that serves dictionaries of any size."""
    cut = segment.segmented_runs(han_runs(spark, folder), han_frequencies(spark, folder), max_words=0)
    return cut.select("run", F.array_join("tokens", " ").alias("tokens"), F.size("tokens").cast("long").alias("n_tokens"))
