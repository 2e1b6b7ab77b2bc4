"""Registered streaming queries: a stream over a whole table, run until everything is processed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.functions.hashing import file_hash
from corpusflow.plans.catalog_corpus import CHUNKS_SQL, chunk_signature_sql, vector_sql
from corpusflow.plans.catalog_dialog import ROUTE_SQL
from corpusflow.plans.catalog_retrieval import RERANK_SQL, VECTOR_SQL
from corpusflow.plans.ingest import Corpus
from corpusflow.plans.registry import query
from corpusflow.session import scratch_path
from corpusflow.sources.tables import table
from corpusflow.streaming import jobs, keyed


def stream_of(spark, folder: str, name: str) -> DataFrame:
    return jobs.table_stream(spark, folder, name)


def collected(spark, stream: DataFrame, label: str, mode: str = "append", key: str | None = None) -> DataFrame:
    """Run the stream to its end into a folder and read that.

    In update mode a key comes again whenever a batch changes it; its last row counts.
    """
    path = scratch_path(spark, label)
    jobs.run_available(stream, f"{path}/checkpoint", jobs.write_batch(f"{path}/rows"), mode)
    rows = spark.read.parquet(f"{path}/rows")
    if key is not None:
        names = [c for c in rows.columns if c not in (key, "batch")]
        rows = rows.groupBy(key).agg(F.max_by(F.struct(*names), "batch").alias("last")).select(key, "last.*")
        return rows
    return rows.drop("batch")


@query(
    f"""WITH x AS (SELECT *, trim(lower(text)) AS t FROM conversations WHERE role = 'user')
    SELECT conv_id, turn, {ROUTE_SQL} AS route FROM x"""
)
def stream_route(spark, folder):
    messages = stream_of(spark, folder, "conversations").filter(F.col("role") == "user")
    return collected(spark, jobs.routed(messages).select("conv_id", "turn", "route"), "stream-route")


TRIGGERS_SQL = """WITH r AS (SELECT conv_id, turn, role, sum((role = 'user')::INT) OVER w AS user_turns, count(*) OVER w AS n_messages
      FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
    SELECT conv_id, turn, user_turns::BIGINT AS user_turns, n_messages FROM r WHERE role = 'user' AND user_turns % 2 = 0 AND n_messages >= 4"""


@query(TRIGGERS_SQL)
def stream_triggers(spark, folder):
    root = scratch_path(spark, "stream-triggers")
    counter = jobs.TriggerCounter(spark, root, every=2, min_messages=4)
    jobs.run_available(stream_of(spark, folder, "conversations"), f"{root}/checkpoint", counter.handle)
    return counter.triggers()


@query(TRIGGERS_SQL)
def stream_triggers_keyed(spark, folder):
    """The same triggers from keyed state."""
    with keyed.keyed_state(spark):
        return collected(spark, keyed.keyed_triggers(stream_of(spark, folder, "conversations"), 2, 4), "stream-keyed")


@query(
    """SELECT date_trunc('minute', ts) AS window_start, count(*) AS n, round(count(*) / 60, 6) AS qps, round(avg(value), 6) AS avg_duration,
      quantile_disc(value, 0.95) AS p95_duration, round(count(*) FILTER (event_type = 'error') / count(*) * 100, 6) AS error_rate
    FROM events GROUP BY 1"""
)
def stream_metrics(spark, folder):
    log = stream_of(spark, folder, "events").select(
        F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("duration"), (F.col("event_type") == "error").alias("is_error")
    )
    rows = collected(spark, jobs.service_metrics(log), "stream-metrics", "update", "window_start")
    rows = rows.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))
    return rows.withColumns({c: F.round(c, 6) for c in ("qps", "avg_duration", "error_rate")})


@query("SELECT DISTINCT sha256(text) AS file_hash FROM documents")
def stream_first_submissions(spark, folder):
    """Documents submitted one second apart, in order of their number."""
    files = stream_of(spark, folder, "documents").select(
        F.timestamp_seconds(F.col("doc_id") + 1_600_000_000).alias("ts"), file_hash(F.col("text")).alias("file_hash")
    )
    root = scratch_path(spark, "stream-first")
    registry = jobs.SubmissionRegistry(spark, root)
    jobs.run_available(files, f"{root}/checkpoint", registry.handle)
    return registry.seen().select("file_hash")


# Chunks that stay after the first file of each content and the first-seen rule over all chunks in order.
KEPT_CHUNKS_SQL = f"""{CHUNKS_SQL},
firsts AS (SELECT min(id) AS id FROM src GROUP BY sha256(t)),
held AS (SELECT chunks.*, source, row_number() OVER (ORDER BY id, chunk_idx) AS n FROM chunks JOIN firsts USING (id) JOIN (SELECT id, source FROM src) USING (id)),
{chunk_signature_sql('held', 'n')},
step AS (SELECT 0::BIGINT AS i, []::BIGINT[] AS kept UNION ALL
  SELECT rep.i, CASE WHEN len(list_filter(kept, lambda x: bit_count(xor(x, signature)) <= 3)) > 0 THEN kept
    ELSE list_append(kept, signature) END FROM step JOIN rep ON rep.i = step.i + 1),
stay AS (SELECT ord AS n FROM rep WHERE signature IN (SELECT unnest(kept) FROM step WHERE i = (SELECT max(i) FROM rep))),
corpus_rows AS (SELECT id * 100000 + chunk_idx AS doc_id, id, chunk_idx, source, NULL::VARCHAR AS lang, start_index, text FROM held JOIN stay USING (n))
"""


def _ingested(spark, folder, label: str) -> Corpus:
    """A corpus after all documents went through the ingest stream; keys that SQL can write as well."""
    root = scratch_path(spark, label)
    corpus = Corpus(spark, root, number=lambda doc, chunk: doc * 100_000 + chunk)
    docs = stream_of(spark, folder, "documents").select("doc_id", "source", "text")
    jobs.ingest_stream(docs, corpus, f"{root}/checkpoint")
    return corpus


@query(
    f"""WITH RECURSIVE {KEPT_CHUNKS_SQL} SELECT id AS doc_id, source, chunk_idx, source || '_' || chunk_idx AS chunk_id, start_index, text
    FROM corpus_rows"""
)
def stream_ingest(spark, folder):
    """The stored chunks after all documents went through the ingest stream."""
    corpus = _ingested(spark, folder, "stream-ingest")
    return corpus.read("chunks").select("doc_id", "source", "chunk_idx", "chunk_id", "start_index", "text")


# Vectors of chunks and benchmark texts from word hashes, then the two lists as in every hybrid search.
STORED_SQL = RERANK_SQL.replace(
    VECTOR_SQL.strip(),
    f"""bv AS (SELECT item_id AS n, text FROM benchmark), {vector_sql('bv', 'q')}, {vector_sql('held', 'c')},
    vq AS (SELECT n AS query_id, v AS q FROM q_vec),
    vd AS (SELECT query_id, doc_id AS vec_id, round(list_sum(list_transform(list_zip(q, v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 9) AS distance
      FROM vq, c_vec JOIN stay USING (n) JOIN held USING (n) JOIN corpus_rows r ON r.id = held.id AND r.chunk_idx = held.chunk_idx),
    vec_all AS (SELECT query_id, vec_id AS doc_id, distance, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM vd)""",
).replace("documents", "corpus_rows")


@query(
    f"""WITH RECURSIVE {KEPT_CHUNKS_SQL}, {STORED_SQL} SELECT query_id, doc_id // 100000 AS doc_id, (doc_id % 100000)::INT AS chunk_idx, rank,
      round(s, 6) AS score, round(rrf_score, 9) AS rrf_score, vector_rank, bm25_rank, source FROM final WHERE rank <= 5"""
)
def stored_hybrid_search(spark, folder):
    """Benchmark texts against the corpus that the stream stored: its vectors, postings and chunks."""
    found = _ingested(spark, folder, "stored-search").search(table(spark, folder, "benchmark").select(F.col("item_id").alias("query_id"), "text"))
    return found.select(
        "query_id", F.floor(F.col("chunk_key") / 100_000).alias("doc_id"), (F.col("chunk_key") % 100_000).cast("int").alias("chunk_idx"), "rank",
        F.round("score", 6).alias("score"), F.round("rrf_score", 9).alias("rrf_score"),
        F.col("ranks")[0].alias("vector_rank"), F.col("ranks")[1].alias("bm25_rank"), "source",
    )
