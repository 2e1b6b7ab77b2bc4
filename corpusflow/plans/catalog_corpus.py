"""Registered corpus queries: cleaning, tokens, hashes, duplicates, chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.functions import hashing, text
from corpusflow.operators import chunking, dedup, fusion
from corpusflow.plans.catalog_retrieval import RRF_SQL, ranked_lists
from corpusflow.plans.registry import query
from corpusflow.session import cut_lineage, scratch_path, spread
from corpusflow.sources import files, stores
from corpusflow.sources.tables import table

WORDS_SQL = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')"
LINES_SQL = r"list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g'))"
CLEAN_SQL = f"array_to_string(list_filter({LINES_SQL}, lambda x: x <> ''), chr(10))"
MD5_SQL = "('0x' || substr(md5(t), 1, 16))::UBIGINT"


def _signed(column: str) -> str:
    return f"(CASE WHEN {column} >= 9223372036854775808 THEN {column} - 18446744073709551616 ELSE {column} END)::BIGINT"


def docs(spark, folder) -> DataFrame:
    return spread(table(spark, folder, "documents").select("doc_id", "source", "text"))


def cleaned(spark, folder) -> DataFrame:
    return docs(spark, folder).withColumn("text", text.clean_text(F.col("text")))


@query(f"SELECT doc_id, {CLEAN_SQL} AS text FROM documents")
def clean_text(spark, folder):
    return cleaned(spark, folder).select("doc_id", "text")


@query(f"SELECT doc_id, len({WORDS_SQL}) AS n_tokens, array_to_string({WORDS_SQL}, ' ') AS tokens FROM documents")
def tokenize_docs(spark, folder):
    tokens = text.words(F.col("text"))
    return docs(spark, folder).select("doc_id", F.size(tokens).alias("n_tokens"), F.array_join(tokens, " ").alias("tokens"))


@query("SELECT doc_id, substr(text, 1, 500) AS head, right(text, 300) AS tail FROM documents")
def truncated_texts(spark, folder):
    """Previews of the first 500 and the last 300 characters."""
    body = F.col("text")
    return docs(spark, folder).select("doc_id", text.head(body, 500).alias("head"), text.tail(body, 300).alias("tail"))


@query("SELECT doc_id, sha256(text) AS file_hash FROM documents")
def file_hash(spark, folder):
    return docs(spark, folder).select("doc_id", hashing.file_hash(F.col("text")).alias("file_hash"))


VECTOR_SIGNATURE_SQL = (
    "m AS (SELECT vec_id, embedding::DOUBLE[] AS v, list_sum(embedding::DOUBLE[]) / len(embedding) AS m FROM embeddings), "
    + "b AS (SELECT vec_id, "
    + " + ".join(f"CASE WHEN v[{i + 1}] > m THEN {2**i}::HUGEINT ELSE 0 END" for i in range(64))
    + f" AS u FROM m), vsig AS (SELECT vec_id, {_signed('u')} AS signature FROM b)"
)


@query(f"WITH {VECTOR_SIGNATURE_SQL} SELECT vec_id, signature FROM vsig")
def vec_simhash(spark, folder):
    held = table(spark, folder, "embeddings")
    return held.select("vec_id", hashing.vector_signature(F.col("embedding")).alias("signature"))


@query(
    f"""WITH k AS (SELECT doc_id, unnest({WORDS_SQL}) AS t FROM documents),
    x AS (SELECT doc_id, bit_xor({MD5_SQL}) AS h, count(*) AS n FROM k GROUP BY doc_id),
    u AS (SELECT doc_id, (h::HUGEINT + (n // 2) % 2) % 18446744073709551616 AS u FROM x)
    SELECT doc_id, coalesce({_signed('u')}, 0) AS signature FROM documents LEFT JOIN u USING (doc_id)"""
)
def token_simhash(spark, folder):
    return docs(spark, folder).select("doc_id", hashing.token_signature(F.col("text")).alias("signature"))


REGISTRY_SQL = "reg AS (SELECT DISTINCT sha256(text) AS file_hash FROM documents WHERE doc_id IN (SELECT doc_id FROM labels))"


@query(
    f"""WITH {REGISTRY_SQL} SELECT sha256(text) AS file_hash, min(doc_id) AS doc_id FROM documents
    WHERE sha256(text) NOT IN (SELECT file_hash FROM reg) GROUP BY 1"""
)
def file_dedup(spark, folder):
    """Labelled documents count as registered; all documents are submitted."""
    files = docs(spark, folder).select("doc_id", hashing.file_hash(F.col("text")).alias("file_hash"))
    labelled = table(spark, folder, "labels").select("doc_id")
    registry = files.join(labelled, "doc_id", "left_semi").select("file_hash").distinct()
    return dedup.new_files(files, registry, "doc_id").select("file_hash", "doc_id")


SIGNATURE_SQL = (
    f"k AS (SELECT doc_id, unnest({WORDS_SQL}) AS t FROM documents), h AS (SELECT doc_id, {MD5_SQL} AS h FROM k), c AS (SELECT doc_id, "
    + ", ".join(f"sum((h >> {i}) & 1)::BIGINT AS b{i}" for i in range(64))
    + " FROM h GROUP BY doc_id), s AS (SELECT *, "
    + " + ".join(f"b{i}" for i in range(64))
    + " AS total FROM c), u AS (SELECT doc_id, "
    + " + ".join(f"CASE WHEN b{i} * 64 > total THEN {2**i}::HUGEINT ELSE 0 END" for i in range(64))
    + f" AS u FROM s), sig AS (SELECT doc_id, coalesce({_signed('u')}, 0) AS signature FROM documents LEFT JOIN u USING (doc_id)), "
    + "rep AS (SELECT signature, min(doc_id) AS ord, row_number() OVER (ORDER BY min(doc_id)) AS i FROM sig GROUP BY signature)"
)


def signatures(spark, folder) -> DataFrame:
    """ord, signature of every document, written once: the steps below read it several times."""
    rows = dedup.projected_signature(docs(spark, folder), "doc_id")
    return cut_lineage(rows.select(F.col("doc_id").alias("ord"), "signature"), "signatures")


@query(f"WITH {SIGNATURE_SQL} SELECT doc_id, signature FROM sig")
def text_signature(spark, folder):
    return dedup.projected_signature(docs(spark, folder), "doc_id")


@query(
    f"""WITH {SIGNATURE_SQL} SELECT a.ord AS first, b.ord AS second, bit_count(xor(a.signature, b.signature))::INT AS distance
    FROM rep a JOIN rep b ON a.ord < b.ord WHERE bit_count(xor(a.signature, b.signature)) <= 3"""
)
def near_dup_pairs(spark, folder):
    """Pairs of distinct signatures; equal ones are merged into the first document."""
    rows = signatures(spark, folder)
    merged = rows.groupBy("signature").agg(F.min("ord").alias("ord"))
    return dedup.close_pairs(merged, hashing.max_hamming(0.95))


@query(
    f"""WITH RECURSIVE {SIGNATURE_SQL},
    step AS (SELECT 0::BIGINT AS i, []::BIGINT[] AS kept UNION ALL
      SELECT rep.i, CASE WHEN len(list_filter(kept, lambda x: bit_count(xor(x, signature)) <= 3)) > 0 THEN kept
        ELSE list_append(kept, signature) END FROM step JOIN rep ON rep.i = step.i + 1),
    kept AS (SELECT unnest(kept) AS signature FROM step WHERE i = (SELECT max(i) FROM rep)),
    kr AS (SELECT signature, ord FROM rep JOIN kept USING (signature)),
    keeper AS (SELECT r.signature, min(kr.ord) AS keeper FROM rep r JOIN kr ON kr.ord <= r.ord AND bit_count(xor(kr.signature, r.signature)) <= 3
      GROUP BY r.signature)
    SELECT doc_id, CASE WHEN keeper <> doc_id THEN keeper END AS duplicate_of FROM sig JOIN keeper USING (signature)"""
)
def chunk_dedup(spark, folder):
    """Every document as one chunk, in order of its number."""
    verdicts = dedup.near_duplicates(signatures(spark, folder), hashing.max_hamming(0.95))
    return verdicts.select(F.col("ord").alias("doc_id"), "duplicate_of")


@query(
    f"""WITH RECURSIVE {VECTOR_SIGNATURE_SQL},
    rep AS (SELECT signature, min(vec_id) AS ord, row_number() OVER (ORDER BY min(vec_id)) AS i FROM vsig GROUP BY signature),
    step AS (SELECT 0::BIGINT AS i, []::BIGINT[] AS kept UNION ALL
      SELECT rep.i, CASE WHEN len(list_filter(kept, lambda x: bit_count(xor(x, signature)) <= 19)) > 0 THEN kept
        ELSE list_append(kept, signature) END FROM step JOIN rep ON rep.i = step.i + 1),
    kept AS (SELECT unnest(kept) AS signature FROM step WHERE i = (SELECT max(i) FROM rep)),
    kr AS (SELECT signature, ord FROM rep JOIN kept USING (signature)),
    keeper AS (SELECT r.signature, min(kr.ord) AS keeper FROM rep r JOIN kr ON kr.ord <= r.ord AND bit_count(xor(kr.signature, r.signature)) <= 19
      GROUP BY r.signature)
    SELECT vec_id, CASE WHEN keeper <> vec_id THEN keeper END AS duplicate_of FROM vsig JOIN keeper USING (signature)"""
)
def vector_dedup(spark, folder):
    """Vectors as chunks at a low similarity (0.7, that is 19 of 64 bits)."""
    held = table(spark, folder, "embeddings")
    rows = held.select(F.col("vec_id").alias("ord"), hashing.vector_signature(F.col("embedding")).alias("signature"))
    verdicts = dedup.near_duplicates(cut_lineage(rows, "signatures"), hashing.max_hamming(0.7))
    return verdicts.select(F.col("ord").alias("vec_id"), "duplicate_of")


@query(
    f"""WITH RECURSIVE {RRF_SQL}, {SIGNATURE_SQL},
    cd AS (SELECT query_id, doc_id, rank, signature, rrf_score FROM fused JOIN sig USING (doc_id) WHERE rank <= 20),
    step AS (SELECT query_id, 0::BIGINT AS rank, []::BIGINT[] AS kept, NULL::BIGINT AS doc_id, 0::BIGINT AS place FROM vq UNION ALL
      SELECT cd.query_id, cd.rank,
        CASE WHEN len(list_filter(kept, lambda x: bit_count(xor(x, signature)) <= 3)) > 0 THEN kept ELSE list_append(kept, signature) END,
        CASE WHEN len(list_filter(kept, lambda x: bit_count(xor(x, signature)) <= 3)) > 0 THEN NULL ELSE cd.doc_id END, len(kept) + 1
      FROM step JOIN cd ON cd.query_id = step.query_id AND cd.rank = step.rank + 1)
    SELECT step.query_id, step.doc_id, place AS rank, round(rrf_score, 9) AS rrf_score
    FROM step JOIN cd USING (query_id, rank) WHERE step.doc_id IS NOT NULL AND place <= 10"""
)
def fusion_distinct(spark, folder):
    """The ten best fused documents out of twenty, without near copies of a better one."""
    texts = docs(spark, folder)

    def signed(keys: DataFrame) -> DataFrame:
        wanted = texts.join(keys.withColumnRenamed("chunk_key", "doc_id"), "doc_id", "left_semi")
        return dedup.projected_signature(wanted, "doc_id").withColumnRenamed("doc_id", "chunk_key")

    fused = fusion.fuse_distinct(ranked_lists(spark, folder), 10, signed)
    return fused.select("query_id", F.col("chunk_key").alias("doc_id"), "rank", F.round("rrf_score", 9).alias("rrf_score"))


EDGE_SQL = r"[\s\p{Z}\x1c-\x1f\x85]+"


def chunk_sql(source: str) -> str:
    """CTEs that end in chunks(id, chunk_idx, start_index, text) of ``source`` (id, t), t without empty lines.

    Lines from 512 characters on are cut at spaces, words from 512 on by
    characters. Neighbouring short pieces form a group; a window of a group ends
    before the first piece that does not fit, and the next one starts with the
    pieces of the last 64 characters that leave room for it. So each window
    follows from the place where the one before it starts.
    """
    return f"""
line1 AS (SELECT id, unnest(string_split(t, chr(10))) AS s, generate_subscripts(string_split(t, chr(10)), 1) AS k FROM {source} WHERE contains(t, chr(10))),
line2 AS (SELECT id, k, length(s) + (k > 1)::INT AS n FROM line1),
line3 AS (SELECT id, k, sum(n) OVER o - n AS a, sum(n) OVER o AS b FROM line2 WINDOW o AS (PARTITION BY id ORDER BY k)),
lines AS (SELECT id, a, b, b - a >= 512 AS long, sum((b - a >= 512)::INT) OVER (PARTITION BY id ORDER BY k) AS g FROM line3 WHERE a < b),
units AS (
  SELECT id, a AS base, substr(t, a::BIGINT + 1, (b - a)::BIGINT) AS s FROM lines JOIN {source} USING (id) WHERE long
  UNION ALL SELECT id, 0, t FROM {source} WHERE NOT contains(t, chr(10)) AND t <> ''),
w1 AS (SELECT id, base, unnest(string_split(s, ' ')) AS x, generate_subscripts(string_split(s, ' '), 1) AS k FROM units WHERE contains(s, ' ')),
w2 AS (SELECT id, base, k, length(x) + (k > 1)::INT AS n FROM w1),
w3 AS (SELECT id, base, k, base + sum(n) OVER o - n AS a, base + sum(n) OVER o AS b FROM w2 WINDOW o AS (PARTITION BY id, base ORDER BY k)),
words AS (SELECT id, base, a, b, b - a >= 512 AS long, sum((b - a >= 512)::INT) OVER (PARTITION BY id, base ORDER BY k) AS g FROM w3 WHERE a < b),
runs AS (
  SELECT id, a, b FROM words WHERE long UNION ALL SELECT id, base, base + length(s) FROM units WHERE NOT contains(s, ' ')),
pieces AS (
  SELECT id, 'l' || g AS gid, list(a::BIGINT ORDER BY a) AS la, list(b::BIGINT ORDER BY a) AS lb FROM lines WHERE NOT long GROUP BY id, g
  UNION ALL
  SELECT id, 'w' || base || '-' || g, list(a::BIGINT ORDER BY a), list(b::BIGINT ORDER BY a) FROM words WHERE NOT long GROUP BY id, base, g),
walk AS (
  SELECT id, gid, 1::BIGINT AS f FROM pieces
  UNION ALL
  SELECT id, gid, least(i, 1 + len(list_filter(la, lambda x: x < greatest(la[i] - 64, lb[i] - 512))))
  FROM (SELECT w.id, w.gid, p.la, p.lb, 1 + len(list_filter(p.lb, lambda x: x <= p.la[w.f] + 512)) AS i
        FROM walk w JOIN pieces p ON p.id = w.id AND p.gid = w.gid) WHERE i <= len(la)),
spans AS (
  SELECT id, la[f] AS a, coalesce(la[1 + len(list_filter(lb, lambda x: x <= la[f] + 512))], lb[len(lb)]) AS b FROM walk JOIN pieces USING (id, gid)
  UNION ALL
  SELECT id, (a + 448 * j)::BIGINT, least(a + 448 * j + 512, b)::BIGINT
  FROM (SELECT id, a, b, unnest(range(greatest(0, ceil((b - a - 512) / 448.0))::BIGINT + 1)) AS j FROM runs)),
bodies AS (SELECT id, a, substr(t, a + 1, b - a) AS body FROM spans JOIN {source} USING (id)),
led AS (SELECT id, a, body, regexp_replace(body, '^{EDGE_SQL}', '') AS rest FROM bodies),
chunks AS (
  SELECT id, (row_number() OVER (PARTITION BY id ORDER BY a) - 1)::INT AS chunk_idx, (a + length(body) - length(rest))::INT AS start_index,
    regexp_replace(rest, '{EDGE_SQL}$', '') AS text FROM led WHERE rest <> '')
"""


def bit_counts_sql(source: str, key: str, name: str) -> str:
    """CTEs up to {name}_c: per row the number of words and of words with each bit of their hash set."""
    sums = ", ".join(f"sum((h >> {i}) & 1)::BIGINT AS b{i}" for i in range(64))
    return f"""{name}_k AS (SELECT {key}, unnest({WORDS_SQL}) AS t FROM {source}), {name}_h AS (SELECT {key}, {MD5_SQL} AS h FROM {name}_k),
{name}_c AS (SELECT {key}, count(*) AS words, {sums} FROM {name}_h GROUP BY {key})"""


def chunk_signature_sql(source: str, key: str) -> str:
    """CTEs that end in rep (signature, ord, i): distinct signatures of the rows in order of their key."""
    total = " + ".join(f"b{i}" for i in range(64))
    bits = " + ".join(f"CASE WHEN b{i} * 64 > total THEN {2**i}::HUGEINT ELSE 0 END" for i in range(64))
    return f"""{bit_counts_sql(source, key, 's')},
s_t AS (SELECT *, {total} AS total FROM s_c), s_u AS (SELECT {key}, {bits} AS u FROM s_t),
sig AS (SELECT {source}.{key}, coalesce({_signed('u')}, 0) AS signature FROM {source} LEFT JOIN s_u USING ({key})),
rep AS (SELECT signature, min({key}) AS ord, row_number() OVER (ORDER BY min({key})) AS i FROM sig GROUP BY signature)"""


def vector_sql(source: str, name: str) -> str:
    """CTEs that end in {name}_vec (n, v): the vector of word hashes of every row of ``source`` (n, text)."""
    parts = ", ".join(f"coalesce(2.0::DOUBLE * b{i} / words - 1.0, 0)" for i in range(64))
    return f"""{bit_counts_sql(source, 'n', name)}, {name}_vec AS (SELECT n, [{parts}]::DOUBLE[] AS v FROM {source} LEFT JOIN {name}_c USING (n))"""


CHUNKS_SQL = f"src AS (SELECT doc_id AS id, source, {CLEAN_SQL} AS t FROM documents), {chunk_sql('src')}"


@query(
    f"""WITH RECURSIVE {CHUNKS_SQL} SELECT id AS doc_id, source, chunk_idx, source || '_' || chunk_idx AS chunk_id, start_index, text
    FROM chunks JOIN (SELECT id, source FROM src) USING (id)"""
)
def chunk_documents(spark, folder):
    return chunking.chunk_documents(cleaned(spark, folder))


def markdown_pages(spark, folder) -> DataFrame:
    """Pages as Markdown: title, advertisement and footer become headings, paragraphs become lines."""
    html = F.col("html")
    body = F.regexp_replace(html, r"(?s)<head>.*?</head>|<nav>.*?</nav>|<!--.*?-->", "")
    body = F.regexp_replace(body, r"<h1>", "\n# ")
    body = F.regexp_replace(body, r'<div class="ad">', "\n## ad\n")
    body = F.regexp_replace(body, r"<footer>", "\n### footer\n")
    body = F.regexp_replace(body, r"</h1>|<p>|<br>", "\n")
    body = F.regexp_replace(body, r"<[^>]*>", "")
    pages = table(spark, folder, "pages")
    name = F.concat(F.lit("page"), F.col("page_id").cast("string"), F.lit(".md"))
    return pages.select(F.col("page_id").alias("doc_id"), name.alias("source"), text.clean_text(body).alias("text"))


MARKDOWN_SQL = r"""
m0 AS (SELECT page_id AS doc_id, 'page' || page_id || '.md' AS source,
  regexp_replace(html, '(?s)<head>.*?</head>|<nav>.*?</nav>|<!--.*?-->', '', 'g') AS t FROM pages),
m1 AS (SELECT doc_id, source, regexp_replace(regexp_replace(replace(replace(replace(t, '<h1>', chr(10) || '# '),
  '<div class="ad">', chr(10) || '## ad' || chr(10)), '<footer>', chr(10) || '### footer' || chr(10)),
  '</h1>|<p>|<br>', chr(10), 'g'), '<[^>]*>', '', 'g') AS text FROM m0),
l0 AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM m1),
l1 AS (SELECT doc_id, source, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS pos,
  regexp_replace(raw, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') AS line FROM l0 WHERE regexp_replace(raw, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') <> ''),
l2 AS (SELECT *, CASE WHEN regexp_matches(line, '^#{1,3}( |$)') THEN length(regexp_extract(line, '^(#{1,3})', 1)) END AS lev FROM l1),
l3 AS (SELECT *, trim(substr(line, lev + 1)) AS title, count(*) FILTER (lev <= 1) OVER o AS c1, count(*) FILTER (lev <= 2) OVER o AS c2
  FROM l2 WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
l4 AS (SELECT *, max(title) FILTER (lev = 1) OVER (PARTITION BY doc_id, c1) AS header1,
  last_value(CASE WHEN lev = 2 THEN title END IGNORE NULLS) OVER (PARTITION BY doc_id, c1 ORDER BY pos) AS header2,
  last_value(CASE WHEN lev = 3 THEN title END IGNORE NULLS) OVER (PARTITION BY doc_id, c2 ORDER BY pos) AS header3 FROM l3),
l5 AS (SELECT *, coalesce(header1, '~') || '|' || coalesce(header2, '~') || '|' || coalesce(header3, '~') AS head FROM l4 WHERE lev IS NULL),
l6 AS (SELECT *, lag(head) OVER o AS prev, pos - lag(pos) OVER o AS gap FROM l5 WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
l7 AS (SELECT *, sum((prev IS NULL OR prev <> head)::INT) OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS section_idx FROM l6),
sections AS (SELECT doc_id, source, section_idx::BIGINT AS section_idx, header1, header2, header3,
  string_agg(CASE WHEN prev IS NULL OR prev <> head THEN '' WHEN gap > 1 THEN '  ' || chr(10) ELSE chr(10) END || line, '' ORDER BY pos) AS text
  FROM l7 GROUP BY ALL)
"""


@query(f"WITH {MARKDOWN_SQL} SELECT * FROM sections WHERE length(text) >= 20")
def md_sections(spark, folder):
    sections = chunking.markdown_sections(markdown_pages(spark, folder))
    return sections.filter(F.length("text") >= 20)


STRIP_SQL = f"regexp_replace(regexp_replace(text, '^{EDGE_SQL}', ''), '{EDGE_SQL}$', '')"


@query(
    f"""WITH RECURSIVE {MARKDOWN_SQL}, kept AS (SELECT * REPLACE ({STRIP_SQL} AS text) FROM sections),
    whole AS (SELECT *, doc_id || '-' || section_idx AS id FROM kept WHERE length(text) >= 20),
    src AS (SELECT id, text AS t FROM whole WHERE length(text) > 1024), {chunk_sql('src')}
    SELECT doc_id, source, section_idx, header1, header2, header3, NULL::INT AS sub_idx, source || '_' || section_idx AS chunk_id,
      NULL::VARCHAR AS section, text FROM whole WHERE length(text) <= 1024
    UNION ALL
    SELECT doc_id, source, section_idx, header1, header2, header3, chunk_idx, source || '_' || section_idx || '_' || chunk_idx,
      coalesce(nullif(header1, ''), header2, ''), chunks.text FROM chunks JOIN whole USING (id)"""
)
def md_chunks(spark, folder):
    return chunking.markdown_chunks(markdown_pages(spark, folder))


@query(
    f"""WITH RECURSIVE {CHUNKS_SQL}, firsts AS (SELECT sha256(t) AS file_hash, min(id) AS id FROM src GROUP BY 1)
    SELECT file_hash, count(*)::INT AS n_chunks, string_agg(source || '_' || chunk_idx, ',' ORDER BY chunk_idx) AS chunk_ids
    FROM chunks JOIN firsts USING (id) JOIN (SELECT id, source FROM src) USING (id) GROUP BY file_hash"""
)
def registry_table(spark, folder):
    """file_hash and chunk ids of the first document of every content."""
    files = cleaned(spark, folder).withColumn("file_hash", hashing.file_hash(F.col("text")))
    first = dedup.first_per_hash(files, "doc_id")
    kept = files.join(first.select("doc_id"), "doc_id", "left_semi")
    chunks = chunking.chunk_documents(kept, keep=["file_hash"])
    return stores.registry_rows(chunks).select("file_hash", F.size("chunk_ids").alias("n_chunks"), F.array_join("chunk_ids", ",").alias("chunk_ids"))


@query(
    """SELECT (SELECT count(*) FROM documents) AS n_chunks, (SELECT count(DISTINCT source) FROM documents) AS n_sources,
      (SELECT count(*) FROM documents WHERE trim(text) <> '') AS n_indexed, (SELECT count(*) FROM embeddings) AS n_vectors"""
)
def corpus_stats(spark, folder):
    held = table(spark, folder, "embeddings").withColumnRenamed("vec_id", "chunk_key")
    return stores.corpus_stats(docs(spark, folder), held)


@query("SELECT doc_id::VARCHAR AS doc_id, source, nullif(text, '') AS text FROM documents")
def csv_roundtrip(spark, folder):
    """The documents written as CSV and read again; texts hold line breaks, commas and quotes."""
    path = scratch_path(spark, "csv")
    files.write_csv(table(spark, folder, "documents").select("doc_id", "source", "text"), path)
    return files.read_csv(spark, path).select("doc_id", "source", "text")


@query(
    """WITH h AS (SELECT sha256(text) AS file_hash, min(doc_id) AS doc_id FROM documents GROUP BY 1)
    SELECT file_hash, doc_id::VARCHAR AS chunk_ids FROM h WHERE doc_id NOT IN (SELECT doc_id FROM labels) OR doc_id % 2 = 0"""
)
def registry_log(spark, folder):
    """Every content registered with its first document; labelled ones are removed, even ones registered again."""
    registry = stores.Registry(spark, scratch_path(spark, "registry"))
    files = docs(spark, folder).select("doc_id", hashing.file_hash(F.col("text")).alias("file_hash"))
    first = cut_lineage(dedup.first_per_hash(files, "doc_id"), "first")
    rows = first.select("doc_id", "file_hash", F.array(F.col("doc_id").cast("string")).alias("chunk_ids"))
    registry.register(rows)
    labelled = rows.join(table(spark, folder, "labels").select("doc_id").distinct(), "doc_id", "left_semi")
    registry.remove(labelled.select("file_hash"))
    registry.register(labelled.filter("doc_id % 2 = 0"))
    return registry.table().select("file_hash", F.array_join("chunk_ids", ",").alias("chunk_ids"))
