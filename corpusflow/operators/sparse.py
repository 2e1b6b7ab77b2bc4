"""BM25: term counts, term statistics and batched search.

An index keeps one row per document with its counted terms. Postings are the
same rows taken apart: one per (document, term) and one with a NULL term per
document, so a single pass gives document frequencies, the number of documents
and the total length. Terms are counted inside the row, which means that
building an index needs no shuffle of texts or postings.

Searches send the term weights of a batch of queries to the tasks. Each task
scores whole documents and lets only rows out that can be among the best k of
a query, so (query, document) pairs are never shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from corpusflow.functions.batches import steps_of, words_of
from corpusflow.functions.text import index_tokens, spaced_index_tokens, term_counts
from corpusflow.options import DEFAULTS, Options
from corpusflow.session import cut_lineage, is_small, stable

# Queries whose weights are sent to the tasks at once; more queries take more passes.
BATCH_QUERIES = 512
# Documents scored at once in a task.
BLOCK_DOCS = 512
# Documents whose tokens are counted at once in a task.
COUNT_DOCS = 256
# Products of a term in a document with a query that are held at once; denser blocks are multiplied as matrices.
MAX_PRODUCTS = 4_000_000


@dataclass(frozen=True)
class SparseIndex:
    documents: DataFrame  # chunk_key, len, runs (terms with their counts)
    terms: DataFrame  # term, df, idf
    n_docs: int
    avg_len: float
    tokenizer: Callable[[Column], Column] = index_tokens


def build_documents(
    chunks: DataFrame, key: str, text: str, tokenizer: Callable[[Column], Column] = index_tokens
) -> DataFrame:
    """chunk_key, len, runs (array of term and tf) for every chunk that is not blank."""
    # The usual tokens travel as one text a row, others as an array.
    tokenizer = spaced_index_tokens if tokenizer is index_tokens else tokenizer
    tokens = (
        chunks.filter(F.col(text).rlike(r"[^\s\p{Z}]"))
        .select(F.col(key).alias("chunk_key"), tokenizer(F.col(text)).alias("tokens"))
    )
    run = StructType([StructField("term", StringType()), StructField("tf", IntegerType())])
    shape = [tokens.schema["chunk_key"], StructField("len", IntegerType()), StructField("runs", ArrayType(run))]
    return tokens.mapInArrow(_counted, StructType(shape))


def _counted(batches):
    """Task function: chunk_key and tokens in, chunk_key, len and runs (in order of the term) out.

    The tokens of some rows are numbered in the order of their text, so that one
    sort of (row, number) counts them all.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    for batch in batches:
        listed = pa.types.is_list(batch.schema.types[1])
        ranges = ((at, COUNT_DOCS) for at in range(0, batch.num_rows, COUNT_DOCS)) if listed else steps_of(batch.column(1), COUNT_DOCS)
        for start, n in ranges:
            part = batch.slice(start, n)
            if listed:
                lengths = pc.fill_null(pc.list_value_length(part.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                tokens = part.column(1).flatten()
            else:
                tokens, lengths = words_of(part.column(1))
            held = tokens.dictionary_encode(null_encoding="encode")
            order = pc.array_sort_indices(held.dictionary, null_placement="at_start").to_numpy().astype(np.int64)
            number = np.empty(len(order), np.int64)
            number[order] = np.arange(len(order))
            codes = np.repeat(np.arange(len(lengths)), lengths) * len(order) + number[held.indices.to_numpy()]
            found, tf = np.unique(codes, return_counts=True)
            owner, term = np.divmod(found, max(len(order), 1))
            ends = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(lengths)))])
            runs = pa.StructArray.from_arrays([held.dictionary.take(pa.array(order[term])), pa.array(tf, pa.int32())], ["term", "tf"])
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(lengths, pa.int32()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), runs)],
                ["chunk_key", "len", "runs"],
            )


def as_postings(documents: DataFrame) -> DataFrame:
    """chunk_key, len, term, tf: the documents' counted terms as rows."""
    document_row = F.struct(F.lit(None).cast("string").alias("term"), F.lit(0).alias("tf"))
    # Never empty; the outer form keeps the optimizer from computing the array again as a filter.
    return documents.select("chunk_key", "len", F.inline_outer(F.concat("runs", F.array(document_row))))


def term_stats(postings: DataFrame) -> DataFrame:
    """term, df, total_len; the NULL term carries the corpus totals."""
    return postings.groupBy("term").agg(
        F.count("*").alias("df"), F.sum(F.when(F.col("term").isNull(), F.col("len"))).alias("total_len")
    )


def index_from_documents(
    documents: DataFrame,
    tokenizer: Callable[[Column], Column] = index_tokens,
    options: Options = DEFAULTS,
    stats: DataFrame | None = None,
) -> SparseIndex:
    """Index over rows of ``build_documents``; three numbers reach the driver, the rest stays a table."""
    stats = cut_lineage(term_stats(as_postings(documents)), "term-stats") if stats is None else stats
    n_docs, total_len = stats.filter(F.col("term").isNull()).select("df", "total_len").first() or (0, 0)
    terms = stats.filter(F.col("term").isNotNull()).select(
        "term",
        "df",
        (F.log(n_docs - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw"),
    )
    mean_idf = terms.agg(F.avg("raw")).first()[0] or 0.0
    # Terms found in more than half of the documents get a small share of the mean instead.
    idf = F.when(F.col("raw") < 0, F.lit(options.bm25_epsilon * mean_idf)).otherwise(F.col("raw"))
    return SparseIndex(
        documents=documents,
        terms=terms.select("term", "df", idf.alias("idf")),
        n_docs=n_docs,
        avg_len=(total_len / n_docs) if n_docs else 0.0,
        tokenizer=tokenizer,
    )


def build_index(
    chunks: DataFrame,
    key: str = "chunk_key",
    text: str = "text",
    tokenizer: Callable[[Column], Column] = index_tokens,
    options: Options = DEFAULTS,
) -> SparseIndex:
    """Tokenise once and write the counted terms; statistics and searches read those."""
    return index_from_documents(cut_lineage(build_documents(chunks, key, text, tokenizer), "counted"), tokenizer, options)


def append(index: SparseIndex, chunks: DataFrame, key: str, text: str, options: Options = DEFAULTS) -> SparseIndex:
    """Index over old and new chunks: counted terms are appended, statistics derived again."""
    added = cut_lineage(build_documents(chunks, key, text, index.tokenizer), "counted")
    return index_from_documents(index.documents.unionByName(added), index.tokenizer, options)


def query_weights(index: SparseIndex, queries: DataFrame) -> DataFrame:
    """query_id, term, weight = idf times the term's count in the query."""
    terms = queries.select(
        "query_id", F.inline_outer(term_counts(index.tokenizer(F.col("text"))))
    ).filter(F.col("term").isNotNull()).withColumnRenamed("tf", "qtf")
    side = F.broadcast(terms) if is_small(terms) else terms
    return index.terms.join(side, "term").select("query_id", "term", (F.col("idf") * F.col("qtf")).alias("weight"))


def _weight_batches(weights: DataFrame, size: int) -> Iterator[tuple[list, list[str], np.ndarray]]:
    """Query ids, terms and the matrix of weights (terms by queries) of ``size`` queries at a time."""

    def matrix(rows: list) -> tuple[list, list[str], np.ndarray]:
        queries, terms = list(dict.fromkeys(r.query_id for r in rows)), sorted({r.term for r in rows})
        at, column = {q: i for i, q in enumerate(queries)}, {t: i for i, t in enumerate(terms)}
        held = np.zeros((len(terms), len(queries)))
        for r in rows:
            held[column[r.term], at[r.query_id]] = r.weight
        return queries, terms, held

    rows, seen = [], set()
    for row in weights.orderBy("query_id").toLocalIterator():
        if row.query_id not in seen and len(seen) == size:
            yield matrix(rows)
            rows, seen = [], set()
        rows.append(row)
        seen.add(row.query_id)
    if rows:
        yield matrix(rows)


def _scores_of(queries: list, terms: list[str], weights: np.ndarray, k: int, avg_len: float, options: Options):
    """Task function: documents in, (query_id, chunk_key, score) of possible top-k rows out."""
    k1, b = options.bm25_k1, options.bm25_b
    # The queries of each term, one run after the other.
    of_term, asking = np.nonzero(weights)
    weight, many = weights[of_term, asking], np.bincount(of_term, minlength=len(terms))
    firsts = np.cumsum(many) - many

    def block_scores(n: int, owner: np.ndarray, place: np.ndarray, impact: np.ndarray) -> np.ndarray:
        """Scores (documents by queries): term by term where few products are not zero, by matrices elsewhere."""
        each = many[place]
        products = int(each.sum())
        if products > min(MAX_PRODUCTS, n * weights.size // 32):
            found = np.zeros((n, len(terms)))
            found[owner, place] = impact
            return found @ weights
        at = np.repeat(firsts[place] - (np.cumsum(each) - each), each) + np.arange(products)
        cells = np.repeat(owner * len(queries), each) + asking[at]
        sums = np.bincount(cells, np.repeat(impact, each) * weight[at], n * len(queries))
        return sums.astype(np.float64, copy=False).reshape(n, len(queries))  # sums of nothing are integers

    def score(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        names, known = pa.array(queries), pa.array(terms, pa.string())
        best = np.zeros((k, len(queries)))  # the task's best scores so far; zero is no hit
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK_DOCS):
                part = batch.slice(start, BLOCK_DOCS)
                runs = part.column(2)
                length = 1 - b + b * part.column(1).to_numpy(zero_copy_only=False) / avg_len
                flat = runs.flatten()
                place = pc.fill_null(pc.index_in(flat.field(0), known), -1).to_numpy(zero_copy_only=False)
                hit = np.flatnonzero(place >= 0)
                owner = np.repeat(np.arange(part.num_rows), runs.value_lengths().to_numpy(zero_copy_only=False))[hit]
                tf = flat.field(1).to_numpy(zero_copy_only=False)[hit]
                scores = block_scores(part.num_rows, owner, place[hit], tf * (k1 + 1) / (tf + k1 * length[owner]))
                # Equal scores stay in; the margin covers the rounding of the final order.
                good = (scores > 0) & (scores >= best.min(axis=0) - 1e-8)
                rising = np.flatnonzero(good.any(axis=0))
                best[:, rising] = -np.partition(-np.concatenate([best[:, rising], scores[:, rising]]), k - 1, axis=0)[:k]
                doc, query = np.nonzero(good & (scores >= best.min(axis=0) - 1e-8))
                yield pa.RecordBatch.from_arrays(
                    [names.take(pa.array(query)), part.column(0).take(pa.array(doc)), pa.array(scores[doc, query])],
                    ["query_id", "chunk_key", "score"],
                )

    return score


def scored_documents(index: SparseIndex, queries: DataFrame, k: int, options: Options = DEFAULTS) -> DataFrame:
    """query_id, chunk_key, score of every pair that can be among the best ``k`` of its query, scores above 0.

    One scan of the documents per BATCH_QUERIES queries, without a shuffle.
    """
    weights = cut_lineage(query_weights(index, queries), "weights")
    types = index.documents.schema["chunk_key"].dataType.simpleString(), queries.schema["query_id"].dataType.simpleString()
    shape = f"query_id {types[1]}, chunk_key {types[0]}, score double"
    rows = index.documents.select("chunk_key", "len", "runs")
    scans = [
        rows.mapInArrow(_scores_of(*batch, k, index.avg_len, options), shape)
        for batch in _weight_batches(weights, BATCH_QUERIES)
    ]
    return reduce(DataFrame.unionByName, scans) if scans else queries.sparkSession.createDataFrame([], shape)


def top_ranked(scored: DataFrame, k: int, score: str = "score", descending: bool = True) -> DataFrame:
    """Best k rows per query with their 1-based rank; ties go to the smaller key.

    The planner limits each partition to k rows per query before the shuffle.
    """
    order = stable(F.col(score))
    order = order.desc() if descending else order.asc()
    window = Window.partitionBy("query_id").orderBy(order, F.col("chunk_key"))
    return scored.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= k)


def search(
    index: SparseIndex,
    queries: DataFrame,
    k: int = 20,
    min_score: float | None = None,
    options: Options = DEFAULTS,
) -> DataFrame:
    """query_id, chunk_key, score, rank. Only positive scores stay, judged after the top-k."""
    ranked = top_ranked(scored_documents(index, queries, k, options), k).filter(F.col("score") > 0)
    return ranked if min_score is None else ranked.filter(F.col("score") >= min_score)
