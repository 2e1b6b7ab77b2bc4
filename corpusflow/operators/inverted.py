"""BM25 over a term-bucketed inverted index with block maxima.

Postings are stored by term, in directories by a hash of the term. The documents
are dealt into shards of bounded size; the postings of a term in one shard are a
block, and a block carries the largest contribution that it can make. A search
reads the directories of its terms only. Block maxima bound what a shard can
give a query; the best shard of each query is scored first, and every shard
whose bound does not reach the k-th score found there is skipped.

Queries and postings meet in joins; neither passes through the driver.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.functions.text import index_tokens, term_counts
from corpusflow.operators.sparse import top_ranked
from corpusflow.options import DEFAULTS, Options
from corpusflow.session import broadcast_if_small, cut_lineage

# Documents of a shard, and queries scored together in a task.
SHARD_DOCS = 4096
BATCH_QUERIES = 512
# Directories by term hash.
BUCKETS = 16
# Tokens of a shard's documents, which bounds a shard of long documents.
SHARD_TERMS = 4_000_000
# Documents whose postings are in one file of a directory, and whose frequencies are.
FILE_DOCS = 65_536
TERM_FILE_DOCS = 1_000_000


@dataclass(frozen=True)
class TermIndex:
    postings: DataFrame  # bucket, term, shard, top, avg_len, keys, tfs, lens
    terms: DataFrame  # bucket, term, df: one row per term and stored batch
    n_docs: int
    total_len: int
    mean_idf: float
    buckets: int
    tokenizer: Callable[[Column], Column] = index_tokens

    @property
    def avg_len(self) -> float:
        return self.total_len / self.n_docs if self.n_docs else 0.0


def bucket_of(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def contribution(tf: Column, length: Column, avg_len: Column | float, options: Options = DEFAULTS) -> Column:
    """What one unit of a term's weight adds to a document's score."""
    k1, b = options.bm25_k1, options.bm25_b
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / avg_len))


def shard_count(n_docs: int, total_len: int, shard_docs: int = SHARD_DOCS) -> int:
    """Shards of a batch: each of about ``shard_docs`` documents, fewer where these are long."""
    return max(1, -(-n_docs // shard_docs), -(-total_len // SHARD_TERMS))


def posting_blocks(
    documents: DataFrame, shards: int, avg_len: float, first_shard: int = 0, buckets: int = BUCKETS, options: Options = DEFAULTS
) -> DataFrame:
    """Rows of ``sparse.build_documents`` as blocks: the postings of one term in one shard.

    A block holds at most the documents of its shard. ``top`` is its largest
    contribution at ``avg_len``, which is stored with it. Whole documents are
    dealt over the shards; their postings are taken apart in the shard's task.
    """
    shard = F.pmod(F.xxhash64("chunk_key"), F.lit(shards)) + first_shard

    def blocks(table):
        import pyarrow as pa

        table = table.combine_chunks()
        runs = table["runs"].chunk(0)
        owner = np.repeat(np.arange(table.num_rows), runs.value_lengths().to_numpy(zero_copy_only=False))
        held = runs.flatten()
        tokens = held.field("term").dictionary_encode()
        codes = tokens.indices.fill_null(-1).to_numpy(zero_copy_only=False)
        order = np.argsort(codes, kind="stable")
        order = order[np.searchsorted(codes[order], 0) :]
        codes, owner = codes[order], owner[order]
        tf = held.field("tf").to_numpy(zero_copy_only=False)[order].astype(np.int32)
        length = table["len"].to_numpy()[owner].astype(np.int32)
        starts = np.flatnonzero(np.diff(codes, prepend=-1))
        ends = pa.array(np.append(starts, len(codes)), pa.int32())
        top = np.maximum.reduceat(contribution(tf, length, avg_len, options), starts) if len(starts) else np.zeros(0)
        lists = table["chunk_key"].chunk(0).take(pa.array(owner)), pa.array(tf), pa.array(length)
        return pa.table({
            "term": tokens.dictionary.take(pa.array(codes[starts])), "shard": pa.array(np.full(len(starts), table["shard"][0].as_py()), pa.int64()),
            "top": pa.array(top), **{name: pa.ListArray.from_arrays(ends, x) for name, x in zip(("keys", "tfs", "lens"), lists)},
        })

    key = documents.schema["chunk_key"].dataType.simpleString()
    held = documents.select("chunk_key", "len", "runs", shard.cast("long").alias("shard")).groupBy("shard").applyInArrow(
        blocks, f"term string, shard long, top double, keys array<{key}>, tfs array<int>, lens array<int>"
    )
    return held.select(
        bucket_of(F.col("term"), buckets).alias("bucket"), "term", "shard", "top", F.lit(avg_len).alias("avg_len"), "keys", "tfs", "lens"
    )


def document_frequencies(blocks: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """bucket, term, df of a batch, from its blocks."""
    merged = blocks.groupBy("term").agg(F.sum(F.size("tfs")).alias("df"))
    return merged.select(bucket_of(F.col("term"), buckets).alias("bucket"), "term", "df")


def file_layout(rows: DataFrame, n_docs: int, salt: str, file_docs: int = FILE_DOCS) -> DataFrame:
    """Rows dealt and sorted for a write by bucket: about one file per bucket and ``file_docs`` documents."""
    files = max(1, -(-n_docs // file_docs))
    return rows.repartition("bucket", F.pmod(F.xxhash64(salt), F.lit(files))).sortWithinPartitions("bucket", "term")


def raw_idf(df: Column, n_docs: int) -> Column:
    return F.log(n_docs - df + 0.5) - F.log(df + 0.5)


def mean_idf(terms: DataFrame, n_docs: int) -> float:
    """Mean over all terms, from the stored frequencies; no document is read."""
    merged = terms.groupBy("term").agg(F.sum("df").alias("df"))
    return merged.agg(F.avg(raw_idf(F.col("df"), n_docs))).first()[0] or 0.0


def query_weights(index: TermIndex, queries: DataFrame, options: Options = DEFAULTS) -> tuple[DataFrame, list[int]]:
    """bucket, query_id, term, weight of all queries, and the buckets that their terms are in."""
    asked = queries.select("query_id", F.inline_outer(term_counts(index.tokenizer(F.col("text"))))).filter(F.col("term").isNotNull())
    asked = cut_lineage(asked.select(bucket_of(F.col("term"), index.buckets).alias("bucket"), "query_id", "term", F.col("tf").alias("qtf")), "asked")
    wanted = [r.bucket for r in asked.select("bucket").distinct().collect()]  # at most ``buckets`` numbers
    names = asked.select("term").distinct()
    found = index.terms.filter(F.col("bucket").isin(wanted)).join(broadcast_if_small(names), "term", "left_semi")
    df = found.groupBy("term").agg(F.sum("df").alias("df")).withColumn("raw", raw_idf(F.col("df"), index.n_docs))
    idf = F.when(F.col("raw") < 0, F.lit(options.bm25_epsilon * index.mean_idf)).otherwise(F.col("raw"))
    weights = asked.join(df.select("term", idf.alias("idf")), "term")
    return cut_lineage(weights.select("bucket", "query_id", "term", (F.col("idf") * F.col("qtf")).alias("weight")), "weights"), wanted


def shard_bounds(index: TermIndex, blocks: DataFrame, weights: DataFrame) -> DataFrame:
    """query_id, shard, bound: no document of the shard scores higher for the query.

    Only the head of each block is read. A block written at another mean length
    is scaled by the growth of the mean, which no contribution can outgrow.
    """
    top = F.col("top") * F.greatest(F.lit(1.0), F.lit(index.avg_len) / F.col("avg_len"))
    heads = blocks.select("term", "shard", top.alias("top")).join(broadcast_if_small(weights.select("query_id", "term", "weight")), "term")
    part = F.greatest(F.col("weight") * F.col("top"), F.lit(0.0))
    return heads.groupBy("query_id", "shard").agg((F.sum(part) * (1 + 1e-12) + 1e-8).alias("bound"))


def _score_shards(index: TermIndex, blocks: DataFrame, weights: DataFrame, pairs: DataFrame, k: int, options: Options) -> DataFrame:
    """query_id, chunk_key, score: the k best positive scores of each (query, shard) of ``pairs``, and equal ones."""
    k1, b, avg_len = options.bm25_k1, options.bm25_b, index.avg_len
    types = index.postings.schema["keys"].dataType.elementType.simpleString(), weights.schema["query_id"].dataType.simpleString()

    def score(frame):
        import pandas as pd

        keys, docs = np.unique(np.concatenate([np.asarray(x) for x in frame["keys"]]), return_inverse=True)
        queries = sorted({q for asked in frame["open"] for q in asked})
        place = {q: i for i, q in enumerate(queries)}
        total, start = np.zeros((len(queries), len(keys))), 0
        # Terms in one order, so that equal documents of any shard get equal sums.
        ends = np.cumsum(frame["keys"].map(len).to_numpy())
        for i in np.argsort(frame["term"].to_numpy(), kind="stable"):
            row = frame.iloc[i]
            at = docs[ends[i] - len(row["keys"]) : ends[i]]
            tf, lens = np.asarray(row["tfs"], np.float64), np.asarray(row["lens"], np.float64)
            impact = tf * (k1 + 1) / (tf + k1 * (1 - b + b * lens / avg_len))
            wanted = set(row["open"])
            for q, w in zip(row["queries"], row["weights"]):
                if q in wanted:
                    total[place[q], at] += w * impact
        out = []
        for i, q in enumerate(queries):
            s = total[i]
            floor = np.partition(s, len(s) - k)[len(s) - k] if len(s) > k else -np.inf
            # The margin covers the rounding of the final order.
            hit = np.flatnonzero((s > 0) & (s >= floor - 1e-8))
            out.append(pd.DataFrame({"query_id": [q] * len(hit), "chunk_key": keys[hit], "score": s[hit]}))
        return pd.concat(out)

    n = weights.select("query_id").distinct().count()
    deal = F.pmod(F.xxhash64("query_id"), F.lit(max(1, -(-n // BATCH_QUERIES)))).alias("deal")
    asked = weights.select("term", deal, "query_id", "weight").groupBy("term", "deal").agg(F.collect_list(F.struct("query_id", "weight")).alias("a"))
    asked = cut_lineage(asked.select("term", "deal", F.col("a.query_id").alias("queries"), F.col("a.weight").alias("weights")), "asked")
    open_ = pairs.select("shard", deal, "query_id").groupBy("shard", "deal").agg(F.collect_list("query_id").alias("open"))
    open_ = cut_lineage(open_, "open")
    rows = blocks.select("term", "shard", "keys", "tfs", "lens").join(broadcast_if_small(asked), "term")
    rows = rows.join(broadcast_if_small(open_), ["shard", "deal"]).filter(F.arrays_overlap("queries", "open"))
    return rows.groupBy("shard", "deal").applyInPandas(score, f"query_id {types[1]}, chunk_key {types[0]}, score double")


def search(
    index: TermIndex, queries: DataFrame, k: int = 20, min_score: float | None = None, options: Options = DEFAULTS
) -> DataFrame:
    """query_id, chunk_key, score, rank: as ``sparse.search``, from the blocks of the queries' terms.

    1. Directories of other terms are not listed in the scan.
    2. Block heads bound every (query, shard).
    3. The shard with the highest bound of each query is scored; its k-th score
       is the query's cutoff.
    4. Other shards are scored where the bound reaches the cutoff, and skipped
       elsewhere.
    """
    weights, wanted = query_weights(index, queries, options)
    blocks = index.postings.filter(F.col("bucket").isin(wanted))
    bounds = cut_lineage(shard_bounds(index, blocks, weights), "bounds")
    best = bounds.groupBy("query_id").agg(F.max_by("shard", F.struct("bound", "shard")).alias("shard"))
    seeds = cut_lineage(best, "seeds")
    first = cut_lineage(_score_shards(index, blocks, weights, seeds, k, options), "first")
    kth = top_ranked(first, k).filter(F.col("rank") == k).select("query_id", F.col("score").alias("cutoff"))
    left = bounds.join(broadcast_if_small(seeds), ["query_id", "shard"], "left_anti").join(kth, "query_id", "left")
    left = cut_lineage(left.filter(F.col("cutoff").isNull() | (F.col("bound") >= F.col("cutoff") - 1e-8)).select("query_id", "shard"), "left")
    rest = cut_lineage(_score_shards(index, blocks, weights, left, k, options), "rest")
    ranked = top_ranked(first.unionByName(rest), k).filter(F.col("score") > 0)
    return ranked if min_score is None else ranked.filter(F.col("score") >= min_score)
