"""Stored corpus: registry, index tables, chunks and vectors as Parquet under one root.

Every table is written in full to a new version folder or appended as files;
nothing is kept on the driver. ``collection`` names an index and is its folder.
"""

from __future__ import annotations

import os
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.operators import inverted, sparse
from corpusflow.options import DEFAULTS, Options
from corpusflow.session import cut_lineage

REGISTRY_SCHEMA = "file_hash string, chunk_ids array<string>, registered_at timestamp, removed boolean"


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table under ``path``, or an empty one before its first write."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def registry_rows(chunks: DataFrame) -> DataFrame:
    """file_hash, chunk_ids (in chunk order) from chunk rows of one document per hash."""
    ids = F.transform(F.array_sort(F.collect_list(F.struct("chunk_idx", "chunk_id"))), lambda x: x["chunk_id"])
    return chunks.groupBy("file_hash").agg(ids.alias("chunk_ids"))


class Registry:
    """Append-only registry of ingested files; the last entry of a hash wins."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.path = spark, os.path.join(root, "registry")

    def _log(self) -> DataFrame:
        return read_or_empty(self.spark, self.path, REGISTRY_SCHEMA)

    def register(self, rows: DataFrame) -> None:
        """Add file_hash, chunk_ids rows."""
        entry = rows.select("file_hash", "chunk_ids", F.current_timestamp().alias("registered_at"), F.lit(False).alias("removed"))
        entry.write.mode("append").parquet(self.path)

    def remove(self, hashes: DataFrame) -> None:
        empty = F.array().cast("array<string>")
        entry = hashes.select("file_hash", empty.alias("chunk_ids"), F.current_timestamp().alias("registered_at"), F.lit(True).alias("removed"))
        entry.write.mode("append").parquet(self.path)

    def table(self) -> DataFrame:
        """file_hash, chunk_ids as they stand."""
        last = self._log().groupBy("file_hash").agg(
            F.max_by(F.struct("chunk_ids", "removed"), F.struct("registered_at", "removed")).alias("last")
        )
        return last.filter(~F.col("last.removed")).select("file_hash", "last.chunk_ids")

    def chunk_ids(self, file_hash: str) -> DataFrame:
        return self.table().filter(F.col("file_hash") == file_hash).select("chunk_ids")

    def clear(self) -> None:
        self.spark.createDataFrame([], REGISTRY_SCHEMA).write.mode("overwrite").parquet(self.path)


class IndexStore:
    """Named sparse indexes: counted documents and term statistics per collection.

    A collection is saved to a new version folder and then entered in the log,
    so a failed write leaves the version before it. Folders carry the name in
    hexadecimal, so any name may be used.
    """

    LOG = "name string, version string, saved_at timestamp"

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, os.path.join(root, "index")

    def _enter(self, name: str, version: str | None) -> None:
        row = self.spark.createDataFrame([(name, version)], "name string, version string")
        row.withColumn("saved_at", F.current_timestamp()).write.mode("append").parquet(os.path.join(self.root, "log"))

    def _versions(self) -> DataFrame:
        log = read_or_empty(self.spark, os.path.join(self.root, "log"), self.LOG)
        last = log.groupBy("name").agg(F.max_by(F.struct("version"), "saved_at").alias("last"))
        return last.select("name", "last.version").filter("version is not null")

    def _version(self, collection: str) -> str | None:
        row = self._versions().filter(F.col("name") == collection).first()
        return row.version if row else None

    def _path(self, collection: str, version: str, table: str) -> str:
        return os.path.join(self.root, collection.encode().hex(), version, table)

    def _empty(self, collection: str, version: str) -> None:
        """Replace a version's files by empty tables."""
        for table in ("documents", "terms"):
            path = self._path(collection, version, table)
            self.spark.createDataFrame([], self.spark.read.parquet(path).schema).write.mode("overwrite").parquet(path)

    def save(self, collection: str, documents: DataFrame) -> None:
        """Replace the collection by rows of ``sparse.build_documents``."""
        old, version = self._version(collection), uuid.uuid4().hex
        path = self._path(collection, version, "documents")
        documents.write.parquet(path)
        stored = self.spark.read.parquet(path)
        sparse.term_stats(sparse.as_postings(stored)).write.parquet(self._path(collection, version, "terms"))
        self._enter(collection, version)
        if old:
            self._empty(collection, old)

    def load(self, collection: str, options: Options = DEFAULTS) -> sparse.SparseIndex:
        version = self._version(collection)
        if version is None:
            raise KeyError(f"no collection {collection!r}")
        stored, stats = (self.spark.read.parquet(self._path(collection, version, t)) for t in ("documents", "terms"))
        return sparse.index_from_documents(stored, options=options, stats=stats)

    def remove(self, collection: str) -> None:
        version = self._version(collection)
        if version is not None:
            self._enter(collection, None)
            self._empty(collection, version)

    def collections(self) -> list[str]:
        return sorted(r.name for r in self._versions().select("name").collect())

    def clear(self) -> None:
        for name in self.collections():
            self.remove(name)


class TermIndexStore:
    """Named inverted indexes that grow by batches.

    A collection is a version folder with batches of postings and document
    frequencies, each divided by term bucket. A batch counts once it is in the
    log, which also holds its number of documents and their length; saving
    starts a new version, removing enters none. Statistics are sums over the
    batches, so an append reads no stored document.
    """

    LOG = "name string, version string, batch long, n_docs long, total_len long, shards long, buckets int, mean_idf double, key string, saved_at timestamp"

    def __init__(self, spark: SparkSession, root: str, shard_docs: int = inverted.SHARD_DOCS):
        self.spark, self.root, self.shard_docs = spark, os.path.join(root, "term-index"), shard_docs

    def _log(self) -> DataFrame:
        return read_or_empty(self.spark, os.path.join(self.root, "log"), self.LOG)

    def _enter(self, *values) -> None:
        row = self.spark.createDataFrame([values], self.LOG.replace(", saved_at timestamp", ""))
        row.withColumn("saved_at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(os.path.join(self.root, "log"))

    def _state(self, name: str):
        """The last log entry of the collection, or None."""
        row = self._log().filter(F.col("name") == name).orderBy(F.desc("saved_at"), F.desc("batch")).first()
        return row if row is not None and row.version else None

    def _path(self, name: str, version: str, table: str, batch: int | None = None) -> str:
        path = os.path.join(self.root, name.encode().hex(), version, table)
        return path if batch is None else os.path.join(path, f"batch={batch}")

    def _write(self, name: str, version: str, documents: DataFrame, before, buckets: int, options: Options) -> None:
        """One batch: postings, frequencies, then the log entry with the sums so far."""
        batch = before.batch + 1 if before else 0
        documents = cut_lineage(documents, "batch")
        n, length = documents.agg(F.count("*"), F.coalesce(F.sum("len"), F.lit(0))).first()
        total_n, total_len = n + (before.n_docs if before else 0), length + (before.total_len if before else 0)
        first_shard = before.shards if before else 0
        mean_len = total_len / total_n if total_len else 1.0
        shards = inverted.shard_count(n, length, self.shard_docs)
        key = documents.schema["chunk_key"].dataType.simpleString()

        def write(table: str, rows: DataFrame) -> None:
            rows.write.mode("overwrite").partitionBy("bucket").parquet(self._path(name, version, table, batch))

        blocks = inverted.posting_blocks(documents, shards, mean_len, first_shard, buckets, options)
        write("postings", inverted.file_layout(blocks, n, "shard"))
        written = self._tables(name, version, batch, key)[0].filter(F.col("batch") == batch)
        write("terms", inverted.file_layout(inverted.document_frequencies(written, buckets), n, "term", inverted.TERM_FILE_DOCS))
        stored = self._tables(name, version, batch, key)
        mean = inverted.mean_idf(stored[1], total_n)
        self._enter(name, version, batch, total_n, total_len, first_shard + shards, buckets, mean, key)

    def _tables(self, name: str, version: str, last: int, key: str) -> tuple[DataFrame, DataFrame]:
        """Postings and frequencies of the batches up to ``last``; a batch that failed is not among them."""
        shapes = (
            f"term string, shard long, top double, avg_len double, keys array<{key}>, tfs array<int>, lens array<int>, batch long, bucket int",
            "term string, df long, batch long, bucket int",
        )
        return tuple(
            read_or_empty(self.spark, self._path(name, version, table), shape).filter(F.col("batch") <= last)
            for table, shape in zip(("postings", "terms"), shapes)
        )

    def save(self, name: str, documents: DataFrame, buckets: int = inverted.BUCKETS, options: Options = DEFAULTS) -> None:
        """Replace the collection by rows of ``sparse.build_documents``."""
        self._write(name, uuid.uuid4().hex, documents, None, buckets, options)

    def append(self, name: str, documents: DataFrame, options: Options = DEFAULTS) -> None:
        """Add rows of ``sparse.build_documents`` with new keys; stored postings stay as they are."""
        before = self._state(name)
        if before is None:
            self.save(name, documents, options=options)
        else:
            self._write(name, before.version, documents, before, before.buckets, options)

    def load(self, name: str) -> inverted.TermIndex:
        state = self._state(name)
        if state is None:
            raise KeyError(f"no collection {name!r}")
        postings, terms = self._tables(name, state.version, state.batch, state.key)
        return inverted.TermIndex(postings, terms, state.n_docs, state.total_len, state.mean_idf, state.buckets)

    def remove(self, name: str) -> None:
        state = self._state(name)
        if state is not None:
            self._enter(name, None, 0, 0, 0, 0, 0, 0.0, state.key)


def corpus_stats(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """One row: n_chunks, n_sources, n_indexed (not blank), n_vectors."""
    text = chunks.agg(
        F.count("*").alias("n_chunks"),
        F.count_distinct("source").alias("n_sources"),
        F.count_if(F.col("text").rlike(r"[^\s\p{Z}]")).alias("n_indexed"),
    )
    return text.select("*", vectors.agg(F.count("*")).scalar().alias("n_vectors"))
