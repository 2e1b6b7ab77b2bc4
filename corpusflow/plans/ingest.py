"""Ingest of documents into a stored corpus, and search over it.

Tables under one root, each divided by batch: registry, chunks, signatures,
bands, vectors, postings. A batch writes its own partitions only. It is visible
from the moment that its end is in the log, so a reader never sees half of one,
and a rerun after a failure leaves the same result. Removed files leave entries
in one table of tombstones that every other table honours; a compaction writes
what is left as one batch.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.functions.hashing import file_hash, max_hamming
from corpusflow.functions.text import clean_text, token_overlap
from corpusflow.operators import chunking, dedup, sparse
from corpusflow.options import DEFAULTS, Options
from corpusflow.plans import retrieval
from corpusflow.session import broadcast_if_small, cut_lineage
from corpusflow.sources.stores import read_or_empty, registry_rows

SCHEMAS = {
    "registry": "file_hash string, chunk_ids array<string>, batch long",
    "chunks": "chunk_key long, doc_id long, source string, chunk_idx int, chunk_id string, start_index int, text string, file_hash string, batch long",
    "signatures": "signature long, chunk_key long, batch long",
    "bands": "part long, signature long, chunk_key long, batch long, band int",
    "vectors": "chunk_key long, embedding array<double>, batch long",
    "postings": "chunk_key long, len int, runs array<struct<term:string,tf:int>>, batch long",
}
#: Rows of a table that a removed file takes with it.
KEYS = {name: "file_hash" if name == "registry" else "chunk_key" for name in SCHEMAS}
TOMBSTONES = "chunk_key long, file_hash string, row_batch long"
LOG = "batch long, state string, at timestamp"

#: (rows, key column) -> key column and ``embedding`` (array of doubles) from the column ``text``.
Embedder = Callable[[DataFrame, str], DataFrame]


class Corpus:
    """A stored corpus. ``embed`` turns texts into vectors, ``number`` (doc_id, chunk_idx) into chunk keys."""

    def __init__(
        self, spark: SparkSession, root: str, embed: Embedder = dedup.projected_vector,
        number: Callable[[Column, Column], Column] = dedup.chunk_key,
    ):
        self.spark, self.root, self.embed, self.number = spark, root, embed, number

    def _path(self, name: str) -> str:
        return os.path.join(self.root, name)

    def _enter(self, rows: list[tuple[int, str]]) -> None:
        """Log entries that count together; they are one file."""
        entry = self.spark.createDataFrame(rows, "batch long, state string").coalesce(1)
        entry.withColumn("at", F.current_timestamp()).write.mode("append").parquet(self._path("log"))

    def begin(self, batch: int) -> None:
        """Hide the batch until ``commit``."""
        self._enter([(batch, "open")])

    def commit(self, batch: int) -> None:
        self._enter([(batch, "done")])

    def visible(self) -> list[int]:
        """Numbers of the batches that count; a compaction leaves one."""
        log = read_or_empty(self.spark, self._path("log"), LOG)
        last = log.groupBy("batch").agg(F.max_by("state", "at").alias("state"))
        return sorted(r.batch for r in last.filter("state = 'done'").select("batch").collect())

    def tombstones(self) -> DataFrame:
        return read_or_empty(self.spark, self._path("tombstones"), TOMBSTONES)

    def read(self, name: str, batches: list[int] | None = None) -> DataFrame:
        """Rows of the visible batches without those of removed files."""
        batches = self.visible() if batches is None else batches
        rows = read_or_empty(self.spark, self._path(name), SCHEMAS[name]).filter(F.col("batch").isin(batches))
        gone = self.tombstones()
        if gone.isEmpty():
            return rows
        gone = gone.select(KEYS[name], F.col("row_batch").alias("batch")).distinct()
        return rows.join(broadcast_if_small(gone), [KEYS[name], "batch"], "left_anti")

    def before(self, name: str, batch: int) -> DataFrame:
        """Rows of other batches; those of a failed first try of this batch do not count."""
        return self.read(name, [b for b in self.visible() if b != batch])

    def write(self, name: str, rows: DataFrame, batch: int) -> None:
        folder = os.path.join(self._path(name), f"batch={batch}")
        if name == "bands":
            rows.repartition("band").sortWithinPartitions("band", "part").write.mode("overwrite").partitionBy("band").parquet(folder)
        else:
            rows.write.mode("overwrite").parquet(folder)

    def index(self, options: Options = DEFAULTS) -> sparse.SparseIndex:
        return sparse.index_from_documents(self.read("postings").drop("batch"), options=options)

    def search(
        self, queries: DataFrame, options: Options = DEFAULTS, scorer: Callable[[Column, Column], Column] | None = token_overlap
    ) -> DataFrame:
        """Hybrid search of ``queries`` (query_id, text) over what was ingested; as ``retrieval.hybrid_search``."""
        asked = cut_lineage(queries.join(self.embed(queries, "query_id"), "query_id", "left"), "asked")
        chunks = self.read("chunks").withColumn("section", F.lit(None).cast("string"))
        return retrieval.hybrid_search(self.index(options), self.read("vectors").drop("batch"), chunks, asked, options, scorer)

    def remove(self, files: DataFrame) -> None:
        """Take files (file_hash) out of the corpus; they may be ingested again.

        Chunks, postings, vectors and signatures of a file go with it, and near
        copies that were left out because of it may come in with a later batch.
        """
        wanted = broadcast_if_small(files.select("file_hash").distinct())
        chunks = self.read("chunks").join(wanted, "file_hash", "left_semi").select("chunk_key", "file_hash", F.col("batch").alias("row_batch"))
        known = self.read("registry").join(wanted, "file_hash", "left_semi")
        known = known.select(F.lit(None).cast("long").alias("chunk_key"), "file_hash", F.col("batch").alias("row_batch"))
        cut_lineage(chunks.unionByName(known), "removed").coalesce(1).write.mode("append").parquet(self._path("tombstones"))

    def compact(self) -> None:
        """Write all that counts as one batch with a number below all others; tombstones of it are empty."""
        old = self.visible()
        if not old:
            return
        new = min(0, *old) - 1
        self.begin(new)
        for name in SCHEMAS:
            self.write(name, self.read(name, old).drop("batch"), new)
        self._enter([(new, "done"), *[(b, "replaced") for b in old]])

    def clear(self) -> None:
        """Hide every batch; nothing of the old corpus stays searchable or registered."""
        if old := self.visible():
            self._enter([(b, "replaced") for b in old])


def ingest(corpus: Corpus, docs: DataFrame, batch: int, options: Options = DEFAULTS) -> None:
    """Add documents (doc_id, source, text): exact copies and near-copy chunks are left out.

    Near copies of stored chunks are found in the band index, of which a batch
    reads only the bands that its signatures fall into.
    """
    corpus.begin(batch)
    d = max_hamming(options.similarity_threshold)
    # Texts are cleaned and hashed once, and their words counted once for signatures and vectors.
    files = docs.select("doc_id", "source", clean_text(F.col("text")).alias("text")).withColumn("file_hash", file_hash(F.col("text")))
    files = cut_lineage(files, "files")
    # Cheap test first: only files that are new reach the chunker.
    fresh = cut_lineage(dedup.new_files(files, corpus.before("registry", batch), "doc_id"), "fresh")
    kept = files.join(broadcast_if_small(fresh.select("doc_id")), "doc_id", "left_semi")
    chunks = dedup.with_signature(chunking.chunk_documents(kept, options, keep=["file_hash"]))
    number = F.col("doc_id"), F.col("chunk_idx")
    chunks = cut_lineage(chunks.withColumns({"chunk_key": corpus.number(*number), "ord": dedup.chunk_ordinal(*number)}), "chunks")
    signatures, chunks = chunks.select("ord", "signature"), chunks.drop("signature")
    if not [b for b in corpus.visible() if b != batch]:
        seen = None
    elif dedup.band_masks(d):
        seen = lambda rows: dedup.close_to_bands(rows, corpus.before("bands", batch), d)
    else:
        seen = corpus.before("signatures", batch)
    verdicts = dedup.near_duplicates(signatures, d, seen)
    stay = cut_lineage(verdicts.filter(F.col("duplicate_of").isNull() & ~F.col("known")).select("ord", "signature"), "stay")
    unique = cut_lineage(chunks.join(broadcast_if_small(stay), "ord"), "unique")
    corpus.write("chunks", unique.select(*[c.split()[0] for c in SCHEMAS["chunks"].split(", ")][:-1]), batch)
    held = unique.select("signature", "chunk_key")
    corpus.write("signatures", held, batch)
    corpus.write("bands", dedup.band_rows(held, d) if dedup.band_masks(d) else corpus.read("bands", []).drop("batch"), batch)
    corpus.write("vectors", corpus.embed(unique, "chunk_key").select("chunk_key", "embedding"), batch)
    corpus.write("postings", sparse.build_documents(unique, "chunk_key", "text"), batch)
    ids = registry_rows(unique)
    corpus.write("registry", fresh.select("file_hash").join(ids, "file_hash", "left").select(
        "file_hash", F.coalesce("chunk_ids", F.array().cast("array<string>")).alias("chunk_ids")
    ), batch)
    corpus.commit(batch)
