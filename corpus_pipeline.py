"""From raw documents to packed training sequences: five stages, each written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.llm import decontaminate, minhash, packing, quality, secrets
from corpusflow.session import broadcast_if_small, cut_lineage
from corpusflow.sources.tables import table

#: Words of a shingle of the near-duplicate stage: one changed word in twenty leaves a document as its own.
SHINGLE = 5


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that the quality classifier does not reject (score of at least 0.3)."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.scored(docs, model).filter("predicted = 1").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near duplicates, the one with the smallest doc_id.

    Identical rows that share that doc_id are one document; one of them stays.
    """
    shingles = minhash.near_duplicates(docs, size=SHINGLE)
    gone = cut_lineage(shingles.filter(~F.col("kept")).select("doc_id").distinct(), "copies")
    kept = docs.join(broadcast_if_small(gone), "doc_id", "left_anti").select(*docs.columns)
    # Only rows whose doc_id is repeated are compared with each other.
    repeated = docs.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").select("doc_id")
    repeated = cut_lineage(repeated, "repeated")
    if repeated.isEmpty():
        return kept
    single = kept.join(broadcast_if_small(repeated), "doc_id", "left_anti").select(*docs.columns)
    return single.unionByName(kept.join(broadcast_if_small(repeated), "doc_id", "left_semi").select(*docs.columns).distinct())


def benchmark_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that contain no benchmark item, edits allowed for."""
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def secret_removal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace confirmed secrets in the texts; every document stays."""
    forest = secrets.fit_forest(secrets.public_findings(spark))
    clean = secrets.redacted(docs, forest)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents, each with its sequence and place."""
    return packing.packed_documents(docs)


STAGES = [
    ("quality_classifier", quality_filter),
    ("minhash_near_dedup", near_dedup),
    ("benchmark_decontamination", benchmark_filter),
    ("secret_scan", secret_removal),
    ("best_fit_packing", sequence_packing),
]

#: Trained models, tokenizer files and edit distances are outside SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of one folder; each result is written and read again as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
