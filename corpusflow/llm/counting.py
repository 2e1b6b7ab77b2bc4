"""Token counts by the whole-token shortcut."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.llm import vocab

BYTE_BPE = "byte_bpe_50k.json"


def token_counts(docs: DataFrame, vocabulary: str = BYTE_BPE, limit: int = 512, text: str = "text") -> DataFrame:
    """Bytes and tokens of every whole text.

    Pre-tokens that are proven to encode alone as one token are counted
    directly; the tokenizer merges only the others. Files ending in ``.model``
    have no pre-token split and are encoded as they are by their own library.

    Returns doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit), one row
    per input row: a null or empty text has no bytes and no tokens, repeated
    rows are counted each for itself, a null doc_id stays null, an empty table
    gives an empty table. Other columns of ``docs`` are not looked at.
    """
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
        F.octet_length(F.coalesce(F.col(text), F.lit(""))).cast("long").alias("n_bytes"),
    )

    def count(batches):
        import pyarrow as pa

        if vocabulary.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=vocab.vocabulary_path(vocabulary))
            measure = lambda t: len(model.encode(t))
        else:
            pieces = vocab.piece_counts(vocabulary)
            measure = lambda t: sum(pieces.of(t))
        for batch in batches:
            counts = pa.array([measure(t.as_py()) for t in batch.column(1)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), counts], ["doc_id", "n_bytes", "n_tokens"])

    counted = rows.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
