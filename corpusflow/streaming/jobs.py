"""Structured Streaming forms of the operators."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpusflow.functions.classify import route
from corpusflow.operators.windows import running_sums
from corpusflow.options import DEFAULTS, Options
from corpusflow.plans.ingest import Corpus, ingest
from corpusflow.session import broadcast_if_small, cut_lineage, delete_folder
from corpusflow.sources.stores import read_or_empty

# A snapshot of conversation counters replaces the deltas of this many batches.
SNAPSHOT_EVERY = 100


def read_stream(spark: SparkSession, folder: str, pattern: str, schema, max_files: int | None = None) -> DataFrame:
    """Parquet files of a folder whose name matches ``pattern``, as they arrive."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(folder)


def table_stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Stream over a Parquet table that is one file or a folder of part files."""
    path = os.path.join(folder, f"{name}.parquet")
    stored = spark.read.parquet(path)
    files = stored.inputFiles()
    if files and all(os.path.basename(f) == f"{name}.parquet" for f in files[:1]):
        return read_stream(spark, folder, f"{name}.parquet", stored.schema)
    return read_stream(spark, path, "*", stored.schema)


def run_available(
    stream: DataFrame, checkpoint: str, handle: Callable[[DataFrame, int], None], mode: str = "append"
) -> StreamingQuery:
    """Process everything that has arrived, then stop."""
    query = (
        stream.writeStream.foreachBatch(handle).outputMode(mode).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return query


def write_batch(path: str) -> Callable[[DataFrame, int], None]:
    """Handler that stores each batch in its own folder; repeating a batch replaces it."""

    def handle(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(os.path.join(path, f"batch={batch}"))

    return handle


def ingest_stream(docs: DataFrame, corpus: Corpus, checkpoint: str, options: Options = DEFAULTS) -> StreamingQuery:
    """Documents into a stored corpus, batch by batch."""
    return run_available(docs, checkpoint, lambda rows, batch: ingest(corpus, rows, batch, options))


def first_submissions(files: DataFrame, delay: str = "1 day") -> DataFrame:
    """Files without the copies that follow within ``delay``. ``files``: ts, file_hash and others."""
    return files.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["file_hash"])


class SubmissionRegistry:
    """First submissions of a stream, with copies caught at any distance.

    The hashes seen are a table divided by their first two digits, not stream
    state, so nothing grows in memory and no late row is lost. A batch reads the
    divisions that its hashes fall into and writes what is new; repeating a batch
    replaces what it wrote.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.path = spark, os.path.join(root, "submissions")

    def handle(self, files: DataFrame, batch: int) -> None:
        """``files``: file_hash, ts. The earliest row of a hash counts within a batch."""
        first = files.groupBy("file_hash").agg(F.min("ts").alias("ts")).withColumn("share", F.substring("file_hash", 1, 2))
        first = cut_lineage(first, "submitted")
        touched = [r.share for r in first.select("share").distinct().collect()]  # at most 256 for hexadecimal hashes
        known = self.seen().filter((F.col("batch") != batch) & F.col("share").isin(touched)).select("share", "file_hash")
        fresh = first.join(known, ["share", "file_hash"], "left_anti")
        fresh.repartition("share").write.mode("overwrite").partitionBy("share").parquet(os.path.join(self.path, f"batch={batch}"))

    def seen(self) -> DataFrame:
        """file_hash, ts, batch, share of every first submission."""
        return read_or_empty(self.spark, self.path, "file_hash string, ts timestamp, batch long, share string")


def service_metrics(log: DataFrame, width: str = "1 minute", delay: str = "10 minutes") -> DataFrame:
    """Per window: n, qps, mean and 95th percentile duration, error rate. ``log``: ts, duration, is_error."""
    by_window = log.withWatermark("ts", delay).groupBy(F.window("ts", width))
    seconds = F.unix_timestamp("window.end") - F.unix_timestamp("window.start")
    return by_window.agg(
        F.count("*").alias("n"),
        F.avg("duration").alias("avg_duration"),
        F.percentile_approx("duration", 0.95, 10_000).alias("p95_duration"),
        (F.count_if("is_error") / F.count("*") * 100).alias("error_rate"),
    ).select(
        F.col("window.start").alias("window_start"), "n", (F.col("n") / seconds).alias("qps"),
        "avg_duration", "p95_duration", "error_rate",
    )


def routed(messages: DataFrame, text: Column | str = "text") -> DataFrame:
    """Messages with their route; no state."""
    return messages.withColumn("route", route(F.col(text) if isinstance(text, str) else text))


class TriggerCounter:
    """Summary triggers over a message stream.

    Counts per conversation are stored as one delta per batch, with a snapshot
    from time to time. A batch numbers its own messages with the block-wise
    running sum and adds the stored counts, so a conversation with very many
    messages is never held by one task.
    """

    SCHEMA = "conv_id long, users long, messages long, batch long"

    def __init__(self, spark: SparkSession, root: str, every: int, min_messages: int, snapshot_every: int = SNAPSHOT_EVERY):
        self.spark, self.root = spark, root
        self.every, self.min_messages, self.snapshot_every = every, min_messages, snapshot_every

    def _counts(self, base: int, batch: int, wanted: DataFrame | None = None) -> DataFrame:
        """conv_id, users, messages of the batches below ``batch``: snapshot ``base`` plus later deltas.

        With ``wanted`` (conv_id) only those conversations are summed.
        """
        stored = [read_or_empty(self.spark, os.path.join(self.root, name), self.SCHEMA) for name in ("snapshots", "deltas")]
        # The snapshot numbered b covers the batches below b.
        held = stored[0].filter(F.col("batch") == base)
        recent = stored[1].filter((F.col("batch") >= base) & (F.col("batch") < batch))
        stored = held.unionByName(recent)
        if wanted is not None:
            stored = stored.join(broadcast_if_small(wanted), "conv_id", "left_semi")
        return stored.groupBy("conv_id").agg(
            F.sum("users").alias("users"), F.sum("messages").alias("messages")
        )

    def _write(self, rows: DataFrame, table: str, batch: int) -> None:
        rows.write.mode("overwrite").parquet(os.path.join(self.root, table, f"batch={batch}"))

    def handle(self, rows: DataFrame, batch: int) -> None:
        rows = rows.select("conv_id", "turn", "role").persist()
        try:
            self._handle(rows, batch)
        finally:
            rows.unpersist()

    def _handle(self, rows: DataFrame, batch: int) -> None:
        base = batch - batch % self.snapshot_every
        if batch and batch == base:
            before = base - self.snapshot_every
            self._write(self._counts(before, batch), "snapshots", batch)
            # A repeated batch may still need the period before it; older files are of no use.
            for old in range(max(0, before - self.snapshot_every), before):
                delete_folder(os.path.join(self.root, "deltas", f"batch={old}"))
        is_user = (F.col("role") == "user").cast("long")
        counts = {"u": is_user, "m": F.lit(1).cast("long")}
        numbered = running_sums(rows, ["conv_id"], "turn", counts)
        counted = numbered.join(self._counts(base, batch, rows.select("conv_id").distinct()), "conv_id", "left").withColumns({
            "user_turns": F.col("u") + F.coalesce("users", F.lit(0)),
            "n_messages": F.col("m") + F.coalesce("messages", F.lit(0)),
        })
        fires = (F.col("role") == "user") & (F.col("user_turns") % self.every == 0) & (F.col("n_messages") >= self.min_messages)
        self._write(counted.filter(fires).select("conv_id", "turn", "user_turns", "n_messages"), "triggers", batch)
        delta = rows.groupBy("conv_id").agg(F.sum(is_user).alias("users"), F.count("*").alias("messages"))
        self._write(delta, "deltas", batch)

    def triggers(self) -> DataFrame:
        schema = "conv_id long, turn long, user_turns long, n_messages long, batch long"
        return read_or_empty(self.spark, os.path.join(self.root, "triggers"), schema).drop("batch")
