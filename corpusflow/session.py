"""Session helpers shared by the operators: checked broadcasts, lineage cuts, table access."""

from __future__ import annotations

import os
import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A side is broadcast only when a count shows that it stays below both limits.
BROADCAST_MAX_ROWS = 200_000
BROADCAST_MAX_BYTES = 64 * 1024 * 1024


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, from ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="corpusflow-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new folder name inside the shared folder; all of an application's folders have one parent."""
    return os.path.join(shared_dir(spark), f"corpusflow-{spark.sparkContext.applicationId}", f"{label}-{uuid.uuid4().hex}")


def delete_folder(path: str) -> None:
    """Delete a folder of the shared file system, if it is there."""
    from pyarrow import fs

    system, place = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{os.path.abspath(path)}")
    if system.get_file_info(place).type == fs.FileType.Directory:
        system.delete_dir(place)


def clear_scratch(spark: SparkSession) -> None:
    """Delete what this application wrote to the shared folder; no result of it can be read afterwards."""
    delete_folder(os.path.join(shared_dir(spark), f"corpusflow-{spark.sparkContext.applicationId}"))


def cut_lineage(df: DataFrame, label: str = "stage", path: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder, or to ``path`` there, and read it back.

    The copy survives the loss of executors, is computed once, and gives the
    planner real sizes for the joins that follow.
    """
    path = path or scratch_path(df.sparkSession, label)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def empty_copy(copy: DataFrame, path: str) -> None:
    """Give back the space of a large copy of ``cut_lineage`` that nothing reads any more.

    Spark overwrites it with no rows, so this works wherever Spark can write.
    """
    copy.sparkSession.createDataFrame([], copy.schema).write.mode("overwrite").parquet(path)


def row_bytes(df: DataFrame) -> Column:
    """Rough in-memory size of one row."""
    size = F.lit(0).cast("long")
    for field in df.schema.fields:
        kind = field.dataType.typeName()
        if kind in ("string", "binary"):
            size = size + F.coalesce(F.octet_length(field.name), F.lit(0)) + 16
        elif kind == "array":
            size = size + F.greatest(F.size(field.name), F.lit(0)) * 16 + 16
        elif kind in ("map", "struct"):
            size = size + F.coalesce(F.octet_length(F.to_json(F.struct(field.name))), F.lit(0))
        else:
            size = size + 8
    return size


def is_small(
    df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS, max_bytes: int = BROADCAST_MAX_BYTES
) -> bool:
    """True when ``df`` is proven to stay below both limits (reads at most max_rows + 1 rows)."""
    probe = df.select(row_bytes(df).alias("b")).limit(max_rows + 1)
    n, size = probe.agg(F.count("*"), F.coalesce(F.sum("b"), F.lit(0))).first()
    return n <= max_rows and size <= max_bytes


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS) -> DataFrame:
    """Broadcast hint behind a size check; otherwise the planner and AQE choose the join."""
    return F.broadcast(df) if is_small(df, max_rows) else df


def stable(score: Column) -> Column:
    """Score used for ordering: summation noise removed so equal documents tie exactly."""
    return F.round(score, 9)


def union_on(frames: list[DataFrame], *keys: str) -> DataFrame:
    """Union of shuffled inputs that a following keyed step may rely on.

    Spark 4.1 takes a union of equally partitioned inputs to be partitioned like
    them and skips the next shuffle, but adaptive execution may coalesce the
    inputs differently, which splits groups. A shuffle on ``keys`` rules that
    out; it is only kept when the inputs are not partitioned by the same keys.
    """
    return reduce(DataFrame.unionByName, frames).repartition(*keys)


def spread(df: DataFrame) -> DataFrame:
    """Give a scan with fewer splits than cores enough partitions; larger scans stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
