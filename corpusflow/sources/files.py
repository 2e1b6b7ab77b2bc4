"""File sources and sinks: text and Markdown documents, CSV tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.functions.parsing import missing_to_null
from corpusflow.functions.text import clean_text

TEXT_SUFFIXES = ["txt", "md"]


def _suffix(name):
    return F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, source, page, text: one cleaned row per .txt or .md file (UTF-8), tagged with its name.

    doc_id is the 64-bit hash of the path, so it may be negative.
    """
    files = (
        spark.read.text(path, wholetext=True, recursiveFileLookup=True)
        .select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("source"))
        .filter(_suffix(F.col("source")).isin(TEXT_SUFFIXES))
    )
    return files.select(F.xxhash64("path").alias("doc_id"), "source", F.lit(0).alias("page"), clean_text(F.col("value")).alias("text"))


def rejected_files(spark: SparkSession, path: str) -> DataFrame:
    """path, reason of the files no reader accepts; their contents are not read."""
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path")
    suffix = _suffix(F.col("path"))
    return listing.filter(~suffix.isin(TEXT_SUFFIXES)).select(
        "path", F.concat(F.lit("unsupported file type: "), suffix).alias("reason")
    )


def has_open_quotes(spark: SparkSession, path: str) -> bool:
    """Whether some line has an odd number of quotes, as where a quoted field holds a line break; stops at the first."""
    line = F.col("value")
    quotes = F.length(line) - F.length(F.replace(line, F.lit('"'), F.lit("")))
    return not spark.read.text(path).filter(quotes % 2 == 1).isEmpty()


def read_csv(spark: SparkSession, path: str, nrows: int | None = None, encoding: str = "utf-8") -> DataFrame:
    """All columns as text, missing-value texts as NULL, at most ``nrows`` rows.

    A first row without any value is dropped, as exports may write one under
    the header. Quoted fields may hold line breaks and doubled quotes. Only where
    some field holds a line break is a file read by one task; otherwise large
    files are split.
    """
    whole = encoding.lower().startswith(("utf-16", "utf-32", "utf16", "utf32")) or has_open_quotes(spark, path)
    raw = spark.read.options(header=True, encoding=encoding, multiLine=whole, escape='"').csv(path)
    names = raw.columns
    rows = raw.select(
        *[missing_to_null(F.col(f"`{c}`")).alias(c) for c in names],
        F.col("_metadata.file_block_start").alias("#block"),
        F.monotonically_increasing_id().bitwiseAND(F.lit(2**33 - 1)).alias("#row"),
    )
    if nrows is not None:
        rows = rows.limit(nrows)
    empty = reduce(lambda a, b: a & b, [F.col(f"`{c}`").isNull() for c in names])
    leading = (F.col("`#block`") == 0) & (F.col("`#row`") == 0) & empty
    return rows.filter(~leading).select(*[F.col(f"`{c}`") for c in names])


def write_csv(df: DataFrame, path: str) -> None:
    """White space and quotes are written as they are; NULL is an empty field."""
    options = {"escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    df.write.mode("overwrite").options(header=True, **options).csv(path)


def write_cleaned(cleaned: DataFrame, continuous: DataFrame, categorical: DataFrame, path: str) -> None:
    """The cleaned table and its two profiles, as folders next to each other."""
    write_csv(cleaned, f"{path}/cleaned")
    write_csv(continuous, f"{path}/eda_continuous")
    write_csv(categorical, f"{path}/eda_categorical")
