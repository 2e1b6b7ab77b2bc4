"""Cleaning of wide tables: duplicates, coercion, column pruning.

Each data-dependent decision (which columns to coerce, which to drop) comes
from one aggregate over the table that returns a single row; the rest is a
lazy projection.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, FractionalType, NumericType, StringType

from corpusflow.functions.parsing import (
    employment_years,
    first_integer,
    is_percent,
    nan_to_null,
    percent_to_number,
    to_number,
)
from corpusflow.options import DEFAULTS, Options
from corpusflow.session import cut_lineage

# Identifier and free-text columns without information.
ID_COLUMNS = ["id", "member_id", "url", "desc"]


def is_numeric(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, (NumericType, BooleanType))


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, StringType)]


def normalise_nan(df: DataFrame) -> DataFrame:
    """NaN becomes NULL, so that there is one kind of missing value."""
    floats = {
        f.name: nan_to_null(F.col(f.name)) for f in df.schema.fields if isinstance(f.dataType, FractionalType)
        and f.dataType.typeName() in ("double", "float")
    }
    return df.withColumns(floats) if floats else df


def drop_duplicates(df: DataFrame) -> DataFrame:
    """Distinct rows, NULL equal to NULL; copies are merged before the shuffle."""
    return df.dropDuplicates()


def duplicate_count(df: DataFrame) -> DataFrame:
    """n_rows, n_distinct, n_duplicates of whole rows."""
    copies = df.groupBy(*df.columns).agg(F.count("*").alias("copies"))
    return copies.agg(F.sum("copies").alias("n_rows"), F.count("*").alias("n_distinct")).select(
        "n_rows", "n_distinct", (F.col("n_rows") - F.col("n_distinct")).alias("n_duplicates")
    )


def percent_columns(df: DataFrame, share: float = DEFAULTS.percent_share) -> list[str]:
    """Text columns in which more than ``share`` of the values end in a percent sign."""
    names = string_columns(df)
    if not names:
        return []
    row = df.agg(*[F.avg(is_percent(F.col(c)).cast("int")).alias(c) for c in names]).first()
    return [c for c in names if row[c] is not None and row[c] > share]


def parse_percent(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    columns = percent_columns(df) if columns is None else columns
    return df.withColumns({c: percent_to_number(F.col(c)) for c in columns}) if columns else df


def map_employment(df: DataFrame, column: str = "emp_length") -> DataFrame:
    return df.withColumn(column, employment_years(F.col(column))) if column in df.columns else df


def parse_term(df: DataFrame, column: str = "term") -> DataFrame:
    return df.withColumn(column, first_integer(F.col(column))) if column in df.columns else df


def numeric_text_columns(df: DataFrame, share: float = DEFAULTS.numeric_share) -> list[str]:
    """Text columns of which at least ``share`` of the values are numbers."""
    names = string_columns(df)
    if not names:
        return []
    row = df.agg(
        *[F.count(to_number(F.col(c))).alias(f"{c}#number") for c in names],
        *[F.count(c).alias(f"{c}#all") for c in names],
    ).first()
    return [c for c in names if row[f"{c}#number"] / max(row[f"{c}#all"], 1) >= share]


def coerce_numeric(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    columns = numeric_text_columns(df) if columns is None else columns
    return df.withColumns({c: to_number(F.col(c)) for c in columns}) if columns else df


def drop_id_columns(df: DataFrame, columns: list[str] = ID_COLUMNS) -> DataFrame:
    return df.drop(*columns)


def null_shares(df: DataFrame) -> dict[str, float]:
    row = df.agg(*[F.avg(F.col(c).isNull().cast("int")).alias(c) for c in df.columns]).first()
    return {c: row[c] if row[c] is not None else 0.0 for c in df.columns}


def drop_high_missing(df: DataFrame, threshold: float = DEFAULTS.missing_threshold) -> DataFrame:
    """Drop columns whose share of NULLs is above the threshold."""
    return df.drop(*[c for c, share in null_shares(df).items() if share > threshold])


def single_valued_columns(df: DataFrame) -> list[str]:
    """Columns with at most one distinct value, NULL counted as one; needs no shuffle of values."""
    row = df.agg(
        F.count("*").alias("#rows"),
        *[F.count(c).alias(f"{c}#n") for c in df.columns],
        *[(F.min(c).eqNullSafe(F.max(c))).alias(f"{c}#one") for c in df.columns],
    ).first()
    return [c for c in df.columns if row[f"{c}#one"] and row[f"{c}#n"] in (0, row["#rows"])]


def drop_single_valued(df: DataFrame) -> DataFrame:
    return df.drop(*single_valued_columns(df))


def clean(df: DataFrame, options: Options = DEFAULTS, id_columns: list[str] = ID_COLUMNS) -> DataFrame:
    """The whole cleaning: duplicates, coercion, id columns, missing share, single values.

    The distinct rows are written once. Coercion and pruning are then decided
    in two passes: one over the text columns, one over the coerced table.
    """
    rows = cut_lineage(drop_duplicates(df), "distinct-rows")
    rows = map_employment(parse_term(rows))
    names = string_columns(rows)
    if names:
        found = rows.agg(
            *[F.avg(is_percent(F.col(c)).cast("int")).alias(f"{c}#percent") for c in names],
            *[F.count(to_number(F.col(c))).alias(f"{c}#number") for c in names],
            *[F.count(c).alias(f"{c}#all") for c in names],
        ).first()
        percent = [c for c in names if (found[f"{c}#percent"] or 0) > options.percent_share]
        number = [
            c for c in names
            if c not in percent and found[f"{c}#number"] / max(found[f"{c}#all"], 1) >= options.numeric_share
        ]
        rows = coerce_numeric(parse_percent(rows, percent), number)
    rows = normalise_nan(drop_id_columns(rows, id_columns))
    seen = rows.agg(
        F.count("*").alias("#rows"),
        *[F.count(c).alias(f"{c}#n") for c in rows.columns],
        *[(F.min(c).eqNullSafe(F.max(c))).alias(f"{c}#one") for c in rows.columns],
    ).first()
    n = seen["#rows"]
    missing = [c for c in rows.columns if n and (n - seen[f"{c}#n"]) / n > options.missing_threshold]
    single = [c for c in rows.columns if seen[f"{c}#one"] and seen[f"{c}#n"] in (0, n)]
    return rows.drop(*missing, *single)
