"""Parquet tables of one data folder."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(folder, f"{name}.parquet"))


def table_columns(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    rows = table(spark, folder, name)
    return rows.select(*columns) if columns else rows
