"""Good/bad labels and the distribution of features against them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusflow.operators.profile import long_numbers, long_texts
from corpusflow.options import DEFAULTS


def label_rows(df: DataFrame, column: str, good: list, bad: list) -> DataFrame:
    """Rows with a good or bad value and their ``target``: 1 for bad, which wins over good."""
    kept = df.filter(F.col(column).isin(list(good) + list(bad)))
    return kept.withColumn("target", F.when(F.col(column).isin(list(bad)), 1).otherwise(0))


def label_summary(df: DataFrame, column: str, good: list, bad: list) -> DataFrame:
    """n_total, n_good, n_bad and their percentages; a value in both lists counts in both."""
    kept = df.filter(F.col(column).isin(list(good) + list(bad)))
    counts = kept.agg(
        F.count("*").alias("n_total"),
        F.count_if(F.col(column).isin(list(good))).alias("n_good"),
        F.count_if(F.col(column).isin(list(bad))).alias("n_bad"),
    )

    def ratio(name):
        share = F.when(F.col("n_total") > 0, F.round(F.col(name) / F.col("n_total") * 100, 2))
        return F.coalesce(share, F.lit(0.0))

    return counts.select("*", ratio("n_good").alias("good_ratio"), ratio("n_bad").alias("bad_ratio"))


def numeric_by_class(labelled: DataFrame, columns: list[str]) -> DataFrame:
    """column, valid_rate, and mean and standard deviation per class."""

    def figures(c: str):
        value = F.col(c).cast("double")
        good, bad = F.when(F.col("target") == 0, value), F.when(F.col("target") == 1, value)
        return F.struct(
            F.round(F.count(value) / F.count("*") * 100, 2).alias("valid_rate"),
            F.round(F.avg(good), 2).alias("good_mean"),
            F.round(F.avg(bad), 2).alias("bad_mean"),
            F.round(F.stddev_samp(good), 2).alias("good_std"),
            F.round(F.stddev_samp(bad), 2).alias("bad_std"),
        ).alias(c)

    return labelled.agg(*[figures(c) for c in columns]).unpivot([], columns, "column", "s").select("column", "s.*")


def histogram_by_class(labelled: DataFrame, columns: list[str]) -> DataFrame:
    """column, target, bin, n, bin_start. The bin count depends on both classes, the range on each alone."""
    long = long_numbers(labelled, columns, "target")
    by_class = long.groupBy("column", "target").agg(
        F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high")
    )
    total = F.sum("n").over(Window.partitionBy("column"))
    flat = F.col("low") == F.col("high")
    ranges = by_class.select(
        "column", "target",
        F.least(F.lit(50), F.greatest(F.lit(10), F.floor(F.sqrt(total.cast("double"))))).cast("int").alias("bins"),
        F.when(flat, F.col("low") - 0.5).otherwise(F.col("low")).alias("start"),
        F.when(flat, F.col("high") + 0.5).otherwise(F.col("high")).alias("end"),
    )
    # Two rows per column: always small enough to broadcast.
    placed = long.join(F.broadcast(ranges), ["column", "target"])
    at = F.floor((F.col("value") - F.col("start")) / (F.col("end") - F.col("start")) * F.col("bins")).cast("int")
    width = (F.col("end") - F.col("start")) / F.col("bins")
    return (
        placed.withColumn("bin", F.least(at, F.col("bins") - 1))
        .groupBy("column", "target", "bin", "bins", "start", "end")
        .agg(F.count("*").alias("n"))
        .select("column", "target", "bin", "n", F.round(F.col("start") + F.col("bin") * width, 6).alias("bin_start"))
    )


def bad_rate_by_category(
    labelled: DataFrame, columns: list[str], max_categories: int = DEFAULTS.max_categories
) -> DataFrame:
    """column, value, bin_count, bad_count, bin_rate, bad_rate; columns with too many values are left out."""
    counts = (
        long_texts(labelled, columns, "target")
        .filter(F.col("value").isNotNull())
        .groupBy("column", "value")
        .agg(F.count("*").alias("bin_count"), F.sum("target").alias("bad_count"))
    )
    totals = counts.groupBy("column").agg(F.count("*").alias("n_unique"), F.sum("bin_count").alias("total"))
    # One row per column. Joining it back keeps a column with many values off a single task.
    kept = counts.join(F.broadcast(totals.filter(F.col("n_unique") <= max_categories)), "column")
    return kept.select(
        "column", "value", "bin_count", "bad_count",
        (F.col("bin_count") / F.col("total")).alias("bin_rate"),
        (F.col("bad_count") / F.col("bin_count")).alias("bad_rate"),
    )


def run_summary(cleaning: DataFrame, labels: DataFrame, n_numeric: int, n_categorical: int) -> DataFrame:
    """One sentence over the cleaning summary and the label summary (one row each)."""
    both = cleaning.withColumn("l", labels.select(F.struct(*labels.columns)).scalar())
    text = F.format_string(
        "数据清洗完成：原始 %,d 行 %,d 列 → 清洗后 %,d 行 %,d 列（删除 %d 列）。"
        "好坏样本分析：%,d 个有效样本中，好样本(M0) %,d（%s%%），坏样本(M1+) %,d（%s%%）。"
        "已生成 %d 张连续特征分布图 + %d 张类别特征分布图。",
        "n_raw_rows", "n_raw_cols", "n_clean_rows", "n_clean_cols", "n_dropped_cols",
        "l.n_total", "l.n_good", F.col("l.good_ratio").cast("string"), "l.n_bad", F.col("l.bad_ratio").cast("string"),
        F.lit(n_numeric), F.lit(n_categorical),
    )
    return both.select(text.alias("summary"))
