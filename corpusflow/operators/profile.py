"""Profiles of table columns, one row per column."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusflow.operators.cleaning import is_numeric
from corpusflow.options import DEFAULTS

# Columns with at most this many distinct values may use the built-in exact percentile,
# which holds one counter per distinct value in memory.
PERCENTILE_MAX_DISTINCT = 10_000
# The distributed percentile narrows each wanted rank down to a value range of at most
# this many rows before it sorts anything.
RANGE_ROWS = 100_000
SKETCH_ACCURACY = 10_000


def long_numbers(df: DataFrame, columns: list[str], *keep: str) -> DataFrame:
    """column, value (double) rows of the numeric columns, without NULLs."""
    values = df.select(*keep, *[F.col(c).cast("double").alias(c) for c in columns])
    return values.unpivot(list(keep), columns, "column", "value").filter(F.col("value").isNotNull())


def long_texts(df: DataFrame, columns: list[str], *keep: str) -> DataFrame:
    values = df.select(*keep, *[F.col(c).cast("string").alias(c) for c in columns])
    return values.unpivot(list(keep), columns, "column", "value")


def value_counts(df: DataFrame, columns: list[str], *keep: str) -> DataFrame:
    """column, value, n: one shuffle for all columns, counted before it."""
    return (
        long_texts(df, columns, *keep)
        .filter(F.col("value").isNotNull())
        .groupBy(*keep, "column", "value")
        .agg(F.count("*").alias("n"))
    )


def approx_distinct(df: DataFrame, columns: list[str]) -> dict[str, int]:
    if not columns:
        return {}
    row = df.agg(*[F.approx_count_distinct(c).alias(c) for c in columns]).first()
    return {c: row[c] for c in columns}


def numeric_sketch(df: DataFrame) -> dict[str, int]:
    """Approximate number of distinct values per numeric column: one pass."""
    return approx_distinct(df, [c for c in df.columns if is_numeric(df, c)])


def column_types(
    df: DataFrame, threshold: int = DEFAULTS.cat_threshold, rough: dict[str, int] | None = None
) -> tuple[list[str], list[str]]:
    """Continuous and categorical columns, in table order.

    A sketch settles numeric columns with far more values than the threshold;
    the values of the remaining ones are counted exactly.
    """
    numeric = [c for c in df.columns if is_numeric(df, c)]
    rough = numeric_sketch(df) if rough is None else rough
    unsure = [c for c in numeric if rough[c] <= 4 * threshold]
    exact = {}
    if unsure:
        rows = value_counts(df, unsure).groupBy("column").agg(F.count("*").alias("n")).collect()
        exact = {r["column"]: r["n"] for r in rows}
    continuous = [c for c in numeric if c not in unsure or exact.get(c, 0) > threshold]
    return continuous, [c for c in df.columns if c not in continuous]


def column_classes(df: DataFrame, threshold: int = DEFAULTS.cat_threshold) -> DataFrame:
    continuous, _ = column_types(df, threshold)
    return column_schema(df).select(
        "column", F.when(F.col("column").isin(continuous), "continuous").otherwise("categorical").alias("class")
    )


def column_schema(df: DataFrame) -> DataFrame:
    """column, dtype, position."""
    rows = [(f.name, f.dataType.simpleString(), i) for i, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(rows, "column string, dtype string, position int")


def missing_report(df: DataFrame) -> DataFrame:
    """column, n_missing, missing_rate (percent), severity of the columns with NULLs: one pass."""
    counts = df.agg(
        F.count("*").alias("#rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns]
    )
    long = counts.unpivot(["#rows"], df.columns, "column", "n_missing").filter(F.col("n_missing") > 0)
    rate = F.col("n_missing") / F.col("#rows") * 100
    severity = F.when(rate > 10, "red").when(rate > 5, "orange").otherwise("green")
    return long.select("column", "n_missing", F.round(rate, 2).alias("missing_rate"), severity.alias("severity"))


def completeness(df: DataFrame) -> DataFrame:
    """column, n_present, present_share, null_rate for every column (a missing-value chart)."""
    counts = df.agg(F.count("*").alias("#rows"), *[F.count(c).alias(c) for c in df.columns])
    long = counts.unpivot(["#rows"], df.columns, "column", "n_present")
    share = F.col("n_present") / F.col("#rows")
    return long.select("column", "n_present", share.alias("present_share"), (1 - share).alias("null_rate"))


def _narrowed(df: DataFrame, ranks: dict[tuple, tuple[int, int, int]], limit: int) -> dict[tuple, tuple]:
    """Per (column, prob): low and high value and the number of rows below, around the wanted ranks.

    Each round takes two passes over the table, both with one wide aggregate: a
    sketch proposes a range around the ranks, a count proves that it holds them
    (a side that does not is left as it was).
    """
    inf = float("inf")
    found = {key: (-inf, inf, 0, total) for key, (_, _, total) in ranks.items()}
    open_keys = [key for key, (_, _, total) in ranks.items() if total > limit]
    while open_keys:
        # Ranks within one range of a column share a sketch.
        wanted: dict[tuple, list] = {}
        for key in open_keys:
            (low, high, before, n), (r0, r1, _) = found[key], ranks[key]
            slack = 2 / SKETCH_ACCURACY
            shares = [max((r0 - before) / n - slack, 0.0), min((r1 + 1 - before) / n + slack, 1.0)]
            wanted.setdefault((key[0], low, high), []).append((key, shares))
        sketches = []
        for i, ((c, low, high), held) in enumerate(wanted.items()):
            value = F.col(c).cast("double")
            shares = [s for _, pair in held for s in pair]
            sketches.append(F.percentile_approx(F.when(value.between(low, high), value), shares, SKETCH_ACCURACY).alias(str(i)))
        row = df.agg(*sketches).first()
        proposed = {
            key: row[i][2 * j : 2 * j + 2] for i, held in enumerate(wanted.values()) for j, (key, _) in enumerate(held)
        }
        counts = []
        for i, key in enumerate(open_keys):
            value, (low, high) = F.col(key[0]).cast("double"), proposed[key]
            counts += [F.count_if(value < low).alias(f"{i}<"), F.count_if(value <= high).alias(f"{i}<=")]
        proven, still = df.agg(*counts).first(), []
        for i, key in enumerate(open_keys):
            (low, high, before, n), (r0, r1, _), (new_low, new_high) = found[key], ranks[key], proposed[key]
            through = before + n
            if proven[f"{i}<"] <= r0:
                low, before = new_low, proven[f"{i}<"]
            if proven[f"{i}<="] > r1:
                high, through = new_high, proven[f"{i}<="]
            found[key] = (low, high, before, through - before)
            if limit < through - before < n and low < high:
                still.append(key)
        open_keys = still
    return found


def selected_quantiles(df: DataFrame, columns: list[str], probs: list[float], limit: int = RANGE_ROWS) -> DataFrame:
    """column, prob, value: exact linear quantiles by selection, without a full sort or large buffers.

    Once the ranges are narrow, only their rows are taken, equal values are
    merged, and a running count finds the values at the wanted ranks. The driver
    holds a few numbers per column.
    """
    totals = df.agg(*[F.count(c).alias(c) for c in columns]).first()
    ranks = {}
    for c in columns:
        for p in probs:
            place = (totals[c] - 1) * p
            if totals[c]:
                ranks[(c, p)] = (math.floor(place), math.ceil(place), totals[c])
    found = _narrowed(df, ranks, limit)
    kinds = "column string, prob double, r0 long, r1 long, share double, before long"
    rows = [(c, p, r0, r1, (n - 1) * p - r0, found[(c, p)][2]) for (c, p), (r0, r1, n) in ranks.items()]
    targets = df.sparkSession.createDataFrame(rows, kinds)
    inside = [
        F.when(
            F.col(c).cast("double").between(found[(c, p)][0], found[(c, p)][1]),
            F.struct(F.lit(c).alias("column"), F.lit(p).alias("prob"), F.col(c).cast("double").alias("value")),
        )
        for c, p in ranks
    ]
    none = F.array().cast("array<struct<column:string,prob:double,value:double>>")
    hits = F.filter(F.array(*inside), lambda x: x.isNotNull()) if inside else none
    counts = df.select(F.inline_outer(hits)).filter(F.col("column").isNotNull()).groupBy("column", "prob", "value").agg(F.count("*").alias("n"))
    order = Window.partitionBy("column", "prob").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    placed = counts.join(F.broadcast(targets), ["column", "prob"]).withColumn("upto", F.col("before") + F.sum("n").over(order))

    def at(rank: str):
        return F.max(F.when((F.col(rank) >= F.col("upto") - F.col("n")) & (F.col(rank) < F.col("upto")), F.col("value")))

    ends = placed.groupBy("column", "prob", "share").agg(at("r0").alias("a"), at("r1").alias("b"))
    return ends.select("column", "prob", (F.col("a") + (F.col("b") - F.col("a")) * F.col("share")).alias("value"))


def quantiles(
    df: DataFrame,
    columns: list[str],
    probs: list[float],
    max_distinct: int = PERCENTILE_MAX_DISTINCT,
    rough: dict[str, int] | None = None,
) -> DataFrame:
    """column, prob, value: exact, by the built-in function while its buffer stays bounded.

    ``rough`` is a sketch of the distinct values, when the caller has one.
    """
    rough = approx_distinct(df, columns) if rough is None else rough
    small = [c for c in columns if rough[c] <= max_distinct]
    large = [c for c in columns if rough[c] > max_distinct]
    if not small:
        return selected_quantiles(df, large, probs)
    held = df.agg(*[F.percentile(F.col(c).cast("double"), probs).alias(c) for c in small])
    pairs = F.arrays_zip(F.array(*[F.lit(float(p)) for p in probs]).alias("prob"), F.col("q").alias("value"))
    rows = held.unpivot([], small, "column", "q").select("column", F.inline(pairs)).toDF("column", "prob", "value")
    return rows.unionByName(selected_quantiles(df, large, probs)) if large else rows


def _wide(quantile_rows: DataFrame, names: dict[float, str]) -> DataFrame:
    return quantile_rows.groupBy("column").agg(
        *[F.max(F.when(F.col("prob") == p, F.col("value"))).alias(name) for p, name in names.items()]
    )


def profile_continuous(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """column, dtype, count, null_rate, mean, std, min, q25, q50, q75, max."""
    rough = numeric_sketch(df)
    columns = column_types(df, rough=rough)[0] if columns is None else columns

    def figures(c: str):
        value = F.col(c).cast("double")
        # The inner rounding removes summation noise, which differs with the partitioning.
        return F.struct(
            F.count(value).alias("count"),
            F.round(1 - F.count(value) / F.count("*"), 4).alias("null_rate"),
            F.round(F.round(F.avg(value), 11), 6).alias("mean"),
            F.round(F.round(F.stddev_samp(value), 11), 6).alias("std"),
            F.min(value).alias("min"),
            F.max(value).alias("max"),
        ).alias(c)

    # One wide aggregate in one pass, then one row per column.
    stats = df.agg(*[figures(c) for c in columns]).unpivot([], columns, "column", "s").select("column", "s.*")
    quarters = _wide(quantiles(df, columns, [0.25, 0.5, 0.75], rough=rough), {0.25: "q25", 0.5: "q50", 0.75: "q75"})
    return (
        stats.join(F.broadcast(quarters), "column", "left")
        .join(F.broadcast(column_schema(df)), "column")
        .select("column", "dtype", "count", "null_rate", "mean", "std", "min", "q25", "q50", "q75", "max")
    )


def profile_categorical(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """column, dtype, count, null_rate, n_unique, top_value, top_freq; the smallest value wins a tie."""
    columns = column_types(df)[1] if columns is None else columns
    # NULL is counted like a value here, so one grouping serves all figures.
    counts = long_texts(df, columns).groupBy("column", "value").agg(F.count("*").alias("n"))
    present = F.col("value").isNotNull()
    best = F.min(F.when(present, F.struct((-F.col("n")).alias("n"), F.col("value").alias("value"))))
    stats = counts.groupBy("column").agg(
        F.coalesce(F.sum(F.when(present, F.col("n"))), F.lit(0)).alias("count"),
        F.sum("n").alias("rows"),
        F.count("value").alias("n_unique"),
        best.alias("best"),
    )
    return stats.join(F.broadcast(column_schema(df)), "column").select(
        "column", "dtype", "count",
        F.round(1 - F.col("count") / F.col("rows"), 4).alias("null_rate"),
        "n_unique",
        F.col("best.value").alias("top_value"),
        F.round(-F.col("best.n") / F.col("count"), 4).alias("top_freq"),
    )


def unique_values(df: DataFrame, column: str) -> DataFrame:
    """Distinct non-NULL values as text, sorted."""
    if column not in df.columns:
        raise ValueError(f"unknown column: {column}")
    values = df.select(F.col(column).cast("string").alias("value")).filter(F.col("value").isNotNull())
    return values.distinct().orderBy("value")


def boxplot_stats(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """column, q1, median, q3, whisker_low, whisker_high, n_outliers (fences at 1.5 interquartile ranges)."""
    columns = column_types(df)[0] if columns is None else columns
    rows = _wide(quantiles(df, columns, [0.25, 0.5, 0.75]), {0.25: "q1", 0.5: "median", 0.75: "q3"}).collect()
    # One row per column; a column without values has no box.
    boxes = {row["column"]: row for row in rows if row["q1"] is not None}
    held = [c for c in columns if c in boxes]

    def figures(c: str):
        value, box = F.col(c).cast("double"), boxes[c]
        reach = 1.5 * (box["q3"] - box["q1"])
        inside = value.between(box["q1"] - reach, box["q3"] + reach)
        return F.struct(
            *[F.lit(box[name]).alias(name) for name in ("q1", "median", "q3")],
            F.min(F.when(inside, value)).alias("whisker_low"),
            F.max(F.when(inside, value)).alias("whisker_high"),
            F.count_if(~inside).alias("n_outliers"),
        ).alias(c)

    if not held:
        kinds = "column string, q1 double, median double, q3 double, whisker_low double, whisker_high double, n_outliers long"
        return df.sparkSession.createDataFrame([], kinds)
    # The fences are known here, so one wide aggregate in one pass serves all columns.
    return df.agg(*[figures(c) for c in held]).unpivot([], held, "column", "s").select("column", "s.*")


def cleaning_summary(raw: DataFrame, cleaned: DataFrame, threshold: int = DEFAULTS.cat_threshold) -> DataFrame:
    """One row: rows and columns before and after, column classes, columns with NULLs."""
    continuous, categorical = column_types(cleaned, threshold)
    after = cleaned.agg(
        F.count("*").alias("n_clean_rows"),
        *[F.count(c).alias(c) for c in cleaned.columns],
    )
    gaps = sum(((F.col(c) < F.col("n_clean_rows")).cast("int") for c in cleaned.columns), F.lit(0))
    return after.select(
        raw.agg(F.count("*")).scalar().alias("n_raw_rows"), "n_clean_rows",
        F.lit(len(raw.columns)).alias("n_raw_cols"),
        F.lit(len(cleaned.columns)).alias("n_clean_cols"),
        F.lit(len(raw.columns) - len(cleaned.columns)).alias("n_dropped_cols"),
        F.lit(len(continuous)).alias("n_continuous"),
        F.lit(len(categorical)).alias("n_categorical"),
        gaps.alias("n_missing_cols"),
    )
