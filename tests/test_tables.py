import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from corpusflow.operators import cleaning, labels, profile
from corpusflow.options import Options


def test_percent_share_must_be_exceeded(spark):
    rows = [("1%", "1%")] * 8 + [("x", "2%"), ("y", "x")]
    df = spark.createDataFrame(rows, "a string, b string")
    assert cleaning.percent_columns(df) == ["b"]


def test_numeric_share_may_be_met(spark):
    rows = [("1", "1")] * 4 + [("x", None), ("2", None)]
    df = spark.createDataFrame(rows[:5], "a string, b string")
    assert cleaning.numeric_text_columns(df) == ["a", "b"]


def test_missing_share_must_be_exceeded(spark):
    rows = [(1, None, None)] * 3 + [(2, 5, None)] + [(3, 5, 1)] * 6
    df = spark.createDataFrame(rows, "k int, at int, above int")
    assert cleaning.drop_high_missing(df).columns == ["k", "at"]


def test_single_value_with_null_stays(spark):
    df = spark.createDataFrame([(1, "x", None, "c"), (2, None, None, "c")], "k int, some string, none string, c string")
    assert cleaning.drop_single_valued(df).columns == ["k", "some"]


def test_clean(spark):
    rows = [(str(i % 5), f"{i}%", " 36 months", "10+ years", "x", str(i) if i else "n/a") for i in range(20)]
    df = spark.createDataFrame(rows + rows[:3], "id string, rate string, term string, emp_length string, fixed string, amount string")
    out = cleaning.clean(df)
    assert out.columns == ["rate", "amount"] and out.count() == 20
    assert dict(out.dtypes) == {"rate": "double", "amount": "double"}
    summary = profile.cleaning_summary(df, out).first()
    assert (summary.n_raw_rows, summary.n_clean_rows, summary.n_dropped_cols, summary.n_missing_cols) == (23, 20, 4, 1)


def test_nan_becomes_null(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),)], "x double")
    assert cleaning.normalise_nan(df).filter("x is null").count() == 1


@pytest.fixture(scope="module")
def numbers(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({
        "flat": rng.normal(size=3000),
        "hot": np.where(rng.random(3000) < 0.4, 7.0, rng.integers(0, 900, 3000).astype(float)),
        "few": rng.integers(0, 4, 3000).astype(float),
    })
    return pdf, spark.createDataFrame(pdf).repartition(5)


@pytest.mark.parametrize("max_distinct, rows", [(10**6, 10**5), (1, 10**5), (1, 40)])
def test_quantiles_are_exact(numbers, max_distinct, rows, monkeypatch):
    """With a limit of 1 value the distributed way is taken; few rows per range force it to narrow."""
    monkeypatch.setattr(profile.selected_quantiles, "__defaults__", (rows,))
    monkeypatch.setattr(profile, "SKETCH_ACCURACY", 100 if rows < 100 else 10_000)
    pdf, df = numbers
    probs = [0.0, 0.25, 0.5, 0.75, 0.95, 1.0]
    got = {(r.column, r.prob): r.value for r in profile.quantiles(df, list(pdf.columns), probs, max_distinct).collect()}
    assert len(got) == len(probs) * 3
    for (column, prob), value in got.items():
        assert value == pytest.approx(pdf[column].quantile(prob), abs=1e-12)


def test_quantiles_of_tiny_columns(spark):
    for values in ([5.0], [1.0, 2.0], [1.0, 1.0, 9.0]):
        df = spark.createDataFrame([(v,) for v in values], "x double")
        got = {r.prob: r.value for r in profile.selected_quantiles(df, ["x"], [0.25, 0.5]).collect()}
        assert got == {p: pytest.approx(pd.Series(values).quantile(p)) for p in (0.25, 0.5)}


def test_profile_continuous(numbers):
    pdf, df = numbers
    row = {r.column: r for r in profile.profile_continuous(df).collect()}
    assert set(row) == {"flat", "hot"}
    assert row["flat"]["mean"] == pytest.approx(pdf["flat"].mean(), abs=1e-6)
    assert row["flat"]["std"] == pytest.approx(pdf["flat"].std(), abs=1e-6)


def test_exactly_ten_values_are_categorical(spark):
    df = spark.createDataFrame([(i % 10, i % 11, "t") for i in range(200)], "ten int, eleven int, t string")
    assert profile.column_types(df) == (["eleven"], ["ten", "t"])


def test_profile_categorical(spark):
    df = spark.createDataFrame([("b", None), ("a", None), ("b", None), ("a", None), (None, None)], "x string, y string")
    row = {r.column: r for r in profile.profile_categorical(df).collect()}
    assert (row["x"]["count"], row["x"].null_rate, row["x"].n_unique, row["x"].top_value, row["x"].top_freq) == (4, 0.2, 2, "a", 0.5)
    assert (row["y"]["count"], row["y"].n_unique, row["y"].top_value, row["y"].top_freq) == (0, 0, None, None)


def test_unknown_column(spark):
    with pytest.raises(ValueError):
        profile.unique_values(spark.range(2), "nope")


def test_bad_wins_over_good(spark):
    df = spark.createDataFrame([("a",), ("b",), ("c",)], "s string")
    got = {r.s: r.target for r in labels.label_rows(df, "s", ["a", "b"], ["b"]).collect()}
    assert got == {"a": 0, "b": 1}
    row = labels.label_summary(df, "s", ["a", "b"], ["b"]).first()
    assert (row.n_total, row.n_good, row.n_bad, row.good_ratio, row.bad_ratio) == (2, 2, 1, 100.0, 50.0)


def test_empty_label_summary(spark):
    row = labels.label_summary(spark.createDataFrame([("z",)], "s string"), "s", ["a"], ["b"]).first()
    assert tuple(row) == (0, 0, 0, 0.0, 0.0)


def test_histogram_equals_numpy(spark):
    rng = np.random.default_rng(4)
    data = {0: rng.normal(size=300), 1: rng.normal(3, 2, size=200)}
    df = spark.createDataFrame([(t, float(v)) for t, vs in data.items() for v in vs], "target int, x double")
    rows = labels.histogram_by_class(df, ["x"]).collect()
    bins = min(50, max(10, int(500**0.5)))
    for target, values in data.items():
        counts, edges = np.histogram(values, bins=bins)
        got = {r.bin: r.n for r in rows if r.target == target}
        assert [got.get(i, 0) for i in range(bins)] == list(counts)


def test_histogram_of_one_value(spark):
    df = spark.createDataFrame([(0, 2.0)] * 4, "target int, x double")
    rows = labels.histogram_by_class(df, ["x"]).collect()
    assert [(r.bin, r.n) for r in rows] == [(5, 4)]


def test_columns_with_many_categories_are_left_out(spark):
    df = spark.createDataFrame([(i % 2, str(i), "ab"[i % 2]) for i in range(30)], "target int, wide string, narrow string")
    rows = labels.bad_rate_by_category(df, ["wide", "narrow"]).orderBy(F.desc("bad_rate")).collect()
    assert [(r.column, r.value, r.bin_count, r.bad_rate, r.bin_rate) for r in rows] == [
        ("narrow", "b", 15, 1.0, 0.5), ("narrow", "a", 15, 0.0, 0.5),
    ]


def test_thresholds_are_options(spark):
    df = spark.createDataFrame([(None, 1), (2, 2), (3, 3)], "a int, b int")
    assert cleaning.clean(df, Options(missing_threshold=0.2)).columns == ["b"]
