"""Profiles from stored sketches against exact ranks and counts."""

import random

import pytest

from corpusflow.operators.sketches import DISTINCT_ERROR, RANK_ERROR, ProfileStore

SHARES = [0.01, 0.25, 0.5, 0.75, 0.99]


@pytest.fixture(scope="module")
def parts(spark):
    rng = random.Random(8)
    out = []
    for b in range(4):
        rows = [(rng.gauss(b, 3), rng.randrange(500), None if rng.random() < 0.2 else float(rng.randrange(20))) for _ in range(9000)]
        out.append(rows + [(float("nan"), None, None)] * 10)
    return out


SCHEMA = "x double, n int, few double"


@pytest.fixture(scope="module")
def store(spark, parts, tmp_path_factory):
    store = ProfileStore(spark, str(tmp_path_factory.mktemp("profile")))
    for b, rows in enumerate(parts):
        store.add(b, spark.createDataFrame(rows, SCHEMA), ["x", "n", "few"])
    return store


def test_report_is_within_its_bounds(store, parts):
    got = {r.column: r for r in store.report(SHARES).collect()}
    for i, name in enumerate(["x", "n", "few"]):
        values = sorted(v for rows in parts for v in [r[i] for r in rows] if v is not None and v == v)
        row = got[name]
        assert (row.rows, row.missing) == (4 * 9010, 4 * 9010 - len(values))
        assert (row.low, row.high, row.mean) == (values[0], values[-1], pytest.approx(sum(values) / len(values)))
        assert abs(row.n_distinct - len(set(values))) <= max(1, DISTINCT_ERROR * len(set(values)))
        for share, q in zip(SHARES, row.quantiles):
            below, upto = sum(v < q for v in values) / len(values), sum(v <= q for v in values) / len(values)
            assert below - RANK_ERROR <= share <= upto + RANK_ERROR


def test_new_rows_read_no_old_ones(spark, store, parts, tmp_path):
    """A profile of a batch and the stored sketches of the others is the profile of all."""
    other = ProfileStore(spark, str(tmp_path))
    for b in (0, 1, 2):
        other.add(b, spark.createDataFrame(parts[b], SCHEMA), ["x", "n", "few"])
    before = {r.column: r.rows for r in other.report([0.5]).collect()}
    other.add(3, spark.createDataFrame(parts[3], SCHEMA), ["x", "n", "few"])
    other.add(3, spark.createDataFrame(parts[3], SCHEMA), ["x", "n", "few"])  # a repeated batch counts once
    after = {r.column: r for r in other.report([0.5]).collect()}
    assert before["x"] == 3 * 9010 and after["x"].rows == 4 * 9010
    assert after["n"].n_distinct == {r.column: r for r in store.report([0.5]).collect()}["n"].n_distinct


def test_missing_and_empty(spark, tmp_path):
    store = ProfileStore(spark, str(tmp_path))
    assert store.report([0.5]).collect() == []
    store.add(0, spark.createDataFrame([(None, 1, None), (float("nan"), 1, None)], SCHEMA), ["x", "n", "few"])
    store.add(1, spark.createDataFrame([], SCHEMA), ["x", "n", "few"])
    got = {r.column: r for r in store.report([0.5]).collect()}
    assert (got["x"].rows, got["x"].missing, got["x"].quantiles, got["x"].n_distinct) == (2, 2, None, 0)
    assert got["n"].quantiles == [1.0]
