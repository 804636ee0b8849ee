"""Numbering with hot groups gives what a plain window gives."""

import random

import pytest
from pyspark.sql import functions as F

import coratings as co


@pytest.fixture(scope="module")
def rows(spark):
    # A third of the rows has key 0, some have none, and values tie a lot.
    rng = random.Random(5)
    data = [
        (rng.choice([0, 0, 0, None, *range(1, 6)]), rng.choice([0.5, 1.0, 1.5]), i)
        for i in range(3000)
    ]
    return co.stored(spark.createDataFrame(data, "k INT, value DOUBLE, id BIGINT"))


@pytest.mark.parametrize("hot_rows", [0, 150, 400, 10_000])
def test_same_as_a_window(rows, hot_rows):
    order = [F.desc("value"), "id"]
    plain = co.number_rows(rows, ["k"], order, "n", hot_rows=1_000_000)
    split = co.number_rows(rows, ["k"], order, "n", hot_rows=hot_rows)
    assert split.dtypes == plain.dtypes
    assert sorted(map(str, split.collect())) == sorted(map(str, plain.collect()))
    assert split.count() == 3000


def test_hot_group_is_spread(spark, monkeypatch):
    kept = []
    from coratings.plans import staging

    def remember(df, compact=False):
        kept.append(staging.stored(df, compact))
        return kept[-1]

    monkeypatch.setattr("coratings.operators.numbering.stored", remember)
    one_key = spark.range(200_000).selectExpr("0 AS k", "id")
    numbered = co.number_rows(one_key, ["k"], ["id"], "n", hot_rows=1000)
    assert numbered.where("n <> id + 1").count() == 0 and numbered.count() == 200_000
    slices = next(df for df in kept if "_slice" in df.columns and "id" in df.columns)
    sizes = [r["count"] for r in slices.groupBy("_slice").count().collect()]
    assert len(sizes) >= 150 and max(sizes) < 4_000


@pytest.mark.parametrize(
    "names",
    [
        ("count", "slice", "shift"),
        ("k", "_slice", "_shift"),
        ("k", "_SLICE", "_place"),
        ("k", "_rows", "_hot_k"),
        ("_hot_k", "_first", "_of_slice"),
    ],
)
def test_column_names_of_the_caller_are_safe(spark, names):
    data = [(i % 2, i, -i) for i in range(50)]
    key, order, other = names
    df = co.stored(spark.createDataFrame(data, f"{key} INT, {order} BIGINT, {other} BIGINT"))
    for hot_rows in (1000, 10):
        got = co.number_rows(df, [key], [order], "n", hot_rows=hot_rows)
        assert got.columns == [*names, "n"]
        assert sorted(map(tuple, got.collect())) == sorted((k, i, -i, i // 2 + 1) for k, i, _ in data)


def test_two_keys(spark):
    data = [(a, b, i) for i in range(300) for a, b in [(i % 2, i % 3)]]
    df = co.stored(spark.createDataFrame(data, "a INT, b INT, id BIGINT"))
    got = co.number_rows(df, ["a", "b"], ["id"], "n", hot_rows=10)
    assert {(r.a, r.b, r.id): r.n for r in got.collect()} == {
        (a, b, i): i // 6 + 1 for a, b, i in data
    }


def test_slices_do_not_grow_with_few_hot_rows(spark, monkeypatch):
    """Each slice is a task and a sample of rows at the driver, so small groups share one."""
    from coratings.operators import numbering
    from coratings.plans import staging

    kept = []
    monkeypatch.setattr(numbering, "stored", lambda df, compact=False: kept.append(staging.stored(df, compact)) or kept[-1])
    monkeypatch.setattr(numbering, "SLICES", 4)
    monkeypatch.setattr(numbering, "SLICE_ROWS", 900)
    many = co.stored(spark.range(6000).selectExpr("id % 100 AS k", "id"))
    numbered = co.number_rows(many, ["k"], ["id"], "n", hot_rows=10)
    assert numbered.where("n <> id div 100 + 1").count() == 0 and numbered.count() == 6000
    slices = next(df for df in kept if "_slice" in df.columns and "id" in df.columns)
    assert 5 <= slices.select("_slice").distinct().count() <= 7
