"""The nearest users by bounds against the plain way."""

import random

import pytest

import coratings as co
from coratings.operators import bounded
from coratings.plans import staging

SCHEMA = "user_id BIGINT, movie_id BIGINT, rating DOUBLE"


def ids(spark, *users):
    return spark.createDataFrame([(u,) for u in users], "user_id BIGINT")


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("metric", co.BOUNDED)
@pytest.mark.parametrize("least", [1, 4])
def test_same_as_knn(spark, metric, least):
    pick = random.Random(least)
    rows = {(u, min(int(pick.expovariate(0.12)), 60)): pick.choice([0.0, *[h / 2 for h in range(1, 11)]]) for u in range(80) for _ in range(pick.randrange(1, 40))}
    ratings = co.stored(spark.createDataFrame([(*x, r) for x, r in rows.items()], SCHEMA).repartition(3))
    targets = ids(spark, 3, 7, 7, 11, 30, 999)
    for k in (5, 200):
        assert rows_of(co.knn_bounded(ratings, targets, metric, k, least)) == rows_of(co.knn(ratings, targets, metric, k, least))


@pytest.mark.parametrize("metric", co.BOUNDED)
def test_few_are_evaluated(spark, metric, monkeypatch):
    """A crowd that differs on rare movies is not looked up in the popular ones."""
    pick = random.Random(1)
    mine = {m: pick.randrange(1, 11) / 2 for m in range(40)}
    rows = [(0, m, r) for m, r in mine.items()]
    for u in range(1, 2000):
        near = u % 100 == 0
        rows += [(u, m, r if near else pick.choice([0.5, 5.0])) for m, r in mine.items() if m < 6 or pick.random() < 0.6]
    ratings = co.stored(spark.createDataFrame(rows, SCHEMA).repartition(3))
    written = []

    def counting(df, compact=False):
        out = staging.stored(df, compact)
        written.append((set(out.columns), out.count()))
        return out

    monkeypatch.setattr(bounded, "stored", counting)
    got = rows_of(co.knn_bounded(ratings, ids(spark, 0), metric, 5, 7))
    assert got == rows_of(co.knn(ratings, ids(spark, 0), metric, 5, 7)) and {r[1] % 100 for r in got} == {0}
    with_bounds = [n for columns, n in written if "bound" in columns]  # all, seeds, evaluated
    assert with_bounds[0] > 1900 and with_bounds[1] == 20 and with_bounds[2] < 100


def test_refused(spark):
    ratings, targets = spark.createDataFrame([], SCHEMA), ids(spark, 1)
    for metric, k, least in (("pearson", 1, 1), ("cosine", -1, 1), ("cosine", 1, 0), ("cosine", 10**6, 1)):
        with pytest.raises(ValueError):
            co.knn_bounded(ratings, targets, metric, k, least)
    assert co.knn_bounded(ratings, targets, "cosine", 1, 1).count() == 0
