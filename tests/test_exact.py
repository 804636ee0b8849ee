"""Measures of ratings off the half-star grid."""

import math
import random
from fractions import Fraction

import pytest

import coratings as co
from coratings.functions.metrics import METRICS

SCHEMA = "user_id BIGINT, movie_id BIGINT, rating DOUBLE"


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def brute(a, b, metric):
    a, b = [Fraction(round(x * 100), 100) for x in a], [Fraction(round(x * 100), 100) for x in b]
    n = len(a)
    if metric == "euclidean":
        return math.sqrt(sum((x - y) ** 2 for x, y in zip(a, b, strict=True)))
    if metric == "manhattan":
        return float(sum(abs(x - y) for x, y in zip(a, b, strict=True)))
    if metric == "pearson":
        a, b = [x - sum(a) / n for x in a], [y - sum(b) / n for y in b]
    below = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(y * y for y in b))
    return float(sum(x * y for x, y in zip(a, b, strict=True))) / below if below else 0.0


@pytest.mark.parametrize("metric", METRICS)
def test_far_from_zero_and_close_together(spark, metric):
    """Ratings about a million apart from zero that differ in the last decimals: squares have 14 digits before those that count."""
    pick = random.Random(2)
    rated = {u: [1_000_000 + pick.randrange(100) / 100 for _ in range(50)] for u in range(4)}
    rated[4] = [1_000_000.25] * 50  # no spread
    rows = [(u, m, r) for u, values in rated.items() for m, r in enumerate(values)]
    targets = spark.createDataFrame([(0,)], "user_id BIGINT")
    got = {r.user_id: r.value for r in co.distances(spark.createDataFrame(rows, SCHEMA), targets, metric, 1, digits=2).collect()}
    for u in range(1, 5):
        assert got[u] == pytest.approx(brute(rated[0], rated[u], metric), rel=1e-12, abs=0.0)


@pytest.mark.parametrize("metric", METRICS)
def test_no_order_of_summation_matters(spark, metric):
    pick = random.Random(3)
    rows = [(u, m, pick.randrange(1, 10**7) / 100) for u in range(12) for m in range(200) if pick.random() < 0.7]
    targets = spark.createDataFrame([(0,), (5,)], "user_id BIGINT")
    results = set()
    for parts in (1, 3, 7):
        pick.shuffle(rows)
        ratings = spark.createDataFrame(rows, SCHEMA).repartition(parts)
        results.add(tuple(rows_of(co.distances(ratings, targets, metric, 1, digits=2))))
    assert len(results) == 1


def test_digits_and_other_joins(spark):
    targets = spark.createDataFrame([(0,)], "user_id BIGINT")
    with pytest.raises(ValueError):
        co.knn(spark.createDataFrame([], SCHEMA), targets, "cosine", 1, 1, co.prefix_overlaps, 2)
    half = spark.createDataFrame([(u, m, 0.5 * (1 + (u * m) % 9)) for u in range(6) for m in range(20)], SCHEMA)
    for metric in ("euclidean", "manhattan"):
        exact, plain = (rows_of(co.distances(half, targets, metric, 1, digits=d)) for d in (1, None))
        assert [r[:2] + r[3:] for r in exact] == [r[:2] + r[3:] for r in plain]
        assert [r[2] for r in exact] == pytest.approx([r[2] for r in plain], rel=1e-14)
