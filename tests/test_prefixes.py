"""The prefix-filtered join against the plain one."""

import random
from collections import Counter

import pytest

import coratings as co
from coratings.functions.metrics import METRICS
from coratings.operators import prefixes
from coratings.plans import staging
from oracle import plan_of


def rated(spark, rows):
    return staging.stored(spark.createDataFrame(rows, "user_id BIGINT, movie_id BIGINT, rating DOUBLE").repartition(3))


def ids(spark, *users):
    return spark.createDataFrame([(u,) for u in users], "user_id BIGINT")


def rows_of(sums):
    return sorted(tuple(r) for r in sums.select("target_id", "user_id", "n_common", "sum_a", "sum_ab", "sum_bb", "sum_sq").collect())


@pytest.mark.parametrize("least", [1, 2, 4, 9])
def test_same_as_the_plain_join(spark, least):
    pick = random.Random(least)
    rows = {(u, min(int(pick.expovariate(0.15)), 40)): pick.randrange(1, 10) / 2 for u in range(40) for _ in range(pick.randrange(1, 30))}
    ratings = rated(spark, [(*k, r) for k, r in rows.items()])
    targets = ids(spark, 3, 7, 7, 11, 12, 30, 999)
    want = co.overlaps(ratings, targets, least).where(f"n_common >= {least}")
    got = co.prefix_overlaps(ratings, targets, least)
    assert rows_of(got) == rows_of(want)
    assert rows_of(got) or least == 9


def test_popular_movies_meet_nobody(spark, monkeypatch):
    """Everybody has rated the same eight movies, and a few also the same rare ones."""
    rows = [(u, m, 3.0) for u in range(300) for m in range(8)]
    rows += [(u, 100 + 7 * u + k, 2.0) for u in range(300) for k in range(7)] + [(u, 90 + k, 1.0 + k) for u in (5, 6, 200) for k in range(6)]
    ratings, targets = rated(spark, rows), ids(spark, *range(50))
    joined = []

    def counting(df, compact=False):
        out = staging.stored(df, compact)
        if {"target_place", "place"} <= set(out.columns):
            joined.append(out.count())
        return out

    monkeypatch.setattr(prefixes, "stored", counting)
    got = rows_of(co.prefix_overlaps(ratings, targets, 12))
    want = rows_of(co.overlaps(ratings, targets, 12).where("n_common >= 12"))
    assert got == want and [r[:3] for r in got] == [(5, 6, 14), (5, 200, 14), (6, 5, 14), (6, 200, 14)]
    plain = co.overlaps(ratings, targets).agg({"n_common": "sum"}).first()[0]
    assert sum(joined) < 100 < 100_000 < plain


def test_nobody_reaches_the_threshold(spark):
    ratings = rated(spark, [(1, 1, 1.0), (2, 1, 2.0), (2, 2, 2.0)])
    assert co.prefix_overlaps(ratings, ids(spark, 1), 2).count() == 0
    assert co.prefix_overlaps(ratings, ids(spark, 9), 1).count() == 0
    with pytest.raises(ValueError):
        co.prefix_overlaps(ratings, ids(spark, 1), 0)


@pytest.mark.parametrize("least", [1, 3, 6])
def test_the_most_popular_movies_are_not_joined(spark, monkeypatch, least):
    """Pairs met in the head only, beside it only, or in both; popular movies go into no join."""
    monkeypatch.setattr(prefixes, "HEAD", 7)
    pick = random.Random(least)
    rows = {(u, m): pick.randrange(1, 10) / 2 for u in range(60) for m in pick.sample(range(7), pick.randrange(0, 8))}
    rows |= {(u, 10 + min(int(pick.expovariate(0.2)), 30)): pick.randrange(1, 10) / 2 for u in range(60) for _ in range(12)}
    ratings, targets, joined = rated(spark, [(*k, r) for k, r in rows.items()]), ids(spark, *range(0, 60, 3), 999), []

    def kept(df, compact=False):
        out = staging.stored(df, compact)
        if {"target_place", "place"} <= set(out.columns):
            joined.append(out)
        return out

    top = {m for m, _ in sorted(Counter(m for _, m in rows).items(), key=lambda x: (-x[1], -x[0]))[:7]}
    monkeypatch.setattr(prefixes, "stored", kept)
    want = rows_of(co.overlaps(ratings, targets, least).where(f"n_common >= {least}"))
    assert rows_of(co.prefix_overlaps(ratings, targets, least)) == want and want
    assert len(joined) == 1 and not top & {r.movie_id for r in joined[0].select("movie_id").collect()}


def test_no_row_of_a_pair_that_meets_in_the_head(spark, monkeypatch):
    """All is popular: pairs are compared where they lie, and no step writes a row per pair."""
    rows = [(u, m, 1.0 + (u + m) % 5) for u in range(200) for m in range(20) if (u * 7 + m * 3) % 5]
    ratings, targets, sizes = rated(spark, rows), ids(spark, *range(100)), []

    def counting(df, compact=False):
        out = staging.stored(df, compact)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(prefixes, "stored", counting)
    monkeypatch.setattr(prefixes, "TASK_PAIRS", 5_000)
    got = rows_of(co.prefix_overlaps(ratings, targets, 4))
    assert got == rows_of(co.overlaps(ratings, targets, 4).where("n_common >= 4")) and len(got) == 100 * 199
    assert max(sizes) <= len(rows)


def test_movies_of_the_head_rated_twice(spark):
    rows = [(u, m, 1.0 + (u + m) % 5) for u in range(6) for m in range(5)] + [(2, 4, 0.5), (3, 0, None)]
    ratings, targets = rated(spark, rows), ids(spark, 1, 2, 3)
    want = co.overlaps(ratings, targets, 2).where("n_common >= 2")
    assert rows_of(co.prefix_overlaps(ratings, targets, 2)) == rows_of(want)


def popular(spark, value, users=150):
    """Everybody has rated most of 16 movies."""
    pick = random.Random(5)
    return rated(spark, [(u, m, value(pick)) for u in range(users) for m in range(16) if pick.random() < 0.7] + [(None, m, value(pick)) for m in range(9)])


VALUES = {
    "halves": lambda pick: pick.randrange(0, 11) / 2,
    "highest": lambda pick: pick.choice([0.0, 63.5, 127.5]),
    "tenths": lambda pick: pick.randrange(1, 50) / 10,
    "below zero": lambda pick: pick.randrange(-4, 5) / 2,
    "huge": lambda pick: pick.choice([1e300, 2.0, float("nan")]),
}


@pytest.mark.parametrize("values, most", [*[(v, None) for v in VALUES], ("halves", 8), ("tenths", 8)])
def test_sums_of_the_head(spark, monkeypatch, values, most):
    """All sums, of ratings that are halves or not, with targets broadcast or dealt into blocks; nothing is a cross join."""
    if most:
        monkeypatch.setattr(prefixes, "_HEAD_ROWS", {True: most, False: most})
        monkeypatch.setattr(prefixes, "TASK_PAIRS", 500)
    ratings, targets = popular(spark, VALUES[values], 60), ids(spark, *range(30), 999)
    want, got = co.overlaps(ratings, targets, 6).where("n_common >= 6"), co.prefix_overlaps(ratings, targets, 6)
    plan = plan_of(got)
    assert "NestedLoop" not in plan and "Cartesian" not in plan and ("ShuffledHashJoin" in plan) == bool(most)
    key = lambda df: {(r.target_id, r.user_id, r.n_common): [*r[3:]] for r in df.select(want.columns).collect()}
    want, got = key(want), key(got)
    assert want.keys() == got.keys() and len(want) > 300
    assert all(got[k] == (pytest.approx(want[k], rel=1e-9, nan_ok=True) if values in ("tenths", "huge") else want[k]) for k in want)


@pytest.mark.parametrize("values, metric", [*[("halves", m) for m in METRICS], ("tenths", "euclidean")])
def test_nearest_of_few_users_bound_those_of_all(spark, monkeypatch, metric, values):
    """What is farther than k users of a few is dropped where it is met; the k nearest are those of the plain join."""
    targets = ids(spark, *range(0, 400, 9))
    ratings = popular(spark, (lambda pick: float(pick.randrange(1, 4))) if values == "halves" else VALUES[values], 400)

    monkeypatch.setattr(prefixes, "BOUND_PAIRS", 0)
    fields = lambda df: sorted((r.target_id, r.neighbor_rank, r.neighbor_id, round(r.value, 9), r.n_common) for r in df.collect())
    want = fields(co.knn(ratings, targets, metric, 3, 9))
    assert fields(co.knn(ratings, targets, metric, 3, 9, co.prefix_overlaps)) == want and len(want) > 100
    all_pairs = co.prefix_overlaps(ratings, targets, 9).count()
    assert co.prefix_overlaps(ratings, targets, 9, nearest=(metric, 3)).count() < all_pairs / 2
