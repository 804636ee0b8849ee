"""Seven users worked out by hand: disjoint, constant, one in common, zero."""

import math

import pytest

import coratings as co
from coratings.operators.recommend import recommend_from

ROWS = {
    1: [(10, 4.0), (20, 5.0), (30, 3.0), (40, 0.5)],
    2: [(10, 4.0), (20, 4.0), (30, 2.5), (50, 1.0), (50, 5.0)],
    3: [(10, 1.0), (20, 5.0), (30, 3.0), (40, 4.5)],
    4: [(50, 4.0)],
    5: [(10, 3.5), (20, 3.5), (30, 3.5)],
    6: [(20, 2.0)],
    7: [(10, 0.0), (20, 0.0)],
}
# user: overlap, euclidean, manhattan, cosine, pearson against user 1
AGAINST_1 = {
    1: (4, 0.0, 0.0, 1.0, 1.0),
    2: (3, 1.1180339887, 1.5, 0.9946917938, 0.8660254038),
    3: (4, 5.0, 7.0, 0.7638915579, -0.1861098372),
    4: (0, 0.0, 0.0, 0.0, 0.0),
    5: (3, 1.6583123952, 2.5, 0.9797958971, 0.0),
    6: (1, 3.0, 3.0, 1.0, 0.0),
    7: (2, 6.4031242374, 9.0, 0.0, 0.0),
    99: (0, 0.0, 0.0, 0.0, 0.0),
}


@pytest.fixture(scope="module")
def ratings(spark):
    lines = [
        (u, m, r, at)
        for at, (u, m, r) in enumerate((u, m, r) for u, rated in ROWS.items() for m, r in rated)
    ]
    raw = spark.createDataFrame(lines, "user_id BIGINT, movie_id BIGINT, rating DOUBLE, at BIGINT")
    return co.stored(co.latest_ratings(raw, "at"))


def ids(spark, *users):
    return spark.createDataFrame([(u,) for u in users], "user_id BIGINT")


def column(df, name):
    return [row[name] for row in df.collect()]


def test_last_rating_wins(ratings):
    assert ratings.where("user_id = 2 AND movie_id = 50").collect()[0].rating == 5.0
    assert ratings.count() == 19


def test_pair_report(spark, ratings):
    pairs = spark.createDataFrame([(1, u) for u in AGAINST_1], "user_a BIGINT, user_b BIGINT")
    report = {row.user_b: row for row in co.pair_report(ratings, pairs).collect()}
    assert set(report) == set(AGAINST_1)
    sizes = {u: len({m for m, _ in rated}) for u, rated in ROWS.items()}
    for user, (n, *measures) in AGAINST_1.items():
        row = report[user]
        assert (row.size_a, row.size_b, row.n_common) == (4, sizes.get(user, 0), n)
        assert row.intersects == (n > 0)
        got = (row.euclidean, row.manhattan, row.cosine, row.pearson)
        assert got == pytest.approx(measures, abs=1e-9)


def test_measures_are_symmetric(spark, ratings):
    users = [*ROWS, 99]
    pairs = spark.createDataFrame(
        [(a, b) for a in users for b in users], "user_a BIGINT, user_b BIGINT"
    )
    report = {(r.user_a, r.user_b): r for r in co.pair_report(ratings, pairs).collect()}
    for (a, b), row in report.items():
        twin = report[b, a]
        assert (row.n_common, row.euclidean, row.manhattan) == (
            twin.n_common,
            twin.euclidean,
            twin.manhattan,
        )
        assert row.cosine == pytest.approx(twin.cosine)
        assert row.pearson == pytest.approx(twin.pearson)
        assert row.manhattan >= row.euclidean
        assert -1e-9 <= row.cosine <= 1 + 1e-9 and abs(row.pearson) <= 1 + 1e-9


@pytest.mark.parametrize(
    "metric, min_common, expected",
    [
        ("euclidean", 1, [2, 5, 6, 3, 7]),
        ("euclidean", 3, [2, 5, 3]),
        ("euclidean", 0, [2, 5, 6, 3, 7]),
        ("euclidean", 5, []),
        ("manhattan", 1, [2, 5, 6, 3, 7]),
        ("cosine", 1, [6, 2, 5, 3, 7]),
        ("pearson", 1, [3, 5, 6, 7, 2]),
    ],
)
def test_distances(spark, ratings, metric, min_common, expected):
    found = co.distances(ratings, ids(spark, 1), metric, min_common)
    assert column(found, "user_id") == expected


def test_pearson_of_constant_off_grid_is_zero(spark):
    rows = [(u, m, r) for u, r in ((1, 0.1), (2, 0.7)) for m in range(7)]
    rows += [(3, m, float(m)) for m in range(7)]
    ratings = spark.createDataFrame(rows, "user_id BIGINT, movie_id BIGINT, rating DOUBLE")
    found = co.distances(ratings, ids(spark, 3), "pearson", 1).collect()
    assert all(math.isfinite(row.value) and abs(row.value) < 1e-6 for row in found)


def test_unknown_target_and_empty_ratings(spark, ratings):
    assert co.distances(ratings, ids(spark, 99), "cosine", 1).count() == 0
    assert co.knn(ratings.limit(0), ids(spark, 1), "cosine", 3, 1).count() == 0


def test_unknown_metric(spark, ratings):
    with pytest.raises(ValueError):
        co.distances(ratings, ids(spark, 1), "chebyshev", 1)


def nearest(spark, ratings, k, metric="euclidean", min_common=1):
    found = co.knn(ratings, ids(spark, 1), metric, k, min_common).orderBy("neighbor_rank")
    return [(row.neighbor_rank, row.neighbor_id) for row in found.collect()]


def test_knn(spark, ratings):
    assert nearest(spark, ratings, 2, min_common=3) == [(1, 2), (2, 5)]
    assert nearest(spark, ratings, 0) == []
    assert nearest(spark, ratings, 2, "pearson") == [(1, 2), (2, 5)]
    everybody = nearest(spark, ratings, 100)
    assert [user for _, user in everybody] == [2, 5, 6, 3, 7]
    for k in range(5):
        assert nearest(spark, ratings, k) == everybody[:k]
    with pytest.raises(ValueError):
        nearest(spark, ratings, -1)


def test_knn_beyond_the_window(spark, ratings, monkeypatch):
    everybody = nearest(spark, ratings, 100)
    monkeypatch.setattr("coratings.operators.neighbors.window_k", lambda spark: 1)
    monkeypatch.setattr("coratings.operators.numbering.HOT_ROWS", 2)
    assert nearest(spark, ratings, 100) == everybody
    assert nearest(spark, ratings, 3) == everybody[:3]


def test_recommendations(spark, ratings):
    neighbors = co.stored(co.knn(ratings, ids(spark, 1), "euclidean", 2, 3))
    recs = co.recommend(ratings, neighbors, 4.0).orderBy("neighbor_rank", "rec_rank")
    assert [(r.neighbor_id, r.rec_rank, r.movie_id, r.rating) for r in recs.collect()] == [
        (2, 1, 50, 5.0),
        (2, 2, 10, 4.0),
        (2, 3, 20, 4.0),
    ]
    unseen = co.recommend(ratings, neighbors, 4.0, exclude_seen=True)
    assert column(unseen, "movie_id") == [50]
    counts = co.rows_per_neighbor(neighbors, recs).orderBy("neighbor_rank")
    assert column(counts, "n_rows") == [3, 0]
    listed = co.neighbor_ratings(ratings, neighbors)
    assert column(listed, "movie_id") == [50, 10, 20, 30, 10, 20, 30]
    counts = co.rows_per_neighbor(neighbors, listed).orderBy("neighbor_rank")
    assert column(counts, "n_rows") == [4, 3]


def test_titles(spark, ratings):
    movies = spark.createDataFrame(
        [(50, "Fifty", None), (10, "Ten", None)],
        "movie_id BIGINT, title STRING, genres ARRAY<STRING>",
    )
    neighbors = co.stored(co.knn(ratings, ids(spark, 1), "euclidean", 1, 3))
    recs = co.recommend(ratings, neighbors, 4.0, movies=movies).orderBy("rec_rank")
    assert column(recs, "title") == ["Fifty", "Ten", None]


def test_recommendations_with_hot_neighbors(spark, ratings, monkeypatch):
    neighbors = co.stored(co.knn(ratings, ids(spark, 1, 3), "euclidean", 3, 1))
    plain = sorted(map(tuple, co.recommend(ratings, neighbors, 1.0).collect()))
    monkeypatch.setattr("coratings.operators.numbering.HOT_ROWS", 1)
    split = sorted(map(tuple, co.recommend(ratings, neighbors, 1.0).collect()))
    assert plain == split and len(plain) > 6


def test_higher_threshold_only_removes(spark, ratings):
    neighbors = co.stored(co.knn(ratings, ids(spark, 1), "euclidean", 5, 1))
    rows = co.neighbor_ratings(ratings, neighbors)
    before = None
    for min_rating in (0.0, 2.5, 4.0, 5.5):
        recs = {(r.neighbor_id, r.movie_id) for r in recommend_from(rows, min_rating).collect()}
        assert before is None or recs <= before
        before = recs
    assert before == set()


def test_lookups(spark, ratings):
    asked = [(1, 10), (1, 99), (99, 10), (1, 10)]
    requests = spark.createDataFrame(asked, "user_id BIGINT, movie_id BIGINT")
    found = sorted(tuple(r) for r in co.lookup_ratings(ratings, requests).fillna(-1.0).collect())
    assert found == [
        (1, 10, 4.0, "found"),
        (1, 10, 4.0, "found"),
        (1, 99, -1.0, "movie_not_found"),
        (99, 10, -1.0, "user_not_found"),
    ]


def test_user_ratings(spark, ratings):
    rated = co.user_ratings(ratings, ids(spark, 2, 99))
    assert [(r.movie_id, r.rating) for r in rated.collect()] == [
        (10, 4.0),
        (20, 4.0),
        (30, 2.5),
        (50, 5.0),
    ]


def test_common_movies(spark, ratings):
    pairs = spark.createDataFrame([(1, 3), (1, 4), (1, 1), (1, 99)], "user_a BIGINT, user_b BIGINT")
    common = co.common_movies(ratings, pairs).orderBy("user_b", "movie_id").collect()
    assert [(r.user_b, r.movie_id) for r in common] == [
        (b, m) for b in (1, 3) for m in (10, 20, 30, 40)
    ]


def test_counts(spark, ratings):
    movies = spark.createDataFrame([(10,), (20,)], "movie_id BIGINT")
    assert {r.kind: r.total for r in co.totals(ratings, movies).collect()} == {
        "users": 7,
        "movies": 2,
    }
    per_user = {r.user_id: r.n_ratings for r in co.ratings_per_user(ratings).collect()}
    assert per_user == {1: 4, 2: 4, 3: 4, 4: 1, 5: 3, 6: 1, 7: 2}
    left = co.candidate_totals(ratings, ids(spark, 1), 3).collect()
    assert [(r.target_id, r.n_candidates) for r in left] == [(1, 3)]


@pytest.fixture
def shuffled_joins(spark, monkeypatch):
    """No side counts as small, neither for the library nor for Spark."""
    monkeypatch.setattr("coratings.plans.staging.BROADCAST_ROWS", -1)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")


def test_large_sides_are_shuffled(spark, ratings, shuffled_joins):
    test_pair_report(spark, ratings)
    test_distances(spark, ratings, "cosine", 1, [6, 2, 5, 3, 7])
    test_recommendations(spark, ratings)
    test_lookups(spark, ratings)
    test_common_movies(spark, ratings)
    plan = co.distances(ratings, ids(spark, 1), "cosine", 1)._jdf.queryExecution().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
