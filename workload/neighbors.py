"""Ratings, measures, neighbours and recommendations."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, functions as F

import coratings as co
from coratings.functions.text import split_genres
from coratings.sinks.reports import distance_lines
from workload import views as v

DENSE_TARGET, SPARSE_TARGET = 1, 7
BATCH = (1, 2, 3)
K = 10
MIN_RATING = 4.0

# Measures over the sums of the ``overlap`` CTE below.
_SPREAD = "sqrt(greatest(s{0}{0} - s{0} * s{0} / n_common, 0.0))"
_DEN = f"({_SPREAD.format('a')} * {_SPREAD.format('b')})"
MEASURES = {
    "euclidean": "coalesce(sqrt(sdd), 0.0)",
    "manhattan": "coalesce(sabs, 0.0)",
    "cosine": "CASE WHEN sqrt(saa) * sqrt(sbb) <> 0 THEN sab / (sqrt(saa) * sqrt(sbb)) ELSE 0.0::DOUBLE END",
    "pearson": f"CASE WHEN n_common > 0 AND {_DEN} <> 0 THEN (sab - sa * sb / n_common) / {_DEN} ELSE 0.0::DOUBLE END",
}
_SUMS = """count(*) AS n_common, sum(a.rating) AS sa, sum(b.rating) AS sb,
         sum(a.rating * b.rating) AS sab, sum(a.rating * a.rating) AS saa,
         sum(b.rating * b.rating) AS sbb, sum(abs(a.rating - b.rating)) AS sabs,
         sum((a.rating - b.rating) * (a.rating - b.rating)) AS sdd"""


# The same over sums of cents, which are whole numbers.
_EXACT = {
    "euclidean": "sqrt(sdd::DOUBLE) / 100.0::DOUBLE",
    "manhattan": "sabs::DOUBLE / 100.0::DOUBLE",
    "cosine": "CASE WHEN saa <> 0 AND sbb <> 0 THEN sab::DOUBLE / (sqrt(saa::DOUBLE) * sqrt(sbb::DOUBLE)) ELSE 0.0::DOUBLE END",
    "pearson": """CASE WHEN n_common * saa <> sa * sa AND n_common * sbb <> sb * sb
      THEN (n_common * sab - sa * sb)::DOUBLE / (sqrt((n_common * saa - sa * sa)::DOUBLE) * sqrt((n_common * sbb - sb * sb)::DOUBLE))
      ELSE 0.0::DOUBLE END""",
}


def _overlap(ratings: str, targets: Iterable[int]) -> str:
    ids = ", ".join(str(t) for t in targets)
    return f"""WITH r AS ({ratings}),
  overlap AS (
  SELECT a.user_id AS target_id, b.user_id, {_SUMS}
  FROM r a JOIN r b ON a.movie_id = b.movie_id AND a.user_id <> b.user_id
  WHERE a.user_id IN ({ids}) GROUP BY 1, 2)"""


def distances_sql(ratings: str, targets: Iterable[int], metric: str, min_common: int, exact: bool = False) -> str:
    return f"""{_overlap(ratings, targets)},
  dist AS (
  SELECT target_id, user_id, {(_EXACT if exact else MEASURES)[metric]} AS value, n_common > 0 AS intersects, n_common
  FROM overlap WHERE n_common >= {min_common})"""


def knn_sql(ratings: str, targets: Iterable[int], metric: str, k: int, min_common: int, exact: bool = False) -> str:
    direction = "DESC" if metric in ("cosine", "pearson") else "ASC"
    return f"""{distances_sql(ratings, targets, metric, min_common, exact)},
  nn AS (
  SELECT target_id, user_id AS neighbor_id,
         row_number() OVER (PARTITION BY target_id ORDER BY value {direction}, user_id) AS neighbor_rank,
         value, intersects, n_common
  FROM dist QUALIFY neighbor_rank <= {k})"""


_RECS = """,
  nr AS (SELECT target_id, neighbor_id, neighbor_rank, movie_id, rating
         FROM nn JOIN r ON r.user_id = nn.neighbor_id),
  recs AS (SELECT *, row_number() OVER (PARTITION BY target_id, neighbor_id
                                        ORDER BY rating DESC, movie_id) AS rec_rank
           FROM nr WHERE rating >= {min_rating} {unseen})"""


def recs_sql(nearest: str, exclude_seen: bool = False) -> str:
    unseen = (
        """AND NOT EXISTS (SELECT 1 FROM r s WHERE s.user_id = nr.target_id
                           AND s.movie_id = nr.movie_id)"""
        if exclude_seen
        else ""
    )
    return nearest + _RECS.format(min_rating=MIN_RATING, unseen=unseen)


def _users(spark: SparkSession, ids: Iterable[int]) -> DataFrame:
    return spark.createDataFrame([(i,) for i in ids], "user_id BIGINT")


def _distances(view, target: int, metric: str, min_common: int):
    return lambda s, d: co.distances(view(s, d), _users(s, [target]), metric, min_common)


def _knn(view, targets: Iterable[int], metric: str, k: int, min_common: int):
    return lambda s, d: co.knn(view(s, d), _users(s, targets), metric, k, min_common)


def _nearest(s: SparkSession, d: str) -> DataFrame:
    return co.stored(co.knn(v.dense(s, d), _users(s, BATCH), "euclidean", 5, 1))


_NEAREST = knn_sql(v.DENSE, BATCH, "euclidean", 5, 1)
_DEBTORS = "SELECT s_suppkey FROM supplier WHERE s_acctbal < 1000"


def _knn_prefix(view, metric: str, min_common: int):
    return lambda s, d: co.knn(view(s, d), _debtors(s, d), metric, 5, min_common, co.prefix_overlaps)


def _debtors(s: SparkSession, d: str) -> DataFrame:
    suppliers = v.table(s, d, "supplier").where("s_acctbal < 1000")
    return suppliers.select(F.col("s_suppkey").alias("user_id"))


QUERIES = {
    "latest_ratings": lambda s, d: v.dense(s, d),
    "latest_ratings_sparse": lambda s, d: v.sparse(s, d),
    "latest_ratings_by_columns": lambda s, d: co.latest_ratings(
        v.table(s, d, "lineitem").select(
            F.col("l_suppkey").alias("user_id"),
            F.col("l_partkey").alias("movie_id"),
            (F.ceil(F.col("l_quantity") / 5) / 2).cast("double").alias("rating"),
            "l_orderkey",
            "l_linenumber",
        ),
        ["l_orderkey", "l_linenumber"],
    ),
    "users": lambda s, d: co.users(v.dense(s, d)),
    "users_total": lambda s, d: co.totals(v.sparse(s, d), v.movies(s, d)),
    "movies_titles": lambda s, d: v.movies(s, d).select("movie_id", "title"),
    "genres_split": lambda s, d: v.movies(s, d).select(
        "movie_id", F.posexplode(split_genres(F.col("genres"))).alias("pos", "genre")
    ),
    "ratings_per_user": lambda s, d: co.ratings_per_user(v.sparse(s, d)),
    "lookup_rating": lambda s, d: co.lookup_ratings(v.dense(s, d), v.requests(s, d)),
    "lookup_rating_sparse": lambda s, d: co.lookup_ratings(v.sparse(s, d), v.requests(s, d)),
    "user_ratings": lambda s, d: co.user_ratings(v.dense(s, d), _users(s, [DENSE_TARGET])),
    "user_ratings_batch": lambda s, d: co.user_ratings(v.dense(s, d), _debtors(s, d)),
    "common_movies": lambda s, d: co.common_movies(v.dense(s, d), v.supplier_pairs(s, d)),
    "common_counts": lambda s, d: co.common_counts(
        co.stored(co.movie_bitmaps(v.dense(s, d))), v.supplier_pairs(s, d)
    ),
    "common_counts_wide": lambda s, d: co.common_counts(
        co.stored(co.movie_bitmaps(v.dense(s, d).withColumn("movie_id", F.col("movie_id") * 37))), v.supplier_pairs(s, d)
    ),
    "pair_report": lambda s, d: co.pair_report(v.dense(s, d), v.supplier_pairs(s, d)),
    "pair_report_sparse": lambda s, d: co.pair_report(v.sparse(s, d), v.supplier_pairs(s, d)),
    "dist_euclidean": _distances(v.dense, DENSE_TARGET, "euclidean", 135),
    "dist_manhattan": _distances(v.dense, DENSE_TARGET, "manhattan", 1),
    "dist_cosine": _distances(v.dense, DENSE_TARGET, "cosine", 1),
    "dist_pearson": _distances(v.dense, DENSE_TARGET, "pearson", 1),
    "dist_euclidean_sparse": _distances(v.sparse, SPARSE_TARGET, "euclidean", 1),
    "dist_manhattan_sparse": _distances(v.sparse, SPARSE_TARGET, "manhattan", 1),
    "dist_cosine_sparse": _distances(v.sparse, SPARSE_TARGET, "cosine", 1),
    "dist_pearson_sparse": _distances(v.sparse, SPARSE_TARGET, "pearson", 1),
    "distance_lines": lambda s, d: distance_lines(
        _distances(v.dense, DENSE_TARGET, "cosine", 1)(s, d)
    ),
    "candidates_total": lambda s, d: co.candidate_totals(v.dense(s, d), _users(s, BATCH), 15),
    "knn_euclidean": _knn(v.dense, [DENSE_TARGET], "euclidean", K, 15),
    "knn_manhattan": _knn(v.dense, [DENSE_TARGET], "manhattan", K, 15),
    "knn_cosine": _knn(v.dense, [DENSE_TARGET], "cosine", K, 15),
    "knn_pearson": _knn(v.dense, [DENSE_TARGET], "pearson", K, 15),
    "knn_sparse": _knn(v.sparse, [SPARSE_TARGET], "euclidean", K, 1),
    "knn_batch": _knn(v.dense, BATCH, "euclidean", 5, 1),
    "knn_unbounded": _knn(v.sparse, BATCH, "manhattan", 1_000_000_000, 1),
    "knn_wide": _knn(v.sparse, BATCH, "cosine", 2000, 1),
    "knn_metrics": _knn(v.dense, BATCH, list(MEASURES), 5, 1),
    **{
        f"dist_{m}_offgrid": lambda s, d, m=m: co.distances(v.offgrid(s, d), _users(s, BATCH), m, 2, digits=2)
        for m in MEASURES
    },
    "knn_offgrid": lambda s, d: co.knn(v.offgrid(s, d), _users(s, BATCH), list(MEASURES), 5, 2, digits=2),
    **{
        f"knn_bounded_{m}": lambda s, d, m=m: co.knn_bounded(v.dense(s, d), _users(s, BATCH), m, 5, 15)
        for m in co.BOUNDED
    },
    "knn_bounded_popular": lambda s, d: co.knn_bounded(v.popular(s, d), _users(s, BATCH), "cosine", 5, 6),
    "knn_prefix": _knn_prefix(v.sparse, "cosine", 3),
    "knn_prefix_popular": _knn_prefix(v.popular, "euclidean", 14),
    **{
        f"dist_{m}_ranked": lambda s, d, m=m: co.ranked(_distances(v.sparse, SPARSE_TARGET, m, 1)(s, d), m)
        for m in MEASURES
    },
    "neighbor_ratings": lambda s, d: co.neighbor_ratings(v.dense(s, d), _nearest(s, d)),
    "neighbor_rating_counts": lambda s, d: _report(s, d).rating_counts,
    "recommend": lambda s, d: co.recommend(v.dense(s, d), _nearest(s, d), MIN_RATING),
    "recommend_titles": lambda s, d: co.recommend(
        v.dense(s, d), _nearest(s, d), MIN_RATING, movies=v.movies(s, d)
    ),
    "recommend_unseen": lambda s, d: co.recommend(
        v.dense(s, d), _nearest(s, d), MIN_RATING, exclude_seen=True
    ),
    "recommend_sparse": lambda s, d: co.neighborhood(
        v.sparse(s, d), _users(s, BATCH), "cosine", 20, 1, MIN_RATING
    ).recommendations,
    "recommend_counts": lambda s, d: _report(s, d).recommendation_counts,
}


def _report(s: SparkSession, d: str):
    targets = _users(s, BATCH)
    return co.neighborhood(v.sparse(s, d), targets, "cosine", 20, 1, MIN_RATING)


_DIST = "SELECT target_id, user_id, value, intersects, n_common FROM dist"
_NN = "SELECT target_id, neighbor_id, neighbor_rank, value, intersects, n_common FROM nn"
_RECS_SPARSE = recs_sql(knn_sql(v.SPARSE, BATCH, "cosine", 20, 1))
_COUNTS = """SELECT nn.target_id, nn.neighbor_id, nn.neighbor_rank, count({0}.movie_id) AS n_rows
  FROM nn LEFT JOIN {0} USING (target_id, neighbor_id) GROUP BY 1, 2, 3"""
_PAIR_REPORT = """WITH r AS ({ratings}), pairs AS ({pairs}),
  sizes AS (SELECT user_id, count(*) AS size FROM r GROUP BY 1),
  sums AS (SELECT user_a, user_b, {sums}
    FROM pairs JOIN r a ON a.user_id = user_a
               JOIN r b ON b.user_id = user_b AND b.movie_id = a.movie_id GROUP BY 1, 2),
  report AS (SELECT p.user_a, p.user_b, coalesce(x.size, 0) AS size_a, coalesce(y.size, 0) AS size_b,
                    sums.* EXCLUDE (user_a, user_b, n_common), coalesce(n_common, 0) AS n_common
    FROM pairs p LEFT JOIN sizes x ON x.user_id = p.user_a LEFT JOIN sizes y ON y.user_id = p.user_b
                 LEFT JOIN sums ON sums.user_a = p.user_a AND sums.user_b = p.user_b)
  SELECT user_a, user_b, size_a, size_b, n_common, n_common > 0 AS intersects, {measures} FROM report"""
_COMMON_COUNTS = f"""WITH r AS ({v.DENSE}), pairs AS ({v.SUPPLIER_PAIRS}),
  counts AS (SELECT user_a, user_b, count(*) AS n FROM pairs JOIN r a ON a.user_id = user_a
             JOIN r b ON b.user_id = user_b AND b.movie_id = a.movie_id GROUP BY 1, 2)
  SELECT user_a, user_b, coalesce(n, 0) AS n_common, n IS NOT NULL AS intersects FROM pairs LEFT JOIN counts USING (user_a, user_b)"""
_LOOKUP = """WITH r AS ({ratings}), q AS ({requests})
  SELECT q.user_id, q.movie_id, r.rating,
         CASE WHEN r.user_id IS NOT NULL THEN 'found'
              WHEN q.user_id IN (SELECT user_id FROM r) THEN 'movie_not_found'
              ELSE 'user_not_found' END AS status
  FROM q LEFT JOIN r ON r.user_id = q.user_id AND r.movie_id = q.movie_id"""


def _pair_report_sql(ratings: str) -> str:
    measures = ", ".join(f"{sql} AS {name}" for name, sql in MEASURES.items())
    return _PAIR_REPORT.format(
        ratings=ratings, pairs=v.SUPPLIER_PAIRS, sums=_SUMS, measures=measures
    )


ORACLES = {
    "latest_ratings": v.DENSE,
    "latest_ratings_sparse": v.SPARSE,
    "latest_ratings_by_columns": v.DENSE,
    "users": "SELECT DISTINCT l_suppkey AS user_id FROM lineitem",
    "users_total": """SELECT 'users' AS kind, count(DISTINCT o_custkey) AS total
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  UNION ALL SELECT 'movies', count(*) FROM part""",
    "movies_titles": f"SELECT movie_id, title FROM ({v.MOVIES})",
    "genres_split": f"""SELECT movie_id, pos, string_split(genres, '|')[pos + 1] AS genre
  FROM ({v.MOVIES}), (SELECT unnest([0, 1])::INTEGER AS pos)""",
    "ratings_per_user": f"SELECT user_id, count(*) AS n_ratings FROM ({v.SPARSE}) GROUP BY 1",
    "lookup_rating": _LOOKUP.format(ratings=v.DENSE, requests=v.REQUESTS),
    "lookup_rating_sparse": _LOOKUP.format(ratings=v.SPARSE, requests=v.REQUESTS),
    "user_ratings": f"SELECT * FROM ({v.DENSE}) WHERE user_id = {DENSE_TARGET}",
    "user_ratings_batch": f"SELECT * FROM ({v.DENSE}) WHERE user_id IN ({_DEBTORS})",
    "common_movies": f"""WITH r AS ({v.DENSE}), pairs AS ({v.SUPPLIER_PAIRS})
  SELECT user_a, user_b, a.movie_id FROM pairs JOIN r a ON a.user_id = user_a
  JOIN r b ON b.user_id = user_b AND b.movie_id = a.movie_id""",
    "common_counts": _COMMON_COUNTS,
    "common_counts_wide": _COMMON_COUNTS,
    "pair_report": _pair_report_sql(v.DENSE),
    "pair_report_sparse": _pair_report_sql(v.SPARSE),
    "dist_euclidean": f"{distances_sql(v.DENSE, [DENSE_TARGET], 'euclidean', 135)} {_DIST}",
    "dist_manhattan": f"{distances_sql(v.DENSE, [DENSE_TARGET], 'manhattan', 1)} {_DIST}",
    "dist_cosine": f"{distances_sql(v.DENSE, [DENSE_TARGET], 'cosine', 1)} {_DIST}",
    "dist_pearson": f"{distances_sql(v.DENSE, [DENSE_TARGET], 'pearson', 1)} {_DIST}",
    "dist_euclidean_sparse": f"{distances_sql(v.SPARSE, [SPARSE_TARGET], 'euclidean', 1)} {_DIST}",
    "dist_manhattan_sparse": f"{distances_sql(v.SPARSE, [SPARSE_TARGET], 'manhattan', 1)} {_DIST}",
    "dist_cosine_sparse": f"{distances_sql(v.SPARSE, [SPARSE_TARGET], 'cosine', 1)} {_DIST}",
    "dist_pearson_sparse": f"{distances_sql(v.SPARSE, [SPARSE_TARGET], 'pearson', 1)} {_DIST}",
    "distance_lines": f"""{distances_sql(v.DENSE, [DENSE_TARGET], 'cosine', 1)}
  SELECT user_id || ' ' || printf('%.10f', value) || ' ' || intersects::INTEGER AS line FROM dist""",
    "candidates_total": f"""{_overlap(v.DENSE, BATCH)}
  SELECT target_id, count(*) AS n_candidates FROM overlap WHERE n_common >= 15 GROUP BY 1""",
    "knn_euclidean": f"{knn_sql(v.DENSE, [DENSE_TARGET], 'euclidean', K, 15)} {_NN}",
    "knn_manhattan": f"{knn_sql(v.DENSE, [DENSE_TARGET], 'manhattan', K, 15)} {_NN}",
    "knn_cosine": f"{knn_sql(v.DENSE, [DENSE_TARGET], 'cosine', K, 15)} {_NN}",
    "knn_pearson": f"{knn_sql(v.DENSE, [DENSE_TARGET], 'pearson', K, 15)} {_NN}",
    "knn_sparse": f"{knn_sql(v.SPARSE, [SPARSE_TARGET], 'euclidean', K, 1)} {_NN}",
    "knn_batch": f"{_NEAREST} {_NN}",
    "knn_unbounded": f"{knn_sql(v.SPARSE, BATCH, 'manhattan', 1_000_000_000, 1)} {_NN}",
    "knn_wide": f"{knn_sql(v.SPARSE, BATCH, 'cosine', 2000, 1)} {_NN}",
    **{f"dist_{m}_offgrid": f"{distances_sql(v.OFFGRID, BATCH, m, 2, exact=True)} {_DIST}" for m in MEASURES},
    "knn_offgrid": " UNION ALL ".join(
        f"SELECT '{m}' AS metric, * FROM ({knn_sql(v.OFFGRID, BATCH, m, 5, 2, exact=True)} {_NN})" for m in MEASURES
    ),
    **{f"knn_bounded_{m}": f"{knn_sql(v.DENSE, BATCH, m, 5, 15)} {_NN}" for m in co.BOUNDED},
    "knn_bounded_popular": f"{knn_sql(v.POPULAR, BATCH, 'cosine', 5, 6)} {_NN}",
    "knn_prefix": f"{knn_sql(v.SPARSE, [_DEBTORS], 'cosine', 5, 3)} {_NN}",
    "knn_prefix_popular": f"{knn_sql(v.POPULAR, [_DEBTORS], 'euclidean', 5, 14)} {_NN}",
    "knn_metrics": " UNION ALL ".join(
        f"SELECT '{m}' AS metric, * FROM ({knn_sql(v.DENSE, BATCH, m, 5, 1)} {_NN})" for m in MEASURES
    ),
    **{
        f"dist_{m}_ranked": f"""{distances_sql(v.SPARSE, [SPARSE_TARGET], m, 1)}
  SELECT target_id, user_id, value, intersects, n_common,
         row_number() OVER (ORDER BY value {'DESC' if m == 'cosine' else 'ASC'}, user_id) AS listing_rank FROM dist"""
        for m in MEASURES
    },
    "neighbor_ratings": f"{recs_sql(_NEAREST)} SELECT * FROM nr",
    "neighbor_rating_counts": f"{_RECS_SPARSE} {_COUNTS.format('nr')}",
    "recommend": f"{recs_sql(_NEAREST)} SELECT * FROM recs",
    "recommend_titles": f"""{recs_sql(_NEAREST)}
  SELECT recs.*, p_name AS title FROM recs LEFT JOIN part ON p_partkey = movie_id""",
    "recommend_unseen": f"{recs_sql(_NEAREST, exclude_seen=True)} SELECT * FROM recs",
    "recommend_sparse": f"{_RECS_SPARSE} SELECT * FROM recs",
    "recommend_counts": f"{_RECS_SPARSE} {_COUNTS.format('recs')}",
}
