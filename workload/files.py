"""Sources and outputs: tables written as files of the expected form and read
back by the library, and its own outputs read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

import coratings as co
from coratings.plans.staging import scratch_root
from coratings.sinks import reports
from coratings.sinks.upsert import read_version, upsert
from coratings.sources.recordings import CATALOG_COLUMNS, list_recordings, match_catalog, read_catalog
from coratings.sources.tables import accepted, read_movies, read_names, read_ratings, rejected
from workload import neighbors as n
from workload import views as v


def _folder(s: SparkSession) -> str:
    return f"{scratch_root(s)}/{uuid.uuid4().hex}"


def _csv(df: DataFrame) -> str:
    path = _folder(df.sparkSession)
    df.write.options(header=True, quote='"', escape='"').csv(path)
    return path


def _ratings_csv(s: SparkSession, d: str) -> str:
    """Ratings in the order they were given; lines of returned items are
    spoilt by a rating that is no number."""
    rating = F.ceil(F.col("l_quantity") / 5) / 2
    lines = v.table(s, d, "lineitem").orderBy("l_orderkey", "l_linenumber", "l_quantity")
    return _csv(
        lines.select(
            F.col("l_suppkey").alias("userId"),
            F.col("l_partkey").alias("movieId"),
            F.when(F.col("l_returnflag") == "R", F.lit("none")).otherwise(rating.cast("string")).alias("rating"),
            F.unix_timestamp("l_shipdate").alias("timestamp"),
        )
    )


def _read_ratings(s: SparkSession, d: str) -> DataFrame:
    return read_ratings(s, _ratings_csv(s, d))


_REQUIRED = ("user_id", "movie_id", "rating")


def _movies_csv(s: SparkSession, d: str) -> str:
    title = F.concat("p_name", F.lit(', "'), "p_brand", F.lit('"'))
    return _csv(
        v.table(s, d, "part").select(
            F.col("p_partkey").alias("movieId"),
            title.alias("title"),
            F.concat_ws("|", "p_brand", "p_type").alias("genres"),
        )
    )


def _movies_from_csv(s: SparkSession, d: str) -> DataFrame:
    movies = co.latest_movies(accepted(read_movies(s, _movies_csv(s, d))), "load_order")
    return movies.select("movie_id", "title", F.concat_ws("/", "genres").alias("genres"))


def _names_from_csv(s: SparkSession, d: str) -> DataFrame:
    people = v.table(s, d, "customer").select(
        F.col("c_name").alias("Name"), F.lower("c_mktsegment").alias("Role")
    )
    return co.count_uppercase(accepted(read_names(s, _csv(people))), "Name", by="Role")


def _movies_upsert(s: SparkSession, d: str) -> DataFrame:
    """Every part twice in one file, the second time under another title."""
    part = v.table(s, d, "part").select(F.explode(F.array(F.lit(0), F.lit(1))).alias("n"), "*")
    lines = part.orderBy("n", "p_partkey").select(
        F.col("p_partkey").alias("movieId"),
        F.when(F.col("n") == 0, F.col("p_name")).otherwise(F.concat("p_name", F.lit(", again"))).alias("title"),
        F.concat_ws("|", "p_brand", "p_type").alias("genres"),
    )
    movies = co.latest_movies(accepted(read_movies(s, _csv(lines))), "load_order")
    return movies.select("movie_id", "title", F.concat_ws("/", "genres").alias("genres"))


def _catalog_csv(s: SparkSession, d: str) -> str:
    """Recordings as lines; of some the rate or the frame count is no number."""
    key = F.col("video_id")
    return _csv(
        v.videos(s, d).select(
            "path",
            F.when(key % 11 == 0, F.lit("thirty")).otherwise(F.col("fps").cast("string")).alias("fps"),
            F.when(key % 7 == 0, F.lit("abc")).when(key % 5 == 0, F.lit(None)).otherwise(F.col("total_frames").cast("string")).alias("total_frames"),
        )
    )


def _catalog_rejects(s: SparkSession, d: str) -> DataFrame:
    lines = rejected(read_catalog(s, _catalog_csv(s, d)), *CATALOG_COLUMNS)
    return lines.groupBy("path").agg(F.count("*").alias("n_rejected"))


def _catalog_from_csv(s: SparkSession, d: str) -> DataFrame:
    lines = accepted(read_catalog(s, _catalog_csv(s, d)), *CATALOG_COLUMNS)
    return lines.select(*CATALOG_COLUMNS)


def _lines(s: SparkSession, write, *args) -> DataFrame:
    path = _folder(s)
    write(*args, path)
    return s.read.text(path).withColumnRenamed("value", "line")


def _distances_report(s: SparkSession, d: str) -> DataFrame:
    found = n.QUERIES["dist_euclidean_sparse"](s, d)
    return _lines(s, reports.write_distances, found)


def _common_report(s: SparkSession, d: str) -> DataFrame:
    pair = s.createDataFrame([(1, 2)], "user_a BIGINT, user_b BIGINT")
    return _lines(s, reports.write_common_movies, co.common_movies(v.dense(s, d), pair))


def _neighborhood_tables(s: SparkSession, d: str, name: str) -> DataFrame:
    path = _folder(s)
    targets = s.createDataFrame([(t,) for t in n.BATCH], "user_id BIGINT")
    result = co.neighborhood(v.dense(s, d), targets, list(n.MEASURES), 5, 1, n.MIN_RATING)
    co.write_neighborhood(result, path, list(n.MEASURES), release_after=True)
    return s.read.parquet(f"{path}/{name}")


def _report_overwritten(s: SparkSession, d: str) -> DataFrame:
    path = _folder(s)
    reports.write_users(v.sparse(s, d), path)
    reports.write_users(v.dense(s, d), path)
    return s.read.text(path).withColumnRenamed("value", "line")


def _neighborhood_lines(s: SparkSession, d: str) -> DataFrame:
    """The text views of neighbours and recommendations, one after the other."""
    targets = s.createDataFrame([(n.DENSE_TARGET,)], "user_id BIGINT")
    result = co.neighborhood(v.dense(s, d), targets, "cosine", 5, 1, n.MIN_RATING)
    return reports.neighbor_lines(result.neighbors).union(reports.rated_lines(result.recommendations))


def _written_totals(s: SparkSession, d: str) -> DataFrame:
    """What the writers of the reports say they have written."""
    ratings = co.stored(v.sparse(s, d))
    found = n.QUERIES["dist_euclidean_sparse"](s, d)
    totals = [
        ("users", reports.write_users(ratings, _folder(s))),
        ("movies", reports.write_movies(v.movies(s, d), _folder(s))),
        ("candidates", reports.write_distances(found, _folder(s))),
        ("ratings", reports.write_table(ratings, _folder(s))),
        ("nobody", reports.write_distances(found.where("n_common < 0"), _folder(s))),
    ]
    return s.createDataFrame(totals, "kind STRING, total BIGINT")


def _catalog_joined(s: SparkSession, d: str) -> DataFrame:
    """A recording a month, its file with a line for each order; every fifth
    month has no file and every seventh no catalog row."""
    orders = v.table(s, d, "orders")
    month = (F.year("o_orderdate") * 12 + F.month("o_orderdate")).alias("month")
    name = F.date_format(F.trunc("o_orderdate", "month"), "yyyy-MM-dd_HH-mm-ss").alias("recording")
    lines = co.stored(orders.select(month, name, F.col("o_orderkey").cast("string").alias("line")))
    folder = _folder(s)
    lines.where("month % 5 <> 0").repartition("recording").select("recording", "line").write.partitionBy("recording").text(folder)
    catalog = lines.where("month % 7 <> 0").groupBy("recording").agg(F.count("*").alias("total_frames")).select(
        F.concat(F.lit("/v/"), "recording", F.lit(".mkv")).alias("path"), F.lit(30.0).alias("fps"), "total_frames"
    )
    named = F.regexp_extract("path", "recording=([^/]+)/", 1)
    matched = match_catalog(catalog, list_recordings(s, folder, "*.txt"), named)
    return matched.select("name", "path", "fps", "total_frames", "length", "status")


def _indexed(s: SparkSession, ratings: DataFrame) -> DataFrame:
    return co.write_indexed(ratings, f"ratings_{uuid.uuid4().hex}", _folder(s), n_buckets=8)


def _neighbor_ratings_indexed(s: SparkSession, d: str) -> DataFrame:
    ratings = _indexed(s, v.dense(s, d))
    targets = s.createDataFrame([(t,) for t in n.BATCH], "user_id BIGINT")
    nearest = co.stored(co.knn(ratings, targets, "euclidean", 5, 1))
    return co.neighbor_ratings(ratings, nearest)


def _deltas(s: SparkSession, d: str) -> DataFrame:
    """Ratings in four parts by ship date, the late ones first, merged one by
    one into a table; position and rating as in ``dense``."""
    path = _folder(s)
    rated = v.positioned(v.table(s, d, "lineitem"), "l_suppkey", "l_shipdate")
    for year in (1998, 1995, 1993, 0):
        upsert(rated.where(F.col("part") == year).drop("part"), path, n_buckets=16)
    return read_version(s, path).select("user_id", "movie_id", "rating")


def _upsert_delta(s: SparkSession, d: str) -> DataFrame:
    """The late half of the order keys merged into the table of the early half."""
    path = _folder(s)
    lines = v.table(s, d, "lineitem")
    half = lines.agg((F.max("l_orderkey") / 2).cast("bigint")).first()[0]
    for part in (lines.where(F.col("l_orderkey") <= half), lines.where(F.col("l_orderkey") > half)):
        upsert(v.positioned(part, "l_suppkey", "l_shipdate").drop("part"), path, n_buckets=16)
    return read_version(s, path).select("user_id", "movie_id", "rating")


QUERIES = {
    "ratings_from_csv": lambda s, d: co.latest_ratings(
        accepted(_read_ratings(s, d), *_REQUIRED), "load_order", total_order=True
    ),
    "ratings_rejects": lambda s, d: rejected(_read_ratings(s, d), *_REQUIRED)
    .groupBy("user_id")
    .agg(F.count("*").alias("n_rejected")),
    "movies_from_csv": _movies_from_csv,
    "movies_upsert": _movies_upsert,
    "names_from_csv": _names_from_csv,
    "catalog_rejects": _catalog_rejects,
    "catalog_from_csv": _catalog_from_csv,
    "users_report": lambda s, d: _lines(s, reports.write_users, v.dense(s, d)),
    "movies_report": lambda s, d: _lines(s, reports.write_movies, v.movies(s, d)),
    "distances_report": _distances_report,
    "common_movies_report": _common_report,
    "neighbors_table": lambda s, d: _neighborhood_tables(s, d, "neighbors"),
    "recommendations_table": lambda s, d: _neighborhood_tables(s, d, "recommendations"),
    "neighbor_ratings_table": lambda s, d: _neighborhood_tables(s, d, "ratings"),
    "neighborhood_lines": _neighborhood_lines,
    "upsert_delta": _upsert_delta,
    "written_totals": _written_totals,
    "lookup_indexed": lambda s, d: co.lookup_ratings(_indexed(s, v.sparse(s, d)), v.requests(s, d)),
    "user_ratings_indexed": lambda s, d: co.user_ratings(_indexed(s, v.dense(s, d)), n._debtors(s, d)),
    "neighbor_ratings_indexed": _neighbor_ratings_indexed,
    "catalog_joined": _catalog_joined,
    "upsert_late_first": _deltas,
    "report_overwritten": _report_overwritten,
}


def _all_metrics(select: str) -> str:
    return " UNION ALL ".join(
        f"SELECT * FROM ({n.recs_sql(n.knn_sql(v.DENSE, n.BATCH, m, 5, 1))} {select.format(m)})"
        for m in n.MEASURES
    )


ORACLES = {
    "lookup_indexed": n.ORACLES["lookup_rating_sparse"],
    "user_ratings_indexed": n.ORACLES["user_ratings_batch"],
    "neighbor_ratings_indexed": n.ORACLES["neighbor_ratings"],
    "written_totals": f"""SELECT 'users' AS kind, count(DISTINCT o_custkey) AS total FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  UNION ALL SELECT 'movies', count(*) FROM part
  UNION ALL SELECT 'candidates', count(*) FROM ({n.distances_sql(v.SPARSE, [n.SPARSE_TARGET], 'euclidean', 1)} SELECT user_id FROM dist)
  UNION ALL SELECT 'ratings', count(*) FROM ({v.SPARSE})
  UNION ALL SELECT 'nobody', 0""",
    "catalog_joined": """WITH m AS (
  SELECT year(o_orderdate) * 12 + month(o_orderdate) AS month, strftime(date_trunc('month', o_orderdate), '%Y-%m-%d_%H-%M-%S') AS name,
         count(*) AS total_frames, sum(strlen(o_orderkey::VARCHAR) + 1)::BIGINT AS length FROM orders GROUP BY 1, 2)
  SELECT name, CASE WHEN month % 7 <> 0 THEN '/v/' || name || '.mkv' END AS path, CASE WHEN month % 7 <> 0 THEN 30.0::DOUBLE END AS fps,
         CASE WHEN month % 7 <> 0 THEN total_frames END AS total_frames, CASE WHEN month % 5 <> 0 THEN length END AS length,
         CASE WHEN month % 5 = 0 THEN 'no_file' WHEN month % 7 = 0 THEN 'not_in_catalog' ELSE 'matched' END AS status
  FROM m WHERE month % 5 <> 0 OR month % 7 <> 0""",
    "upsert_delta": v.DENSE,
    "upsert_late_first": v.DENSE,
    "ratings_from_csv": """
  SELECT l_suppkey AS user_id, l_partkey AS movie_id,
         ceil(max({'o': l_orderkey, 'l': l_linenumber, 'q': l_quantity}).q / 5) / 2 AS rating
  FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1, 2""",
    "ratings_rejects": """SELECT l_suppkey AS user_id, count(*) AS n_rejected
  FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1""",
    "movies_from_csv": """SELECT p_partkey AS movie_id, p_name || ', "' || p_brand || '"' AS title,
         p_brand || '/' || p_type AS genres FROM part""",
    "names_from_csv": """SELECT lower(c_mktsegment) AS "Role",
         count(*) FILTER (regexp_matches(c_name, '[A-Z]')) AS n_uppercase FROM customer GROUP BY 1""",
    "movies_upsert": """SELECT p_partkey AS movie_id, p_name || ', again' AS title,
         p_brand || '/' || p_type AS genres FROM part""",
    "catalog_from_csv": f"""SELECT path, fps, total_frames FROM ({v.VIDEOS})
  WHERE video_id % 11 <> 0 AND video_id % 7 <> 0 AND video_id % 5 <> 0""",
    "catalog_rejects": f"""SELECT path, count(*) AS n_rejected FROM ({v.VIDEOS})
  WHERE video_id % 11 = 0 OR video_id % 7 = 0 OR video_id % 5 = 0 GROUP BY 1""",
    "report_overwritten": "SELECT DISTINCT l_suppkey::VARCHAR AS line FROM lineitem",
    "neighborhood_lines": f"""{n.recs_sql(n.knn_sql(v.DENSE, [n.DENSE_TARGET], 'cosine', 5, 1))}
  SELECT neighbor_id || ' ' || printf('%.10f', value) || ' ' || intersects::INTEGER AS line FROM nn
  UNION ALL SELECT movie_id || ' ' || printf('%.10f', rating) FROM recs""",
    "neighbor_ratings_table": _all_metrics("SELECT nr.*, '{0}' AS metric FROM nr"),
    "users_report": "SELECT DISTINCT l_suppkey::VARCHAR AS line FROM lineitem",
    "movies_report": "SELECT p_partkey || ' ' || p_name AS line FROM part",
    "distances_report": f"""{n.distances_sql(v.SPARSE, [n.SPARSE_TARGET], 'euclidean', 1)}
  SELECT user_id || ' ' || printf('%.10f', value) || ' ' || intersects::INTEGER AS line FROM dist""",
    "common_movies_report": f"""WITH r AS ({v.DENSE})
  SELECT a.movie_id::VARCHAR AS line FROM r a JOIN r b ON a.movie_id = b.movie_id
  WHERE a.user_id = 1 AND b.user_id = 2""",
    "neighbors_table": _all_metrics(
        """SELECT target_id, neighbor_id, neighbor_rank, value, intersects, n_common,
  '{0}' AS metric FROM nn"""
    ),
    "recommendations_table": _all_metrics("SELECT recs.*, '{0}' AS metric FROM recs"),
}
