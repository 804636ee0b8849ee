"""Tables (parquet) and text reports, one row per record.

Text reports are sorted across their part files and hold no header or footer
lines; writers return the number of rows, which the write itself counts, and
totals by key are tables of their own (``totals``, ``rows_per_neighbor``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, functions as F

from coratings.functions.text import ten_decimals
from coratings.operators.ratings import users
from coratings.plans.staging import stored


def write_table(df: DataFrame, path: str) -> int:
    """Any result as parquet; returns the number of rows, counted as they are written."""
    seen, df = _observed(df)
    df.write.mode("overwrite").parquet(path)
    return seen.get.get("rows", 0)


def _observed(df: DataFrame) -> tuple[Observation, DataFrame]:
    seen = Observation()
    return seen, df.observe(seen, F.count(F.lit(1)).alias("rows"))


def write_ratings(ratings: DataFrame, path: str) -> None:
    """Ratings laid out by user, for many queries on the same ratings: what is
    asked of few users then reads few row groups. A user with very many
    ratings spreads over several files."""
    by_user = ratings.repartitionByRange("user_id", "movie_id")
    write_table(by_user.sortWithinPartitions("user_id", "movie_id"), path)


def write_metric_table(df: DataFrame, path: str, metric: str) -> None:
    """A result of one metric below ``path``, beside those of the others.

    Readers of ``path`` see a ``metric`` column. Only this metric's folder is
    replaced.
    """
    df.write.mode("overwrite").parquet(f"{path.rstrip('/')}/metric={metric}")


def write_metric_tables(df: DataFrame, path: str, metrics: Sequence[str]) -> None:
    """A result of several metrics, told apart by its column ``metric``: the
    folders of all of ``metrics`` are replaced, also of one without rows."""
    df = stored(df)
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("metric").parquet(path)
    present = {r.metric for r in df.select("metric").distinct().collect()}
    for metric in metrics:
        if metric not in present:
            write_metric_table(df.drop("metric").limit(0), path, metric)


def neighbor_lines(neighbors: DataFrame) -> DataFrame:
    """``id value flag`` of every neighbour, like ``distance_lines``."""
    return distance_lines(neighbors.withColumnRenamed("neighbor_id", "user_id"))


def rated_lines(rows: DataFrame) -> DataFrame:
    """``movie rating`` per row of ``neighbor_ratings`` or ``recommend``, ten decimals."""
    return rows.select(F.concat_ws(" ", F.col("movie_id"), ten_decimals(F.col("rating"))).alias("line"))


def distance_lines(distances: DataFrame) -> DataFrame:
    """``id value flag`` per row, ten decimals, flag 1 or 0."""
    flag = F.col("intersects").cast("int")
    return distances.select(
        F.concat_ws(" ", F.col("user_id"), ten_decimals(F.col("value")), flag).alias("line")
    )


def write_users(ratings: DataFrame, path: str) -> int:
    """User ids, one per line; returns how many users have ratings."""
    return _write_lines(users(ratings).orderBy("user_id"), path, F.col("user_id"))


def write_movies(movies: DataFrame, path: str) -> int:
    """``id title`` per line; returns how many movies are listed."""
    return _write_lines(movies.orderBy("movie_id"), path, F.col("movie_id"), F.col("title"))


def write_distances(distances: DataFrame, path: str) -> int:
    """``id value flag`` per line, in the order of ``distances``; returns the
    number of candidates."""
    return _write_lines(distance_lines(distances), path, F.col("line"))


def write_common_movies(common: DataFrame, path: str) -> int:
    """Movie ids, one per line; returns their number. For one pair; use
    ``write_table`` for many."""
    return _write_lines(common.orderBy("movie_id"), path, F.col("movie_id"))


def _write_lines(df: DataFrame, path: str, *columns: Column) -> int:
    line = F.concat_ws(" ", *columns)
    seen, lines = _observed(df.select(line.alias("line")))
    lines.write.mode("overwrite").text(path)
    return seen.get.get("rows", 0)
