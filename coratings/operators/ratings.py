"""Building the ratings table and the point queries on it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from coratings.plans.staging import among, fits_broadcast, stored


def latest_ratings(
    raw: DataFrame, order: Sequence[str | Column] | str, total_order: bool = False
) -> DataFrame:
    """One rating per (user, movie): the last one in ``order``.

    ``order`` names what "last" means, since a distributed table has no file
    order (``read_ratings`` offers ``load_order`` for that). Equal positions
    are settled by the higher rating. If a single column already orders all
    ratings of a (user, movie), say ``total_order=True``: the aggregate then
    keeps two fixed-width values and is hashed instead of sorted.
    """
    order = [order] if isinstance(order, str) else list(order)
    if total_order:
        if len(order) != 1:
            raise ValueError("total_order needs exactly one order column")
        last = F.max_by("rating", order[0])
    else:
        columns = [F.col(c) if isinstance(c, str) else c for c in order]
        keys = [c.alias(f"k{i}") for i, c in enumerate(columns)]
        last = F.max(F.struct(*keys, F.col("rating")))["rating"]
    return raw.groupBy("user_id", "movie_id").agg(last.alias("rating"))


def latest_movies(raw: DataFrame, order: Sequence[str | Column] | str) -> DataFrame:
    """One row per movie id: the last one in ``order``."""
    order = [order] if isinstance(order, str) else list(order)
    columns = [F.col(c) if isinstance(c, str) else c for c in order]
    keys = [c.alias(f"k{i}") for i, c in enumerate(columns)]
    last = F.max(F.struct(*keys, "title", "genres")).alias("last")
    return raw.groupBy("movie_id").agg(last).select("movie_id", "last.title", "last.genres")


def users(ratings: DataFrame) -> DataFrame:
    """Distinct users."""
    return ratings.select("user_id").distinct()


def totals(ratings: DataFrame, movies: DataFrame) -> DataFrame:
    """Two rows: how many users have ratings, how many movies are listed."""
    rated_by = users(ratings).agg(F.count("*").alias("total")).withColumn("kind", F.lit("users"))
    listed = movies.agg(F.count("*").alias("total")).withColumn("kind", F.lit("movies"))
    return rated_by.unionByName(listed).select("kind", "total")


def ratings_per_user(ratings: DataFrame) -> DataFrame:
    """Number of rated movies of every user."""
    return ratings.groupBy("user_id").agg(F.count("*").alias("n_ratings"))


def user_ratings(ratings: DataFrame, wanted: DataFrame) -> DataFrame:
    """All movies and ratings of the wanted users; none for an unknown one."""
    return among(ratings, wanted, "user_id").orderBy("user_id", "movie_id")


def lookup_ratings(ratings: DataFrame, requests: DataFrame) -> DataFrame:
    """Rating of every requested (user, movie), with what was found.

    ``status`` is ``found``, ``movie_not_found`` (the user is known) or
    ``user_not_found``. One scan serves both questions: of the ratings of the
    users asked for, the requested ones keep their movie and all others fall
    into one row per user, which says that the user is known. Runs jobs.
    """
    wanted = stored(requests.select("user_id", "movie_id").distinct())
    # Answers are at most twice as many as what is wanted, so one count bounds
    # all of these sides.
    small = F.broadcast if fits_broadcast(wanted) else (lambda side: side)
    theirs = among(ratings, wanted, "user_id")
    asked = small(wanted.withColumn("asked", F.lit(True)))
    seen = theirs.join(asked, ["user_id", "movie_id"], "left")
    movie = F.when(F.col("asked"), F.col("movie_id"))
    answers = stored(
        seen.groupBy("user_id", movie.alias("movie_id"))
        .agg(F.max(F.when(F.col("asked"), F.col("rating"))).alias("rating"))
    )
    hits = small(answers.where("movie_id IS NOT NULL").withColumn("hit", F.lit(True)))
    known = small(answers.select("user_id").distinct().withColumn("known", F.lit(True)))
    status = (
        F.when(F.col("hit"), "found")
        .when(F.col("known"), "movie_not_found")
        .otherwise("user_not_found")
    )
    return (
        requests.join(hits, ["user_id", "movie_id"], "left")
        .join(known, "user_id", "left")
        .select("user_id", "movie_id", "rating", status.alias("status"))
    )
