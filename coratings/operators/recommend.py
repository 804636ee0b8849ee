"""What the neighbours of a target have rated, and rated well."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from coratings.operators.distances import target_ratings
from coratings.operators.numbering import number_rows
from coratings.plans.staging import join_small, sized, stored

_NEIGHBOR = ["target_id", "neighbor_id", "neighbor_rank"]


def _lists(df: DataFrame) -> list[str]:
    """What names one neighbour's list; the metric as well if there are several."""
    return ["metric", *_NEIGHBOR] if "metric" in df.columns else _NEIGHBOR


def _best_first() -> list[Column]:
    return [F.desc("rating"), F.asc("movie_id")]


def rated_by_neighbors(ratings: DataFrame, neighbors: DataFrame) -> DataFrame:
    """All ratings of every neighbour, in no order. ``neighbors`` is what
    ``knn`` returns, stored."""
    lists = _lists(neighbors)
    side = neighbors.select(*lists).withColumnRenamed("neighbor_id", "user_id")
    rows = join_small(ratings, side, "user_id").withColumnRenamed("user_id", "neighbor_id")
    return rows.select(*lists, "movie_id", "rating")


def neighbor_ratings(ratings: DataFrame, neighbors: DataFrame) -> DataFrame:
    """All ratings of every neighbour, nearest neighbour first, best first."""
    rows = rated_by_neighbors(ratings, neighbors)
    return rows.orderBy("target_id", "neighbor_rank", *_best_first())


def recommend(
    ratings: DataFrame,
    neighbors: DataFrame,
    min_rating: float,
    movies: DataFrame | None = None,
    exclude_seen: bool = False,
) -> DataFrame:
    """Per neighbour the movies rated at least ``min_rating``, best first.

    The lists stay apart: nothing is merged or scored across neighbours, and
    what the target has already rated stays in unless ``exclude_seen``. With
    ``movies`` a title column is added. Runs jobs.
    """
    rows = rated_by_neighbors(ratings, neighbors)
    return recommend_from(
        rows,
        min_rating,
        movies,
        ratings if exclude_seen else None,
        neighbors,
    )


def recommend_from(
    rows: DataFrame,
    min_rating: float,
    movies: DataFrame | None = None,
    seen_in: DataFrame | None = None,
    neighbors: DataFrame | None = None,
) -> DataFrame:
    """``recommend`` on rows of ``rated_by_neighbors``; ``seen_in`` are the
    ratings to take what the targets have seen from, and ``neighbors`` tells
    the targets without a look at ``rows``."""
    liked = rows.where(F.col("rating") >= F.lit(float(min_rating)))
    if seen_in is not None:
        wanted = stored((rows if neighbors is None else neighbors).select(F.col("target_id").alias("user_id")).distinct())
        seen = stored(target_ratings(seen_in, wanted).select("target_id", "movie_id"), compact=True)
        liked = liked.join(sized(seen), ["target_id", "movie_id"], "left_anti")
    lists = _lists(rows)
    ranked = number_rows(stored(liked), lists, _best_first(), "rec_rank")
    columns = [*lists, "movie_id", "rating", "rec_rank"]
    if movies is not None:
        ranked = ranked.join(movies.select("movie_id", "title"), "movie_id", "left")
        columns.append("title")
    return ranked.select(*columns)


def rows_per_neighbor(neighbors: DataFrame, rows: DataFrame) -> DataFrame:
    """Number of rows of every neighbour, 0 included: of ``neighbor_ratings``
    or of ``recommend``."""
    lists = _lists(neighbors)
    counts = rows.groupBy(*lists).agg(F.count("*").alias("n_rows"))
    return (
        neighbors.select(*lists)
        .join(counts, lists, "left")
        .fillna(0, subset=["n_rows"])
        .select(*lists, "n_rows")
    )
