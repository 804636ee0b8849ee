"""Neighbours, their ratings and the recommendations in one run."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame

from coratings.operators.neighbors import knn
from coratings.operators.recommend import (
    rated_by_neighbors,
    recommend_from,
    rows_per_neighbor,
)
from coratings.plans.staging import release, stored
from coratings.sinks.reports import write_metric_table, write_metric_tables


class Neighborhood(NamedTuple):
    neighbors: DataFrame
    ratings: DataFrame
    rating_counts: DataFrame
    recommendations: DataFrame
    recommendation_counts: DataFrame


def neighborhood(
    ratings: DataFrame,
    targets: DataFrame,
    metric: str | Sequence[str],
    k: int,
    min_common: int,
    min_rating: float,
    movies: DataFrame | None = None,
    exclude_seen: bool = False,
) -> Neighborhood:
    """The k nearest of every target and what follows from them. Neighbours
    and their ratings are written once and shared by all results; several
    metrics are read off one join and kept apart by a column ``metric``."""
    neighbors = stored(knn(ratings, targets, metric, k, min_common))
    rows = stored(rated_by_neighbors(ratings, neighbors))
    recommendations = recommend_from(
        rows, min_rating, movies, ratings if exclude_seen else None, neighbors
    )
    return Neighborhood(
        neighbors,
        rows,
        rows_per_neighbor(neighbors, rows),
        recommendations,
        rows_per_neighbor(neighbors, recommendations),
    )


def write_neighborhood(
    result: Neighborhood, path: str, metric: str | Sequence[str], release_after: bool = False
) -> None:
    """Each result as a table below ``path``, with one folder per metric;
    ``metric`` as given to ``neighborhood``. ``release_after`` removes the
    intermediate tables, after which ``result`` cannot be used any more."""
    for name, table in result._asdict().items():
        where = f"{path.rstrip('/')}/{name}"
        if isinstance(metric, str):
            write_metric_table(table, where, metric)
        else:
            write_metric_tables(table, where, metric)
    if release_after:
        release(*result)
