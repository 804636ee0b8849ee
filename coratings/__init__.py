"""Neighbourhood-based recommendation and light data preparation on DataFrames."""

from coratings.operators.bitmaps import common_counts, movie_bitmaps
from coratings.operators.bounded import BOUNDED, knn_bounded
from coratings.operators.distances import candidate_totals, distances, overlaps, ranked
from coratings.operators.neighbors import knn
from coratings.operators.numbering import number_rows
from coratings.operators.pairs import common_movies, pair_report
from coratings.operators.prefixes import prefix_overlaps
from coratings.operators.profiling import count_uppercase, greet
from coratings.operators.ratings import (
    latest_movies,
    latest_ratings,
    lookup_ratings,
    ratings_per_user,
    totals,
    user_ratings,
    users,
)
from coratings.operators.recommend import neighbor_ratings, recommend, rows_per_neighbor
from coratings.operators.sampling import (
    frames_per_video,
    rejected_videos,
    resolve_name_collisions,
    sample_every,
    sampling_plan,
)
from coratings.plans.neighborhood import neighborhood, write_neighborhood
from coratings.plans.staging import release, stored
from coratings.sinks.indexed import open_indexed, write_indexed
from coratings.sinks.upsert import read_version, upsert, vacuum

__all__ = [
    "BOUNDED",
    "candidate_totals",
    "common_counts",
    "common_movies",
    "count_uppercase",
    "distances",
    "frames_per_video",
    "greet",
    "knn",
    "knn_bounded",
    "latest_movies",
    "latest_ratings",
    "lookup_ratings",
    "movie_bitmaps",
    "neighbor_ratings",
    "neighborhood",
    "number_rows",
    "open_indexed",
    "overlaps",
    "pair_report",
    "prefix_overlaps",
    "ranked",
    "read_version",
    "ratings_per_user",
    "recommend",
    "rejected_videos",
    "release",
    "resolve_name_collisions",
    "rows_per_neighbor",
    "sample_every",
    "sampling_plan",
    "stored",
    "totals",
    "upsert",
    "user_ratings",
    "users",
    "vacuum",
    "write_indexed",
    "write_neighborhood",
]
