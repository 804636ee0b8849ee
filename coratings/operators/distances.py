"""Target users against everybody else."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from coratings.functions.metrics import METRICS, co_rated_sums, exact_sums, exact_value, metric_value
from coratings.operators.numbering import number_rows
from coratings.plans.staging import among, join_small, sized, stored


def target_ratings(ratings: DataFrame, targets: DataFrame) -> DataFrame:
    """Ratings of the targets: ``(target_id, movie_id, target_rating)``."""
    return among(ratings, targets, "user_id").select(
        F.col("user_id").alias("target_id"),
        "movie_id",
        F.col("rating").alias("target_rating"),
    )


def overlaps(
    ratings: DataFrame, targets: DataFrame, min_common: int = 1, digits: int | None = None
) -> DataFrame:
    """Sums over the co-rated movies of every (target, other user) that have
    at least one. One join serves all measures. With ``digits`` the sums are
    exact, of ratings with so many decimals.

    The targets' ratings are written once. If they fit a broadcast, the
    ratings are cut down to the targets' movies before anything is shuffled,
    and joined where they lie. If not, both sides are shuffled by movie, and
    AQE splits the movies that very many users have rated. Targets with fewer
    than ``min_common`` ratings are left out before the join.
    Runs jobs: the targets' ratings are written.
    """
    mine = stored(target_ratings(ratings, targets), compact=True)
    # One look at the targets' ratings tells their number, the range of their
    # movies and whether any target falls below.
    sizes = mine.groupBy("target_id").agg(F.count("*").alias("n"), F.min("movie_id").alias("low"), F.max("movie_id").alias("high"))
    rows, low, high, least = sizes.agg(F.sum("n"), F.min("low"), F.max("high"), F.min("n")).first()
    known = (rows or 0, low, high)
    if least is not None and least < min_common:
        enough = sizes.where(F.col("n") >= min_common).select("target_id")
        mine, known = stored(mine.join(sized(stored(enough)), "target_id", "left_semi")), None
    a, b = F.col("target_rating"), F.col("rating")
    return (
        join_small(ratings, mine, "movie_id", known)
        .where(F.col("user_id") != F.col("target_id"))
        .groupBy("target_id", "user_id")
        .agg(*(co_rated_sums(a, b) if digits is None else exact_sums(a, b, digits)))
    )


def candidates(
    ratings: DataFrame, targets: DataFrame, metric: str | Sequence[str], min_common: int,
    joined: Callable[[DataFrame, DataFrame, int], DataFrame] | None = None, digits: int | None = None,
) -> DataFrame:
    """``distances`` in no order, for a plan that goes on from here. Several
    metrics are read off one join, with a column ``metric``. ``joined`` makes
    the sums: ``overlaps`` (also if None) or ``prefix_overlaps``, not with ``digits``."""
    if digits is not None and joined is not None:
        raise ValueError("digits go with the plain join only")
    value_of = metric_value if digits is None else (lambda m: exact_value(m, digits))
    metrics = [metric] if isinstance(metric, str) else list(metric)
    for name in metrics:
        if name not in METRICS:
            raise ValueError(f"unknown metric {name!r}, expected one of {METRICS}")
    if digits is None:
        found = (joined or overlaps)(ratings, targets, min_common)
    else:
        found = overlaps(ratings, targets, min_common, digits)
    found = found.where(F.col("n_common") >= min_common)
    intersects = (F.col("n_common") > 0).alias("intersects")
    if isinstance(metric, str):
        return found.select("target_id", "user_id", value_of(metric).alias("value"), intersects, "n_common")
    values = [F.struct(F.lit(m).alias("metric"), value_of(m).alias("value")) for m in metrics]
    return found.select("target_id", "user_id", "n_common", intersects, F.explode(F.array(*values)).alias("m")).select(
        "m.metric", "target_id", "user_id", "m.value", "intersects", "n_common"
    )


def listing_order(metric: str) -> Column:
    """Order of ``distances``: cosine from the most alike down, the others
    ascending - Pearson too, which lists the most opposed user first."""
    return F.desc("value") if metric == "cosine" else F.asc("value")


def distances(
    ratings: DataFrame, targets: DataFrame, metric: str, min_common: int, digits: int | None = None
) -> DataFrame:
    """Every other user with at least ``min_common`` movies in common with a
    target, by the measure; ties by user id. No overlap is never listed.

    Give ``digits``, the decimals that ratings have, if they don't lie on a
    0.5 grid: sums are then exact, and neither values nor near-ties depend on
    the order of summation. Ratings are rounded to so many decimals."""
    found = candidates(ratings, targets, metric, min_common, digits=digits)
    return found.orderBy("target_id", listing_order(metric), "user_id")


def candidate_totals(
    ratings: DataFrame, targets: DataFrame, min_common: int
) -> DataFrame:
    """How many users are left per target after the overlap threshold."""
    left = overlaps(ratings, targets, min_common).where(F.col("n_common") >= min_common)
    return left.groupBy("target_id").agg(F.count("*").alias("n_candidates"))


def ranked(found: DataFrame, metric: str) -> DataFrame:
    """``distances`` with ``listing_rank``, each row's place in the list of its
    target, from 1. Runs jobs: ``found`` is written."""
    return number_rows(stored(found), ["target_id"], [listing_order(metric), "user_id"], "listing_rank")
