"""Pairs of users: their common movies and all measures between them."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from coratings.functions.metrics import METRICS, co_rated_sums, metric_value
from coratings.plans.staging import among, sized, stored


def _pairs_with_sizes(ratings: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct pairs with the sizes of both users, and the ratings of all
    users in them; both stored, after one pass over ``ratings``."""
    pairs = stored(pairs.select("user_a", "user_b").distinct())
    members = pairs.select(F.explode(F.array("user_a", "user_b")).alias("user_id"))
    theirs = stored(among(ratings, members, "user_id"), compact=True)
    sizes = theirs.groupBy("user_id").agg(F.count("*").alias("size"))
    with_sizes = (
        pairs.join(sizes.toDF("user_a", "size_a"), "user_a", "left")
        .join(sizes.toDF("user_b", "size_b"), "user_b", "left")
        .fillna(0, subset=["size_a", "size_b"])
    )
    return stored(with_sizes), theirs


def _co_rated(pairs: DataFrame, theirs: DataFrame) -> DataFrame:
    """``(user_a, user_b, movie_id, a, b)`` for every movie both have rated.

    The smaller user of a pair drives: only their ratings are repeated per
    pair, so one user with very many ratings may be in very many pairs.
    """
    a_drives = F.col("size_a") <= F.col("size_b")
    driving = pairs.select(
        "user_a",
        "user_b",
        a_drives.alias("a_drives"),
        F.when(a_drives, F.col("user_a")).otherwise(F.col("user_b")).alias("user_id"),
        F.when(a_drives, F.col("user_b")).otherwise(F.col("user_a")).alias("other"),
    )
    driven = theirs.join(sized(driving), "user_id").select(
        "user_a",
        "user_b",
        "a_drives",
        F.col("other").alias("user_id"),
        "movie_id",
        F.col("rating").alias("driven"),
    )
    mine, others = F.col("driven"), F.col("rating")
    return driven.join(sized(theirs), ["user_id", "movie_id"]).select(
        "user_a",
        "user_b",
        "movie_id",
        F.when(F.col("a_drives"), mine).otherwise(others).alias("a"),
        F.when(F.col("a_drives"), others).otherwise(mine).alias("b"),
    )


def common_movies(ratings: DataFrame, pairs: DataFrame) -> DataFrame:
    """Movies both users of a pair have rated; all of them if it is one user."""
    return _co_rated(*_pairs_with_sizes(ratings, pairs)).select("user_a", "user_b", "movie_id")


def pair_report(ratings: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row per pair: sizes of both users, overlap and all four measures.

    Pairs without overlap, or with an unknown user, have 0 in every measure
    and ``intersects`` false.
    """
    pairs, theirs = _pairs_with_sizes(ratings, pairs)
    sums = (
        _co_rated(pairs, theirs)
        .groupBy("user_a", "user_b")
        .agg(*co_rated_sums(F.col("a"), F.col("b")))
    )
    return (
        pairs.join(sums, ["user_a", "user_b"], "left")
        .fillna(0, subset=["n_common"])
        .select(
            "user_a",
            "user_b",
            "size_a",
            "size_b",
            "n_common",
            (F.col("n_common") > 0).alias("intersects"),
            *[metric_value(m).alias(m) for m in METRICS],
        )
    )
