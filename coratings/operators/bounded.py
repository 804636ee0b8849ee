"""The k nearest users by bounds: most users are judged by their rare movies alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from coratings.functions.metrics import co_rated_sums, metric_value
from coratings.operators.distances import target_ratings
from coratings.operators.neighbors import nearness, window_k
from coratings.operators.numbering import number_rows
from coratings.plans.staging import among, join_small, sized, stored

# Metrics that have a bound; pearson is left to ``knn``.
BOUNDED = ("euclidean", "manhattan", "cosine")
# Users a target evaluates first to learn what the k-th value is at best, as a multiple of k.
SEEDS = 4
_PAIR = ["target_id", "user_id"]
_SUMS = ("n_common", "sum_a", "sum_b", "sum_ab", "sum_aa", "sum_bb", "sum_abs", "sum_sq")


def _bound(metric: str) -> Column:
    """The best value that sums over part of the movies leave open, a little
    widened, since it is rounded on another way than the value itself.

    Distances only grow with further movies. Of cosines the rest of the
    target's vector, of length ``aa_last``, can at most point the same way.
    """
    if metric == "cosine":
        best = (F.col("sum_ab") * F.col("sum_ab") / F.nullif(F.col("sum_bb"), F.lit(0.0)) + F.col("aa_last")) / F.nullif(F.col("sum_aa") + F.col("aa_last"), F.lit(0.0))
        return F.coalesce(F.sqrt(best), F.lit(1.0)) * (1 + 1e-9)
    return metric_value(metric) * (1 - 1e-9)


def knn_bounded(ratings: DataFrame, targets: DataFrame, metric: str, k: int, min_common: int) -> DataFrame:
    """The rows of ``knn`` for one of the metrics BOUNDED, by fewer full evaluations.

    A target's ``min_common - 1`` most popular movies, the dearest to join, are
    put last. Whoever shares ``min_common`` movies shares one of the others, so
    the join over those finds all candidates, and their sums there bound what
    the value can be. Some users with the best bounds are evaluated in full; of
    the rest only those whose bound reaches the k-th value of these. Pays for
    a high ``min_common`` and popular movies; with ``min_common = 1`` nothing
    is left to look up. Runs jobs: each step is written.
    """
    if metric not in BOUNDED:
        raise ValueError(f"no bound for {metric!r}, only for {BOUNDED}")
    if k < 0:
        raise ValueError("k must not be negative")
    if min_common < 1:
        raise ValueError("min_common must be at least 1")
    if SEEDS * k > window_k(ratings.sparkSession):
        raise ValueError("k is too large for bounds to pay; use knn")
    mine = stored(target_ratings(ratings, targets), compact=True)
    theirs = stored(among(ratings, mine, "movie_id").select("user_id", "movie_id", "rating"))
    raters = stored(theirs.groupBy("movie_id").agg(F.count("*").alias("raters")))
    placed = stored(mine.join(sized(raters), "movie_id"))
    placed = stored(number_rows(placed, ["target_id"], [F.desc("raters"), F.desc("movie_id")], "place").drop("raters"))
    rare, last = placed.where(F.col("place") >= min_common).drop("place"), placed.where(F.col("place") < min_common).drop("place")
    left_open = last.groupBy("target_id").agg(F.count("*").alias("n_last"), F.sum(F.col("target_rating") * F.col("target_rating")).alias("aa_last"))

    a, b = F.col("target_rating"), F.col("rating")
    partial = join_small(theirs, stored(rare), "movie_id").where("user_id <> target_id").groupBy(*_PAIR).agg(*co_rated_sums(a, b))
    partial = partial.join(sized(stored(left_open)), "target_id", "left").fillna(0, subset=["n_last", "aa_last"])
    partial = stored(partial.withColumn("bound", _bound(metric)).where(F.col("n_common") + F.col("n_last") >= min_common))

    def evaluated(pairs: DataFrame) -> DataFrame:
        """Pairs with their sums over all movies and the value, where enough are in common."""
        rest = pairs.select(*_PAIR).join(sized(last), "target_id").join(theirs, ["user_id", "movie_id"]).groupBy(*_PAIR).agg(*co_rated_sums(a, b))
        both = pairs.select(*_PAIR, *_SUMS).union(rest.select(*_PAIR, *_SUMS))
        sums = both.groupBy(*_PAIR).agg(*[F.sum(c).alias(c) for c in _SUMS]).where(F.col("n_common") >= min_common)
        return sums.select("target_id", F.col("user_id").alias("neighbor_id"), metric_value(metric).alias("value"), "n_common")

    def first(rows: DataFrame, value: Column, id_: str, n: int) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy("target_id").orderBy(value, F.asc(id_)))
        return rows.withColumn("neighbor_rank", rank).where(F.col("neighbor_rank") <= n)

    by_bound = F.desc("bound") if metric == "cosine" else F.asc("bound")
    seeds = stored(first(partial, by_bound, "user_id", SEEDS * k).drop("neighbor_rank"))
    kth = first(evaluated(seeds), nearness(metric), "neighbor_id", k).where(F.col("neighbor_rank") == k)
    kth = sized(stored(kth.select("target_id", F.col("value").alias("kth"))))
    reaches = F.col("bound") >= F.col("kth") if metric == "cosine" else F.col("bound") <= F.col("kth")
    worth = stored(partial.join(kth, "target_id", "left").where(F.col("kth").isNull() | reaches).drop("kth"))
    nearest = first(evaluated(worth), nearness(metric), "neighbor_id", k)
    return nearest.select(
        "target_id", "neighbor_id", F.col("neighbor_rank").cast("bigint").alias("neighbor_rank"), "value", (F.col("n_common") > 0).alias("intersects"), "n_common"
    )
