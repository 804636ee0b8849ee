"""The k nearest users."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from coratings.operators.distances import candidates
from coratings.operators.numbering import number_rows
from coratings.operators.prefixes import prefix_overlaps
from coratings.plans.staging import stored


def window_k(spark: SparkSession) -> int:
    """Up to this k Spark cuts a window to k rows per task before its shuffle.
    Beyond, a target's list is numbered in slices instead of in one task."""
    return int(spark.conf.get("spark.sql.optimizer.windowGroupLimitThreshold"))


def nearness(metric: str) -> Column:
    """Nearest first: small distances, large similarities. Pearson counts as
    a similarity here, unlike in the listing of ``distances``."""
    return F.desc("value") if metric in ("cosine", "pearson") else F.asc("value")


def knn(
    ratings: DataFrame, targets: DataFrame, metric: str | Sequence[str], k: int, min_common: int,
    joined: Callable[[DataFrame, DataFrame, int], DataFrame] | None = None, digits: int | None = None,
) -> DataFrame:
    """The ``k`` nearest users of every target, ranked from 1, ties by user id.

    With a list of metrics one join serves all of them, and a column
    ``metric`` comes first. All candidates if there are fewer than ``k``, none
    for ``k = 0``. ``joined`` and ``digits`` are for ``candidates``. Runs jobs;
    store the result before using it more than once.
    """
    if k < 0:
        raise ValueError("k must not be negative")
    if joined is prefix_overlaps and isinstance(metric, str) and 0 < k <= window_k(ratings.sparkSession):
        joined = partial(prefix_overlaps, nearest=(metric, k))
    found = candidates(ratings, targets, metric, min_common, joined, digits).withColumnRenamed(
        "user_id", "neighbor_id"
    )
    if isinstance(metric, str):
        lists, order = ["target_id"], [nearness(metric), F.asc("neighbor_id")]
    else:
        # Similarities turned round, so that one order serves all metrics.
        alike = F.col("metric").isin("cosine", "pearson")
        distance = F.when(alike, F.lit(0.0) - F.col("value")).otherwise(F.col("value"))
        lists, order = ["metric", "target_id"], [distance.asc(), F.asc("neighbor_id")]
    if k <= window_k(found.sparkSession):
        rank = F.row_number().over(Window.partitionBy(*lists).orderBy(*order))
        ranked = found.withColumn("neighbor_rank", rank).where(F.col("neighbor_rank") <= k)
        ranked = ranked.withColumn("neighbor_rank", F.col("neighbor_rank").cast("bigint"))
    else:
        ranked = number_rows(stored(found), lists, order, "neighbor_rank")
        ranked = ranked.where(F.col("neighbor_rank") <= k)
    return ranked.select(
        *lists, "neighbor_id", "neighbor_rank", "value", "intersects", "n_common"
    )
