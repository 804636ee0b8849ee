"""The four measures between two users, from one set of sums.

Every measure looks only at the movies both users have rated; ``a`` and ``b``
are the two ratings of one such movie.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

METRICS = ("euclidean", "manhattan", "cosine", "pearson")


def co_rated_sums(a: Column, b: Column) -> list[Column]:
    """Aggregates over co-rated movies. All buffers are fixed width, so they
    run as partial and final hash aggregates; unused ones are pruned."""
    return [
        F.count("*").alias("n_common"),
        F.sum(a).alias("sum_a"),
        F.sum(b).alias("sum_b"),
        F.sum(a * b).alias("sum_ab"),
        F.sum(a * a).alias("sum_aa"),
        F.sum(b * b).alias("sum_bb"),
        F.sum(F.abs(a - b)).alias("sum_abs"),
        F.sum((a - b) * (a - b)).alias("sum_sq"),
    ]


def _ratio(numerator: Column, denominator: Column) -> Column:
    """0.0 where nothing is in common or the denominator is zero."""
    safe = F.when(denominator != 0.0, numerator / F.nullif(denominator, F.lit(0.0)))
    return F.coalesce(safe, F.lit(0.0))


def _spread(total_sq: Column, total: Column, n_common: Column) -> Column:
    # Rounding can push this slightly below zero for a user who rates
    # everything alike; that user has no spread.
    return F.sqrt(F.greatest(total_sq - total * total / n_common.cast("double"), F.lit(0.0)))


def metric_value(metric: str, of: Callable[[str], Column] = F.col) -> Column:
    """The measure as an expression over the columns of ``co_rated_sums``, or
    over what ``of`` gives for their names."""
    if metric == "euclidean":
        return F.coalesce(F.sqrt(of("sum_sq")), F.lit(0.0))
    if metric == "manhattan":
        return F.coalesce(of("sum_abs"), F.lit(0.0))
    if metric == "cosine":
        return _ratio(of("sum_ab"), F.sqrt(of("sum_aa")) * F.sqrt(of("sum_bb")))
    if metric == "pearson":
        n = F.nullif(of("n_common"), F.lit(0)).cast("double")
        covariance = of("sum_ab") - of("sum_a") * of("sum_b") / n
        spread_a, spread_b = (_spread(of(f"sum_{x}{x}"), of(f"sum_{x}"), of("n_common")) for x in "ab")
        return F.when(of("n_common") > 0, _ratio(covariance, spread_a * spread_b)).otherwise(0.0)
    raise ValueError(f"unknown metric {metric!r}, expected one of {METRICS}")


def exact_sums(a: Column, b: Column, digits: int) -> list[Column]:
    """``co_rated_sums`` in whole numbers: ratings count in units of the last of
    ``digits`` decimals. Sums are exact, so they don't depend on the order of
    the rows, and differences of large sums lose nothing."""
    x, y = (F.round(c * F.lit(10.0**digits)).cast("bigint") for c in (a, b))
    wide = lambda c: c.cast("decimal(18,0)")
    return [
        F.count("*").alias("n_common"),
        F.sum(wide(x)).alias("sum_a"),
        F.sum(wide(y)).alias("sum_b"),
        F.sum(wide(x) * wide(y)).alias("sum_ab"),
        F.sum(wide(x) * wide(x)).alias("sum_aa"),
        F.sum(wide(y) * wide(y)).alias("sum_bb"),
        F.sum(wide(F.abs(x - y))).alias("sum_abs"),
        F.sum(wide(x - y) * wide(x - y)).alias("sum_sq"),
    ]


def exact_value(metric: str, digits: int) -> Column:
    """The measure over the columns of ``exact_sums``, for at least one co-rated
    movie. Only the last steps, on exact numbers, are rounded."""
    real = lambda c: (F.col(c) if isinstance(c, str) else c).cast("double")
    unit = F.lit(10.0**digits)
    if metric == "euclidean":
        return F.sqrt(real("sum_sq")) / unit
    if metric == "manhattan":
        return real("sum_abs") / unit
    if metric == "cosine":
        return _ratio(real("sum_ab"), F.sqrt(real("sum_aa")) * F.sqrt(real("sum_bb")))
    if metric == "pearson":
        n = F.col("n_common").cast("decimal(18,0)")
        spread = lambda total_sq, total: real(n * F.col(total_sq) - F.col(total) * F.col(total))
        covariance = real(n * F.col("sum_ab") - F.col("sum_a") * F.col("sum_b"))
        return _ratio(covariance, F.sqrt(spread("sum_aa", "sum_a")) * F.sqrt(spread("sum_bb", "sum_b")))
    raise ValueError(f"unknown metric {metric!r}, expected one of {METRICS}")
