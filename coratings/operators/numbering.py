"""Row numbers within a group that hold up when one group is huge."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from coratings.plans.staging import sized, stored

# A group beyond this many rows is numbered by many tasks.
HOT_ROWS = 5_000_000

# Slices of hot groups: never more than SLICES unless they would be of more than SLICE_ROWS rows.
SLICES = 256
SLICE_ROWS = 1_000_000


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """Column names like the wanted ones that ``df`` has in no spelling."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def number_rows(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    name: str,
    hot_rows: int | None = None,
) -> DataFrame:
    """Add ``name``: 1, 2, ... within ``keys`` by ``order``, a total order.

    Groups up to ``hot_rows`` use a window. The rows of larger ones are range
    partitioned by key and order into slices of about ``hot_rows`` rows, so
    that one group spreads over many tasks; each slice is sorted and counted
    through as it is written, and shifted by the sizes of the slices before
    it. Every slice costs a task and a sample of rows at the driver, so for a
    small ``hot_rows`` there are no more than ``SLICES``, or as many as
    ``SLICE_ROWS`` rows each take, and groups share them. Runs jobs: ``df`` is counted, so pass a stored table or a plain scan.
    """
    keys, order = list(keys), list(order)
    hot_rows = HOT_ROWS if hot_rows is None else hot_rows
    window = Window.partitionBy(*keys).orderBy(*order)
    windowed = df.withColumn(name, F.row_number().over(window).cast("bigint"))
    if df.count() <= hot_rows:
        return windowed
    rows, place, part, first, shift, *hot_keys = free_names(
        df, "_rows", "_place", "_slice", "_first", "_shift", *[f"_hot_{k}" for k in keys]
    )
    sizes = df.groupBy(*keys).agg(F.count("*").alias(rows))
    hot = sizes.where(F.col(rows) > hot_rows).select(*[F.col(k).alias(h) for k, h in zip(keys, hot_keys, strict=True)], rows)
    hot = stored(hot)
    total = hot.agg(F.sum(rows)).first()[0]
    if total is None:
        return windowed

    hot = sized(hot.select(*hot_keys))
    is_hot = _same(keys, hot_keys)
    cold = df.join(hot, is_hot, "left_anti")
    cold = cold.withColumn(name, F.row_number().over(window).cast("bigint"))

    # Places count on from row to row of a slice, so the rank within a slice is
    # the distance from the key's first place there. An explicit number of
    # slices also keeps AQE from merging them.
    n_slices = min(-(-total // max(hot_rows, 1)), max(SLICES, -(-total // SLICE_ROWS)))
    slices = stored(
        df.join(hot, is_hot, "left_semi")
        .repartitionByRange(n_slices, *keys, *order)
        .sortWithinPartitions(*keys, *order)
        .withColumn(place, F.monotonically_increasing_id())
        .withColumn(part, F.spark_partition_id())
    )
    earlier = (
        Window.partitionBy(*hot_keys)
        .orderBy(part)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    (of_part,) = free_names(slices, "_of_slice")
    shifts = (
        slices.groupBy(*[F.col(k).alias(h) for k, h in zip(keys, hot_keys, strict=True)], part)
        .agg(F.count("*").alias(rows), F.min(place).alias(first))
        .withColumn(shift, F.coalesce(F.sum(rows).over(earlier), F.lit(0)))
        .select(*hot_keys, F.col(part).alias(of_part), first, shift)
    )
    same_slice = _same([*keys, part], [*hot_keys, of_part])
    rank = F.col(place) - F.col(first) + F.col(shift) + 1
    numbered = slices.join(sized(stored(shifts)), same_slice).withColumn(name, rank)
    return cold.unionByName(numbered.select(*cold.columns))


def _same(keys: Sequence[str], others: Sequence[str]) -> Column:
    match = F.lit(True)
    for k, other in zip(keys, others, strict=True):
        match = match & F.col(k).eqNullSafe(F.col(other))
    return match
