"""Ratings laid out for lookups by user and movie, and joins by user without a shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

ROW_GROUP = 16 << 20  # bytes; small row groups, so that a filter passes over more of them


def write_indexed(
    ratings: DataFrame, table: str, path: str, n_buckets: int = 64, row_group: int = ROW_GROUP, distinct: int = 1_000_000
) -> DataFrame:
    """Write ``ratings`` as the bucketed table ``table`` below ``path`` and return it.

    All ratings of a user lie in one of ``n_buckets`` files, sorted by user and
    movie: a question about users opens their buckets only, and a join by user
    (``neighbor_ratings``, ``pair_report``) leaves this side where it is.
    Footers hold bloom filters of both ids, made for ``distinct`` ids a row
    group, which pass over row groups whose range has an id without holding it. One user with very many
    ratings makes one long file; where that matters use ``write_ratings``,
    which parts users.
    """
    filters = {}
    for column in ("user_id", "movie_id"):
        filters[f"parquet.bloom.filter.enabled#{column}"] = "true"
        filters[f"parquet.bloom.filter.expected.ndv#{column}"] = str(distinct)
    (
        ratings.repartition(n_buckets, "user_id")
        .write.mode("overwrite").format("parquet")
        .options(path=path, **{"parquet.block.size": str(row_group)}, **filters)
        .bucketBy(n_buckets, "user_id").sortBy("user_id", "movie_id").saveAsTable(table)
    )
    return ratings.sparkSession.table(table)


def open_indexed(spark: SparkSession, table: str, path: str, n_buckets: int = 64) -> DataFrame:
    """A table of ``write_indexed`` in a session whose catalog doesn't know it."""
    if not spark.catalog.tableExists(table):
        columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in spark.read.parquet(path).schema)
        spark.sql(f"CREATE TABLE {table} ({columns}) USING parquet CLUSTERED BY (user_id) SORTED BY (user_id, movie_id) INTO {n_buckets} BUCKETS LOCATION '{path}'")
    return spark.table(table)
