"""CSV tables: ratings, movies, names.

Each reader returns every line of its files. Lines that do not fit the schema
have ``_corrupt_record`` set: ``accepted`` and ``rejected`` part the two.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from coratings.functions.text import split_genres

CORRUPT = "_corrupt_record"
# The listing and the scan write the slashes after a scheme differently.
SLASHES = (r"^(\w+):/+", r"\1:/")

# Ranks of so many files are broadcast, with their names; those of more are
# joined by a shuffle, in which AQE parts the lines of a large file.
BROADCAST_FILES = 100_000

# Column order of the three files. A reader skips the header
# line of each file without looking at it.
RATINGS_SCHEMA = "user_id BIGINT, movie_id BIGINT, rating DOUBLE, ts STRING"
MOVIES_SCHEMA = "movie_id BIGINT, title STRING, genres STRING"
NAMES_SCHEMA = "Name STRING, Role STRING"


def read_lines(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """Every line of CSV files, with ``load_order`` and, where it does not fit,
    ``_corrupt_record``.

    ``load_order`` is one number of fixed width for a line's place in all files,
    files by name: rank of the file, start of its block, line in the block. No
    two lines share one, so it is a total order.
    """
    # Without column pruning a line is judged by all its fields, whichever of
    # them a query goes on to use.
    lines = (
        spark.read.schema(f"{schema}, {CORRUPT} STRING")
        .options(header=True, enforceSchema=True, mode="PERMISSIVE", quote='"', escape='"')
        .options(columnNameOfCorruptRecord=CORRUPT, columnPruning=False)
        .csv(path)
    )
    # The driver has listed the files to plan the scan.
    files = sorted({re.sub(*SLASHES, f) for f in lines.inputFiles()})
    ranks = spark.createDataFrame(list(enumerate(files)), "_rank BIGINT, _file STRING")
    if len(files) <= BROADCAST_FILES:
        ranks = F.broadcast(ranks)
    placed = lines.withColumns(
        {
            "_path": F.regexp_replace("_metadata.file_path", SLASHES[0], SLASHES[1].replace("\\", "$")),
            "_block": F.col("_metadata.file_block_start"),
            "_line": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1),
        }
    ).join(ranks, F.col("_path") == F.col("_file"), "left")
    rank = F.coalesce("_rank", F.raise_error(F.lit("a file that was not listed")).cast("bigint"))
    return placed.select(*lines.columns, load_order(rank, F.col("_block"), F.col("_line")).alias("load_order"))


def load_order(rank: Column, block: Column, line: Column) -> Column:
    """One number for a place: ten digits of the file's rank, fourteen of a
    byte in the file, ten of a line counter."""
    wide = lambda c, digits: c.cast(f"DECIMAL({digits},0)")
    of_file = wide(rank, 10) * wide(F.lit(10**14), 15) + wide(block, 14)
    return (wide(of_file, 26) * wide(F.lit(10**10), 11) + wide(line, 10)).cast("DECIMAL(38,0)")


def read_ratings(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``user_id, movie_id, rating, ts`` with ``load_order``, the position of
    the line in its files, as a total order for ``latest_ratings``."""
    return read_lines(spark, path, RATINGS_SCHEMA)


def read_movies(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``movie_id, title, genres`` with genres as an array; quoted titles may
    hold commas."""
    return read_lines(spark, path, MOVIES_SCHEMA).withColumn(
        "genres", split_genres(F.col("genres"))
    )


def read_names(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``Name, Role``."""
    return read_lines(spark, path, NAMES_SCHEMA)


def accepted(lines: DataFrame, *required: str) -> DataFrame:
    """Lines that fit the schema and have all ``required`` columns."""
    return lines.where(_fits(lines, required)).drop(CORRUPT)


def rejected(lines: DataFrame, *required: str) -> DataFrame:
    """The other lines, for a rejects table."""
    return lines.where(~_fits(lines, required))


def _fits(lines: DataFrame, required: tuple[str, ...]):
    # Spark refuses a query on the corrupt column alone, so the position is
    # looked at as well; it is never null.
    fits = F.col(CORRUPT).isNull() & F.col("load_order").isNotNull()
    for name in required or lines.columns[:1]:
        fits = fits & F.col(name).isNotNull()
    return fits
