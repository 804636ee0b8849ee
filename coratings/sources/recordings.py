"""Catalogs of recordings. The media files themselves are never opened."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from coratings.functions.clock import base_name
from coratings.sources.tables import read_lines

CATALOG_SCHEMA = "path STRING, fps DOUBLE, total_frames BIGINT"
CATALOG_COLUMNS = ("path", "fps", "total_frames")


def read_catalog(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``path, fps, total_frames`` from CSV, one line per recording, with the
    lines that do not fit: ``accepted`` and ``rejected`` part the two, given
    ``CATALOG_COLUMNS``."""
    return read_lines(spark, path, CATALOG_SCHEMA)


def list_recordings(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Files below a folder, to join with what is known about each: ``path,
    length, modificationTime``. The content column is not read."""
    return (
        spark.read.format("binaryFile")
        .options(pathGlobFilter=pattern, recursiveFileLookup=True)
        .load(path)
        .select("path", "length", "modificationTime")
    )


def match_catalog(catalog: DataFrame, files: DataFrame, of_file: Column | None = None) -> DataFrame:
    """A catalog held against the files of ``list_recordings``: ``name, path,
    fps, total_frames, file, length, status``.

    Both are matched by the recording's name, a path's last part without its
    ending, or for files what ``of_file`` makes of their columns. ``status`` is
    ``matched``, ``no_file`` (a catalog row only) or ``not_in_catalog`` (a file only).
    A name that either side has several times gives a row for each pair.
    """
    rows = catalog.select(base_name(F.col("path")).alias("name"), *CATALOG_COLUMNS, F.lit(True).alias("listed"))
    name = base_name(F.col("path")) if of_file is None else of_file
    found = files.select(name.alias("name"), F.col("path").alias("file"), "length")
    status = F.when(F.col("file").isNull(), "no_file").when(F.col("listed").isNull(), "not_in_catalog").otherwise("matched")
    return rows.join(found, "name", "full").select("name", *CATALOG_COLUMNS, "file", "length", status.alias("status"))
