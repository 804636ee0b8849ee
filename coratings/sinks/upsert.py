"""Ratings kept as a table of buckets that a delta is merged into.

A table is a folder of versions and a log: ``data/v=.../bucket=N`` folders of
parquet, and ``_versions/NNNNNNNNNN`` with the folder that each bucket had
in that version. A merge writes the touched buckets anew beside the old ones
and then its log entry; readers see a version whole or not at all.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from coratings.plans.staging import release, stored

# Rows of the table have the latest rating of a (user, movie) and the place it
# has in the order of all ratings, which decides when a later delta meets it.
COLUMNS = ("user_id", "movie_id", "rating", "position")
_LOG = "_versions"


def bucket_of(n_buckets: int) -> Column:
    """Bucket of a row by its user; all ratings of a user lie in one bucket."""
    return F.pmod(F.xxhash64("user_id"), F.lit(n_buckets)).cast("int")


def _files(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()), folder


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the versions of the table at ``path``, the newest last."""
    files, folder = _files(spark, f"{path}/{_LOG}")
    if not files.exists(folder):
        return []
    names = [status.getPath().getName() for status in files.listStatus(folder)]
    return sorted(int(name) for name in names if name.isdigit())


def _log(spark: SparkSession, path: str, version: int) -> DataFrame:
    return spark.read.parquet(f"{path}/{_LOG}/{version:010d}")


def read_version(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The ratings of a version, the newest if None: ``user_id, movie_id,
    rating, position``."""
    known = versions(spark, path)
    if not known:
        raise ValueError(f"no table of ratings at {path}")
    version = known[-1] if version is None else version
    # One row for each bucket: their number is a parameter of the table.
    folders = [f"{path}/{r.folder}" for r in _log(spark, path, version).where("folder IS NOT NULL").collect()]
    schema = _log(spark, path, version).first()["columns"]
    if not folders:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*folders)


def _commit(spark: SparkSession, path: str, version: int, rows: list[tuple], columns: str) -> None:
    """Write a log entry under another name and rename it: of two merges onto
    one version the second finds the name taken and fails."""
    log = spark.createDataFrame([(*row, columns) for row in rows], "bucket INT, folder STRING, columns STRING")
    files, target = _files(spark, f"{path}/{_LOG}/{version:010d}")
    draft = f"{path}/{_LOG}/draft-{uuid.uuid4().hex}"
    log.coalesce(1).write.parquet(draft)
    _, source = _files(spark, draft)
    if files.exists(target) or not files.rename(source, target):
        files.delete(source, True)
        raise RuntimeError(f"version {version} of {path} was written by somebody else; merge again")


def upsert(delta: DataFrame, path: str, n_buckets: int = 64) -> int:
    """Merge ``delta`` (``user_id, movie_id, rating, position``) into the table
    at ``path``, which is created by the first merge; return the new version.

    Of equal (user, movie) the rating with the greater ``position`` stays, be
    it the table's or the delta's; of equal positions the higher rating. Only buckets with rows in the
    delta are read and written; the files of all others stay as they are, and
    older versions can still be read. ``n_buckets`` counts when the table is
    created. A delta of no rows makes a version equal to the last.
    """
    spark = delta.sparkSession
    known = versions(spark, path)
    entries = {r.bucket: r.folder for r in _log(spark, path, known[-1]).collect()} if known else dict.fromkeys(range(n_buckets))
    n_buckets, version = len(entries), (known[-1] + 1 if known else 0)
    last = F.max(F.struct("position", "rating"))

    def latest(rows: DataFrame) -> DataFrame:
        found = rows.groupBy("user_id", "movie_id").agg(last.alias("last"))
        return found.select("user_id", "movie_id", "last.rating", "last.position")

    # The delta's own duplicates go first, so what is merged is as small as it can be.
    new = stored(latest(delta.select(*COLUMNS)).withColumn("bucket", bucket_of(n_buckets)))
    touched = [r.bucket for r in new.select("bucket").distinct().collect()]  # at most n_buckets
    old = [f"{path}/{entries[b]}" for b in touched if entries[b]]
    rows, schema = new.drop("bucket"), new.drop("bucket").schema
    if old:
        rows = rows.union(spark.read.schema(schema).parquet(*old).select(*COLUMNS))
    if touched:
        name = f"v={version:010d}-{uuid.uuid4().hex}"
        merged = latest(rows).withColumn("bucket", bucket_of(n_buckets))
        # A bucket is one task's, unless it is large: then AQE parts it again.
        (
            merged.hint("rebalance", "bucket").sortWithinPartitions("bucket", "user_id", "movie_id")
            .write.partitionBy("bucket").parquet(f"{path}/data/{name}")
        )
        entries |= {b: f"data/{name}/bucket={b}" for b in touched}
    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema)
    _commit(spark, path, version, sorted(entries.items()), columns)
    release(new)
    return version


def vacuum(spark: SparkSession, path: str, keep: int = 1) -> int:
    """Remove all but the newest ``keep`` versions and the folders only they
    read; returns how many folders went. Readers of those versions fail."""
    known = versions(spark, path)
    kept, gone = known[-keep:], known[:-keep]
    in_use = {r.folder for v in kept for r in _log(spark, path, v).collect()}
    folders = {r.folder for v in gone for r in _log(spark, path, v).collect()} - in_use - {None}
    for v in gone:
        files, entry = _files(spark, f"{path}/{_LOG}/{v:010d}")
        files.delete(entry, True)
    for folder in folders:
        files, place = _files(spark, f"{path}/{folder}")
        files.delete(place, True)
    return len(folders)
