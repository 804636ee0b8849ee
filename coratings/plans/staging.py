"""Where a plan is cut, and when a side may be broadcast.

Intermediate tables go to the shared folder the cluster names in
``spark.checkpoint.dir``, so a lost executor costs nothing that was written.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

# Rows are narrow here (ids, a rating, a few counters), about 100 bytes each
# once hashed, so a broadcast stays near 100 MB on every executor.
BROADCAST_ROWS = 1_000_000


# Up to this many wanted keys are named in the filter itself.
NAMED_KEYS = 1_000

# Results of more files than this are compacted where that is asked for.
COMPACT_FILES = 8


def scratch_root(spark: SparkSession) -> str:
    """Folder for this application's intermediate tables, below the shared
    folder of the session (``spark.checkpoint.dir``, or the context's
    checkpoint folder where that is set instead)."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared:
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    return f"{shared.rstrip('/')}/coratings/{spark.conf.get('spark.app.id')}"


def stored(df: DataFrame, compact: bool = False) -> DataFrame:
    """Write ``df`` once, in a job of its own, and return the written table.

    Partitions behind a shuffle are merged by AQE as they are. ``compact`` is
    for results without one, such as a narrow filter of a wide scan: where that
    reads many files, a shuffle is added that merges the partitions.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{uuid.uuid4().hex}"
    compact = compact and len(df.inputFiles()) > COMPACT_FILES
    (df.hint("rebalance") if compact else df).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(*frames: DataFrame) -> int:
    """Remove the intermediate tables that ``frames`` read, once their results
    are written; returns how many. The frames cannot be used any more."""
    folders = set()
    for df in frames:
        root = scratch_root(df.sparkSession).split(":")[-1].lstrip("/")
        folders |= {f.rsplit("/", 1)[0] for f in df.inputFiles() if root in f}
    for folder in folders:
        spark = frames[0].sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return len(folders)


def fits_broadcast(df: DataFrame, max_rows: int | None = None) -> bool:
    """True if ``df`` is small enough to broadcast. Counts ``df``: give it a
    stored table (a count of footers) or a frame that is cheap to compute."""
    return df.count() <= (BROADCAST_ROWS if max_rows is None else max_rows)


def sized(df: DataFrame) -> DataFrame:
    """``df`` with a broadcast hint if it fits. Else unchanged: Spark shuffles
    it, and AQE splits the partitions a hot key makes large."""
    return F.broadcast(df) if fits_broadcast(df) else df


def among(ratings: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """Rows of ``ratings`` whose ``on`` occurs in ``keys``.

    A few keys are named in the filter, so that the scan skips all files and
    row groups without them. Beyond, a semi join on a grouping key moves below
    the aggregate that keeps the latest rating, so the shuffle there carries
    only the rows that matter, and the range of the keys goes to the scan.
    Runs a job: ``keys`` is counted.
    """
    return _among(ratings, keys, on)[0]


def join_small(
    ratings: DataFrame, side: DataFrame, on: str, known: tuple | None = None
) -> DataFrame:
    """Inner join with a side that usually fits a broadcast: then ``ratings``
    are narrowed by ``among`` first and joined where they lie.

    Beyond the bound that narrowing would cost a shuffle itself; both sides
    are shuffled once, and AQE splits the partition of a hot key. ``known``
    are the side's rows and its least and greatest key, if the caller has them.
    """
    narrowed, fits = _among(ratings, side, on, known)
    if not fits:
        return ratings.join(side, on)
    return narrowed.join(F.broadcast(side), on)


def _among(ratings: DataFrame, keys: DataFrame, on: str, known: tuple | None = None) -> tuple[DataFrame, bool]:
    rows, low, high = known or keys.agg(F.count("*"), F.min(on), F.max(on)).first()
    fits = rows <= BROADCAST_ROWS
    if rows <= NAMED_KEYS:
        named = [r[0] for r in keys.select(on).distinct().collect()]
        return ratings.where(F.col(on).isin(named)), fits
    side = F.broadcast(keys.select(on)) if fits else keys.select(on)
    in_range = ratings.where(F.col(on).between(F.lit(low), F.lit(high)))
    return in_range.join(side, on, "left_semi"), fits
