"""Where plans of this package are cut, and when a side is broadcast."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from coratings.plans.staging import scratch_root

# Rows of a broadcast side are a few fixed-width columns here, at most 100 bytes.
BROADCAST_ROWS = 1_000_000
# Rows with a host or a path among their columns are wider.
BROADCAST_TEXT_ROWS = 100_000


def folder(spark: SparkSession) -> str:
    """A new folder for files all executors can see."""
    return f"{scratch_root(spark)}/{uuid.uuid4().hex}"


def cut(df: DataFrame, codec: str | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder, in the session's codec if None, and go on from the written table."""
    path = folder(df.sparkSession)
    (df.write.option("compression", codec) if codec else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sized(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """A written, narrow ``df``, broadcast if it has at most ``most`` rows; else it is shuffled."""
    return F.broadcast(df) if df.count() <= most else df


def text_columns(docs: DataFrame) -> DataFrame:
    """doc_id and text alone, whatever other columns ``docs`` has; null text is empty."""
    return docs.select("doc_id", F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"))


def text_key(text: str = "text"):
    """Two longs that stand for a text: 128 bits, null and empty alike."""
    value = F.coalesce(F.col(text), F.lit(""))
    return F.xxhash64(value).alias("key_a"), F.xxhash64(F.lit(1), value).alias("key_b")


def keep_by(docs: DataFrame, keep: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose (doc_id, text) is not marked false in ``keep``.

    ``keep`` has doc_id, key_a, key_b (see text_key) and keep. The columns of
    ``docs`` stay as they are; rows that are not in ``keep`` stay.
    """
    gone = cut(
        keep.where(~F.col("keep"))
        .select(*[F.col(c).alias(f"__gone_{c}") for c in ("doc_id", "key_a", "key_b")])
        .distinct()
    )
    key_a, key_b = text_key()
    match = (
        docs["doc_id"].eqNullSafe(F.col("__gone_doc_id"))
        & (key_a == F.col("__gone_key_a"))
        & (key_b == F.col("__gone_key_b"))
    )
    return docs.join(sized(gone), match, "left_anti")
