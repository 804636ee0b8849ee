"""Fixed-interval sampling of recordings: which frames to keep, and their names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from coratings.functions.clock import (
    frame_name,
    later,
    offset_micros,
    start_time,
    step_frames,
)
from coratings.operators.numbering import free_names, number_rows

# Most kept frames one row turns into at once.
CHUNK_FRAMES = 100_000


# What sampling_plan adds.
PLANNED = ("start_time", "step", "frame_idx", "frame_time", "second", "frame_name")


def _timed(videos: DataFrame, interval_sec: float, added: Sequence[str]) -> DataFrame:
    if not interval_sec > 0:
        raise ValueError("interval_sec must be positive")
    clash = {c.lower() for c in videos.columns} & set(added)
    if clash:
        raise ValueError(f"columns {sorted(clash)} would be overwritten; rename them first")
    return videos.withColumns(
        {
            "start_time": start_time(F.col("path")),
            "step": step_frames(F.col("fps"), interval_sec),
        }
    )


def _whole_second() -> Column:
    return later(F.col("start_time"), F.col("second") * 1_000_000)


def sampling_plan(
    videos: DataFrame, interval_sec: float = 10, chunk_frames: int | None = None
) -> DataFrame:
    """One row per frame to keep: ordinal 0, step, 2 * step, ..., its time, the
    whole second since the start and the name made of it. ``videos`` has
    ``path``, ``fps`` and ``total_frames``; further columns are carried along,
    and one named like a column of PLANNED is an error. Recordings in
    ``rejected_videos`` are left out; one of 0 frames has none to keep.

    The catalog is small beside the frames, so it is spread evenly over the
    tasks, long recordings in chunks, before a row turns into many.
    """
    chunk = F.lit(CHUNK_FRAMES if chunk_frames is None else chunk_frames).cast("bigint")
    zero = F.lit(0).cast("bigint")
    tasks = int(videos.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # A null sequence explodes to no row. A filter would have the start time
    # worked out twice, once for itself.
    usable = F.expr("start_time IS NOT NULL AND step >= 1 AND total_frames > 0")
    kept, first, nth = free_names(videos, "_kept", "_first", "_n")
    firsts = F.when(usable, F.sequence(zero, F.col(kept) - 1, chunk))
    chunks = (
        _timed(videos, interval_sec, PLANNED)
        .withColumn(kept, F.expr("(total_frames + step - 1) div greatest(step, 1)"))
        .withColumn(first, F.explode(firsts))
        .repartition(tasks)
    )
    last = F.least(F.col(first) + chunk, F.col(kept)) - 1
    micros = offset_micros(F.col("frame_idx"), F.col("fps"))
    return (
        chunks.withColumn(nth, F.explode(F.sequence(F.col(first), last)))
        .withColumn("frame_idx", F.col(nth) * F.col("step"))
        .withColumn("frame_time", later(F.col("start_time"), micros))
        .withColumn("second", F.floor(micros / 1_000_000))
        .withColumn("frame_name", frame_name(_whole_second()))
        .drop(kept, first, nth)
    )


def rejected_videos(videos: DataFrame, interval_sec: float = 10) -> DataFrame:
    """Recordings that cannot be sampled, with the reason. These, the
    recordings in the plan and those of 0 frames are the whole catalog."""
    reason = (
        F.when(F.col("start_time").isNull(), "name is not a time")
        .when(F.col("fps").isNull() | F.isnan("fps"), "fps is not a number")
        .when(F.coalesce(F.col("step"), F.lit(0)) < 1, "interval is below one frame")
        .when(F.coalesce(F.col("total_frames"), F.lit(-1)) < 0, "frame count is missing")
    )
    return (
        _timed(videos, interval_sec, ("start_time", "step", "reason"))
        .withColumn("reason", reason)
        .where("reason IS NOT NULL")
        .drop("start_time", "step")
    )


def _second_of(nth: Column) -> Column:
    """Whole second since the start of the ``nth`` kept frame."""
    return F.floor(offset_micros(nth * F.col("step"), F.col("fps")) / 1_000_000)


def _first_of_second() -> Column:
    """The first kept frame of the row's second, by its ordinal among the kept."""
    # The time of a frame is rounded to the microsecond, so the quotient may be
    # off by one to either side.
    guess = F.ceil(F.col("second") * F.col("fps") / F.col("step"))
    same = lambda n: (n >= 0) & (_second_of(n) == F.col("second"))
    return F.when(same(guess - 1), guess - 1).when(same(guess), guess).otherwise(guess + 1)


def resolve_name_collisions(
    plan: DataFrame, by: Sequence[str] = ("path",), whole_plan: bool = False
) -> DataFrame:
    """Files that remain: of the frames of one recording that share a name the
    last one wins; ``n_frames`` tells how many were written to it.

    Recordings start on a whole second, so frames share a name if they share
    the second since the start; names are made only for what remains.

    ``whole_plan`` says that ``plan`` is all that ``sampling_plan`` returned,
    one catalog row per ``by``. Then a frame remains if the next kept one is of
    another second or does not exist, and nothing is shuffled.
    """
    if whole_plan:
        nth = F.col("frame_idx").cast("bigint") / F.col("step")
        nth = nth.cast("bigint")
        last = (F.col("frame_idx") + F.col("step") >= F.col("total_frames")) | (_second_of(nth + 1) != F.col("second"))
        return plan.where(last).select(
            *by, "frame_name", "frame_idx", (nth - _first_of_second() + 1).cast("bigint").alias("n_frames")
        )
    return (
        plan.groupBy(*by, "start_time", "second")
        .agg(F.max("frame_idx").alias("frame_idx"), F.count("*").alias("n_frames"))
        .select(*by, frame_name(_whole_second()).alias("frame_name"), "frame_idx", "n_frames")
    )


def frames_per_video(
    plan: DataFrame, by: Sequence[str] = ("path",), whole_plan: bool = False
) -> DataFrame:
    """Frames written and files that remain, per recording; ``whole_plan`` as
    in ``resolve_name_collisions``, which leaves one combined aggregate."""
    return (
        resolve_name_collisions(plan, by, whole_plan)
        .groupBy(*by)
        .agg(F.sum("n_frames").alias("n_saved"), F.count("*").alias("n_files"))
    )


def sample_every(
    df: DataFrame,
    key: str | Sequence[str],
    order: Sequence[str | Column],
    step: int,
    hot_rows: int | None = None,
) -> DataFrame:
    """Every ``step``-th row of each key in ``order``, from the first one on,
    with its ordinal ``frame_idx`` (from 0)."""
    if step < 1:
        raise ValueError("step must be at least 1")
    keys = [key] if isinstance(key, str) else list(key)
    numbered = number_rows(df, keys, order, "frame_idx", hot_rows)
    return numbered.withColumn("frame_idx", F.col("frame_idx") - 1).where(
        F.col("frame_idx") % step == 0
    )
