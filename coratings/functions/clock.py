"""Recording time: start from the file name, time and name of one frame."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed value: recordings are named YYYY-MM-DD_HH-MM-SS, padded or not, and
# there is no year 0.
RECORDING_NAME = r"^(?!0000)(\d{4}-\d{1,2}-\d{1,2})_(\d{1,2})-(\d{1,2})-(\d{1,2})$"
# Fixed value: kept frames are images of this type.
FRAME_SUFFIX = ".jpg"


def base_name(path: Column) -> Column:
    """File name up to its first dot."""
    return F.substring_index(F.substring_index(path, "/", -1), ".", 1)


def start_time(path: Column) -> Column:
    """Start of a recording as wall-clock time, null where the name is no time.

    Read as a time without zone, so the session time zone has no say in it.
    """
    name = base_name(path)
    spelled = F.regexp_replace(name, RECORDING_NAME, "$1 $2:$3:$4")
    return F.when(name.rlike(RECORDING_NAME), spelled.try_cast("timestamp_ntz"))


def step_frames(fps: Column, interval_sec: float) -> Column:
    """Frames between two kept ones, truncated; null where fps is no number."""
    return (fps * F.lit(float(interval_sec))).try_cast("bigint")


def offset_micros(frame_idx: Column, fps: Column) -> Column:
    """Microseconds from the start to a frame, halves to the even one."""
    return F.rint(frame_idx / fps * 1e6).cast("bigint")


def later(start: Column, micros: Column) -> Column:
    """``start`` moved on by microseconds."""
    return start + micros * F.expr("INTERVAL '0.000001' SECOND")


def stamp(time: Column) -> Column:
    """``YYYY-MM-DD_HH-MM-SS`` of a time without zone."""
    spelled = F.substring(time.cast("string"), 1, 19)
    dashed = F.replace(spelled, F.lit(":"), F.lit("-"))
    return F.replace(dashed, F.lit(" "), F.lit("_"))


def frame_name(time: Column) -> Column:
    """Name of a kept frame, to the second."""
    return F.concat(stamp(time), F.lit(FRAME_SUFFIX))
