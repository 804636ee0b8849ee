"""Name columns and sampling of recordings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

import coratings as co
from coratings.functions.clock import base_name, start_time
from coratings.functions.text import has_uppercase
from workload import views as v

_BY = ["video_id", "path"]
_KEPT = ["video_id", "frame_idx", "frame_time", "frame_name"]


def _named_recordings(s: SparkSession, d: str) -> DataFrame:
    """Recordings of ``videos`` and, as files with a name that is no time, parts."""
    parts = v.table(s, d, "part").select(
        F.col("p_partkey").alias("video_id"),
        F.concat(F.lit("/p/"), "p_name", F.lit(".mkv")).alias("path"),
        F.lit(30.0).alias("fps"),
        F.lit(1800).cast("bigint").alias("total_frames"),
    )
    return v.videos(s, d).unionByName(parts)


def _sample(step: int, hot_rows: int | None = None):
    def run(s: SparkSession, d: str) -> DataFrame:
        events = v.table(s, d, "events").select("user_id", "ts", "event_id")
        return co.sample_every(events, "user_id", ["ts", "event_id"], step, hot_rows)

    return run


QUERIES = {
    "uppercase_count": lambda s, d: co.count_uppercase(v.names(s, d), "name", by="grp"),
    "uppercase_total": lambda s, d: co.count_uppercase(v.names(s, d), "name"),
    "uppercase_flags": lambda s, d: v.table(s, d, "documents").select(
        "doc_id", has_uppercase(F.col("text")).alias("has_uppercase")
    ),
    "greeting": lambda s, d: co.greet(
        v.table(s, d, "customer").select("c_custkey", "c_name"), "c_name"
    ),
    "recording_start": lambda s, d: _named_recordings(s, d).select(
        *_BY,
        base_name(F.col("path")).alias("base_name"),
        start_time(F.col("path")).alias("start_time"),
    ),
    "sampling_plan": lambda s, d: co.sampling_plan(v.videos(s, d), 5).select(*_KEPT),
    "sampling_plan_chunked": lambda s, d: co.sampling_plan(v.videos(s, d), 5, chunk_frames=4).select(*_KEPT),
    "sampling_rejects": lambda s, d: co.rejected_videos(_named_recordings(s, d), 0.04).select(
        *_BY, "reason"
    ),
    "frames_per_video": lambda s, d: co.frames_per_video(
        co.sampling_plan(v.videos(s, d), 1), ["video_id"], whole_plan=True
    ),
    "frame_collisions": lambda s, d: co.resolve_name_collisions(
        co.sampling_plan(v.videos(s, d), 1), ["video_id"], whole_plan=True
    ),
    "frame_collisions_grouped": lambda s, d: co.resolve_name_collisions(
        co.sampling_plan(v.videos(s, d), 1).where("frame_idx % 3 = 0"), ["video_id"]
    ),
    "sample_every_nth": _sample(29),
    "sample_every_nth_split": _sample(7, hot_rows=70),
}

# The form of frame names here, the greeting and the reasons below.
_PLAN = """WITH videos AS ({videos}),
  steps AS (SELECT *, trunc(fps * {interval})::BIGINT AS step FROM videos),
  idx AS (SELECT *, unnest(range(0, total_frames, step)) AS frame_idx FROM steps),
  timed AS (SELECT *, start_time + to_microseconds(round(frame_idx / fps * 1000000)::BIGINT) AS frame_time
            FROM idx),
  plan AS (SELECT *, strftime(frame_time, '%Y-%m-%d_%H-%M-%S') || '.jpg' AS frame_name FROM timed)"""
_PLAN_5 = _PLAN.format(videos=v.VIDEOS, interval=5) + f" SELECT {', '.join(_KEPT)} FROM plan"
_PLAN_1 = _PLAN.format(videos=v.VIDEOS, interval=1)
_NAMED = f"""
  SELECT video_id, path, fps, start_time FROM ({v.VIDEOS})
  UNION ALL SELECT p_partkey, '/p/' || p_name || '.mkv', 30.0::DOUBLE, NULL FROM part"""
_EVERY = """SELECT user_id, ts, event_id, frame_idx FROM (
  SELECT user_id, ts, event_id,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame_idx
  FROM events) WHERE frame_idx % {0} = 0"""

ORACLES = {
    "uppercase_count": f"""SELECT grp, count(*) FILTER (regexp_matches(name, '[A-Z]')) AS n_uppercase
  FROM ({v.NAMES}) GROUP BY 1""",
    "uppercase_total": f"""SELECT count(*) FILTER (regexp_matches(name, '[A-Z]')) AS n_uppercase
  FROM ({v.NAMES})""",
    "uppercase_flags": """SELECT doc_id, coalesce(regexp_matches(text, '[A-Z]'), false) AS has_uppercase
  FROM documents""",
    "greeting": """SELECT c_custkey, c_name, 'Hola, ' || c_name || '! Bienvenido de' AS greeting
  FROM customer""",
    "recording_start": f"""SELECT video_id, path,
         string_split(string_split(path, '/')[-1], '.')[1] AS base_name, start_time FROM ({_NAMED})""",
    "sampling_plan": _PLAN_5,
    "sampling_plan_chunked": _PLAN_5,
    "sampling_rejects": f"""SELECT video_id, path,
         CASE WHEN start_time IS NULL THEN 'name is not a time'
              ELSE 'interval is below one frame' END AS reason
  FROM ({_NAMED}) WHERE start_time IS NULL OR trunc(fps * 0.04::DOUBLE) < 1""",
    "frames_per_video": f"""{_PLAN_1} SELECT video_id, count(*) AS n_saved,
         count(DISTINCT frame_name) AS n_files FROM plan GROUP BY 1""",
    "frame_collisions": f"""{_PLAN_1} SELECT video_id, frame_name, max(frame_idx) AS frame_idx,
         count(*) AS n_frames FROM plan GROUP BY 1, 2""",
    "frame_collisions_grouped": f"""{_PLAN_1} SELECT video_id, frame_name, max(frame_idx) AS frame_idx,
         count(*) AS n_frames FROM plan WHERE frame_idx % 3 = 0 GROUP BY 1, 2""",
    "sample_every_nth": _EVERY.format(29),
    "sample_every_nth_split": _EVERY.format(7),
}
