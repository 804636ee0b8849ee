"""Sampling plans against literal frames."""

from datetime import datetime

import pytest

import coratings as co

# Fixed value: recordings are named by their start.
START = "2025-04-25_12-26-31"


BEGIN = datetime(2025, 4, 25, 12, 26, 31)
LITERAL = {
    (30.0, 5): [
        (0, "2025-04-25T12:26:31", "2025-04-25_12-26-31.jpg"),
        (150, "2025-04-25T12:26:36", "2025-04-25_12-26-36.jpg"),
        (1800, "2025-04-25T12:27:31", "2025-04-25_12-27-31.jpg"),
    ],
    (29.97, 1): [
        (29, "2025-04-25T12:26:31.967634", "2025-04-25_12-26-31.jpg"),
        (58, "2025-04-25T12:26:32.935269", "2025-04-25_12-26-32.jpg"),
    ],
}


def videos(spark, *rows):
    return spark.createDataFrame(list(rows), "path STRING, fps DOUBLE, total_frames BIGINT")


@pytest.mark.parametrize(
    "fps, interval, total, step, kept, files",
    [
        (30.0, 5, 1801, 150, 13, 13),
        (29.97, 5, 1800, 149, 13, 13),
        (29.97, 1, 3000, 29, 104, 100),
        (23.976, 2, 2000, 47, 43, 43),
        (30.0, 10, 1, 300, 1, 1),
    ],
)
@pytest.mark.parametrize("chunk", [None, 7])
def test_plan(spark, fps, interval, total, step, kept, files, chunk):
    catalog = videos(spark, (f"/media/{START}.mkv", fps, total))
    plan = co.sampling_plan(catalog, interval, chunk)
    rows = plan.orderBy("frame_idx").collect()
    got = [(r.frame_idx, r.frame_time, r.frame_name) for r in rows]
    assert [idx for idx, _, _ in got] == list(range(0, total, step)) and len(rows) == kept
    assert all(abs((time - BEGIN).total_seconds() - idx / fps) < 1e-6 for idx, time, _ in got)
    assert {r.step for r in rows} == {step}
    for idx, time, name in LITERAL.get((fps, interval), []):
        assert (idx, datetime.fromisoformat(time), name) in got
    whole = co.resolve_name_collisions(plan, whole_plan=True).collect()
    assert sorted(map(tuple, whole)) == sorted(map(tuple, co.resolve_name_collisions(plan).collect()))
    assert co.frames_per_video(plan, whole_plan=True).collect() == co.frames_per_video(plan).collect()
    counts = co.frames_per_video(plan).collect()[0]
    assert (counts.n_saved, counts.n_files) == (kept, files)
    last = {}
    for idx, _, name in got:
        last[name] = idx
    remaining = co.resolve_name_collisions(plan).collect()
    assert {r.frame_name: r.frame_idx for r in remaining} == last
    assert sum(r.n_frames for r in remaining) == kept


@pytest.mark.parametrize(
    "name, ok",
    [
        ("2025-04-25_12-26-31.mkv", True),
        ("2025-4-5_1-2-3.mkv", True),
        ("2025-04-25_12-26-31.part.mkv", True),
        ("2024-02-29_00-00-00", True),
        ("2025-02-29_00-00-00.mkv", False),
        ("2025-13-01_00-00-00.mkv", False),
        ("2025-04-25_12-26-60.mkv", False),
        ("2025-04-25_24-00-00.mkv", False),
        ("0000-04-25_12-26-31.mkv", False),
        ("2025-04-25.mkv", False),
        ("2025-04-25 12:26:31.mkv", False),
        ("25-04-25_12-26-31.mkv", False),
        ("holiday.mkv", False),
        (".mkv", False),
    ],
)
def test_names(spark, name, ok):
    catalog = videos(spark, (f"/a.b/{name}", 30.0, 1))
    plan = co.sampling_plan(catalog, 5)
    rejected = co.rejected_videos(catalog, 5)
    assert plan.count() == (1 if ok else 0)
    assert [r.reason for r in rejected.collect()] == ([] if ok else ["name is not a time"])
    if ok:
        parsed = datetime.strptime(name.split(".")[0], "%Y-%m-%d_%H-%M-%S")
        assert plan.collect()[0].start_time == parsed


def test_rejected_steps(spark):
    path = f"/v/{START}.mkv"
    catalog = videos(
        spark,
        (path, 0.5, 10),
        (path, None, 10),
        (path, float("nan"), 10),
        (path, -30.0, 10),
        (path, 30.0, 10),
    )
    rejected = co.rejected_videos(catalog, 1)
    assert sorted(r.reason for r in rejected.collect()) == [
        "fps is not a number", "fps is not a number", "interval is below one frame", "interval is below one frame",
    ]
    assert co.sampling_plan(catalog, 1).count() == 1
    with pytest.raises(ValueError):
        co.sampling_plan(catalog, 0)


def test_plan_rejects_and_empty_recordings_are_the_catalog(spark):
    path = f"/v/{START}.mkv"
    catalog = videos(spark, (path, 30.0, 0), ("/v/2025-04-26_00-00-00.mkv", 30.0, None), (f"/w/{START}.mkv", 30.0, 9), ("/v/x.mkv", None, None), ("/x/" + START, -1.0, -5))
    rejected = {r.path: r.reason for r in co.rejected_videos(catalog, 5).collect()}
    assert rejected == {
        "/v/2025-04-26_00-00-00.mkv": "frame count is missing",
        "/v/x.mkv": "name is not a time",
        "/x/" + START: "interval is below one frame",
    }
    planned = {r.path for r in co.sampling_plan(catalog, 5).collect()}
    assert planned == {f"/w/{START}.mkv"}
    empty = catalog.where("total_frames = 0").count()
    assert len(planned) + len(rejected) + empty == catalog.count()


@pytest.mark.parametrize("name", ["second", "step", "start_time", "FRAME_IDX", "frame_time", "frame_name"])
def test_columns_are_never_overwritten(spark, name):
    catalog = videos(spark, (f"/v/{START}.mkv", 30.0, 9)).selectExpr("*", f"1 AS {name}", "7 AS _n", "8 AS _kept")
    with pytest.raises(ValueError, match="overwritten"):
        co.sampling_plan(catalog, 5)
    rows = co.sampling_plan(catalog.drop(name), 5).collect()
    assert [(r._n, r._kept) for r in rows] == [(7, 8)]


def test_session_time_zone_has_no_say(spark):
    # 02:30 does not exist on this day in New York.
    name = "2025-03-09_02-30-00"
    catalog = videos(spark, (f"/v/{name}.mkv", 30.0, 301))
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        rows = co.sampling_plan(catalog, 5).orderBy("frame_idx").collect()
        got = [(r.frame_idx, r.frame_time, r.frame_name) for r in rows]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert got == [
        (0, datetime(2025, 3, 9, 2, 30), "2025-03-09_02-30-00.jpg"),
        (150, datetime(2025, 3, 9, 2, 30, 5), "2025-03-09_02-30-05.jpg"),
        (300, datetime(2025, 3, 9, 2, 30, 10), "2025-03-09_02-30-10.jpg"),
    ]


def test_sample_every(spark):
    rows = [(k, t, i) for i, (k, t) in enumerate((k, t) for k in "ab" for t in range(10))]
    df = co.stored(spark.createDataFrame(rows, "k STRING, t INT, id BIGINT"))
    for hot_rows in (None, 3):
        got = co.sample_every(df, "k", ["t", "id"], 4, hot_rows).orderBy("k", "t").collect()
        assert [(r.k, r.t, r.frame_idx) for r in got] == [
            (k, t, t) for k in "ab" for t in (0, 4, 8)
        ]
    with pytest.raises(ValueError):
        co.sample_every(df, "k", ["t"], 0)
