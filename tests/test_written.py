"""Counts that writes return, catalogs held against files, and many files in one load."""

import pytest
from pyspark.sql import functions as F

import coratings as co
from coratings.sinks import reports
from coratings.sources import tables
from coratings.sources.recordings import list_recordings, match_catalog
from coratings.sources.tables import accepted, load_order, read_ratings


def test_writers_count_as_they_write(spark, tmp_path):
    ratings = spark.createDataFrame([(u, m, 1.0) for u in range(7) for m in range(3)], "user_id BIGINT, movie_id BIGINT, rating DOUBLE")
    store = spark.sparkContext.statusTracker()
    group = "written"
    spark.sparkContext.setJobGroup(group, "one write")
    try:
        before = len(store.getJobIdsForGroup(group))
        assert reports.write_table(ratings, str(tmp_path / "r")) == 21
        assert len(store.getJobIdsForGroup(group)) - before == 1  # no second pass
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert reports.write_users(ratings, str(tmp_path / "u")) == 7 == spark.read.text(str(tmp_path / "u")).count()
    assert reports.write_users(ratings.where("user_id > 99"), str(tmp_path / "n")) == 0
    assert reports.write_table(ratings.limit(0), str(tmp_path / "e")) == 0
    pair = spark.createDataFrame([(1, 2)], "user_a BIGINT, user_b BIGINT")
    assert reports.write_common_movies(co.common_movies(ratings, pair), str(tmp_path / "c")) == 3


def test_catalog_against_files(spark, tmp_path):
    for name in ("2025-01-01_00-00-00.mkv", "sub/2025-01-02_00-00-00.mkv", "sub/b/2025-01-02_00-00-00.mp4", "note.txt"):
        file = tmp_path / name
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_bytes(b"x" * len(name))
    rows = [("/v/2025-01-01_00-00-00.mkv", 30.0, 10), ("/v/2025-01-02_00-00-00.mkv", 25.0, 5), ("/v/2025-01-03_00-00-00.mkv", 24.0, 7), ("", None, None)]
    catalog = spark.createDataFrame(rows, "path STRING, fps DOUBLE, total_frames BIGINT")
    found = match_catalog(catalog, list_recordings(spark, str(tmp_path)))
    got = sorted((r.name, r.status, r.length or 0, r.fps or 0) for r in found.collect())
    assert got == [
        ("", "no_file", 0, 0), ("2025-01-01_00-00-00", "matched", 23, 30.0), ("2025-01-02_00-00-00", "matched", 27, 25.0),
        ("2025-01-02_00-00-00", "matched", 29, 25.0), ("2025-01-03_00-00-00", "no_file", 0, 24.0), ("note", "not_in_catalog", 8, 0),
    ]
    assert match_catalog(catalog, list_recordings(spark, str(tmp_path), "*.avi")).where("status = 'no_file'").count() == 4


def test_places_of_very_many_files(spark):
    """Ranks beyond 18 bits, large files and long blocks keep their order."""
    places = [(r, b, n) for r in (0, 1, (1 << 18) - 1, 1 << 18, (1 << 31) - 1) for b in (0, 1 << 27, (1 << 44) - 1) for n in (0, 1, (1 << 33) - 1)]
    df = spark.createDataFrame(places, "r BIGINT, b BIGINT, n BIGINT").repartition(3)
    order = df.select("r", "b", "n", load_order(F.col("r"), F.col("b"), F.col("n")).alias("at")).orderBy("at").collect()
    assert [(x.r, x.b, x.n) for x in order] == sorted(places) and len({x["at"] for x in order}) == len(places)


def test_names_of_many_files_are_not_broadcast(spark, tmp_path, monkeypatch):
    for k in range(5):
        (tmp_path / f"part{k}.csv").write_text(f"userId,movieId,rating,timestamp\n1,{k % 2},{k}.5,x\n")

    def latest():
        lines = accepted(read_ratings(spark, str(tmp_path)), "user_id")
        return sorted(map(tuple, co.latest_ratings(lines, "load_order", total_order=True).collect()))

    want = latest()
    monkeypatch.setattr(tables, "BROADCAST_FILES", 2)
    assert latest() == want == [(1, 0, 4.5), (1, 1, 3.5)]


@pytest.mark.parametrize("most", [0, 8])
def test_compaction_is_for_many_files(spark, monkeypatch, most):
    from coratings.plans import staging

    monkeypatch.setattr(staging, "COMPACT_FILES", most)
    wide = co.stored(spark.range(100).repartition(6))
    assert len(co.stored(wide.where("id < 50"), compact=True).inputFiles()) <= (1 if most == 0 else 6)
