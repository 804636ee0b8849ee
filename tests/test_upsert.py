"""Merging a delta into a stored table of ratings."""

import random
import re

import pytest

from coratings.sinks import upsert as module
from coratings.sinks.upsert import bucket_of, read_version, upsert, vacuum, versions

SCHEMA = "user_id BIGINT, movie_id BIGINT, rating DOUBLE, position BIGINT"


def delta(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def rows_of(df):
    return sorted(tuple(r) for r in df.select("user_id", "movie_id", "rating", "position").collect())


def files_by_bucket(df):
    out = {}
    for f in df.inputFiles():
        out.setdefault(int(re.search(r"bucket=(\d+)", f)[1]), set()).add(f)
    return out


def latest(rows):
    best = {}
    for user, movie, rating, position in rows:
        best[user, movie] = max(best.get((user, movie), (position, rating)), (position, rating))
    return sorted((u, m, r, p) for (u, m), (p, r) in best.items())


def test_many_deltas(spark, tmp_path):
    pick, path, all_rows = random.Random(1), str(tmp_path / "t"), []
    for version in range(4):
        rows = [(pick.randrange(60), pick.randrange(20), pick.randrange(1, 11) / 2, pick.randrange(500)) for _ in range(300)]
        all_rows += rows
        assert upsert(delta(spark, rows), path, n_buckets=8) == version
        assert rows_of(read_version(spark, path)) == latest(all_rows)
    assert versions(spark, path) == [0, 1, 2, 3]
    assert rows_of(read_version(spark, path, 0)) == latest(all_rows[:300])


def test_untouched_buckets_keep_their_files(spark, tmp_path):
    path = str(tmp_path / "t")
    upsert(delta(spark, [(u, 1, 1.0, 1) for u in range(200)]), path, n_buckets=16)
    before = files_by_bucket(read_version(spark, path))
    assert len(before) == 16
    changed = spark.createDataFrame([(7,)], "user_id BIGINT").select(bucket_of(16)).first()[0]
    upsert(delta(spark, [(7, 1, 5.0, 2), (7, 2, 4.0, 2)]), path)
    after = files_by_bucket(read_version(spark, path))
    assert {b for b in after if after[b] != before[b]} == {changed}
    # An older rating that comes late changes nothing.
    upsert(delta(spark, [(7, 1, 3.0, 1)]), path)
    assert (7, 1, 5.0, 2) in rows_of(read_version(spark, path))
    # What only old versions read goes, and the table stays.
    want = rows_of(read_version(spark, path))
    assert vacuum(spark, path) == 2 and versions(spark, path) == [2]
    assert rows_of(read_version(spark, path)) == want


def test_empty_delta_and_no_table(spark, tmp_path):
    path = str(tmp_path / "t")
    with pytest.raises(ValueError, match="no table"):
        read_version(spark, path)
    upsert(delta(spark, []), path, n_buckets=2)
    assert rows_of(read_version(spark, path)) == []
    upsert(delta(spark, [(1, 1, 1.0, 1)]), path)
    upsert(delta(spark, []), path)
    assert rows_of(read_version(spark, path)) == [(1, 1, 1.0, 1)] and versions(spark, path) == [0, 1, 2]


def test_the_second_of_two_merges_onto_one_version_fails(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    upsert(delta(spark, [(1, 1, 1.0, 1)]), path, n_buckets=2)
    monkeypatch.setattr(module, "versions", lambda *a: [0])
    upsert(delta(spark, [(1, 1, 2.0, 2)]), path)
    with pytest.raises(RuntimeError, match="merge again"):
        upsert(delta(spark, [(1, 1, 3.0, 3)]), path)
    monkeypatch.undo()
    assert rows_of(read_version(spark, path)) == [(1, 1, 2.0, 2)] and versions(spark, path) == [0, 1]


def test_one_user_with_most_ratings(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = [(1, m, 1.0, 1) for m in range(3000)] + [(u, 1, 1.0, 1) for u in range(2, 500)]
    upsert(delta(spark, rows), path, n_buckets=4)
    upsert(delta(spark, [(1, m, 2.0, 2) for m in range(0, 3000, 2)]), path)
    found = rows_of(read_version(spark, path))
    assert len(found) == 3498 and sum(r[2] == 2.0 for r in found) == 1500
