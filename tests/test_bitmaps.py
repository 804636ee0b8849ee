"""Overlaps counted on bitmaps."""

import random
import re

import coratings as co
from oracle import plan_of


def test_counts(spark):
    pick = random.Random(1)
    rated = {u: set(pick.sample(range(-70_000, 200_000), 40)) | {5, 32_768, 32_769, -1} for u in range(1, 7)}
    rated[8] = {77}
    rows = [(u, m, 1.0) for u, movies in rated.items() for m in movies]
    ratings = spark.createDataFrame(rows, "user_id BIGINT, movie_id BIGINT, rating DOUBLE").repartition(3)
    pairs = [(1, 2), (2, 1), (1, 2), (3, 3), (4, 8), (5, 99), (98, 99), (6, 5)]
    found = co.common_counts(co.stored(co.movie_bitmaps(ratings)), spark.createDataFrame(pairs, "user_a BIGINT, user_b BIGINT"))
    want = sorted((a, b, len(rated.get(a, set()) & rated.get(b, set()))) for a, b in set(pairs))
    assert sorted((r.user_a, r.user_b, r.n_common) for r in found.collect()) == want
    assert all(r.intersects == (r.n_common > 0) for r in found.collect())
    plan = plan_of(found)
    assert "movie_id" not in plan and "Generate" in plan  # bitmaps only, no row per movie


def test_no_pairs(spark):
    ratings = spark.createDataFrame([(1, 1, 1.0)], "user_id BIGINT, movie_id BIGINT, rating DOUBLE")
    none = spark.createDataFrame([], "user_a BIGINT, user_b BIGINT")
    assert co.common_counts(co.movie_bitmaps(ratings), none).collect() == []


def test_one_bitmap_per_user_and_bucket_is_shuffled(spark):
    """However the ratings lie, no bitmap is made before they meet."""
    ratings = spark.range(2000).selectExpr("id % 5 AS user_id", "id AS movie_id", "1.0D AS rating").repartition(16)
    plan = plan_of(co.movie_bitmaps(ratings))
    after = plan[: plan.index("Exchange hashpartitioning(user_id")]
    assert after.count("bitmap_construct_agg") >= plan.count("bitmap_construct_agg") > 0


def test_tasks_grow_with_the_bitmaps(spark, monkeypatch):
    """Partitions are counted in bitmaps: their compressed size would merge them all."""
    from coratings.operators import bitmaps

    monkeypatch.setattr(bitmaps, "TASK_BITMAPS", 50)
    ratings = spark.range(4000).selectExpr("id % 400 AS user_id", "id * 37 AS movie_id", "1.0D AS rating")
    pairs = spark.range(400).selectExpr("id AS user_a", "explode(array(id, id + 1)) AS user_b")
    found = co.common_counts(co.stored(co.movie_bitmaps(ratings)), pairs)
    assert {(r.user_a, r.user_b): r.n_common for r in found.collect()} == {(u, u + d): 10 * (not d) for u in range(400) for d in (0, 1)}
    plan = plan_of(found)
    tasks = [int(n) for n in re.findall(r"hashpartitioning\(user_[^)]*?, (\d+)\), REPARTITION_BY_NUM", plan)]
    assert len(tasks) >= 3 and min(tasks) >= 400 // 50


def test_one_bitmap_of_a_pair_is_moved_and_none_is_written_again(spark, monkeypatch):
    from coratings.operators import bitmaps
    from coratings.plans import staging

    written = []

    def kept(df, compact=False):
        written.append(staging.stored(df, compact))
        return written[-1]

    ratings = spark.range(3000).selectExpr("id % 300 AS user_id", "id * 37 AS movie_id", "1.0D AS rating")
    pairs = spark.range(300).selectExpr("id AS user_a", "explode(array(id, pmod(id + 150, 300), null)) AS user_b")
    made = co.stored(co.movie_bitmaps(ratings))
    monkeypatch.setattr(bitmaps, "stored", kept)
    found = co.common_counts(made, pairs)
    counts = {(r.user_a, r.user_b): (r.n_common, r.intersects) for r in found.collect()}
    assert counts == {(u, v): (10 * (u == v), u == v) for u in range(300) for v in (u, (u + 150) % 300, None)}
    assert written and all("movies" not in df.columns for df in written)
    plan = plan_of(found)
    assert "ReusedExchange" in plan
