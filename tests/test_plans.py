"""What the plans of the registered queries look like."""

import re

from oracle import plan_of

import __spark_entry__ as entry_point
import coratings as co
from coratings.plans.staging import scratch_root
from coratings.sinks.reports import write_ratings
from workload import views as v

QUERIES = entry_point.queries()


def test_targets_movies_prune_before_the_first_shuffle(spark, sf_small, monkeypatch):
    def check(plan, prune):
        partial = plan.index("partial_max_by")
        exchange = plan.index("Exchange hashpartitioning(user_id")
        assert exchange < partial < plan.rindex(prune)
        assert "SortMergeJoin" not in plan and "SortAggregate" not in plan

    check(plan_of(QUERIES["knn_euclidean"](spark, sf_small)), "INSET")
    monkeypatch.setattr("coratings.plans.staging.NAMED_KEYS", 0)
    check(plan_of(QUERIES["knn_euclidean"](spark, sf_small)), "LeftSemi")


def test_few_users_are_named_to_the_scan(spark, sf_small, tmp_path, monkeypatch):
    path = str(tmp_path / "ratings")
    write_ratings(v.dense(spark, sf_small).repartition(16), path)
    ratings = spark.read.parquet(path)
    target = spark.createDataFrame([(3,)], "user_id BIGINT")
    found = co.user_ratings(ratings, target)
    assert "EqualTo(user_id,3)" in plan_of(found)
    assert found.count() == v.dense(spark, sf_small).where("user_id = 3").count() > 0
    assert co.user_ratings(ratings, target.limit(0)).count() == 0
    # Two users at the ends of the ids read the row groups of two users.
    ends = co.user_ratings(ratings, spark.createDataFrame([(1,), (10,)], "user_id BIGINT"))
    assert "In(user_id, [1,10])" in plan_of(ends)
    # Below the aggregate as well.
    assert "EqualTo(l_suppkey,3)" in plan_of(co.user_ratings(v.dense(spark, sf_small), target))
    # Many users: their range.
    monkeypatch.setattr("coratings.plans.staging.NAMED_KEYS", 0)
    many = plan_of(co.user_ratings(ratings, target))
    assert "GreaterThanOrEqual(user_id,3), LessThanOrEqual(user_id,3)" in many


def test_stored_ratings_are_shuffled_once(spark, sf_small):
    assert plan_of(v.dense(spark, sf_small)).count("Exchange") == 1
    ratings = co.stored(v.dense(spark, sf_small))
    assert ratings.count() == v.dense(spark, sf_small).count()


def test_a_lookup_scans_the_ratings_once(spark, sf_small, monkeypatch):
    from coratings.operators import ratings as module
    from coratings.plans import staging

    plans = []

    def remember(df, compact=False):
        plans.append(plan_of(df))
        return staging.stored(df, compact)

    monkeypatch.setattr(module, "stored", remember)
    plans.append(plan_of(QUERIES["lookup_rating"](spark, sf_small)))
    assert sum(plan.count("lineitem.parquet") for plan in plans) == 1


def test_ranking_is_cut_before_its_shuffle(spark, sf_small):
    plan = plan_of(QUERIES["knn_batch"](spark, sf_small))
    assert re.search(r"WindowGroupLimit .* 5, Partial", plan)
    targets = spark.createDataFrame([(1,)], "user_id BIGINT")
    for k in (1, 999, 1000):
        assert "WindowGroupLimit" in plan_of(co.knn(v.dense(spark, sf_small), targets, "cosine", k, 1))


def test_whole_plans_are_not_shuffled_by_second(spark, sf_small):
    plan = plan_of(QUERIES["frame_collisions"](spark, sf_small))
    assert "hashpartitioning" not in plan and "Aggregate" not in plan
    plan = plan_of(QUERIES["frames_per_video"](spark, sf_small))
    assert plan.count("hashpartitioning") == 1


def test_one_join_serves_all_metrics(spark, sf_small, monkeypatch):
    from coratings.operators import distances

    calls = []
    plain = distances.overlaps
    monkeypatch.setattr(distances, "overlaps", lambda *a, **k: calls.append(1) or plain(*a, **k))
    QUERIES["neighbors_table"](spark, sf_small)
    assert calls == [1]


def test_only_needed_columns_and_sums(spark, sf_small):
    plan = plan_of(QUERIES["dist_manhattan"](spark, sf_small))
    schema = re.search(r"lineitem.parquet\].*?ReadSchema: struct<([^>]*)>", plan).group(1)
    assert "l_comment" not in schema and "l_extendedprice" not in schema
    assert plan.count("partial_sum") == 1


def test_min_rating_reaches_the_scan_of_stored_ratings(spark, sf_small):
    ratings = co.stored(v.dense(spark, sf_small))
    plan = plan_of(ratings.where("rating >= 4.0D"))
    assert "GreaterThanOrEqual(rating,4.0)" in plan


def test_scratch_is_below_the_shared_folder(spark):
    shared = spark.conf.get("spark.checkpoint.dir", None)
    root = scratch_root(spark)
    assert shared is None or root.startswith(shared.rstrip("/"))
    assert spark.conf.get("spark.app.id") in root
