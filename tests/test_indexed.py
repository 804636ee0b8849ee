"""The bucketed table of ratings: what is read, and what isn't shuffled."""

import re

import pytest

import coratings as co
from coratings.plans import staging
from oracle import plan_of

USERS = [(u,) for u in (3, 977, 1500, 2991)]


@pytest.fixture(scope="module")
def ratings(spark):
    rows = spark.range(300_000).selectExpr("id % 3000 AS user_id", "2 * (xxhash64(id) % 100000) AS movie_id", "CAST(1 + id % 9 AS DOUBLE) / 2 AS rating", "id AS at")
    return co.stored(co.latest_ratings(rows, "at", total_order=True))


@pytest.fixture(scope="module")
def indexed(spark, ratings, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("indexed") / "ratings")
    return co.write_indexed(ratings, "indexed_ratings", path, n_buckets=8, row_group=64 << 10, distinct=20_000), path


def scanned(df):
    """Rows that the scans of a plan without joins handed on, after row groups were passed over."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    nodes, rows = [plan], 0
    while nodes:
        node = nodes.pop()
        if "FileSourceScan" in node.getClass().getSimpleName():
            rows += node.metrics().apply("numOutputRows").value()
        if "AdaptiveSparkPlan" in node.getClass().getSimpleName():
            nodes.append(node.executedPlan())
        children = node.children()
        nodes += [children.apply(i) for i in range(children.size())]
    return rows


def test_scattered_users_and_movies_read_little(spark, ratings, indexed):
    table, _ = indexed
    users = spark.createDataFrame(USERS, "user_id BIGINT")
    got = co.user_ratings(table, users)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, co.user_ratings(ratings, users).collect()))
    by_user = table.where("user_id IN (3, 977, 1500, 2991)")
    assert scanned(by_user) < 0.4 * scanned(ratings.where("user_id IN (3, 977, 1500, 2991)"))
    # Odd movies lie within the range of every row group and in none; only the filters can tell.
    assert scanned(table.where("movie_id IN (77777, -40001)")) == 0 < scanned(ratings.where("movie_id IN (77777, -40001)"))


def test_joins_by_user_leave_the_table_where_it_is(spark, indexed, ratings, monkeypatch):
    table, _ = indexed
    monkeypatch.setattr(staging, "BROADCAST_ROWS", -1)
    monkeypatch.setattr(staging, "NAMED_KEYS", -1)
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}
    for key, value in conf.items():
        spark.conf.set(key, value)
    try:
        neighbors = co.stored(spark.createDataFrame([(1, n, n) for (n,) in USERS], "target_id BIGINT, neighbor_id BIGINT, neighbor_rank BIGINT"))
        found = co.recommend(table, neighbors, 0.0)
        rows = staging.join_small(table, neighbors.selectExpr("target_id", "neighbor_id AS user_id"), "user_id")
        plan = plan_of(rows)
        # One exchange, of the neighbours; between the join and the table there is none.
        assert len(re.findall(r"Exchange hashpartitioning\(user_id", plan)) == 1 and "SortMergeJoin" in plan
        above = plan[: plan.index("indexed_ratings")].rsplit("SortMergeJoin", 1)[1]
        assert "Exchange" not in above or above.index("Exchange") > above.index("Scan")
        assert found.count() == co.recommend(ratings, neighbors, 0.0).count() > 0
    finally:
        for key in conf:
            spark.conf.unset(key)


def test_opened_in_another_session(spark, indexed):
    table, path = indexed
    again = co.open_indexed(spark, "opened_ratings", path, 8)
    assert again.count() == table.count() and co.open_indexed(spark, "opened_ratings", path, 8).schema == table.schema
    assert 0 < scanned(again.where("user_id = 3")) < 0.2 * again.count()
