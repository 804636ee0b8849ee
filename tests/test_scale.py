"""What holds the plans up on large and skewed data."""

import pytest

import coratings as co
from coratings.plans import staging
from oracle import plan_of


def ids(spark, *users):
    return spark.createDataFrame([(u,) for u in users], "user_id BIGINT")


@pytest.fixture(scope="module")
def hot_movie(spark):
    """A third of all ratings is for movie 0."""
    rated = spark.range(60_000).selectExpr(
        "id % 20000 AS user_id",
        "CASE WHEN id < 20000 THEN 0 ELSE 1 + xxhash64(id) % 5000 END AS movie_id",
        "CAST(1 + id % 9 AS DOUBLE) / 2 AS rating",
        "id AS at",
    )
    latest = co.latest_ratings(rated, "at").repartition(16, "user_id")
    return staging.stored(latest, compact=False)


def test_hot_movie_is_split_when_both_sides_are_shuffled(spark, hot_movie, monkeypatch):
    targets = ids(spark, 1, 2, 3)
    want = sorted(map(tuple, co.distances(hot_movie, targets, "euclidean", 1).collect()))

    monkeypatch.setattr(staging, "BROADCAST_ROWS", -1)
    conf = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "32KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "32KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.files.openCostInBytes": "128MB",
        "spark.sql.shuffle.partitions": "16",
    }
    for key, value in conf.items():
        spark.conf.set(key, value)
    try:
        found = co.distances(hot_movie, targets, "euclidean", 1)
        got = sorted(map(tuple, found.collect()))
        assert "skew=true" in plan_of(found)
    finally:
        for key in conf:
            spark.conf.unset(key)
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got == want and len(got) > 50_000


def test_bound_decides_about_the_broadcast(spark, hot_movie, monkeypatch):
    small = ids(spark, *range(5))
    assert "ResolvedHint" in logical(staging.sized(small))
    monkeypatch.setattr(staging, "BROADCAST_ROWS", 4)
    assert "ResolvedHint" not in logical(staging.sized(small))
    monkeypatch.setattr(staging, "BROADCAST_ROWS", 5)
    assert "ResolvedHint" in logical(staging.sized(small))


def logical(df):
    return df._jdf.queryExecution().analyzed().toString()


def test_stored_tables_are_compact(spark, hot_movie):
    one = co.stored(hot_movie.repartition(40).where("user_id = 7"), compact=True)
    assert len(one.inputFiles()) == 1
    assert one.schema == hot_movie.schema


def test_session_without_shared_folder_is_refused():
    class Context:
        folder = None

        def getCheckpointDir(self):
            return self.folder

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(key, default=None):
                return {"spark.app.id": "app"}.get(key, default)

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        staging.scratch_root(Session)
    Context.folder = "file:/shared"
    assert staging.scratch_root(Session) == "file:/shared/coratings/app"


def test_release_removes_the_tables_a_frame_reads(spark):
    kept, gone = co.stored(spark.range(5)), co.stored(spark.range(7))
    joined = gone.join(spark.range(3), "id")
    assert co.release(joined) == 1
    assert kept.count() == 5
    with pytest.raises(Exception, match="(?i)not.exist|FILE_NOT_EXIST"):
        spark.read.schema("id long").parquet(*gone.inputFiles()).count()


def test_hot_targets_below_min_common_are_left_out(spark, hot_movie):
    targets = ids(spark, *range(20))
    want = sorted(map(tuple, co.distances(hot_movie, targets, "cosine", 1).where("n_common >= 3").collect()))
    assert sorted(map(tuple, co.distances(hot_movie, targets, "cosine", 3).collect())) == want
