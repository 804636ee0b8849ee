"""CSV sources, text profiling and outputs."""

import pytest
from pyspark.sql import functions as F

import coratings as co
from oracle import plan_of
from coratings.sinks import reports
from coratings.sources.recordings import list_recordings, read_catalog
from coratings.sources.tables import accepted, read_movies, read_names, read_ratings, rejected


@pytest.fixture
def write(tmp_path):
    def run(name, text):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text, encoding="utf-8")
        return str(path)

    return run


RATINGS = """userId,movieId,rating,timestamp
1,10,4.0,964982703
1,20,5.0,964981247
1,20
x,10,3.0,1
1,10,2.5,5
2,10,bad,7
2,30,3.0,8
"""


def test_ratings(spark, write):
    lines = read_ratings(spark, write("ratings.csv", RATINGS))
    good = accepted(lines, "user_id", "movie_id", "rating")
    bad = rejected(lines, "user_id", "movie_id", "rating")
    assert good.count() == 4 and bad.count() == 3
    assert sorted(r._corrupt_record for r in bad.collect()) == ["1,20", "2,10,bad,7", "x,10,3.0,1"]
    assert good.select("user_id").count() == 4
    assert good.select("user_id").distinct().count() == 2
    latest = co.latest_ratings(good, "load_order", total_order=True)
    assert "SortAggregate" not in plan_of(latest)
    assert sorted(map(tuple, latest.collect())) == [(1, 10, 2.5), (1, 20, 5.0), (2, 30, 3.0)]


def test_file_order_decides_across_blocks(spark, write):
    rows = "".join(f"{i % 7},{i % 5},{i % 10 / 2},{i}\n" for i in range(3000))
    path = write("ratings.csv", "userId,movieId,rating,timestamp\n" + rows)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        lines = read_ratings(spark, path)
        assert lines.rdd.getNumPartitions() > 4
        latest = co.latest_ratings(accepted(lines), "load_order", total_order=True).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    last = {(i % 7, i % 5): i % 10 / 2 for i in range(3000)}
    assert {(r.user_id, r.movie_id): r.rating for r in latest} == last


def test_files_by_name(spark, write, tmp_path):
    for name, rating in (("b.csv", 2.0), ("a.csv", 1.0), ("c d.csv", 3.0)):
        write(f"many/{name}", f"userId,movieId,rating,timestamp\n1,1,{rating},0\n")
    lines = accepted(read_ratings(spark, str(tmp_path / "many")))
    assert [r.rating for r in lines.orderBy("load_order").collect()] == [1.0, 2.0, 3.0]
    assert co.latest_ratings(lines, "load_order", total_order=True).collect()[0].rating == 3.0


def test_timestamp_as_order(spark, write):
    lines = read_ratings(spark, write("ratings.csv", RATINGS))
    latest = co.latest_ratings(accepted(lines), [F.expr("try_cast(ts AS BIGINT)")])
    assert latest.where("user_id = 1 AND movie_id = 10").collect()[0].rating == 4.0


def test_total_order_takes_one_column(spark, write):
    lines = read_ratings(spark, write("ratings.csv", RATINGS))
    with pytest.raises(ValueError):
        co.latest_ratings(lines, ["ts", "load_order"], total_order=True)


def test_movies(spark, write):
    path = write(
        "movies.csv",
        "movieId,title,genres\n"
        "1,Toy Story (1995),Adventure|Animation\n"
        '2,"American President, The (1995)",Drama\n'
        '3,"Say ""Hi"" (2000)",(no genres listed)\n'
        "1,Toy Story again,Comedy\n",
    )
    movies = co.latest_movies(accepted(read_movies(spark, path)), "load_order")
    assert sorted(map(tuple, movies.collect())) == [
        (1, "Toy Story again", ["Comedy"]),
        (2, "American President, The (1995)", ["Drama"]),
        (3, 'Say "Hi" (2000)', ["(no genres listed)"]),
    ]


def test_names(spark, write):
    path = write(
        "names.csv",
        "Name,Role\nAna,Student\nbea,Student\nCARL,student\n,Student\n#REF!,#REF!\nÑandú,ñ\n",
    )
    names = accepted(read_names(spark, path), "Role")
    assert names.count() == 6
    assert co.count_uppercase(names, "Name").collect()[0].n_uppercase == 3
    assert co.count_uppercase(names, "Role").collect()[0].n_uppercase == 4
    by_role = co.count_uppercase(names, "Name", by="Role").collect()
    assert {r.Role: r.n_uppercase for r in by_role} == {
        "Student": 1,
        "student": 1,
        "#REF!": 1,
        "ñ": 0,
    }
    greetings = {r.Name: r.greeting for r in co.greet(names, "Name").collect()}
    assert greetings["Ana"] == "Hola, Ana! Bienvenido de" and greetings[None] is None


def test_missing_file_fails(spark, tmp_path):
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        read_ratings(spark, str(tmp_path / "none.csv"))


def test_recordings(spark, write, tmp_path):
    write("media/2025-04-25_12-26-31.mkv", "x")
    write("media/day/2025-04-26_00-00-00.mkv", "xyz")
    write("media/readme.txt", "")
    files = list_recordings(spark, str(tmp_path / "media"), "*.mkv")
    assert sorted(r.length for r in files.collect()) == [1, 3]
    catalog = write("catalog.csv", "path,fps,total_frames\n/v/2025-04-25_12-26-31.mkv,30,1801\n")
    assert co.sampling_plan(read_catalog(spark, catalog), 5).count() == 13


def lines_of(spark, path):
    return [r.value for r in spark.read.text(path).collect()]


def test_text_reports(spark, tmp_path):
    ratings = spark.createDataFrame(
        [(u, m, float(r)) for u, m, r in [(2, 10, 4), (1, 10, 3), (1, 20, 1), (2, 20, 2)]],
        "user_id BIGINT, movie_id BIGINT, rating DOUBLE",
    )
    movies = spark.createDataFrame([(20, "B"), (10, "A")], "movie_id BIGINT, title STRING")
    target = spark.createDataFrame([(1,)], "user_id BIGINT")
    out = str(tmp_path / "out")

    reports.write_users(ratings, out)
    assert lines_of(spark, out) == ["1", "2"]
    reports.write_movies(movies, out)
    assert lines_of(spark, out) == ["10 A", "20 B"]
    reports.write_distances(co.distances(ratings, target, "euclidean", 1), out)
    assert lines_of(spark, out) == ["2 1.4142135624 1"]
    pair = spark.createDataFrame([(1, 2)], "user_a BIGINT, user_b BIGINT")
    reports.write_common_movies(co.common_movies(ratings, pair), out)
    assert lines_of(spark, out) == ["10", "20"]


def test_neighborhood_tables(spark, tmp_path):
    ratings = spark.createDataFrame(
        [(u, m, float((u * m) % 5)) for u in range(1, 7) for m in range(1, 9)],
        "user_id BIGINT, movie_id BIGINT, rating DOUBLE",
    )
    targets = spark.createDataFrame([(1,), (2,)], "user_id BIGINT")
    out = str(tmp_path / "out")
    for metric in ("euclidean", "cosine"):
        result = co.neighborhood(ratings, targets, metric, 3, 1, 3.0)
        co.write_neighborhood(result, out, metric)
    neighbors = spark.read.parquet(f"{out}/neighbors")
    assert {r.metric: r["count"] for r in neighbors.groupBy("metric").count().collect()} == {
        "euclidean": 6,
        "cosine": 6,
    }
    recs = spark.read.parquet(f"{out}/recommendations")
    counts = spark.read.parquet(f"{out}/recommendation_counts")
    assert counts.agg(F.sum("n_rows")).first()[0] == recs.count() > 0

    # Without candidates the old output of this metric is replaced as well.
    nobody = co.neighborhood(ratings, targets, "cosine", 3, 100, 3.0)
    co.write_neighborhood(nobody, out, "cosine")
    again = spark.read.parquet(f"{out}/neighbors")
    assert [r.metric for r in again.select("metric").distinct().collect()] == ["euclidean"]

    # Several metrics at once give the same tables.
    several = str(tmp_path / "several")
    result = co.neighborhood(ratings, targets, ["euclidean", "cosine"], 3, 1, 3.0)
    co.write_neighborhood(result, several, ["euclidean", "cosine"], release_after=True)
    for name in ("recommendations", "recommendation_counts", "rating_counts"):
        one, two = (spark.read.parquet(f"{x}/{name}").where("metric = 'euclidean'") for x in (out, several))
        assert sorted(map(tuple, one.select(*sorted(one.columns)).collect())) == sorted(map(tuple, two.select(*sorted(two.columns)).collect()))
    nobody = co.neighborhood(ratings, targets, ["euclidean"], 3, 100, 3.0)
    co.write_neighborhood(nobody, several, ["euclidean"])
    again = spark.read.parquet(f"{several}/neighbors")
    assert [r.metric for r in again.select("metric").distinct().collect()] == ["cosine"]
